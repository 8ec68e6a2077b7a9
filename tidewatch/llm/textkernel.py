"""Vectorised text work on Arrow string columns: words, word hashes and word n-grams, without a Python loop per word.

A word is a maximal run of letters, digits, combining marks (of any script) and underscores in the lower-cased
text; quotes, dashes and other signs of any script part words. Nulls count as empty texts. Work goes in slices of a few MB, so memory follows the longest text, not the batch.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_rng = np.random.default_rng(20240917)
BYTE_CODE = _rng.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
BASE = np.uint64(0x9E3779B97F4A7C15)
GRAM_BASE = np.uint64(0xD6E8FEB86659FD93)
IS_WORD = np.zeros(256, bool)  # bytes below 128; characters of more bytes are looked up in LETTERS
IS_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), 95]] = True
LETTERS = np.array([unicodedata.category(chr(c))[0] in "LNM" for c in range(0x33480)] + [False])  # code points; no later plane has letters


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64 bits: xor-shifts around two odd multipliers."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def as_strings(col: pa.Array | pa.ChunkedArray) -> pa.Array:
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    return pc.fill_null(col, "") if col.null_count else col


def buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts and the offsets of each (one more than texts)."""
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, off, data = col.buffers()
    off = np.frombuffer(off, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64) if len(col) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, off - off[0]


def slices(off: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Runs of texts of at most `most` bytes together; a longer text stands alone."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def word_bytes(data: np.ndarray) -> np.ndarray:
    """Which bytes of a run of UTF-8 belong to words."""
    out = IS_WORD[data]
    lead = np.flatnonzero(data >= 0xC2)
    if len(lead):
        end = len(data) - 1
        b, size = data[lead].astype(np.int64), 2 + (data[lead] >= 0xE0) + (data[lead] >= 0xF0)
        tail = [data[np.minimum(lead + k, end)] & np.int64(63) for k in (1, 2, 3)]
        code = np.choose(size - 2, [(b & 31) << 6 | tail[0], (b & 15) << 12 | tail[0] << 6 | tail[1], (b & 7) << 18 | tail[0] << 12 | tail[1] << 6 | tail[2]])
        good = LETTERS[np.minimum(code, len(LETTERS) - 1)]
        lead, size = lead[good], size[good]
        for k in range(4):
            out[np.minimum(lead[size > k] + k, end)] = True
    return out


def word_spans(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and length of every word, and for each text the index of its first word (one more than texts)."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    isw = word_bytes(data)
    first = isw.copy()
    first[1:] &= ~isw[:-1]
    cut = off[:-1][off[:-1] < n]
    first[cut] = isw[cut]
    last = isw.copy()
    last[:-1] &= ~isw[1:]
    cut = off[1:][off[1:] > 0] - 1
    last[cut] = isw[cut]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last)
    return starts, ends - starts + 1, np.searchsorted(starts, off)


def word_hashes(data: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """64-bit hash of each word: a polynomial over random byte codes, then mixed."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    at = np.concatenate(([0], np.cumsum(lens)[:-1]))
    inside = np.arange(int(lens.sum())) - np.repeat(at, lens)
    letters = data[inside + np.repeat(starts, lens)]
    return mix(np.add.reduceat(BYTE_CODE[letters] * powers(BASE, int(lens.max()))[inside], at))


def word_endings(data: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """31 bits for each word's last four bytes: words that are built alike fall together."""
    code = np.zeros(len(starts), np.uint64)
    for k in (1, 2, 3, 4):
        code = code * np.uint64(256) + np.where(lens >= k, data[np.maximum(starts + lens - k, 0)], 0).astype(np.uint64)
    return (mix(code) >> np.uint64(33)).astype(np.int64)


def gram_hashes(words: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n-word runs, text after text, and each text's offset among them.

    A text of 1 to n-1 words has one gram of all its words; a text without words has none.
    """
    count = np.diff(first)
    if not len(words):
        return np.zeros(0, np.uint64), np.zeros(len(first), np.int64)
    p = powers(GRAM_BASE, n)
    padded = np.concatenate((words, np.zeros(n - 1, np.uint64)))
    gram = np.zeros(len(words), np.uint64)
    for j in range(n):
        gram += padded[j : j + len(words)] * p[n - 1 - j]
    text = np.repeat(np.arange(len(count)), count)
    left = first[1:][text] - np.arange(len(words))
    keep = left >= n
    for t in np.flatnonzero((count > 0) & (count < n)):
        own, at = words[first[t] : first[t + 1]], first[t]
        keep[at] = True
        gram[at] = np.add.reduce(own * p[: len(own)]) + np.uint64(len(own))
    per = np.bincount(text[keep], minlength=len(count))
    return mix(gram[keep]), np.concatenate(([0], np.cumsum(per)))


def lowered(col: pa.Array, most: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first text, last text + 1, lower-cased bytes, offsets) over slices of an Arrow string column; only a slice is copied at a time."""
    raw = as_strings(col)
    for i, j in slices(buffers(raw)[1], most):
        yield i, j, *buffers(pc.utf8_lower(raw.slice(i, j - i)))


def iter_grams(col: pa.Array, n: int, most: int = 2_000_000) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first text, last text + 1, gram hashes, offsets) over slices of an Arrow string column."""
    for i, j, words, first in iter_words(col, most):
        yield i, j, *gram_hashes(words, first, n)


def iter_words(col: pa.Array, most: int = 2_000_000) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first text, last text + 1, word hashes, offsets) over slices of an Arrow string column."""
    for i, j, data, off in lowered(col, most):
        starts, lens, first = word_spans(data, off)
        yield i, j, word_hashes(data, starts, lens), first


def iter_endings(col: pa.Array, most: int = 2_000_000) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first text, last text + 1, word hashes, their endings, offsets) over slices of an Arrow string column."""
    for i, j, data, off in lowered(col, most):
        starts, lens, first = word_spans(data, off)
        yield i, j, word_hashes(data, starts, lens), word_endings(data, starts, lens), first

"""Benchmark decontamination by pigeonhole edit matching.

A test item of m words may differ from a passage by k = rate x m word edits. Cut into k + 1 pieces, at least one piece then stands
unchanged in the passage; exact piece hits, found by rolling word hashes, name the places. A place goes on only if it holds m - k
of the item's words, as a passage within k edits must; then Myers' bit-parallel edit distance over words decides.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches
from .textkernel import GRAM_BASE, iter_words, mix, powers

# What is held at once, whatever a text repeats: piece hits, hits below which items are not looked up first, words of windows.
RANGE_HITS, FEW_HITS, WINDOW_WORDS = 1_000_000, 20_000, 1_000_000


@dataclass(frozen=True)
class EditConfig:
    rate: float = 0.2  # word edits allowed, as a share of the item's words
    least_words: int = 1  # shorter items are left out; items of fewer than 1 / rate words must stand exactly
    block_words: int = 8_000_000  # words of test items that one pass over the documents holds, at some 25 bytes a word


def near_distance(pattern: list[int], text: list[int], most: int) -> tuple[int, int]:
    """Least word edits that turn the pattern into some run of the text, and the run's end; (most + 1, -1) if beyond `most`.

    Myers' recurrence: one bit for each pattern word, in an integer as wide as the pattern.
    """
    m = len(pattern)
    where: dict[int, int] = {}
    for k, w in enumerate(pattern):
        where[w] = where.get(w, 0) | 1 << k
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score = full, 0, m
    best, end = (m, 0) if m <= most else (most + 1, -1)
    for at, w in enumerate(text):
        eq = where.get(w, 0)
        diag = (((eq & plus) + plus) ^ plus) | eq | minus
        up = minus | ~(diag | plus)
        down = plus & diag
        if up & top:
            score += 1
        elif down & top:
            score -= 1
        up, down = up << 1, down << 1  # a run may start anywhere, so the first row stays 0
        plus = (down | ~(diag | up)) & full
        minus = up & diag & full
        if score < best:
            best, end = score, at + 1
    return best, end


class Pieces:
    """The pieces of a block of test items, by length and hash."""

    def __init__(self, items: list[tuple[int | None, np.ndarray]], cfg: EditConfig):
        self.items = [(i, w, int(cfg.rate * len(w))) for i, w in items if len(w) >= cfg.least_words]
        by_length: dict[int, list[tuple[int, int, int]]] = {}
        for at, (_, words, most) in enumerate(self.items):
            cut = np.linspace(0, len(words), most + 2).round().astype(int)
            for lo, hi in zip(cut[:-1], cut[1:], strict=True):
                by_length.setdefault(int(hi - lo), []).append((int(rolling(words[lo:hi], int(hi - lo))[0]), at, int(lo)))
        owner = np.repeat(np.arange(len(self.items), dtype=np.uint64), [len(w) for _, w, _ in self.items])
        pairs = owned(owner, np.concatenate([w for _, w, _ in self.items])) if self.items else np.zeros(0, np.uint64)
        self.pairs, self.times = np.unique(pairs, return_counts=True)
        own = [np.unique(w, return_counts=True) for _, w, _ in self.items]  # the different words of each item, one item after the other
        self.own_off = np.cumsum([0, *(len(w) for w, _ in own)])
        self.own_words, self.own_times = (np.concatenate([x[j] for x in own]) if own else np.zeros(0, np.int64) for j in (0, 1))
        self.least = np.array([len(w) - most for _, w, most in self.items], np.int64)
        self.longest = max((len(w) + most for _, w, most in self.items), default=0)
        self.by_length = {}
        for n, rows in by_length.items():
            rows.sort()
            h = np.array([r[0] for r in rows], np.uint64)
            seen = np.zeros(1 << 16, bool)
            seen[(h >> np.uint64(48)).astype(int)] = True
            self.by_length[n] = (h, np.array([r[1] for r in rows]), np.array([r[2] for r in rows]), seen)

    def hit_ranges(self, words: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """Runs of words (from, to) with the exact piece hits in them, as item and place at which the item would start: at most RANGE_HITS in a run, or those of one word."""
        found, total = [], np.zeros(len(words) + 1, np.int64)
        for n, (h, item, at, seen) in self.by_length.items():
            if len(words) < n:
                continue
            own = rolling(words, n)
            place = np.flatnonzero(seen[(own >> np.uint64(48)).astype(np.int64)])
            lo, hi = np.searchsorted(h, own[place], "left"), np.searchsorted(h, own[place], "right")
            count = hi - lo
            on = count > 0
            if on.any():
                found.append((place[on], lo[on], count[on], item, at))
                total[place[on] + 1] += count[on]
        total = np.cumsum(total)
        ends = np.searchsorted(total, np.arange(RANGE_HITS, total[-1] + RANGE_HITS, RANGE_HITS), "right")
        first = 0
        for end in np.unique(np.minimum(ends, len(words))).tolist():
            items, starts = [], []
            for place, lo, count, item, at in found:
                i, j = np.searchsorted(place, [first, end])
                if i < j:
                    p, c = place[i:j], count[i:j]
                    k = np.repeat(lo[i:j], c) + np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c)
                    items.append(item[k])
                    starts.append(np.repeat(p, c) - at[k])
            if items:
                yield first, end, np.concatenate(items), np.concatenate(starts)
            first = end

    def possible(self, words: np.ndarray, item: np.ndarray) -> np.ndarray:
        """Of the items (numbers, each once) those of whose words a run holds as many as a near passage must, each as often as the item has it at most."""
        known, count = np.unique(words, return_counts=True)
        size = self.own_off[item + 1] - self.own_off[item]
        which = np.repeat(np.arange(len(item)), size)
        k = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size) + np.repeat(self.own_off[item], size)
        place = np.minimum(np.searchsorted(known, self.own_words[k]), len(known) - 1)
        held = np.where(known[place] == self.own_words[k], np.minimum(count[place], self.own_times[k]), 0)
        return item[np.bincount(which, held, len(item)) >= self.least[item]]

    def enough(self, words: np.ndarray, windows: list[tuple[int, int, int]]) -> np.ndarray:
        """Which windows (item, from, to) hold as many words of the item, each as often as the item has it at most, as a near passage must."""
        item, lo, hi = (np.array(x, np.int64) for x in zip(*windows, strict=True))
        size = hi - lo
        window = np.repeat(np.arange(len(size)), size)
        at = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size) + np.repeat(lo, size)
        key = owned(item[window].astype(np.uint64), words[at])
        place = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        known = self.pairs[place] == key
        seen, count = np.unique(window[known] * len(self.pairs) + place[known], return_counts=True)
        held = np.bincount(seen // len(self.pairs), np.minimum(count, self.times[seen % len(self.pairs)]), minlength=len(size))
        return held >= self.least[item]


def owned(item: np.ndarray, words: np.ndarray) -> np.ndarray:
    """A key for each word of an item."""
    return mix(words ^ mix(item + np.uint64(1)))


def rolling(words: np.ndarray, n: int) -> np.ndarray:
    p = powers(GRAM_BASE, n)
    out = np.zeros(len(words) - n + 1, np.uint64)
    for j in range(n):
        out += words[j : j + len(out)] * p[n - 1 - j]
    return mix(out)


def matches(pieces: Pieces, words: np.ndarray, first: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """(text, item, edits, first word of the window, end word) for the best passage of each item in each text of a slice."""
    best: dict[tuple[int, int], tuple[int, int, int]] = {}
    for lo, hi, item, start in pieces.hit_ranges(words):
        if len(item) > FEW_HITS:  # a common piece: most of its items have no other word here
            near = words[max(0, lo - pieces.longest) : hi + pieces.longest]
            stay = np.isin(item, pieces.possible(near, np.unique(item)))
            item, start = item[stay], start[stay]
        if len(item):
            _verify(pieces, words, first, item, start, best)
    return [(t, i, e, a - int(first[t]), end - int(first[t])) for (t, i), (e, end, a) in sorted(best.items())]


def _verify(pieces: Pieces, words: np.ndarray, first: np.ndarray, item: np.ndarray, start: np.ndarray, best: dict[tuple[int, int], tuple[int, int, int]]) -> None:
    """Read the windows around the hits and keep the best passage of each (text, item).

    Near starts of one item share a window, up to four lengths of the item; a longer run of them is read in windows that overlap.
    """
    order = np.lexsort((start, item))
    held: tuple[int, int, int] | None = None  # item, first and last start of a run of near starts
    groups: list[tuple[int, int, int]] = []
    for i, s in zip(item[order].tolist(), start[order].tolist(), strict=True):
        if held and held[0] == i and s - held[2] <= pieces.items[i][2] and s - held[1] <= 4 * len(pieces.items[i][1]):
            held = (i, held[1], s)
        else:
            if held:
                groups.append(held)
            held = (i, s, s)
    groups.append(held)
    windows, texts, size = [], [], 0

    def read() -> None:
        for k in np.flatnonzero(pieces.enough(words, windows)):
            (i, a, b), t = windows[k], texts[k]
            _, pattern, most = pieces.items[i]
            known = best.get((t, i), (most + 1, 0, 0))
            if known[0] == 0 and known[1] <= b:  # no passage is better than an exact one, and no later one as early
                continue
            edits, end = near_distance(pattern.tolist(), words[a:b].tolist(), most)
            if edits <= most and (edits, a + end) < known[:2]:
                best[t, i] = (edits, a + end, a)

    for i, lo, hi in groups:
        _, pattern, most = pieces.items[i]
        lo, hi = max(0, lo - most), min(len(words), hi + len(pattern) + most)
        # a window may touch more than one text: each part is tried by itself
        for t in range(int(np.searchsorted(first, lo, "right")) - 1, int(np.searchsorted(first, hi, "left"))):
            a, b = max(lo, int(first[t])), min(hi, int(first[t + 1]))
            if b - a >= len(pattern) - most:
                windows.append((i, a, b))
                texts.append(t)
                size += b - a
        if size > WINDOW_WORDS:
            read()
            windows, texts, size = [], [], 0
    if windows:
        read()


def item_blocks(benchmark: DataFrame, cfg: EditConfig) -> Iterator[list[tuple[int | None, np.ndarray]]]:
    """Test items as word hashes, block after block, so that no more than block_words words are held or sent at once."""
    held: list[tuple[int | None, np.ndarray]] = []
    size = 0
    for row in benchmark.select("item_id", "text").filter("text is not null").orderBy("item_id", "text").toLocalIterator():
        for _, _, words, _ in iter_words(pa.array([row.text], pa.string())):
            held.append((row.item_id, words))
            size += len(words)
        if size >= cfg.block_words:
            yield held
            held, size = [], 0
    if held:
        yield held


def _scan(cfg: EditConfig, pieces):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("edits", pa.int32()), ("item_words", pa.int32()), ("end_word", pa.int64())])
        for batch in batches:
            rows = []
            for i, _, words, first in iter_words(batch.column(1)):
                for t, k, edits, _, end in matches(pieces.value, words, first):
                    item_id, pattern, _ = pieces.value.items[k]
                    rows.append((batch.column(0)[i + t].as_py(), item_id, edits, len(pattern), end))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return run


def find_leaks(docs: DataFrame, benchmark: DataFrame, cfg: EditConfig = EditConfig()) -> DataFrame:
    """One row for each row of docs and each test item found in it: doc_id, item_id, edits (least, of its best passage), item_words,
    end_word (where that passage ends).

    Words are lower-cased runs of letters, marks and digits of any script, so case, punctuation and line breaks don't matter. Null and empty texts
    hold nothing; null items, those without words and those shorter than least_words are left out; repeated rows and items give repeated rows. Empty tables give no rows.

    Scale: one pass over the texts (one for each block_words of a benchmark beyond that size), and no exchange; a passage that a third of
    all texts share costs each of them one verification, and a common piece without its passage a count of words. A text that repeats a piece of many items is
    read in runs of a million hits, so memory is bounded beside the words of the text.
    """
    small_batches(docs.sparkSession)
    out = None
    for block in item_blocks(benchmark, cfg):
        pieces = docs.sparkSession.sparkContext.broadcast(Pieces(block, cfg))  # about block_words words
        found = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_scan(cfg, pieces), "doc_id long, item_id long, edits int, item_words int, end_word long")
        out = found if out is None else out.unionAll(found)
    return docs.sparkSession.createDataFrame([], "doc_id long, item_id long, edits int, item_words int, end_word long") if out is None else out


def without_leaks(docs: DataFrame, benchmark: DataFrame, cfg: EditConfig = EditConfig()) -> DataFrame:
    """Rows of docs in which no test item is found (see find_leaks), whole and unchanged; texts stay where they are.

    Rows with null and empty texts stay; repeated rows stay or go together; null items, those without words and those shorter than least_words remove nothing.
    Empty tables remove nothing. Other columns, whatever their names, are kept.
    """
    small_batches(docs.sparkSession)
    at = docs.columns.index("text")
    for block in item_blocks(benchmark, cfg):
        pieces = docs.sparkSession.sparkContext.broadcast(Pieces(block, cfg))

        def run(batches: Iterator[pa.RecordBatch], pieces=pieces) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                clean = np.ones(batch.num_rows, bool)
                for i, _, words, first in iter_words(batch.column(at)):
                    clean[[i + m[0] for m in matches(pieces.value, words, first)]] = False
                yield batch.filter(pa.array(clean))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))

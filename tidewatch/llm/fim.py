"""Fill-in-the-middle forms of whole texts, cut by a parallel scan of a finite automaton.

The automaton reads bytes, counts units (code points or words) and looks for sentinels. A chunk of a text is read for all entry states at once and gives
a function from entry to leaving state and, for each entry state, the units that begin in it. Such functions compose in any grouping, so chunks are
read side by side (of one document too, over tasks), their entry states follow from the chunks before them, and the chunk that holds the k-th unit finds it.
"""

from __future__ import annotations

import hashlib
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, read

PAD = 256  # a symbol that changes no state and counts nothing
SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"


@dataclass(frozen=True)
class FimConfig:
    """units: `chars` or `words` (a word with the blanks after it). A sentinel in a text leaves it plain, as does a draw of 100 - fim_percent in 100; spm_percent of the others put the suffix first.

    chunk_bytes are read by one lane, piece_bytes of a text by one task's row.
    """

    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"
    fim_percent: int = 90
    spm_percent: int = 20
    units: str = "chars"
    salt: str = "1:"
    chunk_bytes: int = 512
    piece_bytes: int = 64 << 10

    @cached_property
    def sentinels(self) -> tuple[bytes, bytes, bytes]:
        return self.prefix.encode(), self.suffix.encode(), self.middle.encode()


@dataclass(frozen=True)
class Automaton:
    """step[state, byte] and begins[state, byte]: whether a unit begins at this byte. State 0 is the start; states from `found` on have seen a sentinel."""

    step: np.ndarray
    begins: np.ndarray
    found: frozenset[int] = field(default_factory=frozenset)

    @property
    def states(self) -> int:
        return len(self.step)


def sentinel_states(words: tuple[bytes, ...]) -> tuple[np.ndarray, int]:
    """Transitions of the automaton that looks for any of the words; its last state keeps that one was found."""
    prefixes = sorted({w[:k] for w in words for k in range(len(w))} | {b""}, key=lambda p: (len(p), p))
    at = {p: k for k, p in enumerate(prefixes)}
    found = len(prefixes)
    step = np.full((found + 1, 257), found, np.uint8)
    for p, k in at.items():
        for b in range(256):
            s = p + bytes([b])
            if not any(s.endswith(w) for w in words):
                step[k, b] = next(at[s[j:]] for j in range(len(s) + 1) if s[j:] in at)
            else:
                step[k, b] = found
        step[k, PAD] = k
    return step, found


def automaton(units: str, sentinels: tuple[bytes, ...]) -> Automaton:
    """The product of the unit counter and the sentinel finder, without states that can't be reached."""
    look, found = sentinel_states(sentinels)
    inside = np.zeros((2, 257), np.uint8)
    begins = np.zeros((2, 257), bool)
    for b in range(256):
        if units == "chars":
            begins[:, b] = b & 0xC0 != 0x80
        elif units == "words":
            inside[:, b] = b not in SPACES
            begins[0, b] = b not in SPACES
        else:
            raise ValueError(f"units are chars or words, not {units}")
    inside[1, PAD] = 1
    order, todo = {(0, 0): 0}, deque([(0, 0)])
    rows: list[tuple[list[int], np.ndarray]] = []
    while todo:
        a, s = todo.popleft()
        after = []
        for b in range(257):
            to = (int(inside[a, b]), int(look[s, b]))
            if to not in order:
                order[to] = len(order)
                todo.append(to)
            after.append(order[to])
        rows.append((after, begins[a]))
    if len(order) > 255:
        raise ValueError("the sentinels make too many states")
    return Automaton(np.array([r[0] for r in rows], np.uint8), np.array([r[1] for r in rows]), frozenset(k for (_, s), k in order.items() if s == found))


class Scan:
    """Texts, or pieces of texts, read in lanes of chunk_bytes for all entry states at once."""

    def __init__(self, auto: Automaton, texts: list[bytes], chunk_bytes: int):
        self.auto, self.sizes = auto, np.array([len(t) for t in texts], np.int64)
        self.n = np.maximum(1, -(-self.sizes // chunk_bytes))
        self.first = np.cumsum(self.n) - self.n
        flat = np.full(int(self.n.sum()) * chunk_bytes, PAD, np.uint16)
        for t, at in zip(texts, self.first * chunk_bytes, strict=True):
            flat[at : at + len(t)] = np.frombuffer(t, np.uint8)
        self.symbols = np.ascontiguousarray(flat.reshape(-1, chunk_bytes).T)
        # one table: where the next state's row starts, and in the top bit whether a unit begins
        self.table = (auto.step.astype(np.int32) * 257 + (auto.begins.astype(np.int32) << 20)).ravel()
        at = np.repeat(np.arange(auto.states, dtype=np.int32)[:, None] * 257, len(flat) // chunk_bytes, axis=1)
        self.counts = np.zeros(at.shape, np.int32)
        for row in self.symbols:
            v = self.table.take(at + row)
            self.counts += v >> 20
            at = v & 0xFFFFF
        self.leaves = at // 257

    def compose(self, entry: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Leaving state and units of each text for its entry state; keeps what each chunk is entered with and the units before it."""
        self.entered, self.before = np.zeros(len(self.leaves[0]), np.int32), np.zeros(len(self.leaves[0]), np.int64)
        state, total = entry.astype(np.int32).copy(), np.zeros(len(entry), np.int64)
        for c in range(int(self.n.max(initial=0))):
            on = np.flatnonzero(self.n > c)
            lane = self.first[on] + c
            self.entered[lane], self.before[lane] = state[on], total[on]
            total[on] += self.counts[state[on], lane]
            state[on] = self.leaves[state[on], lane]
        return state, total

    def places(self, text: np.ndarray, k: np.ndarray) -> np.ndarray:
        """After compose: the byte at which the k-th unit (from 0) of a text begins; the text's length if it has no such unit. One entry for each (text, k)."""
        lane = np.array([self.first[t] + np.searchsorted(self.before[self.first[t] : self.first[t] + self.n[t]], x, "right") - 1 for t, x in zip(text, k, strict=True)], np.int64)
        out, want, seen = self.sizes[text].copy(), k - self.before[lane] + 1, np.zeros(len(k), np.int64)
        at, chosen, start = self.entered[lane] * 257, self.symbols[:, lane], (lane - self.first[text]) * len(self.symbols)
        for t, row in enumerate(chosen):
            v = self.table.take(at + row)
            begins = v >> 20
            seen += begins
            hit = (begins == 1) & (seen == want)
            out[hit] = start[hit] + t
            at = v & 0xFFFFF
        return out


def draws(doc_id: int | None, config: FimConfig) -> tuple[int, int, int, int]:
    """Four numbers of 32 bits from the document's id alone (a null id counts as empty text), so that reruns and other engines agree."""
    digest = hashlib.sha256(f"{config.salt}{'' if doc_id is None else doc_id}".encode()).digest()
    return tuple(int.from_bytes(digest[4 * k : 4 * k + 4], "big") for k in range(4))


def decide(doc_id: int | None, n: int, sentinel: bool, config: FimConfig) -> tuple[str, int, int]:
    """Form and the units before the middle and before the suffix."""
    h1, h2, h3, h4 = draws(doc_id, config)
    if n == 0 or sentinel or h3 % 100 >= config.fim_percent:
        return "plain", 0, 0
    return "spm" if h4 % 100 < config.spm_percent else "psm", min(h1 % (n + 1), h2 % (n + 1)), max(h1 % (n + 1), h2 % (n + 1))


def assembled(text: bytes, form: str, a: int, b: int, config: FimConfig) -> bytes:
    p, s, m = config.sentinels
    if form == "plain":
        return text
    if form == "psm":
        return b"".join((p, text[:a], s, text[b:], m, text[a:b]))
    return b"".join((s, text[b:], p, text[:a], m, text[a:b]))


OUT = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_units", pa.int64()), ("middle_units", pa.int64()), ("output", pa.string())])
OUT_DDL = "doc_id long, n long, form string, prefix_units long, middle_units long, output string"


def _out(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True))
    return pa.RecordBatch.from_arrays([*(pa.array(c, f.type) for c, f in zip(cols[:5], OUT, strict=False)), pa.array(cols[5], pa.binary()).view(pa.string())], schema=OUT)


def _row(doc_id: int | None, n: int, form: str, a: int, b: int, output: bytes) -> tuple:
    return doc_id, n, form, None if form == "plain" else a, None if form == "plain" else b - a, output


def _raw(column: pa.Array, k: int) -> bytes:
    return column[k].as_buffer().to_pybytes() if column[k].is_valid else b""


def _whole(docs: DataFrame, config: FimConfig) -> DataFrame:
    """Texts of one piece each, where they stand."""
    auto = automaton(config.units, config.sentinels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, lo = batch.column(0).to_pylist(), 0
            while lo < len(ids):
                texts, lanes = [], 0
                while lo + len(texts) < len(ids) and lanes < 1 << 21:
                    texts.append(_raw(batch.column(1), lo + len(texts)))
                    lanes += max(len(texts[-1]), config.chunk_bytes)
                scan = Scan(auto, texts, config.chunk_bytes)
                state, total = scan.compose(np.zeros(len(texts), np.int32))
                plans = [decide(ids[lo + k], int(total[k]), int(state[k]) in auto.found, config) for k in range(len(texts))]
                cut = [k for k, p in enumerate(plans) if p[0] != "plain"]
                at = scan.places(np.repeat(np.array(cut, np.int64), 2), np.array([x for k in cut for x in plans[k][1:]], np.int64)).reshape(-1, 2)
                where = dict(zip(cut, at.tolist(), strict=True))
                yield _out([_row(ids[lo + k], int(total[k]), *plans[k], assembled(t, plans[k][0], *where.get(k, (0, 0)), config)) for k, t in enumerate(texts)])
                lo += len(texts)

    return docs.mapInArrow(run, OUT_DDL)


def _pieces(docs: DataFrame, config: FimConfig) -> DataFrame:
    schema = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("piece", pa.int32()), ("bytes", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            for k, doc_id in enumerate(batch.column(0).to_pylist()):
                raw = _raw(batch.column(1), k)
                for lo in range(0, max(1, len(raw)), 64 * config.piece_bytes):
                    parts = [raw[x : x + config.piece_bytes] for x in range(lo, min(len(raw), lo + 64 * config.piece_bytes), config.piece_bytes)] or [b""]
                    first = lo // config.piece_bytes
                    yield pa.RecordBatch.from_arrays([pa.array([row] * len(parts), pa.int64()), pa.array([doc_id] * len(parts), pa.int64()), pa.array(range(first, first + len(parts)), pa.int32()), pa.array(parts, pa.binary())], schema=schema)
                row += 1

    return docs.mapInArrow(run, "row long, doc_id long, piece int, bytes binary")


def _summaries(pieces: DataFrame, config: FimConfig) -> DataFrame:
    """(row, doc_id, piece, leaves, units): the function of each piece and its units, an entry for each entry state."""
    auto = automaton(config.units, config.sentinels)
    schema = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("piece", pa.int32()), ("leaves", pa.list_(pa.int32())), ("units", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 32):
                part = batch.slice(lo, 32)
                scan = Scan(auto, [_raw(part.column(3), k) for k in range(part.num_rows)], config.chunk_bytes)
                by_state = [scan.compose(np.full(part.num_rows, s, np.int32)) for s in range(auto.states)]
                leaves, units = (np.stack([x[j] for x in by_state], 1).tolist() for j in (0, 1))
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(leaves, pa.list_(pa.int32())), pa.array(units, pa.list_(pa.int64()))], schema=schema)

    return pieces.mapInArrow(run, "row long, doc_id long, piece int, leaves array<int>, units array<long>")


def _plans(summaries: DataFrame, config: FimConfig) -> DataFrame:
    """(row, doc_id, n, form, a, b, cuts): what is decided for each document, and for each of its two cuts the piece, its entry state and the unit within it.

    A text is one cell, so its pieces are 2 GB / piece_bytes at most and their functions fit a row.
    """
    auto = automaton(config.units, config.sentinels)
    kind = pa.list_(pa.struct([("piece", pa.int32()), ("state", pa.int32()), ("k", pa.int64())]))
    schema = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("a", pa.int64()), ("b", pa.int64()), ("cuts", kind)])
    one = summaries.groupBy("row", "doc_id").agg(F.array_sort(F.collect_list(F.struct("piece", "leaves", "units"))).alias("parts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                state, total, entered, before = 0, 0, [], []
                for p in r["parts"]:
                    entered.append(state)
                    before.append(total)
                    total += p["units"][state]
                    state = p["leaves"][state]
                form, a, b = decide(r["doc_id"], total, state in auto.found, config)
                at = [int(np.searchsorted(before, x, "right")) - 1 for x in (a, b)] if form != "plain" else []
                out.append((r["row"], r["doc_id"], total, form, a, b, [{"piece": i, "state": entered[i], "k": x - before[i]} for i, x in zip(at, (a, b), strict=False)]))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)] if out else [pa.array([], f.type) for f in schema], schema=schema)

    return one.mapInArrow(run, "row long, doc_id long, n long, form string, a long, b long, cuts array<struct<piece int, state int, k long>>")


def _cut_places(pieces: DataFrame, plans: DataFrame, config: FimConfig) -> DataFrame:
    """(row, a_byte, b_byte): each cut found in the one piece that holds it."""
    auto = automaton(config.units, config.sentinels)
    asked = plans.select("row", F.posexplode("cuts").alias("which", "c")).select("row", "which", "c.*")
    schema = pa.schema([("row", pa.int64()), ("which", pa.int32()), ("at", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 32):
                part = batch.slice(lo, 32)
                scan = Scan(auto, [_raw(part.column(5), k) for k in range(part.num_rows)], config.chunk_bytes)
                scan.compose(np.array(part.column(3).to_pylist(), np.int32))
                at = scan.places(np.arange(part.num_rows), np.array(part.column(4).to_pylist(), np.int64)) + np.array(part.column(2).to_pylist(), np.int64) * config.piece_bytes
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(at, pa.int64())], schema=schema)

    found = asked.join(pieces.select("row", "piece", "bytes"), ["row", "piece"]).select("row", "which", "piece", "state", "k", "bytes").mapInArrow(run, "row long, which int, at long")
    return found.groupBy("row").agg(*[F.max(F.when(F.col("which") == w, F.col("at"))).alias(f"{c}_byte") for w, c in enumerate("ab")])


def _in_pieces(docs: DataFrame, config: FimConfig) -> DataFrame:
    """Texts of several pieces: read by as many tasks as there are pieces, then put together, each in one task, as the one cell that it is."""
    scratch = Scratch(docs.sparkSession, "fim")
    pieces = scratch.table(_pieces(docs, config).repartition("row", "piece"), "pieces")
    plans = scratch.table(_plans(_summaries(pieces, config), config), "plans")
    about = plans.join(_cut_places(pieces, plans, config), "row", "left").select("row", F.lit(-1).alias("piece"), F.lit(None).cast("binary").alias("bytes"), F.struct("doc_id", "n", "form", "a", "b", "a_byte", "b_byte").alias("about"))
    both = about.unionByName(pieces.select("row", "piece", "bytes"), allowMissingColumns=True).repartition("row").sortWithinPartitions("row", "piece")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        about, held = None, bytearray()

        def done() -> pa.RecordBatch:
            return _out([_row(*(about[c] for c in ("doc_id", "n", "form", "a", "b")), assembled(bytes(held), about["form"], about["a_byte"] or 0, about["b_byte"] or 0, config))])

        for batch in batches:
            for k in range(batch.num_rows):
                if batch.column(3)[k].is_valid and batch.column(1)[k].as_py() == -1:
                    if about is not None:
                        yield done()
                    about, held = batch.column(3)[k].as_py(), bytearray()
                else:
                    held += _raw(batch.column(2), k)
        if about is not None:
            yield done()

    return both.mapInArrow(run, OUT_DDL)


def fill_in_middle(docs: DataFrame, config: FimConfig = FimConfig()) -> DataFrame:
    """doc_id, n, form, prefix_units, middle_units, output: one row for each row of docs, its whole text cut into prefix, middle and suffix.

    form is plain (output is the text), psm or spm; the units of prefix and middle are null where it is plain. All draws hang on doc_id and the salt. A
    null text counts as empty, a null doc_id as an empty one; a text without units, or with a sentinel, stays plain; equal rows give equal rows; an empty table
    gives no rows; other columns of docs are not read.

    Scale: texts of one piece are cut where they stand, without an exchange. Longer ones are read piece by piece in as many tasks and shuffled twice, so memory
    holds some megabytes of texts, and, where a long text is put together, that text and its form.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    long = F.coalesce(F.octet_length("text"), F.lit(0)) > config.piece_bytes
    return _whole(docs.filter(~long), config).unionByName(_in_pieces(docs.filter(long), config))


def restored(output: str = "output", form: str = "form", config: FimConfig = FimConfig()):
    """The exact text, as a column, rebuilt from an output and its form."""
    parts = F.split(F.col(output), "|".join(r"\Q" + s + r"\E" for s in (config.prefix, config.suffix, config.middle)), -1)
    return F.when(F.col(form) == "psm", F.concat(parts[1], parts[3], parts[2])).when(F.col(form) == "spm", F.concat(parts[2], parts[3], parts[1])).otherwise(F.col(output))


def op12_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fill_in_middle(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n", "form", F.col("prefix_units").alias("prefix_chars"), F.col("middle_units").alias("middle_chars"), F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(), 256).alias("restored_sha256"))

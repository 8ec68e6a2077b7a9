"""Join of texts by the Jaccard similarity of their word n-grams: MinHash LSH forest, then exact verification.

Equal n-gram sets fall together first. Each remaining set has a signature of trees x max_depth MinHash values; a tree orders the sets by their
values as a trie does. Where few sets share the prefix of `depth` values, they are compared there. Where many do, the trie is followed to
longer prefixes until its nodes are small, which alone would lose pairs at the threshold; so for a set whose recall falls short of the
target, prefixes are shortened again, in the smallest nodes first, until the target is reached, against those sets only that the longer
prefixes did not connect with it. What is near by signature forms coarse classes; within these, in blocks, all intersections are
counted exactly. Pairs are never rows: a block gives each set's links and a spanning forest of the links found.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, spare
from .components import connected_components
from .textkernel import as_strings, iter_grams, mix


@dataclass(frozen=True)
class ForestConfig:
    words: int = 5
    similarity: str = "0.8"
    trees: int = 32
    max_depth: int = 8
    target_recall: float = 0.99999
    coarse: float = 0.675  # least share of equal signature values between sets that are compared exactly: 5 deviations below 0.8
    first_trees: int = 4  # trees in which large nodes are compared before all others
    node_rows: int = 256  # signatures that one block of a trie holds
    block_bytes: int = 8_000_000  # n-grams of a class that one chunk of it holds
    block_sets: int = 1000  # sets that it holds, whatever their size: a block counts all pairs of two chunks in one matrix
    seed: int = 5

    def missed(self, depth: int) -> float:
        """Logarithm of the chance that a pair at the threshold doesn't share a prefix of this length in one tree."""
        return math.log(1 - float(self.similarity) ** depth)

    @property
    def depth(self) -> int:
        """The longest prefix, short of the whole, at which a pair at the threshold is found with the target recall, if it is the same in all trees."""
        depth = self.max_depth - 1
        while depth > 1 and self.trees * self.missed(depth) > math.log(1 - self.target_recall):
            depth -= 1
        return depth


def unique_grams(grams: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct n-grams of each text and their offsets."""
    text = np.repeat(np.arange(len(off) - 1), np.diff(off))
    order = np.lexsort((grams, text))
    g, t = grams[order], text[order]
    keep = np.ones(len(g), bool)
    keep[1:] = (g[1:] != g[:-1]) | (t[1:] != t[:-1])
    g, t = g[keep], t[keep]
    return g, np.concatenate(([0], np.cumsum(np.bincount(t, minlength=len(off) - 1))))


def fingerprints(g: np.ndarray, off: np.ndarray, raw: list[bytes]) -> np.ndarray:
    """16 bytes for each set of n-grams, whatever their order; a text without words is known by its own bytes."""
    out = np.zeros((len(off) - 1, 2), np.uint64)
    full = np.flatnonzero(np.diff(off))
    if len(full):
        for k, c in enumerate((0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)):
            out[full, k] = mix(np.add.reduceat(mix(g ^ np.uint64(c)), off[full]) + np.diff(off)[full].astype(np.uint64))
    for k in np.flatnonzero(np.diff(off) == 0):
        out[k] = np.frombuffer(hashlib.blake2b(raw[k], digest_size=16).digest(), np.uint64)
    return out


def signatures(g: np.ndarray, off: np.ndarray, cfg: ForestConfig) -> np.ndarray:
    """Least values of trees x max_depth hash functions over each set, as 32-bit numbers; sets must not be empty."""
    rng = np.random.default_rng(cfg.seed)
    n = cfg.trees * cfg.max_depth
    a, b = (rng.integers(0, 2**32, n, dtype=np.uint32) | np.uint32(1) for _ in range(2))
    c = rng.integers(0, 2**32, n, dtype=np.uint32)
    hi, lo = (g >> np.uint64(32)).astype(np.uint32), g.astype(np.uint32)
    out = np.empty((len(off) - 1, n), np.uint32)
    step = 200_000
    for i, j in _runs(off, step):
        h, l, at = hi[off[i] : off[j]], lo[off[i] : off[j]], off[i:j] - off[i]
        for k in range(n):
            out[i:j, k] = np.minimum.reduceat(h * a[k] + l * b[k] + c[k], at)
    return out


def _runs(off: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    i, n = 0, len(off) - 1
    while i < n:
        j = min(n, max(i + 1, int(np.searchsorted(off, off[i] + most, "right")) - 1))
        yield i, j
        i = j


def _sets(col: pa.Array, cfg: ForestConfig) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first text, last + 1, distinct n-grams, offsets, fingerprints) over slices of a column."""
    col = as_strings(col)
    for i, j, grams, off in iter_grams(col, cfg.words):
        g, off = unique_grams(grams, off)
        empty = np.diff(off) == 0
        raw = [x.as_buffer().to_pybytes() if e else b"" for x, e in zip(col.slice(i, j - i), empty, strict=True)] if empty.any() else [b""] * (j - i)
        yield i, j, g, off, fingerprints(g, off, raw)


def _fixed(rows: np.ndarray) -> pa.Array:
    """Equal-sized rows as a binary column."""
    rows = np.ascontiguousarray(rows)
    width = rows.dtype.itemsize * rows.shape[1]
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer((np.arange(len(rows) + 1) * width).astype(np.int32)), pa.py_buffer(rows.tobytes())])


def sketch(docs: DataFrame, cfg: ForestConfig) -> DataFrame:
    """doc_id, row_key, fp, n (distinct n-grams), keys (each tree's node at `depth`, the tree in the last six bits), low (lowest byte of each signature value, tree after tree) of every row."""
    trees, depth = cfg.trees, cfg.depth

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, g, off, fp in _sets(batch.column(2), cfg):
                n = np.diff(off)
                full = np.flatnonzero(n)
                keys = np.zeros((j - i, trees), np.uint64)
                low = np.zeros((j - i, trees * cfg.max_depth), np.uint8)
                if len(full):
                    sig = signatures(g, np.concatenate((off[full], off[-1:])), cfg)
                    low[full] = sig.astype(np.uint8)
                    node = np.arange(1, trees + 1, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407)
                    for d in range(depth):
                        node = mix(node + sig[:, d :: cfg.max_depth].astype(np.uint64))
                    keys[full] = node & ~np.uint64(63) | np.arange(trees, dtype=np.uint64)
                count = np.where(n > 0, trees, 0)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(count))), pa.int32()), pa.array(keys[full].ravel().view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), _fixed(fp), pa.array(n, pa.int32()), lists, _fixed(low)], ["doc_id", "row_key", "fp", "n", "keys", "low"])

    return _keyed(docs).mapInArrow(run, "doc_id long, row_key long, fp binary, n int, keys array<long>, low binary")


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string")).alias("row_key"), F.col("text").cast("string"))


def _by_run(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of the rows of one key each, from batches sorted by key; a key's rows may span batches."""
    held: list[pa.RecordBatch] = []
    held_key = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        new = np.zeros(batch.num_rows, bool)
        new[0] = held_key is not None and tuple(c[0] for c in cols) != held_key
        for c in cols:
            new[1:] |= c[1:] != c[:-1]
        cuts = np.concatenate(([0], np.flatnonzero(new), [batch.num_rows]))
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            if hi == lo:
                continue
            if held and new[lo]:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(lo, hi - lo))
            held_key = tuple(c[hi - 1] for c in cols)
    if held:
        yield pa.Table.from_batches(held)


def _forest(adj: np.ndarray) -> np.ndarray:
    """Least connected index of each row of a symmetric boolean matrix."""
    label = np.arange(len(adj))
    while True:
        new = np.minimum(label, np.where(adj, label[None, :], len(adj)).min(1))
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _flat(col: pa.ChunkedArray, dtype: type) -> np.ndarray:
    """A binary column of equal-sized values as a matrix."""
    return np.frombuffer(b"".join(col.to_pylist()), dtype).reshape(len(col), -1)


def near_labels(low: np.ndarray, label: np.ndarray, least: float) -> np.ndarray:
    """Least connected row of each, from the given labels on: neighbours in the order of the trie first, then all rows that are still apart."""
    label = label.copy()

    def join(a: int, b: int) -> None:
        lo, hi = sorted((label[a], label[b]))
        label[label == hi] = lo

    order = np.lexsort(low.T[::-1])
    for k in np.flatnonzero((low[order[1:]] == low[order[:-1]]).sum(1) >= least):
        join(order[k], order[k + 1])
    for k in range(len(low)):
        other = np.flatnonzero(label != label[k])
        other = other[other > k]
        for j in other[(low[other] == low[k]).sum(1) >= least]:
            join(k, j)
    return label


def coarse_edges(blocks: DataFrame, keys: list[str], cfg: ForestConfig) -> DataFrame:
    """(a, b): a spanning forest of the near signatures in each block (keys, sid, low, component), beyond what the components connect.

    blocks are dealt and sorted by their keys. A set's component is its own number where nothing is known of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[np.ndarray] = []
        for block in _by_run(batches, keys):
            sid, known = block.column("sid").to_numpy(), block.column("component").to_numpy()
            if len(block) < 2 or (known == known[0]).all():
                continue
            order = np.argsort(sid)  # the least set of a block leads, in whatever tree
            sid, known, low = sid[order], known[order], _flat(block.column("low"), np.uint8)[order]
            first, label = np.unique(known, return_index=True, return_inverse=True)[1:]
            label = first[label]
            new = near_labels(low, label, cfg.coarse * low.shape[1] + (1 - cfg.coarse) * low.shape[1] / 256)
            joined = (new != label) & (label == np.arange(len(sid)))
            out.append(np.stack([sid[joined], sid[new[joined]]]))
        if out:
            a, b = np.concatenate(out, 1)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return blocks.select(*keys, "sid", "low", "component").mapInArrow(run, "a long, b long")


def tries(sets: DataFrame, cfg: ForestConfig) -> DataFrame:
    """(node, sid, m, low, piece) of the sets that share their node at `depth` in some tree with others: m sets there, and piece the values beyond that prefix."""
    in_nodes = sets.select("sid", F.explode("keys").alias("node"))
    shared = in_nodes.groupBy("node").agg(F.count("*").alias("m")).filter("m > 1")
    members = in_nodes.join(shared, "node").join(sets.select("sid", "low"), "sid")
    return members.withColumn("piece", F.expr(f"substring(low, cast(node & 63 as int) * {cfg.max_depth} + {cfg.depth + 1}, {cfg.max_depth - cfg.depth})"))


def small_nodes(large: DataFrame, cfg: ForestConfig) -> DataFrame:
    """(node, piece, more, rows, leader): how many values beyond `depth` the trie is followed for the sets of a node with this piece, the sets there, and the least of the full prefix."""
    most = cfg.max_depth - cfg.depth
    full = large.groupBy("node", "piece").agg(F.count("*").alias("n"), F.min("sid").alias("leader"))
    out = full.withColumn(f"n{most}", F.col("n"))
    for k in range(1, most):
        start = F.expr(f"substring(piece, 1, {k})").alias("__start")
        sums = full.select("node", start, "n").groupBy("node", "__start").agg(F.sum("n").alias(f"n{k}"))
        out = out.withColumn("__start", start).join(sums, ["node", "__start"]).drop("__start")
    more, rows = F.lit(most), F.col(f"n{most}")
    for k in range(most - 1, 0, -1):
        fits = F.col(f"n{k}") <= cfg.node_rows
        more, rows = F.when(fits, k).otherwise(more), F.when(fits, F.col(f"n{k}")).otherwise(rows)
    return out.select("node", "piece", more.alias("more"), rows.alias("rows"), "leader")


def long_prefixes(large: DataFrame, cfg: ForestConfig, scratch: Scratch) -> DataFrame:
    """The sets of large nodes, each with the small node further down (block) that it is compared in, and with how many more values (more).

    A full prefix that too many sets share is cut into chunks, each with the prefix's least set: they are nearly equal, so most are near that one.
    """
    large = large.join(small_nodes(large, cfg), ["node", "piece"])
    block = F.xxhash64("node", "more", F.expr("substring(piece, 1, more)"))
    chunks = F.ceil(F.col("rows") / cfg.node_rows).cast("int")
    own = F.when(F.col("rows") <= cfg.node_rows, F.array(F.lit(0))).when(F.col("sid") == F.col("leader"), F.sequence(F.lit(0), chunks - 1)).otherwise(F.array(F.pmod(F.xxhash64("sid"), chunks).cast("int")))
    return scratch.table(large.select("node", "m", "sid", "low", "more", block.alias("block"), own.alias("chunks")), "large")


def shortened(large: DataFrame, cfg: ForestConfig) -> DataFrame:
    """Nodes at `depth` to which prefixes are shortened: for each set below the target recall, of its large nodes the smallest ones, until it reaches it."""
    gain = F.element_at(F.array(*[F.lit(cfg.missed(cfg.depth + k) - cfg.missed(cfg.depth)) for k in range(1, cfg.max_depth - cfg.depth + 1)]), F.col("more"))
    own = large.select("sid", "node", "m", gain.alias("gain"))
    all_, so_far = Window.partitionBy("sid"), Window.partitionBy("sid").orderBy("m", "node").rowsBetween(Window.unboundedPreceding, -1)  # at most one row a tree
    short = F.sum("gain").over(all_) - (math.log(1 - cfg.target_recall) - cfg.trees * cfg.missed(cfg.depth))
    return own.withColumn("short", short).withColumn("won", F.coalesce(F.sum("gain").over(so_far), F.lit(0.0))).filter("won < short").select("node").distinct()


def _apart(rows: DataFrame, cfg: ForestConfig) -> DataFrame:
    """The sets of each node (node, sid, low, component) in blocks in which those of different components meet.

    A node with one component needs none. The sets of a node's largest component don't meet one another, so their copies follow the number of the other sets."""
    sizes = rows.groupBy("node", "component").agg(F.count("*").alias("n"))
    top = sizes.groupBy("node").agg(F.max(F.struct("n", "component")).alias("top"), F.sum("n").alias("m")).filter("m > top.n")
    main = F.col("component") == F.col("top.component")
    rows = rows.join(top, "node").withColumn("cm", F.ceil(F.col("top.n") / cfg.node_rows).cast("int")).withColumn("cu", F.ceil((F.col("m") - F.col("top.n")) / cfg.node_rows).cast("int"))
    rows = rows.withColumn("chunk", F.when(main, F.pmod(F.xxhash64("sid"), F.col("cm"))).otherwise(F.col("cm") + F.pmod(F.xxhash64("sid"), F.col("cu"))).cast("int"))
    return _in_blocks(rows.withColumn("first", F.when(main, F.col("cm")).otherwise(0)), "node", "first", "cm + cu")


def coarse_classes(sets: DataFrame, cfg: ForestConfig, scratch: Scratch) -> DataFrame:
    """(node, component): classes of sets (sid, keys, low) that near signatures connect; sets without a near one are left out."""
    members = scratch.table(tries(sets, cfg).select("node", "sid", "m", "low", "piece"), "members")
    blocks = members.filter(F.col("m") <= cfg.node_rows).select("node", F.col("node").alias("block"), F.lit(0).alias("chunk"), "sid", "low")
    big = members.filter(F.col("m") > cfg.node_rows)
    some_big = bool(big.limit(1).count())
    own, by = F.col("sid").alias("component"), ["block", "chunk"]

    def edges_in(rows: DataFrame, known: DataFrame | None) -> DataFrame:
        rows = rows.select(*by, "sid", "low", own) if known is None else rows.join(known, "sid", "left").select(*by, "sid", "low", F.coalesce("component", "sid").alias("component"))
        return scratch.table(coarse_edges(rows.repartition(*by).sortWithinPartitions(*by), by, cfg).distinct(), "coarse")

    def connected(edges: DataFrame) -> DataFrame:
        return connected_components(edges, scratch).select(F.col("node").alias("sid"), "component")

    if not some_big:
        return connected(edges_in(blocks, None))
    # a large group comes together in a few trees; the others then add only what these leave apart
    big = long_prefixes(big, cfg, scratch)
    deep = big.select("node", "block", F.explode("chunks").alias("chunk"), "sid", "low")
    few = F.expr(f"(node & 63) < {cfg.first_trees}")
    edges = edges_in(deep.filter(few), None)
    edges = edges.unionByName(edges_in(blocks.unionByName(deep.filter(~few)), connected(edges)))
    rows = big.join(shortened(big, cfg), "node").select("node", "sid", "low").join(connected(edges), "sid", "left")
    rows = scratch.table(rows.withColumn("component", F.coalesce("component", "sid")), "shortened")
    return connected(edges.unionByName(scratch.table(coarse_edges(_apart(rows, cfg), ["node", "ci", "cj"], cfg).distinct(), "coarse")))


def similar(shared: np.ndarray, n: np.ndarray, m: np.ndarray, similarity: str) -> np.ndarray:
    """shared / (n + m - shared) >= similarity, in whole numbers."""
    t = Fraction(similarity)
    return shared * (t.numerator + t.denominator) >= t.numerator * (n + m)


def intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections, by products over the n-grams that at least two sets have."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, col, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.cumsum(count > 1) - 1
    keep = count[col] > 1
    owner, col = owner[keep], rank[col[keep]]
    order = np.argsort(col, kind="stable")
    owner, col = owner[order], col[order]
    out = np.zeros((len(sets), len(sets)), np.float64)
    width = 4096
    for lo in range(0, int(col[-1]) + 1 if len(col) else 0, width):
        i, j = np.searchsorted(col, [lo, lo + width])
        block = np.zeros((len(sets), width), np.float32)
        block[owner[i:j], col[i:j] - lo] = 1
        out += block @ block.T
    return np.rint(out).astype(np.int64)


def verified(blocks: DataFrame, cfg: ForestConfig) -> DataFrame:
    """For each block of a class (class_key, ci, cj, chunk, sid, copies, grams): each set's links (a, null, links) and a spanning forest of them (a, b, 0)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("links", pa.int64())])
        for block in _by_run(batches, ["class_key", "ci", "cj"]):
            block = block.take(pa.array(np.unique(block.column("sid").to_numpy(), return_index=True)[1]))  # equal rows of other tasks go
            if len(block) < 2:
                continue
            sid, copies = block.column("sid").to_numpy(), np.asarray(block.column("copies"))
            chunk, cross = np.asarray(block.column("chunk")), block.column("ci")[0] != block.column("cj")[0]
            sets = [np.frombuffer(x, np.uint64) for x in block.column("grams").to_pylist()]
            size = np.array([len(s) for s in sets])
            if len(sets) == 2:
                same = len(np.intersect1d(*sets, assume_unique=True))
                shared = np.array([[size[0], same], [same, size[1]]])
            else:
                shared = intersections(sets)
            adj = similar(shared, size[:, None], size[None, :], cfg.similarity)
            np.fill_diagonal(adj, False)
            if cross:
                adj &= chunk[:, None] != chunk[None, :]
            links = adj @ copies
            label = _forest(adj)
            rows = [(sid[k], None, int(links[k])) for k in np.flatnonzero(links)] + [(sid[k], sid[label[k]], 0) for k in np.flatnonzero(label != np.arange(len(sid)))]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return blocks.select("class_key", "ci", "cj", "chunk", "sid", "copies", "grams").mapInArrow(run, "a long, b long, links long")


def _in_blocks(rows: DataFrame, key: str, first: str, chunks: str) -> DataFrame:
    """Each row once for every pair of its own chunk and one of those from `first` to `chunks` - 1 of its key, dealt and sorted by pair."""
    pairs = F.explode(F.expr(f"transform(sequence({first}, {chunks} - 1), c -> struct(least(c, chunk) as ci, greatest(c, chunk) as cj))"))
    return rows.withColumn("pair", pairs).select("*", "pair.ci", "pair.cj").drop("pair").repartition(key, "ci", "cj").sortWithinPartitions(key, "ci", "cj")


def _filter_words(ids: DataFrame, bits: int) -> np.ndarray:
    """A one-hash Bloom filter of row_key as 64-bit words; at most bits / 64 numbers reach the driver."""
    at = F.pmod(F.col("row_key"), F.lit(bits))
    rows = ids.select(F.shiftright(at, 6).cast("int").alias("w"), F.expr("shiftleft(1L, cast(pmod(row_key, 64) as int))").alias("m")).groupBy("w").agg(F.bit_or("m").alias("m")).collect()
    out = np.zeros(bits // 64, np.int64)
    for r in rows:
        out[r.w] = r.m
    return out.view(np.uint64)


def gram_sets(docs: DataFrame, chosen: DataFrame, cfg: ForestConfig) -> DataFrame:
    """row_key, fp and sorted n-grams of the rows whose row_key is in chosen (row_key); of equal rows, one in each task.

    A filter of 16 bits a chosen row thins the texts before their n-grams are made and joined; it stops growing at 2^28 bits (32 MB on
    the driver), beyond which more n-grams move that the join then drops.
    """
    bits = 1 << min(28, max(16, (16 * chosen.count()).bit_length()))
    words = docs.sparkSession.sparkContext.broadcast(_filter_words(chosen, bits))  # bits / 8 bytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[int] = set()
        for batch in batches:
            key = batch.column(1).to_numpy()
            at = np.mod(key, bits)
            hit = ((words.value[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)).astype(bool)
            for k in np.flatnonzero(hit):
                hit[k] = (own := int(key[k])) not in done
                done.add(own)
            batch = batch.filter(pa.array(hit))
            if not batch.num_rows:
                continue
            for i, j, g, off, fp in _sets(batch.column(2), cfg):
                grams = pa.Array.from_buffers(pa.binary(), j - i, [None, pa.py_buffer((off * 8).astype(np.int32)), pa.py_buffer(g.tobytes())])
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(i, j - i), _fixed(fp), grams], ["row_key", "fp", "grams"])

    return _keyed(docs).mapInArrow(run, "row_key long, fp binary, grams binary")


def classify(docs: DataFrame, cfg: ForestConfig = ForestConfig()) -> DataFrame:
    """One row for each row of docs: doc_id, class_id (least doc_id of its class), n_links (other rows at the threshold or above, copies included), copies
    (rows with its n-gram set), row_key and is_kept (true for one set of each class, the one with class_id).

    Texts with fewer than `words` words have one n-gram of all their words; texts without words (null counts as empty) link only to
    equal texts. Classes join whatever links connect. Rows with equal or null ids are rows like any other; a class of null ids has a null class_id.
    An empty table gives no rows.

    Scale: a row of some 550 bytes for each text goes on from one pass; text is read once more for those in coarse classes. Trie nodes and
    classes are cut into blocks of bounded size, whatever a group's share of the rows; exact links within one class of m different texts
    cost m^2 counts, spread over (m / block)^2 tasks, but no rows.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "ngrams")
    rows = scratch.table(sketch(docs, cfg), "sketch")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row_key"))
    sets = rows.groupBy("fp").agg(first.alias("lead"), F.count("*").alias("copies"), F.first(F.struct("n", "keys", "low")).alias("s"))
    sets = sets.select(F.monotonically_increasing_id().alias("sid"), "fp", "lead.row_key", F.col("lead.doc_id").alias("rep_id"), "copies", "s.n", "s.keys", "s.low")
    sets = scratch.table(sets, "sets")

    classes = coarse_classes(sets.filter("n > 0"), cfg, scratch)
    inside = classes.withColumnRenamed("component", "class_key").join(sets.select("sid", "fp", "row_key", "copies", "n"), "sid")
    weight = inside.groupBy("class_key").agg(F.greatest(F.ceil(F.sum(F.col("n") * 8.0 + 64) / cfg.block_bytes), F.ceil(F.count("*") / cfg.block_sets)).cast("int").alias("chunks"))
    inside = scratch.table(inside.join(weight, "class_key").withColumn("chunk", F.pmod(F.xxhash64("sid"), F.col("chunks")).cast("int")), "inside")
    grams = gram_sets(docs, inside.select("row_key"), cfg)
    blocks = _in_blocks(grams.join(inside, ["row_key", "fp"]).select("class_key", "chunks", "chunk", "sid", "copies", "grams"), "class_key", "0", "chunks")
    found = scratch.table(verified(blocks, cfg), "links")
    final = connected_components(found.filter("b is not null"), scratch)

    links = found.filter("b is null").groupBy(F.col("a").alias("sid")).agg(F.sum("links").alias("links"))
    sets = sets.select("sid", "fp", "row_key", "rep_id", "copies").join(links, "sid", "left").join(final.select(F.col("node").alias("sid"), "component"), "sid", "left")
    sets = sets.withColumn("component", F.coalesce("component", "sid"))
    lead = sets.groupBy("component").agg(F.min(F.struct(F.col("rep_id").isNull().alias("last"), "rep_id", "sid")).alias("lead"))
    sets = sets.join(lead, "component").select("fp", F.col("row_key").alias("set_row"), F.col("lead.rep_id").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).cast("long").alias("n_links"), "copies", (F.col("sid") == F.col("lead.sid")).alias("kept_set"))
    sets = scratch.table(sets, "classes")
    out = rows.select("doc_id", "row_key", "fp").join(sets, "fp")
    return out.select("doc_id", "class_id", "n_links", "copies", "row_key", (F.col("kept_set") & (F.col("row_key") == F.col("set_row"))).alias("is_kept"))


def one_of_each(docs: DataFrame, cfg: ForestConfig = ForestConfig()) -> DataFrame:
    """docs with one row of each class (see classify): that of the least doc_id of the class that has one, whole.

    A null text counts as empty, and empty texts are one class; of repeated rows one stays; a class without any doc_id keeps one of its rows. An empty table gives
    no rows. Other columns, whatever their names, are kept.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "ngrams")
    kept = classify(docs, cfg).filter("is_kept").groupBy("row_key").agg(F.count("*").alias("rows"))
    key, again, lane, one = (spare(docs, c) for c in ("__row_key", "__again", "__lane", "__one"))
    kept = scratch.table(kept.select(F.col("row_key").alias(key), (F.col("rows") > 1).alias(again)), "kept")
    out = docs.withColumn(key, F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string"))).join(kept, key)
    if kept.filter(F.col(again)).limit(1).count():  # the same row more than once: first one of each partition, then one of all
        rank = F.row_number().over(Window.partitionBy(key, lane).orderBy(key))
        firsts = out.filter(F.col(again)).withColumn(lane, F.spark_partition_id()).withColumn(one, rank).filter(F.col(one) == 1).drop(one, lane)
        out = out.filter(~F.col(again)).unionByName(firsts.dropDuplicates([key]))
    return out.select(*docs.columns)


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "class_id", "n_links", "copies")

"""Gradient boosting by histograms, trees grown leaf by leaf.

Features are cut into at most 255 bins at their quantiles; missing values have a bin of their own. For every open node a pass over the rows sums gradients and
curvatures by feature and bin, and the driver gets the best split of each node. The node of the greatest gain is split next. Several models on the same rows
(feature sets) grow in the same passes. A fit makes some thousand passes, so rows are held on the executors in numpy blocks and a pass is one small RDD job; where one task
reads all rows its sums are whole, so it makes the passes of several trees in a row, and the models are dealt over tasks. A single
pass as a plan (histograms, split_gains: gains are columns over the sums) is there for reports.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from math import log

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranges import discrete_quantiles

MISSING = 255
UNIT = 2.0**30  # sums are of whole numbers of this fraction, so they don't hang on the order of rows


@dataclass(frozen=True)
class BoostParams:
    iterations: int = 300
    step: float = 0.05
    leaves: int = 15
    least_rows: int = 50
    l2: float = 1.0
    bins: int = 255
    store_every: int = 10  # trees after which the rows' margins are made anew; of rows in one block, trees that one job grows
    block_rows: int = 20_000  # rows that one task of a pass reads, about


@dataclass(frozen=True)
class Split:
    node: int  # 1 is the root, 2k and 2k + 1 the children of k
    feature: int
    bin: int  # rows of this bin or a lower one go left
    missing_left: bool


@dataclass
class Tree:
    splits: list[Split] = field(default_factory=list)  # parents before children
    values: dict[int, float] = field(default_factory=dict)

    def nodes(self, bins: np.ndarray) -> np.ndarray:
        at = np.ones(len(bins), np.int64)
        for s in self.splits:
            here = np.flatnonzero(at == s.node)
            b = bins[here, s.feature]
            left = np.where(b == MISSING, s.missing_left, b <= s.bin)
            at[here] = 2 * s.node + 1 - left
        return at

    def add_to(self, margin: np.ndarray, bins: np.ndarray) -> None:
        ids = np.array(sorted(self.values), np.int64)
        margin += np.array([self.values[i] for i in ids.tolist()])[np.searchsorted(ids, self.nodes(bins))]


def bin_ends(rows: DataFrame, columns: list[str], bins: int = 255) -> dict[str, list[float]]:
    """The greatest value of each bin: all values of a column that has at most bins - 1 different ones, else its quantiles. The driver gets these alone."""
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in columns])).alias("e")
    long = rows.select(each).select("e.*").filter("value is not null and not isnan(value)")
    values = long.groupBy("feature", "value").agg(F.count("*").alias("n"))
    many = values.groupBy("feature").agg(F.count("*").alias("n")).collect()
    wide = [r["feature"] for r in many if r["n"] > bins - 1]
    ends = {c: set() for c in columns}
    for r in values.filter(~F.col("feature").isin(wide) if wide else F.lit(True)).select("feature", "value").collect():  # bins - 1 at most for each column
        ends[r["feature"]].add(r["value"])
    if wide:
        cuts = tuple(k / (bins - 1) for k in range(1, bins))
        for r in discrete_quantiles(long.filter(F.col("feature").isin(wide)), ["feature"], "value", cuts).collect():
            ends[r["feature"]].add(r["quantile"])
    return {c: sorted(e) for c, e in ends.items()}


def in_bins(values: np.ndarray, ends: list[list[float]]) -> np.ndarray:
    """rows x columns of doubles (missing: not a number) to bins; above the last end counts as in the last bin."""
    out = np.full(values.shape, MISSING, np.uint8)
    for k, e in enumerate(ends):
        here = ~np.isnan(values[:, k])
        out[here, k] = np.minimum(np.searchsorted(e, values[here, k], "left"), max(0, len(e) - 1))
    return out


def _matrix(batch: pa.RecordBatch, first: int, n: int) -> np.ndarray:
    return np.column_stack([batch.column(first + k).to_numpy(zero_copy_only=False).astype(np.float64) for k in range(n)]) if n else np.zeros((batch.num_rows, 0))


def binned(rows: DataFrame, label: str, columns: list[str], ends: dict[str, list[float]], models: int) -> DataFrame:
    """bins (a byte for each column), y and margins (a double for each model, 0 yet)."""
    cut = [ends[c] for c in columns]
    schema = pa.schema([("bins", pa.binary()), ("y", pa.int32()), ("margins", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = in_bins(_matrix(batch, 1, len(cut)), cut)
            zero = bytes(8 * models)
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in x], pa.binary()), batch.column(0), pa.array([zero] * len(x), pa.binary())], schema=schema)

    return rows.select(F.col(label).cast("int").alias("y"), *[F.col(c).cast("double").alias(f"x{k}") for k, c in enumerate(columns)]).mapInArrow(run, "bins binary, y int, margins binary")


def _unpacked(batch: pa.RecordBatch, features: int, models: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    cells = lambda k: b"".join(x.as_buffer() for x in batch.column(k))
    return np.frombuffer(cells(0), np.uint8).reshape(-1, features), batch.column(1).to_numpy(), np.frombuffer(cells(2), np.float64).reshape(-1, models).copy()


def gradients(y: np.ndarray, margin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    p = 1 / (1 + np.exp(-margin))
    return np.rint((p - y) * UNIT), np.rint(p * (1 - p) * UNIT)


def node_sums(blocks: Iterable[tuple[np.ndarray, np.ndarray, np.ndarray]], columns: list[list[int]], features: int, pending: list[list[Tree]], trees: list[Tree], asked: list[list[int]]) -> dict[tuple[int, int], np.ndarray]:
    """(model, node) of each asked node to its sums of g, h and rows by feature x 256 + bin, over blocks of (bins, y, margins)."""
    models = len(columns)
    sums = {(m, node): np.zeros((3, features * 256)) for m in range(models) for node in asked[m]}
    for bins, y, margins in blocks:
        for m in range(models):
            if not asked[m]:
                continue
            margin = margins[:, m].copy()
            for t in pending[m]:
                t.add_to(margin, bins)
            g, h = gradients(y, margin)
            at = trees[m].nodes(bins)
            for node in asked[m]:
                here = np.flatnonzero(at == node)
                key = (bins[here][:, columns[m]].astype(np.int64) + 256 * np.array(columns[m], np.int64)).ravel()
                for k, w in enumerate((g[here], h[here], np.ones(len(here)))):
                    sums[m, node][k] += np.bincount(key, np.repeat(w, len(columns[m])), features * 256)
    return sums


def histograms(rows: DataFrame, columns: list[list[int]], features: int, pending: list[list[Tree]], trees: list[Tree], asked: list[list[int]]) -> DataFrame:
    """model, node, feature, bin, g, h, n: sums over the rows of each asked node of each model."""
    models = len(columns)
    schema = pa.schema([("model", pa.int32()), ("node", pa.int32()), ("feature", pa.int32()), ("bin", pa.int32()), ("g", pa.int64()), ("h", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = node_sums((_unpacked(batch, features, models) for batch in batches), columns, features, pending, trees, asked)
        for (m, node), s in sums.items():
            on = np.flatnonzero(s[2])
            if len(on):
                full = lambda x: np.full(len(on), x, np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (full(m), full(node), (on // 256).astype(np.int32), (on % 256).astype(np.int32), *(s[k][on].astype(np.int64) for k in range(3)))], schema=schema)

    return rows.mapInArrow(run, "model int, node int, feature int, bin int, g long, h long, n long")


def split_gains(sums: DataFrame, keys: list[str], least_rows: int, l2: float) -> DataFrame:
    """keys, feature and the split of each that gains most: bin, missing_left, gain and the left and whole sums (g, h, n); without one that leaves enough rows on both sides, no row.

    sums are partial ones by keys, feature and bin. They are dealt by keys and feature, once: adding up, running sums over bins and the choice need no further
    exchange. Of equal gains the lowest bin comes first, then missing values to the right. Where no value is missing, later missing ones follow the larger part.
    """
    by = ", ".join([*keys, "feature"])
    part = lambda g, h: f"(({g}) / {UNIT}D) * (({g}) / {UNIT}D) / (({h}) / {UNIT}D + {float(l2)}D)"
    dealt = sums.repartition(*keys, "feature").groupBy(*keys, "feature", "bin").agg(*[F.sum(c).alias(c) for c in "ghn"])
    over = f"over (partition by {by} order by bin rows between unbounded preceding and"
    t = dealt.selectExpr("*", *[x for c in "ghn" for x in (f"sum({c}) {over} current row) as {c}_upto", f"sum({c}) {over} unbounded following) as {c}_all", f"coalesce(sum(if(bin = {MISSING}, {c}, 0)) {over} unbounded following), 0) as {c}_gap")])
    side = lambda left: f"named_struct('missing_left', {str(left).lower()}, {', '.join(f"'{c}', {c}_upto{f' + {c}_gap' if left else ''}" for c in 'ghn')})"
    t = t.filter(f"bin <> {MISSING}").selectExpr(*keys, "feature", "bin", *[f"{c}_all" for c in "ghn"], f"explode(if(n_gap > 0, array({side(False)}, {side(True)}), array(if(2 * n_upto >= n_all, {side(True)}, {side(False)})))) as side")
    t = t.selectExpr(*keys, "feature", "bin", *[f"{c}_all" for c in "ghn"], "side.missing_left as missing_left", *[f"side.{c} as {c}_left" for c in "ghn"]).filter(f"n_left >= {least_rows} and n_all - n_left >= {least_rows}")
    t = t.selectExpr("*", f"{part('g_left', 'h_left')} + {part('g_all - g_left', 'h_all - h_left')} - {part('g_all', 'h_all')} as gain")
    rest = "struct(bin, missing_left, gain, g_left, h_left, n_left, g_all, h_all, n_all)"
    return t.groupBy(*keys, "feature").agg(F.expr(f"max_by({rest}, struct(gain, -bin, not missing_left))").alias("best")).select(*keys, "feature", "best.*")


def best_split(sums: np.ndarray, least_rows: int, l2: float) -> dict | None:
    """The split that gains most among all features of one node, from its whole sums (g, h, n by feature and bin: 3 x features x 256 of int64), each split as split_gains has it; of equal gains the first feature's."""
    whole, gap = sums.sum(axis=2)[:, :, None], sums[:, :, MISSING:]
    upto = sums[:, :, :MISSING].cumsum(axis=2)
    left = np.stack([upto, upto + gap], axis=3)  # missing values to the right, to the left
    sides = np.where(gap[2, :, :, None] > 0, True, (2 * upto[2] >= whole[2])[:, :, None] == np.array([False, True]))
    fits = (sums[2, :, :MISSING] > 0)[:, :, None] & sides & (left[2] >= least_rows) & (whole[2][:, :, None] - left[2] >= least_rows)
    if not fits.any():
        return None
    feature, bin_, side = at = np.nonzero(fits)  # by feature, bin and side: of equal gains the first counts
    (g, h, n), (ga, ha, na) = (x[at] for x in left), (x[feature, 0] for x in whole)
    part = lambda g, h: (g / UNIT) * (g / UNIT) / (h / UNIT + l2)
    gains = part(g, h) + part(ga - g, ha - h) - part(ga, ha)
    i = int(np.argmax(gains))
    numbers = {"g_left": g, "h_left": h, "n_left": n, "g_all": ga, "h_all": ha, "n_all": na, "feature": feature, "bin": bin_}
    return {"gain": float(gains[i]), "missing_left": bool(side[i])} | {k: int(v[i]) for k, v in numbers.items()}


def splits_of_pass(blocks: RDD, columns: list[list[int]], features: int, pending: list[list[Tree]], trees: list[Tree], asked: list[list[int]], params: BoostParams) -> dict[tuple[int, int], dict]:
    """(model, node) of asked nodes to their best split: sums of tasks meet by node, the driver gets one split for each."""

    def sums(part: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> Iterator[tuple[tuple[int, int], np.ndarray]]:
        for (m, node), s in node_sums(part, columns, features, pending, trees, asked).items():
            yield (m, node), s.astype(np.int64).reshape(3, features, 256)

    parts, each = blocks.getNumPartitions(), blocks.mapPartitions(sums)
    whole = each.reduceByKey(np.add, min(parts, 16)) if parts > 1 else each
    return {key: best for key, best in whole.mapValues(lambda s: best_split(s, params.least_rows, params.l2)).collect() if best}


def in_blocks(table: DataFrame, features: int, models: int, parts: int) -> RDD:
    """binned rows as numpy blocks (bins, y, margins), an Arrow batch each, in so many tasks at most."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bins, y, margins = _unpacked(batch, features, models)
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (bins, y.astype(np.int32), margins)], ["bins", "y", "margins"])

    packed = table.mapInArrow(pack, "bins binary, y binary, margins binary").rdd
    block = lambda r: (np.frombuffer(r[0], np.uint8).reshape(-1, features), np.frombuffer(r[1], np.int32), np.frombuffer(r[2], np.float64).reshape(-1, models))
    return packed.coalesce(parts).map(block)


class _Growing:
    """One tree: nodes whose best split is known, and those that have to be asked for before the next best-first step is certain."""

    def __init__(self, params: BoostParams):
        self.params, self.known, self.tree, self.asked = params, {}, Tree(), [1]

    def told(self, found: dict[int, dict]) -> None:
        for node in self.asked:
            self.known[node] = found.get(node)
        self.tree, self.asked, sums = Tree(), [], {}
        heap = self.offered(1)
        leaves = {1}
        while heap and len(leaves) < self.params.leaves:
            _, node = heapq.heappop(heap)
            best = self.known[node]
            self.tree.splits.append(Split(node, best["feature"], best["bin"], best["missing_left"]))
            leaves = leaves - {node} | {2 * node, 2 * node + 1}
            sums[2 * node] = (best["g_left"], best["h_left"])
            sums[2 * node + 1] = (best["g_all"] - best["g_left"], best["h_all"] - best["h_left"])
            sizes = {2 * node: best["n_left"], 2 * node + 1: best["n_all"] - best["n_left"]}
            for child, n in sizes.items():
                if n < 2 * self.params.least_rows:
                    self.known[child] = None
                if child in self.known:
                    for x in self.offered(child):
                        heapq.heappush(heap, x)
                elif len(leaves) < self.params.leaves:  # else nothing is split any more
                    self.asked.append(child)
        if not self.asked:
            self.tree.values = {leaf: -self.params.step * (sums[leaf][0] / UNIT) / (sums[leaf][1] / UNIT + self.params.l2) if leaf in sums else 0.0 for leaf in leaves}

    def offered(self, node: int) -> list[tuple[float, int]]:
        best = self.known[node]
        return [(-best["gain"], node)] if best is not None and best["gain"] > 1e-9 else []


def trees_of_block(blocks: RDD, columns: list[list[int]], features: int, pending: list[list[Tree]], n: int, params: BoostParams) -> list[list[Tree]]:
    """n more trees of each model, or fewer up to the first without splits, from blocks that stand in one partition: a task for each model, one job."""

    def grow(m: int, part: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> Iterator[tuple[int, list[Tree]]]:
        rows, out = [], []
        for bins, y, margins in part:
            margin = margins[:, m].copy()
            for t in pending[m]:
                t.add_to(margin, bins)
            rows.append((bins, y, margin.reshape(-1, 1)))
        while len(out) < n and (not out or out[-1].splits):
            growing = _Growing(params)
            while growing.asked:
                sums = node_sums(rows, [columns[m]], features, [[]], [growing.tree], [growing.asked])
                growing.told({node: best_split(s.astype(np.int64).reshape(3, features, 256), params.least_rows, params.l2) for (_, node), s in sums.items()})
            for bins, _, margin in rows:
                growing.tree.add_to(margin[:, 0], bins)
            out.append(growing.tree)
        yield m, out

    each = [blocks.mapPartitions(lambda part, m=m: grow(m, part)) for m in range(len(columns))]
    found = dict(blocks.context.union(each).collect())
    return [found[m] for m in range(len(columns))]


@dataclass(frozen=True)
class Boosted:
    """A fitted model: its columns' bins, start and trees."""

    columns: list[str]
    ends: dict[str, list[float]]
    start: float
    trees: list[Tree]

    def scored(self, rows: DataFrame, name: str = "model_score") -> DataFrame:
        """rows with the probability of label 1; missing values go where each split has learned to send them. One pass, no exchange."""
        columns, cut, trees, start = self.columns, [self.ends[c] for c in self.columns], self.trees, self.start
        at = len(rows.columns)
        ready = rows.select("*", *[F.col(c).cast("double").alias(f"__x{k}") for k, c in enumerate(columns)])
        names = [*rows.columns, name]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                bins = in_bins(_matrix(batch, at, len(cut)), cut)
                margin = np.full(len(bins), start)
                for t in trees:
                    t.add_to(margin, bins)
                yield pa.RecordBatch.from_arrays([*batch.columns[:at], pa.array(1 / (1 + np.exp(-margin)))], names)

        return ready.mapInArrow(run, rows.withColumn(name, F.lit(0.0)).schema)


def fit(rows: DataFrame, label: str, feature_sets: dict[str, list[str]], keep: Callable[[str, DataFrame], DataFrame], params: BoostParams = BoostParams()) -> dict[str, Boosted]:
    """A model of label (0 or 1) for each feature set. Rows with a null label are left out; without rows of both labels models are constant.

    Scale: a pass over the binned rows, a byte for each column, for each level of best-first growth, of all models together: sums are shuffled
    (bins x features x open nodes for each task), and the driver gets one split for each open node. `keep` stores the binned rows; blocks of them stay
    on the executors, block_rows to a task, so small tables make small jobs. Margins are moved every store_every trees; a lost executor's blocks are made again
    from the stored rows by the trees so far. Rows that one task reads anyway (block_rows at most) take a job for each store_every trees instead of one for each pass.
    """
    rows = rows.filter(F.col(label).isNotNull())
    columns = sorted({c for cs in feature_sets.values() for c in cs})
    ends = bin_ends(rows, columns, params.bins)
    names = list(feature_sets)
    at = [[columns.index(c) for c in feature_sets[n]] for n in names]
    table = keep("binned_rows", binned(rows, label, columns, ends, len(names)))
    size = table.agg(F.count("*").alias("n"), F.sum("y").alias("hits")).first()
    n, hits = size["n"], size["hits"] or 0
    start = log(hits / (n - hits)) if 0 < hits < n else 0.0
    first = Tree(values={1: start})
    pending, trees = [[first] for _ in names], [[] for _ in names]
    parts = max(1, -(-n // params.block_rows))
    blocks = in_blocks(table, len(columns), len(names), parts).persist(StorageLevel.MEMORY_AND_DISK)
    turns = params.iterations if 0 < hits < n else 0
    while parts == 1 and len(trees[0]) < turns:
        found = trees_of_block(blocks, at, len(columns), pending, min(params.store_every, turns - len(trees[0])), params)
        most = max(len(ts) for ts in found)
        for k, ts in enumerate(found):
            ts += [ts[-1]] * (most - len(ts))  # without splits, and so is what would follow
            pending[k] += ts
            trees[k] += ts
        if all(not ts[-1].splits for ts in found):
            break
    for turn in range(turns if parts > 1 else 0):
        growing = [_Growing(params) for _ in names]
        while any(g.asked for g in growing):
            found = splits_of_pass(blocks, at, len(columns), pending, [g.tree for g in growing], [g.asked for g in growing], params)
            for k, g in enumerate(growing):
                if g.asked:
                    g.told({node: best for (m, node), best in found.items() if m == k})
        for k, g in enumerate(growing):
            pending[k].append(g.tree)
            trees[k].append(g.tree)
        if all(not g.tree.splits for g in growing):
            break
        if (turn + 1) % params.store_every == 0 and turn + 1 < params.iterations:
            old, blocks = blocks, _moved(blocks, pending).persist(StorageLevel.MEMORY_AND_DISK)
            blocks.count()
            old.unpersist()
            pending = [[] for _ in names]
    blocks.unpersist()
    getattr(keep, "drop", lambda df: None)(table)
    remapped = lambda t, k: Tree([Split(s.node, feature_sets[names[k]].index(columns[s.feature]), s.bin, s.missing_left) for s in t.splits], t.values)
    return {name: Boosted(feature_sets[name], {c: ends[c] for c in feature_sets[name]}, start, [remapped(t, k) for t in trees[k]]) for k, name in enumerate(names)}


def _moved(blocks: RDD, pending: list[list[Tree]]) -> RDD:
    def move(block: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        bins, y, margins = block[0], block[1], block[2].copy()
        for m, ts in enumerate(pending):
            for t in ts:
                t.add_to(margins[:, m], bins)
        return bins, y, margins

    return blocks.map(move)

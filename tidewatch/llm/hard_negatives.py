"""Hard negatives by a Voronoi-partitioned nearest-neighbour join.

Scores are inner products. With one more coordinate, root(M^2 - |x|^2) for candidates of norm at most M and 0 for anchors, the largest product is the least
distance, so the triangle inequality bounds it. Pivots divide the space; anchors of one pivot form a group with a radius, and a candidate goes to a group only
if its distance to the pivot lets it come near enough to an anchor of it. What meets there is compared exactly.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, read


@dataclass(frozen=True)
class NegativeConfig:
    """Anchors are every `anchor_every`-th id; ids divisible by `relabel_every` first take the next of `labels` labels. A negative scores between `least_percent` and 100 % of its positive.

    anchors_per_group and block_bytes bound what one task compares at once; most_pivots bounds what is broadcast (pivots, radii and bounds).
    """

    anchor_every: int = 100
    relabel_every: int = 7
    labels: int = 10
    positives: int = 5
    negatives: int = 5
    least_percent: int = 80
    scale: int = 256
    anchors_per_group: int = 256
    least_pivots: int = 8
    most_pivots: int = 1024
    block_bytes: int = 4 << 20


MOST_SQUARES = 2.0**48  # of a vector's components, so that products are whole in doubles and order with their ties in longs
POINT = "row long, vec_id long, label int, v binary"


def prepared(vectors: DataFrame, config: NegativeConfig = NegativeConfig(), column: str = "embedding") -> DataFrame:
    """row, vec_id, label and whole components (`v`, an array of doubles) of the rows that take part."""
    v = F.transform(F.col(column), lambda x: F.floor(x.cast("double") * config.scale).cast("double"))
    whole = F.forall(F.col(column), lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(2.0**60)))
    fits = F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x) < MOST_SQUARES
    label = F.when(F.col("vec_id") % config.relabel_every == 0, (F.col("label") + 1) % config.labels).otherwise(F.col("label")).cast("int")
    ok = vectors.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col(column).isNotNull()).filter(whole).filter(fits)
    return ok.select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"), label.alias("label"), v.alias("v"))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Vectors held as bytes of doubles, one in each cell."""
    return np.frombuffer(b"".join(x.as_buffer() for x in column), np.float64).reshape(len(column), dim) if dim else np.zeros((len(column), 0))


class Space:
    """Pivots and the norm M, small enough to be sent with every task: at most most_pivots vectors."""

    def __init__(self, pivots: np.ndarray, square: float):
        self.square = square
        self.dim = pivots.shape[1]
        # an anchor's extra coordinate is 0, and pivots stand where anchors do
        self.pivots = np.unique(pivots, axis=0) if len(pivots) else pivots
        self.norms = (self.pivots**2).sum(1)

    def distances(self, x: np.ndarray, candidate: bool) -> np.ndarray:
        """From each row to each pivot, in the space with one more coordinate."""
        own = np.full(len(x), self.square) if candidate else (x**2).sum(1)
        return np.sqrt(np.maximum(0.0, own[:, None] + self.norms[None, :] - 2 * (x @ self.pivots.T)))

    @property
    def slack(self) -> float:
        """What rounding may take from a distance."""
        return 1e-3 + 1e-6 * (self.square**0.5 + self.norms.max(initial=0.0) ** 0.5)


def _in_cells(points: DataFrame, space: Space) -> DataFrame:
    """Each point with the pivot nearest to it as a candidate (cell) and as an anchor (home), and its distance to the latter."""
    schema = pa.schema([("row", pa.int64()), ("vec_id", pa.int64()), ("label", pa.int32()), ("v", pa.binary()), ("cell", pa.int32()), ("home", pa.int32()), ("home_distance", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = batch.column(3).flatten().to_numpy(zero_copy_only=False)
            x = flat.reshape(batch.num_rows, space.dim)
            for lo in range(0, len(x), 4096):
                part = x[lo : lo + 4096]
                own = space.distances(part, False)
                home = own.argmin(1)
                cells = [pa.array(space.distances(part, True).argmin(1), pa.int32()), pa.array(home, pa.int32()), pa.array(own[np.arange(len(part)), home])]
                yield pa.RecordBatch.from_arrays([*batch.slice(lo, len(part)).columns[:3], pa.array([r.tobytes() for r in part], pa.binary()), *cells], schema=schema)

    return points.mapInArrow(run, f"{POINT}, cell int, home int, home_distance double")


Local = Callable[[dict, dict], list]


def _served(candidates: DataFrame, anchors: DataFrame, slices: dict[int, int], space: Space, config: NegativeConfig, local: Local, schema: pa.Schema, ddl: str) -> DataFrame:
    """What `local` finds where candidates (with `groups`, the groups that they may serve) meet the anchors of these groups.

    A group's candidates are dealt by hash into blocks of bounded size, and its anchors stand in slices, copied to each block: neither has to fit one task.
    """
    counts = {r["grp"]: r["n"] for r in candidates.select(F.explode("groups").alias("grp")).groupBy("grp").agg(F.count("*").alias("n")).collect()}  # a row for each pivot at most
    in_block = max(64, config.block_bytes // (8 * max(1, space.dim)))
    spread = {g: (slices[g], max(1, -(-n // in_block))) for g, n in counts.items() if g in slices}
    if not spread:
        return candidates.sparkSession.createDataFrame([], ddl)
    of = F.create_map(*[x for g, (s, b) in spread.items() for x in (F.lit(g), F.struct(F.lit(s).alias("s"), F.lit(b).alias("b")))])
    upto = lambda n: F.sequence(F.lit(0), n - 1)
    c = candidates.select("row", "vec_id", "label", "v", F.explode("groups").alias("grp")).withColumn("of", F.element_at(of, F.col("grp"))).filter("of is not null")
    c = c.select("row", "vec_id", "label", "v", "grp", F.explode(upto(F.col("of.s"))).alias("slice"), F.pmod(F.xxhash64("row"), F.col("of.b")).cast("int").alias("block"))
    a = anchors.withColumn("of", F.element_at(of, F.col("grp"))).filter("of is not null")
    a = a.select("*", F.explode(upto(F.col("of.b"))).alias("block")).drop("of")

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return schema.empty_table()
        whole = lambda t: {n: t.column(n).combine_chunks() for n in t.column_names}
        first, second = whole(left), whole(right)
        a = {n: x.to_numpy(zero_copy_only=False) for n, x in first.items() if n in ("row", "label")} | {"v": _matrix(first["v"], space.dim), "positives": first["positives"].to_pylist() if "positives" in first else None}
        c = {n: second[n].to_numpy(zero_copy_only=False) for n in ("row", "vec_id", "label")} | {"v": _matrix(second["v"], space.dim)}
        order = np.lexsort((c["row"], c["vec_id"]))  # so that of equal scores the first is the least id
        cols = local(a, {n: x[order] for n, x in c.items()})
        return pa.Table.from_arrays([pa.array(x, f.type) for x, f in zip(cols, schema, strict=True)], schema=schema)

    keys = ["grp", "slice", "block"]
    return a.groupBy(*keys).cogroup(c.groupBy(*keys)).applyInArrow(meet, ddl)


FOUND = pa.schema([("anchor_row", pa.int64()), ("row", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])
FOUND_DDL = "anchor_row long, row long, vec_id long, score long"
NEGATIVES = pa.schema([("anchor_row", pa.int64()), ("positive_row", pa.int64()), ("row", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])
NEGATIVES_DDL = "anchor_row long, positive_row long, row long, vec_id long, score long"


def best_of_label(k: int) -> Local:
    """The k best other rows of each anchor's label in one block."""

    def local(a: dict, c: dict) -> list:
        out: list[list] = [[], [], [], []]
        m = len(c["row"])
        for lo in range(0, len(a["row"]), 64):
            score = np.rint(a["v"][lo : lo + 64] @ c["v"].T).astype(np.int64)
            fits = (a["label"][lo : lo + 64, None] == c["label"][None, :]) & (a["row"][lo : lo + 64, None] != c["row"][None, :])
            key = np.where(fits, score * m + (m - 1 - np.arange(m)), -(1 << 62))
            top = np.argpartition(-key, min(k, m) - 1, axis=1)[:, :k] if m > k else np.tile(np.arange(m), (len(key), 1))
            i, j = np.nonzero(np.take_along_axis(fits, top, 1))
            j = top[i, j]
            for col, x in zip(out, (a["row"][lo + i], c["row"][j], c["vec_id"][j], score[i, j]), strict=True):
                col.append(x)
        return [np.concatenate(x) for x in out]

    return local


def best_in_bands(k: int, least_percent: int) -> Local:
    """The k best rows of other labels within the band below each positive of each anchor, in one block."""

    def local(a: dict, c: dict) -> list:
        out: list[list] = [[], [], [], [], []]
        for i, positives in enumerate(a["positives"]):
            score = np.rint(c["v"] @ a["v"][i]).astype(np.int64)
            low = min(least_percent * p["score"] for p in positives)
            high = max(100 * p["score"] for p in positives)
            j = np.flatnonzero((c["label"] != a["label"][i]) & (100 * score >= low) & (100 * score <= high))
            j = j[np.argsort(-score[j], kind="stable")]
            s = 100 * score[j]
            for p in positives:
                best = j[np.flatnonzero((s >= least_percent * p["score"]) & (s <= 100 * p["score"]))[:k]]
                for col, x in zip(out, ([a["row"][i]] * len(best), [p["row"]] * len(best), c["row"][best], c["vec_id"][best], score[best]), strict=True):
                    col.append(np.asarray(x, np.int64))
        return [np.concatenate(x) if x else np.zeros(0, np.int64) for x in out]

    return local


def _ranked(found: DataFrame, keys: list[str], k: int) -> DataFrame:
    by = Window.partitionBy(*keys).orderBy(F.desc("score"), "vec_id", "row")
    return found.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k)


def _near(points: DataFrame, space: Space, radius: dict[int, float], limits: Column | None = None, reach: dict[int, float] | None = None) -> DataFrame:
    """points with `groups`: those whose pivot lies so that the point may be within the group's reach of one of its anchors.

    An anchor is at most `radius` from its pivot, so a point farther from the pivot than radius + reach is farther than reach from every anchor of the
    group. reach is one number for each group, or a column (array of group and reach) that hangs on the point.
    """
    schema = pa.schema([("row", pa.int64()), ("vec_id", pa.int64()), ("label", pa.int32()), ("v", pa.binary()), ("groups", pa.list_(pa.int32()))])
    rows = points.select("row", "vec_id", "label", "v", (limits if limits is not None else F.lit(None).cast("array<struct<grp int, reach double>>")).alias("limits"))
    wide = np.full(len(space.pivots), -np.inf)
    for g, r in (reach or {}).items():
        wide[g] = radius[g] + r + space.slack

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 2048):
                part = batch.slice(lo, 2048)
                d = space.distances(_matrix(part.column(3), space.dim), True)
                if reach is not None:
                    groups = [np.flatnonzero(x).tolist() for x in d <= wide]
                else:
                    groups = [[x["grp"] for x in lim or () if x["reach"] is None or d[k, x["grp"]] <= radius[x["grp"]] + x["reach"] + space.slack] for k, lim in enumerate(part.column(4).to_pylist())]
                yield pa.RecordBatch.from_arrays([*part.columns[:4], pa.array(groups, pa.list_(pa.int32()))], schema=schema)

    return rows.mapInArrow(run, f"{POINT}, groups array<int>").filter(F.size("groups") > 0)


def hard_negatives(vectors: DataFrame, config: NegativeConfig = NegativeConfig(), column: str = "embedding") -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: for each anchor and each of its best rows of the same label, the best rows of other labels in the band below it.

    Rows with a null id, label or vector, with a null, infinite or not-a-number component, or whose components' squares exceed 2^48 after scaling, take no
    part. Vectors of other lengths count as ended by zeros. Equal scores go to the least id; repeated rows are rows of their own, so a repeated anchor gives its
    rows twice. An anchor without positives or negatives gives no rows, nor does an empty table. Other columns are not read.

    Scale: three joins, each of blocks of bounded size: at home (what an anchor finds in its own cell bounds the distance of its positives), positives, then
    negatives, whose distance the positives bound. Candidates go to the groups that the bounds leave, at worst to all groups of `anchors_per_group` anchors.
    Sent to the driver and back with tasks: pivots, radii and bounds, a row for each of at most most_pivots.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "negatives")
    points = scratch.table(prepared(vectors, config, column), "points")
    anchor = F.col("vec_id") % config.anchor_every == 0
    square = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
    size = points.agg(F.max(F.size("v")).alias("dim"), F.max(square).alias("square"), F.count_if(anchor).alias("anchors")).first()
    empty = spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    if not size["anchors"]:
        return empty
    points = points.withColumn("v", F.concat("v", F.array_repeat(F.lit(0.0), F.lit(size["dim"]) - F.size("v"))))
    n_pivots = min(config.most_pivots, max(config.least_pivots, -(-size["anchors"] // config.anchors_per_group)))
    chosen = points.filter(anchor).orderBy(F.xxhash64("vec_id", "row"), "row").limit(n_pivots).select("v").collect()
    space = Space(np.array([r["v"] for r in chosen], np.float64).reshape(len(chosen), size["dim"]), float(size["square"]))

    cells = scratch.table(_in_cells(points, space), "cells")
    anchors = cells.filter(anchor)
    groups = anchors.groupBy("home").agg(F.count("*").alias("n"), F.max("home_distance").alias("radius")).collect()  # a row for each pivot at most
    radius = {r["home"]: r["radius"] for r in groups}
    slices = {r["home"]: -(-r["n"] // config.anchors_per_group) for r in groups}
    count = F.create_map(*[F.lit(x) for g, n in slices.items() for x in (g, n)])
    anchors = anchors.select("row", F.col("vec_id").alias("anchor_id"), "label", "v", F.col("home").alias("grp"), F.pmod(F.xxhash64("row"), F.element_at(count, F.col("home"))).cast("int").alias("slice"))
    seek = anchors.select("row", "label", "v", "grp", "slice")

    # at home: an anchor's best rows in its own cell are no farther than those of all cells
    at_home = cells.select("row", "vec_id", "label", "v", F.array("cell").alias("groups"))
    first = _served(at_home, seek, slices, space, config, best_of_label(config.positives), FOUND, FOUND_DDL)
    kth = _ranked(first, ["anchor_row"], config.positives).filter(F.col("rank") == config.positives).select(F.col("anchor_row").alias("row"), "score")
    far = seek.select("row", "label", "grp").join(kth, "row", "left").join(points.select("row", square.alias("own_square")), "row")
    reach = F.sqrt(F.greatest(F.lit(0.0), F.col("own_square") + space.square - 2.0 * F.col("score")))
    # an anchor that found too few at home has no bound (null), and then neither has its label in its group
    by_label = far.groupBy("label", "grp").agg(F.when(F.count("score") == F.count("*"), F.max(reach)).alias("reach")).groupBy("label").agg(F.collect_list(F.struct("grp", "reach")).alias("limits"))
    by_label = scratch.table(by_label, "limits")

    near = scratch.table(_near(cells.join(by_label, "label"), space, radius, F.col("limits")), "near")
    positives = _served(near, seek, slices, space, config, best_of_label(config.positives), FOUND, FOUND_DDL)
    positives = scratch.table(_ranked(positives, ["anchor_row"], config.positives).select("anchor_row", F.col("row").alias("positive_row"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")

    # a band is empty below a negative score, and its floor bounds the distance of what can stand in it
    useful = positives.filter("positive_score >= 0").groupBy(F.col("anchor_row").alias("row")).agg(F.collect_list(F.struct(F.col("positive_row").alias("row"), F.col("positive_score").alias("score"))).alias("positives"), F.min("positive_score").alias("least"))
    asked = scratch.table(seek.join(useful, "row").join(points.select("row", square.alias("own_square")), "row"), "asked")
    reach = F.sqrt(F.greatest(F.lit(0.0), F.col("own_square") + space.square - F.lit(0.02 * config.least_percent) * F.col("least")))
    limits = {r["grp"]: r["reach"] for r in asked.groupBy("grp").agg(F.max(reach).alias("reach")).collect()}  # a row for each pivot at most
    if not limits:
        return empty
    near = scratch.table(_near(cells, space, radius, reach=limits), "near")
    found = _served(near, asked.drop("least", "own_square"), slices, space, config, best_in_bands(config.negatives, config.least_percent), NEGATIVES, NEGATIVES_DDL)
    best = _ranked(found, ["anchor_row", "positive_row"], config.negatives)
    ids = positives.join(anchors.select(F.col("row").alias("anchor_row"), "anchor_id"), "anchor_row")
    return best.join(ids, ["anchor_row", "positive_row"]).select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives(read(spark, sf_dir, "embeddings"))

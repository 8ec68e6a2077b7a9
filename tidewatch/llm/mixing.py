"""Mixing sources to target weights: exact quotas, split among output shards by a multivariate-hypergeometric tree.

Each source's documents fall into blocks, by ranges of a keyed hash. A source's quota of words draws its blocks in permuted order, all of them
as often as the quota holds the whole source, then as many as the rest asks; of the last block, the first documents. The number of blocks
that every source draws is split exactly among the output shards by a binary tree of multivariate-hypergeometric draws; each shard then takes
its quota of the source's drawn blocks, in another permuted order, disjoint from all other shards, and shuffles its own rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, spare

WORD = r"[^\x20\x09-\x0D]+"


@dataclass(frozen=True)
class MixConfig:
    weights: tuple[int, ...] = (5, 2, 1)
    share: float = 1.5
    most_repeats: float = 2.0
    n_shards: int = 16
    block_bits: int = 12  # a source has 2^12 blocks; fewer where there are so many sources that all draws would pass 9e8
    shard_words: int = 8_000_000  # of one shuffled part of a shard, about: some 50 MB of text
    most_parts: int = 50_000  # shuffled parts of all shards together; beyond, the parts grow instead, and their sorts spill
    seed: int = 11
    most_sources: int = 1_000_000  # the driver holds a few numbers for each source; more are refused
    broadcast_blocks: int = 200_000  # above this many rows, the table of blocks is joined by a shuffle


def word_count(text: Column) -> Column:
    """Runs of anything but blank, tab and line breaks; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: list[tuple[str | None, int]], cfg: MixConfig) -> list[tuple[str | None, int, float]]:
    """(source, size, target words) by code point, null last; what exceeds a cap is shared again by weight until none is above."""
    order = sorted(sizes, key=lambda r: (r[0] is None, (r[0] or "").encode("utf-8")))
    weight = [cfg.weights[i % len(cfg.weights)] for i in range(len(order))]
    capped: set[int] = set()
    total = cfg.share * sum(size for _, size in order)
    while True:
        free = [i for i in range(len(order)) if i not in capped]
        rate = (total - sum(cfg.most_repeats * order[i][1] for i in capped)) / max(1, sum(weight[i] for i in free))
        over = {i for i in free if weight[i] * rate > cfg.most_repeats * order[i][1]}
        if not over:
            return [(s, n, cfg.most_repeats * n if i in capped else weight[i] * rate) for i, (s, n) in enumerate(order)]
        capped |= over


def split_quotas(blocks: list[int], n_shards: int, seed: int) -> np.ndarray:
    """Blocks of each source for each shard: rows sum to the sources' blocks, columns differ by at most one block."""
    rng = np.random.default_rng(seed)
    out = np.zeros((len(blocks), n_shards), np.int64)
    total = sum(blocks)
    room = [total // n_shards + (s < total % n_shards) for s in range(n_shards)]

    def split(have: np.ndarray, lo: int, hi: int) -> None:
        if hi - lo == 1:
            out[:, lo] = have
            return
        mid = (lo + hi) // 2
        want, left, rest = sum(room[lo:mid]), np.zeros_like(have), int(have.sum())
        for k in np.flatnonzero(have):  # one hypergeometric draw a source, given those before
            rest -= int(have[k])
            left[k] = rng.hypergeometric(int(have[k]), rest, want)
            want -= int(left[k])
        split(left, lo, mid)
        split(have - left, mid, hi)

    if blocks:
        split(np.asarray(blocks, np.int64), 0, n_shards)
    return out


def order_key(cfg: MixConfig, size: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(F.lit(cfg.seed), F.col("doc_id"), size), 1)  # not negative, so blocks and keys sort alike


def block_of(key: Column, bits: int) -> Column:
    return F.shiftright(key, 63 - bits).cast("int") if bits else F.lit(0)


def draw_blocks(rows: DataFrame, cfg: MixConfig, scratch: Scratch) -> tuple[DataFrame, int, int]:
    """The blocks that have words, with their draws; the bits of a block's number; the words of the whole mix.

    rows: source, size, key. Columns: src, block, source_size, target, whole (times that all of the source is drawn), drawn (the rest draws
    it too), cut (of the last block, the words still taken; else null), shards (one for each draw of it).
    """
    spark = rows.sparkSession
    cells = scratch.table(rows.groupBy(F.col("source").alias("src"), block_of(F.col("key"), cfg.block_bits).alias("block")).agg(F.sum("size").alias("n")), "cells")
    totals = [(r.src, r.n) for r in cells.groupBy("src").agg(F.sum("n").alias("n")).limit(cfg.most_sources + 1).collect()]
    if len(totals) > cfg.most_sources:
        raise ValueError(f"more than {cfg.most_sources} sources")
    targets = source_targets(totals, cfg)
    bits = cfg.block_bits
    while bits and len(targets) * 3 << bits > 900_000_000:
        bits -= 1
    if bits < cfg.block_bits:
        cells = cells.groupBy("src", F.shiftright("block", cfg.block_bits - bits).alias("block")).agg(F.sum("n").alias("n"))
    quota = [round(t) for _, _, t in targets]
    table = [(s, n, float(t), q // n if n else 0, q % n if n else 0) for (s, n, t), q in zip(targets, quota, strict=True)]
    by_source = spark.createDataFrame(table, "s string, source_size long, target double, whole long, left long")
    same = F.col("src").eqNullSafe(F.col("s"))
    by_turn = Window.partitionBy("src").orderBy(F.xxhash64(F.lit(cfg.seed + 1), "block"), "block").rowsBetween(Window.unboundedPreceding, -1)  # at most 2^bits rows
    blocks = cells.filter("n > 0").join(by_source, same).drop("s").withColumn("before", F.coalesce(F.sum("n").over(by_turn), F.lit(0)))
    blocks = blocks.withColumn("drawn", F.col("before") < F.col("left")).withColumn("cut", F.when(F.col("drawn") & (F.col("before") + F.col("n") > F.col("left")), F.col("left") - F.col("before")))
    blocks = scratch.table(blocks, "blocks")
    turns = {r.src: r.n for r in blocks.groupBy("src").agg(F.sum(F.col("whole") + F.col("drawn").cast("int")).alias("n")).collect()}
    dealt = split_quotas([turns.get(s, 0) for s, _, _ in targets], cfg.n_shards, cfg.seed)
    upto = spark.createDataFrame([(s, [int(x) for x in np.cumsum(dealt[k])]) for k, (s, _, _) in enumerate(targets)], "s string, upto array<long>")
    draws = blocks.select("src", "block", F.explode(F.expr("sequence(0L, whole + cast(drawn as int))")).alias("turn"), "whole", "drawn").filter(F.col("turn") < F.col("whole") + F.col("drawn").cast("int"))
    order = Window.partitionBy("src").orderBy(F.xxhash64(F.lit(cfg.seed + 2), "block", "turn"), "block", "turn")
    draws = draws.withColumn("at", F.row_number().over(order) - 1).join(upto, same).withColumn("shard", F.expr("size(filter(upto, u -> u <= at))"))
    shards = draws.groupBy(F.col("src").alias("s"), F.col("block").alias("b")).agg(F.expr("transform(array_sort(collect_list(struct(turn, shard))), x -> x.shard)").alias("shards"))
    blocks = blocks.join(shards, same & (F.col("block") == F.col("b")), "left").drop("s", "b", "n", "before", "left")
    return scratch.table(blocks, "drawn"), bits, sum(quota)


def _small(blocks: DataFrame, cfg: MixConfig) -> DataFrame:
    return F.broadcast(blocks) if blocks.count() <= cfg.broadcast_blocks else blocks


def plan_mix(docs: DataFrame, cfg: MixConfig = MixConfig(), scratch: Scratch | None = None) -> DataFrame:
    """How many words the mix takes of each row, and in which shards its repeats stand.

    Columns: doc_id, source, size, source_size, target (of its source), taken, shards (one entry for each repeat). Null sources form one
    source, the last; null and empty texts have size 0 and are taken for 0 words. Rows with equal ids are rows of their own. A source
    without words has target 0. An empty table gives no rows.

    Scale: rows of a few numbers move, not texts. What is ordered is the blocks of a source (2^block_bits) and the rows of its last
    block, so that a source with a third of all rows spreads over tasks; the driver holds a few numbers a source.
    """
    scratch = scratch or Scratch(docs.sparkSession, "mixing")
    size = word_count(F.col("text"))
    rows = scratch.table(docs.select("doc_id", F.col("source").cast("string").alias("source"), size.alias("size")).withColumn("key", order_key(cfg, F.col("size"))), "rows")
    return _taken(rows, *draw_blocks(rows, cfg, scratch)[:2], cfg)


def _taken(rows: DataFrame, blocks: DataFrame, bits: int, cfg: MixConfig) -> DataFrame:
    sizes = blocks.groupBy(F.col("src").alias("s")).agg(F.first("source_size").alias("source_size"), F.first("target").alias("target"))
    small = _small(blocks.drop("source_size", "target"), cfg)
    rows = rows.join(_small(sizes, cfg), F.col("source").eqNullSafe(F.col("s")), "left").drop("s").withColumn("at", block_of(F.col("key"), bits))
    rows = rows.join(small, F.col("source").eqNullSafe(F.col("src")) & (F.col("at") == F.col("block")), "left")
    whole = rows.filter("cut is null").withColumn("part", F.when(F.col("drawn"), F.col("size")).otherwise(0))
    inside = F.coalesce(F.sum("size").over(Window.partitionBy("source").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # one block of each source
    last = rows.filter("cut is not null").withColumn("part", F.greatest(F.lit(0), F.least(F.col("size"), F.col("cut") - inside)))
    out = whole.unionByName(last).withColumn("repeats", F.when(F.col("size") > 0, F.col("whole") + (F.col("part") > 0).cast("int")).otherwise(0).cast("int"))
    return out.select(
        "doc_id", "source", "size", F.coalesce("source_size", F.lit(0)).cast("long").alias("source_size"), F.coalesce("target", F.lit(0.0)).alias("target"),
        F.when(F.col("size") > 0, F.col("whole") * F.col("size") + F.col("part")).otherwise(0).cast("long").alias("taken"),
        F.when(F.col("repeats") > 0, F.slice("shards", 1, F.col("repeats"))).otherwise(F.expr("cast(array() as array<int>)")).alias("shards"), "key", "part", "cut",
    )


def realise(docs: DataFrame, cfg: MixConfig = MixConfig(), keep_shard: str | None = None) -> DataFrame:
    """The mix itself, with docs' columns (and the shard, if a name for it is given): every row as often as its block is drawn, in the shards that the tree gave these draws, shuffled within them.

    Of a source's last block, a row that the plan takes only in part comes if the part is at least half of it, so a source is off its
    target by at most half a document. Rows without words are not taken. Rows of a shard stand together, in `shard_words` parts or one, each in a hashed order.

    Scale: the texts meet the table of blocks where they lie and move once, to their shard; nothing is sorted but a part of a shard.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "mixing")
    n, key, at, times, draw, shard, part = (spare(docs, c) for c in ("__size", "__key", "__at", "__times", "__draw", "__shard", "__part"))
    size = word_count(F.col("text"))
    rows = scratch.table(docs.select("doc_id", F.col("source").cast("string").alias("source"), size.alias("size")).withColumn("key", order_key(cfg, F.col("size"))), "rows")
    blocks, bits, words = draw_blocks(rows, cfg, scratch)
    half = F.max(F.when(F.col("part") * 2 >= F.col("size"), F.struct("key", "doc_id", "size")))
    ends = _taken(rows, blocks, bits, cfg).filter("cut is not null and size > 0").groupBy(F.col("source").alias("s")).agg(half.alias("end"))
    blocks = blocks.join(ends, F.col("src").eqNullSafe(F.col("s")) & F.col("cut").isNotNull(), "left").select(F.struct("src", "block", "whole", "drawn", "cut", "shards", "end").alias(draw))
    blocks = _small(scratch.table(blocks, "ends"), cfg)
    out = docs.withColumn(n, size).filter(F.col(n) > 0).withColumn(key, order_key(cfg, F.col(n))).withColumn(at, block_of(F.col(key), bits))
    out = out.join(blocks, F.col("source").cast("string").eqNullSafe(F.col(f"{draw}.src")) & (F.col(at) == F.col(f"{draw}.block")))
    here = F.struct(F.col(key).alias("key"), F.col("doc_id"), F.col(n).alias("size"))
    again = F.col(f"{draw}.drawn") & (F.col(f"{draw}.cut").isNull() | F.coalesce(here <= F.col(f"{draw}.end"), F.lit(False)))
    out = out.withColumn(times, (F.col(f"{draw}.whole") + again.cast("int")).cast("int")).filter(F.col(times) > 0)
    out = out.select(*docs.columns, key, F.posexplode(F.slice(f"{draw}.shards", 1, F.col(times))).alias(draw, shard))
    place = F.xxhash64(F.lit(cfg.seed + 3), key, draw)
    parts = max(1, min(-(-words // (cfg.n_shards * cfg.shard_words)), cfg.most_parts // cfg.n_shards))
    out = out.withColumn(n, place).withColumn(part, F.pmod(n, F.lit(parts))).repartition(cfg.n_shards * parts, shard, part).sortWithinPartitions(shard, part, n, "doc_id")
    return out.select(*docs.columns, *([F.col(shard).alias(keep_shard)] if keep_shard else []))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = plan_mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return plan.select("doc_id", "size", "source_size", "target", "taken", "source", "shards")

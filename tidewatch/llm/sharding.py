"""Sharding by fixed virtual slots.

Records hash into thousands of virtual slots; only the bytes of each slot are aggregated, and a small versioned
map says which shard holds which slot. The map is made near equal in bytes, and later edited, not remade: a
rebalance moves as few slots as it can and stores the next version.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch

MAP_SETTING = "spark.tidewatch.slots.path"
MAP_SCHEMA = T.StructType([T.StructField("slot", T.IntegerType(), False), T.StructField("shard", T.IntegerType(), False), T.StructField("bytes", T.LongType(), False), T.StructField("n_shards", T.IntegerType(), False), T.StructField("heavy", T.ArrayType(T.LongType()), False)])


@dataclass(frozen=True)
class SlotMap:
    """Which shard holds each virtual slot, with the bytes seen when the version was made and the texts (by key) that are dealt by doc_id."""

    n_shards: int
    shard_of: tuple[int, ...]
    bytes_of: tuple[int, ...]
    version: int = 1
    heavy: tuple[int, ...] = ()
    edits: tuple[tuple[int, int, int], ...] = field(default=(), compare=False)  # (slot, from shard, to shard) against the version before

    def loads(self) -> list[int]:
        out = [0] * self.n_shards
        for shard, size in zip(self.shard_of, self.bytes_of, strict=True):
            out[shard] += size
        return out

    def save(self, spark: SparkSession, path: str) -> None:
        """Store this version beside the earlier ones. The same map again changes nothing; another map under a version that is stored is refused."""
        if self.version in SlotMap.versions(spark, path):
            if SlotMap.load(spark, path, self.version) != self:
                raise ValueError(f"version {self.version} at {path} is another map")
            return
        rows = [(k, s, b, self.n_shards, list(self.heavy) if not k else []) for k, (s, b) in enumerate(zip(self.shard_of, self.bytes_of, strict=True))]
        spark.createDataFrame(rows, MAP_SCHEMA).coalesce(1).write.mode("overwrite").parquet(f"{path}/version={self.version}")  # of a write that broke off, what is left goes

    @staticmethod
    def versions(spark: SparkSession, path: str) -> list[int]:
        """The versions that are wholly written."""
        jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
        found = jvm.org.apache.hadoop.fs.Path(path).getFileSystem(conf).globStatus(jvm.org.apache.hadoop.fs.Path(f"{path}/version=*/_SUCCESS"))
        return sorted(int(f.getPath().getParent().getName().split("=")[1]) for f in found or [])

    @staticmethod
    def load(spark: SparkSession, path: str, version: int | None = None) -> SlotMap:
        """The stored version, or the latest."""
        version = version or max(SlotMap.versions(spark, path))
        rows = spark.read.schema(MAP_SCHEMA).parquet(f"{path}/version={version}").orderBy("slot").collect()
        return SlotMap(rows[0].n_shards, tuple(r.shard for r in rows), tuple(r.bytes for r in rows), version, tuple(rows[0].heavy))


def build_map(bytes_of: list[int], n_shards: int, heavy: tuple[int, ...] = ()) -> SlotMap:
    """Largest slot first, always to the shard with the fewest bytes (ties: lower number)."""
    heap, shard_of = [(0, s) for s in range(n_shards)], [0] * len(bytes_of)
    for slot in sorted(range(len(bytes_of)), key=lambda k: (-bytes_of[k], k)):
        load, shard = heap[0]
        shard_of[slot] = shard
        heapq.heapreplace(heap, (load + bytes_of[slot], shard))
    return SlotMap(n_shards, tuple(shard_of), tuple(bytes_of), heavy=heavy)


def rebalance(old: SlotMap, bytes_of: list[int], n_shards: int | None = None, tolerance: float = 0.02) -> SlotMap:
    """The next version: slots leave shards above the mean (and closed shards), largest that fits first, until all are within tolerance.

    Only slots that must move do; with more shards than before, slots move only into the new ones.
    """
    n = n_shards or old.n_shards
    shard_of, edits = list(old.shard_of), []
    load = [0] * max(n, old.n_shards)
    own: dict[int, list[int]] = {s: [] for s in range(len(load))}
    for slot, shard in enumerate(shard_of):
        load[shard] += bytes_of[slot]
        own[shard].append(slot)
    mean = sum(bytes_of) / n
    takers = [s for s in range(n) if s >= old.n_shards] or list(range(n))

    def move(slot: int, to: int) -> None:
        edits.append((slot, shard_of[slot], to))
        load[shard_of[slot]] -= bytes_of[slot]
        load[to] += bytes_of[slot]
        shard_of[slot] = to

    for shard in range(len(load)):
        for slot in sorted(own[shard], key=lambda k: (-bytes_of[k], k)):
            if shard >= n:
                move(slot, min(range(n), key=lambda s: (load[s], s)))
            elif load[shard] > mean * (1 + tolerance):
                to = min((s for s in takers if s != shard), key=lambda s: (load[s], s), default=shard)
                if to != shard and load[to] + bytes_of[slot] < load[shard]:
                    if load[to] + bytes_of[slot] <= mean * (1 + tolerance):
                        move(slot, to)
    return SlotMap(n, tuple(shard_of), tuple(bytes_of), old.version + 1, old.heavy, tuple(edits))


@dataclass(frozen=True)
class ShardConfig:
    n_shards: int = 16
    n_slots: int = 4096
    lane_rows: int = 200_000  # rows of a virtual slot that are numbered together, about
    broadcast_lanes: int = 1_000_000  # above this many rows, the table of lanes is joined by a shuffle


def _keyed(docs: DataFrame, cfg: ShardConfig, heavy: tuple[int, ...], keep: list[str]) -> DataFrame:
    """size, text_crc32, text_key and virtual_slot of every row, beside the kept columns."""
    text = F.coalesce("text", F.lit(""))
    crc, key = F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text, F.octet_length(text)).alias("text_key")
    out = docs.select(*[F.col(c) for c in keep], F.struct((F.octet_length(text) + 1).cast("long").alias("size"), crc, key, F.xxhash64("doc_id").alias("id_key")).alias("__row"))
    return out.withColumn("__slot", _virtual_slot(cfg, heavy))


def measured(docs: DataFrame) -> DataFrame:
    """A stored table of the numbers of every row (`__row`), for which the texts are read once."""
    return Scratch(docs.sparkSession, "sharding").table(_keyed(docs, ShardConfig(), (), []).select("__row"), "rows")


def _virtual_slot(cfg: ShardConfig, heavy: tuple[int, ...]) -> Column:
    group = F.when(F.col("__row.text_key").isin(list(heavy)), F.xxhash64("__row.id_key", "__row.text_key")).otherwise(F.col("__row.text_key")) if heavy else F.col("__row.text_key")
    return F.pmod(F.xxhash64(group), F.lit(cfg.n_slots)).cast("int")


def plan_shards(docs: DataFrame, cfg: ShardConfig = ShardConfig(), map_path: str | None = None, rows: DataFrame | None = None) -> SlotMap:
    """The slot map for these rows: the latest stored one edited, or a new one; stored if there is a map_path. `rows`: what measured(docs) has given, if it was called before.

    Equal texts share a virtual slot, unless they together weigh more than half of a shard's fair part: such a group is dealt by doc_id, from then on in all later versions.
    """
    spark = docs.sparkSession
    old = SlotMap.load(spark, map_path) if map_path and SlotMap.versions(spark, map_path) else None
    if old and len(old.shard_of) != cfg.n_slots:
        raise ValueError(f"the map at {map_path} has {len(old.shard_of)} slots, not {cfg.n_slots}")
    rows = measured(docs) if rows is None else rows
    total = rows.agg(F.sum("__row.size")).first()[0] or 0
    # at most 2 x n_shards groups can weigh more than half of a fair part each
    found = rows.groupBy("__row.text_key").agg(F.sum("__row.size").alias("b")).filter(F.col("b") * 2 * cfg.n_shards > total).select("text_key").collect()
    heavy = tuple(sorted({r[0] for r in found} | set(old.heavy if old else ())))
    weight = [0] * cfg.n_slots
    for r in rows.groupBy(_virtual_slot(cfg, heavy).alias("s")).agg(F.sum("__row.size").alias("b")).collect():
        weight[r.s] = r.b
    new = rebalance(replace(old, heavy=heavy), weight, cfg.n_shards) if old else build_map(weight, cfg.n_shards, heavy)
    if map_path:
        new.save(spark, map_path)
    return new


def place(docs: DataFrame, slot_map: SlotMap, cfg: ShardConfig = ShardConfig(), keep: list[str] | None = None, rows: DataFrame | None = None) -> DataFrame:
    """Every row in the shard that the map gives its virtual slot: the kept columns of docs, size, text_crc32, virtual_slot, shard, slot and map_version.

    The same map places the same rows in the same shards, whenever it is used. Kept columns of these names are left out. Where texts are kept, they move once, to their virtual slot.
    """
    spark = docs.sparkSession
    made = {"size", "text_crc32", "virtual_slot", "shard", "slot", "map_version"}
    keep = [c for c in (["doc_id"] if keep is None else keep) if c.lower() not in made]
    cfg = replace(cfg, n_slots=len(slot_map.shard_of))
    narrow = (measured(docs) if rows is None else rows).select(_virtual_slot(cfg, slot_map.heavy).alias("__slot"), "__row.id_key")
    rows_of = {r[0]: r[1] for r in narrow.groupBy("__slot").count().collect()}  # at most n_slots rows
    lanes = spark.createDataFrame([(s, max(1, -(-n // cfg.lane_rows))) for s, n in rows_of.items()], "__slot int, __lanes int")
    lane = F.pmod(F.xxhash64(F.lit(7), "id_key"), F.col("__lanes")).cast("int").alias("__lane")
    cells = {(r[0], r[1]): r[2] for r in narrow.join(F.broadcast(lanes), "__slot").groupBy("__slot", lane).count().collect()}  # about n_slots and one more for each lane_rows rows
    begin, table = [0] * slot_map.n_shards, []
    for slot, at in sorted(cells):
        shard = slot_map.shard_of[slot]
        table.append((slot, at, shard, begin[shard]))
        begin[shard] += cells[slot, at]
    starts = spark.createDataFrame(table, "__slot int, __lane int, shard int, __begin long")
    starts = F.broadcast(starts) if len(table) <= cfg.broadcast_lanes else starts
    out = _keyed(docs, cfg, slot_map.heavy, keep).join(F.broadcast(lanes), "__slot").withColumn("__lane", F.pmod(F.xxhash64(F.lit(7), "__row.id_key"), F.col("__lanes")).cast("int"))
    order = [*([F.col("doc_id")] if "doc_id" in keep else []), "__row.id_key", "__row.text_crc32", "__row.size"]
    within = F.row_number().over(Window.partitionBy("__slot", "__lane").orderBy(*order))
    out = out.withColumn("__own", within).join(starts, ["__slot", "__lane"])
    return out.select(*keep, "__row.size", "__row.text_crc32", F.col("__slot").alias("virtual_slot"), "shard", (F.col("__begin") + F.col("__own") - 1).cast("long").alias("slot"), F.lit(slot_map.version).alias("map_version"))


def assign_shards(docs: DataFrame, n_shards: int = 16, n_slots: int = 4096, map_path: str | None = None, keep: list[str] | None = None) -> DataFrame:
    """Put every row into a shard, near equal in bytes.

    Columns: doc_id (or the columns to keep), size (UTF-8 bytes of the text, null as none, plus 1), text_crc32 (of those bytes), virtual_slot,
    shard, slot (place in its shard, gapless from 0), map_version. Where map_path holds a map, its latest version is edited for these rows and
    saved as the next; else a new map is made, and saved if there is a map_path. An empty table gives no rows; rows with
    equal or null ids are rows like any other.

    Scale: numbers go into tables of some 40 bytes a row; the map is n_slots numbers (a parameter, whatever the input); places come from
    counts of virtual slots, the large ones in lanes of lane_rows rows, so that no task numbers more than one lane.
    """
    cfg = ShardConfig(n_shards, n_slots)
    rows = measured(docs)
    return place(docs, plan_shards(docs, cfg, map_path, rows), cfg, keep, rows)


def map_folder(spark: SparkSession, name: str) -> str:
    """Where the maps of one use of shards are kept: under the folder that the session's setting names, so that the next run edits them; else in a scratch table, for this run alone."""
    kept = spark.conf.get(MAP_SETTING, None)
    return f"{kept.rstrip('/')}/{name}" if kept else Scratch(spark, "sharding").fresh("map")


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = assign_shards(spark.read.parquet(f"{sf_dir}/documents.parquet"), map_path=map_folder(spark, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", "map_version")

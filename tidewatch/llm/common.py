"""Helpers that several corpus operators share: shared-folder tables, folds and partition-safe columns."""

from __future__ import annotations

import re
import tempfile
import uuid
from typing import ClassVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where it is unset (tests on one machine) a temporary folder is made and set on the
    session; on a cluster that would not be shared, so a non-local master is refused.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="tidewatch-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def small_batches(spark: SparkSession, most: int = 8 << 20) -> None:
    """Let no Arrow batch exceed `most` bytes: a worker holds a few batches at once, and so does the JVM beside it."""
    key, unit = "spark.sql.execution.arrow.maxBytesPerBatch", {"": 1, "b": 1, "k": 1 << 10, "m": 1 << 20, "g": 1 << 30, "t": 1 << 40, "p": 1 << 50}
    number, name = re.fullmatch(r"(-?\d+)\s*([a-z]?)b?", spark.conf.get(key).strip().lower()).groups()
    if not 0 < int(number) * unit[name] <= most:
        spark.conf.set(key, str(most))


class Scratch:
    """Tables written once into the shared folder, so that a lost executor loses no work."""

    made: ClassVar[list[str]] = []  # the folders of this process, for remove_since

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.base = spark, f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"
        Scratch.made.append(self.base)
        self.count = 0
        small_batches(spark)

    def table(self, df: DataFrame, tag: str = "t") -> DataFrame:
        """Write df and return the table read back: the plan above starts from files."""
        path = self.fresh(tag)
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def fresh(self, tag: str) -> str:
        self.count += 1
        return f"{self.base}/{self.count:02d}-{tag}"

    def drop(self, df: DataFrame) -> None:
        """Delete the files of a table that no later plan reads."""
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            self._remove(self.spark, folder)

    @staticmethod
    def _remove(spark: SparkSession, folder: str) -> None:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)

    @classmethod
    def remove_since(cls, spark: SparkSession, mark: int) -> None:
        """Delete the folders that were made after the first `mark`, when what was read from them is written elsewhere."""
        for folder in cls.made[mark:]:
            cls._remove(spark, folder)
        del cls.made[mark:]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spare(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def held_out(doc_id: Column | str = "doc_id") -> Column:
    """The fold that no fit may see: crc32 of the id's text leaves remainder 0 by 5 (a null id: False)."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fan_in(n: int) -> int:
    """Reducers of a two-level sum over n partial results: about the root of n."""
    return max(1, min(256, int(round(n**0.5))))


def add_up(partials: DataFrame, column: str = "part"):
    """Sum float64 vectors, held as bytes in one row for each task or so, over three levels: the driver gets one vector, and no task meets them all.

    Whole numbers below 2^53 add up to the same sum in any order."""
    import numpy as np
    import pyarrow as pa

    def add(batches):
        total = None
        for batch in batches:
            for x in batch.column(0):
                v = np.frombuffer(x.as_buffer(), np.float64)
                total = v.copy() if total is None else total + v
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["part"])

    n = fan_in(partials.sparkSession.sparkContext.defaultParallelism * 16)
    sums = partials.select(F.col(column).alias("part")).repartition(n).mapInArrow(add, "part binary")
    rows = sums.repartition(1).mapInArrow(add, "part binary").collect()
    return sum((np.frombuffer(r.part, np.float64) for r in rows), start=np.zeros(1)) if rows else None

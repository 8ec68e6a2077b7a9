"""Where a model stores frames that several others read."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def stored(spark: SparkSession) -> Callable[[str, DataFrame], DataFrame]:
    """A `keep` that writes tables into the folder that driver and executors share (spark.checkpoint.dir), or persists where none is set.

    Its `drop` deletes a kept table, or frees it, when nothing reads it any more; `kept` are the persisted frames.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    base = f"{root.rstrip('/')}/marts-{uuid.uuid4().hex}" if root else None
    kept: list[DataFrame] = []

    def keep(name: str, df: DataFrame) -> DataFrame:
        if base is None:
            kept.append(df.persist())
            return kept[-1]
        df.write.parquet(f"{base}/{name}")
        return spark.read.schema(df.schema).parquet(f"{base}/{name}")

    def drop(df: DataFrame) -> None:
        if base is None:
            df.unpersist()
            return
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)

    keep.kept, keep.drop = kept, drop
    return keep

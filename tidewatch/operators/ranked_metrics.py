"""Metrics over scored rows: top-N with ties shared out, and step-wise average precision.

Rows fall together by score first; the scores are then ordered in ranges, so no task meets all scores of a key, however many there are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranges import running_totals


def _by_score(df: DataFrame, keys: list[str], score: Column, label: Column) -> DataFrame:
    return df.groupBy(*keys, score.alias("__score")).agg(F.count("*").alias("__rows"), F.sum(label.cast("int")).alias("__hits"))


def top_n_shared(df: DataFrame, keys: list[str], score: str, label: str, n: Column, eligible: Column | None = None) -> DataFrame:
    """keys, n_taken and hits among the n best eligible rows of each key; the score at the cut counts in proportion to its places.

    n is a column over keys (constant in each).
    """
    rows = df.filter(eligible) if eligible is not None else df
    steps = _by_score(rows.withColumn("__n", n), [*keys, "__n"], F.col(score), F.col(label))
    steps = running_totals(steps, keys, [-F.col("__score")], {"__upto": F.col("__rows")})
    take = F.greatest(F.lit(0), F.least(F.col("__rows"), F.col("__n") - (F.col("__upto") - F.col("__rows"))))
    found = steps.withColumn("__take", take).groupBy(*keys).agg(F.sum("__take").alias("n_taken"), F.sum(F.col("__hits") * F.col("__take") / F.col("__rows")).alias("hits"))
    return df.select(*keys).distinct().join(found, keys, "left").fillna(0, ["n_taken", "hits"])


def average_precision(df: DataFrame, keys: list[str], score: Column, label: str) -> DataFrame:
    """keys and the sum over falling scores of (recall gained x precision so far); null without a positive row."""
    steps = _by_score(df, keys, score, F.col(label))
    steps = running_totals(steps, keys, [-F.col("__score")], {"__seen": F.col("__rows"), "__found": F.col("__hits")})
    return steps.groupBy(*keys).agg((F.sum(F.col("__hits") * F.col("__found") / F.col("__seen")) / F.nullif(F.sum("__hits"), F.lit(0))).alias("average_precision"))

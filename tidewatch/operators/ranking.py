"""Row numbers over a total order, without sorting the table in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranges import running_totals


def global_row_number(df: DataFrame, lead: list[str], rest: list[str], name: str, coarse: tuple[Column, ...] = ()) -> DataFrame:
    """Number all rows from 1 in the order of lead, then rest.

    Without `coarse` rows are numbered in sampled ranges of that order (ranges.running_totals; one job for the sample when called). With it, nothing runs when
    called: rows are counted for each value of the lead columns and numbered within it, and the running counts before each value add up over levels: the
    values of `coarse` (columns over lead, from coarse to fine, that rise with the order, such as a timestamp's hour), each level within the one above, then
    the leads within the last level. One task orders the counts of the first level only, so that should have few values.
    """
    if not coarse:
        return running_totals(df, [], [F.col(c) for c in (*lead, *rest)], {name: F.lit(1).cast("bigint")})
    levels = [f"__level{k}" for k in range(len(coarse))]
    counts = df.groupBy(*lead).agg(F.count("*").alias("__n")).withColumns(dict(zip(levels, coarse, strict=True)))
    before = lambda above, by: F.coalesce(F.sum("__n").over(Window.partitionBy(*above).orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts, start = counts.withColumn("__before", before(levels, lead)), F.col("__before")
    for k, level in enumerate(levels):
        upto = levels[: k + 1]
        own = counts.groupBy(*upto).agg(F.sum("__n").alias("__n")).select(*[F.col(c).alias(f"{c}__") for c in upto], before(levels[:k], [level]).alias(f"__before{k}"))
        starts = starts.join(own, [F.col(c).eqNullSafe(F.col(f"{c}__")) for c in upto]).drop(*[f"{c}__" for c in upto])
        start = start + F.col(f"__before{k}")
    starts = starts.select(*[F.col(c).alias(f"__{c}") for c in lead], start.alias("__start"))
    on = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in lead]
    numbered = df.withColumn("__own", F.row_number().over(Window.partitionBy(*lead).orderBy(*rest)))
    return numbered.join(starts, on).withColumn(name, (F.col("__start") + F.col("__own")).cast("bigint")).drop("__own", "__start", *[f"__{c}" for c in lead])

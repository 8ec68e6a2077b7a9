"""Running totals and order statistics over a total order, range by range.

A window without partition keys orders all rows in one task, and one over a few keys all rows of a key. Here a sample names the ends of ranges of about equal
size, rows are numbered within their range, and what stands before a range is added: only one row for each key and range is ever ordered together.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MOST_RANGES = 4096


def range_ends(df: DataFrame, order: list[Column], ranges: int | None = None, per_range: int = 32) -> list[tuple]:
    """The ends of about equal ranges of df in the order of these columns, from a sample; runs one job.

    Ranges are as many as four times the shuffle partitions, 4,096 at most; the driver gets `per_range` sampled rows for each. Only the ranges' sizes hang on
    the sample, no result does.
    """
    spark = df.sparkSession
    n = min(MOST_RANGES, ranges or 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    keys = df.select(*[c.alias(f"k{i}") for i, c in enumerate(order)])
    sample = sorted_sample(keys, n * per_range)
    return list(dict.fromkeys(sample[i] for i in range(per_range, len(sample), per_range)))


def sorted_sample(keys: DataFrame, rows: int) -> list[tuple]:
    """At most so many rows of keys, drawn evenly and in order; every task hands on no more than these."""
    drawn = keys.withColumn("__draw", F.rand(17)).orderBy("__draw").limit(rows).drop("__draw")
    return [tuple(r) for r in drawn.orderBy(*drawn.columns).collect()]


def range_number(order: list[Column], ends: list[tuple], types: list[str]) -> Column:
    """The range of a row: how many ends are not above it. Two levels of ends keep it to about twice the root of their number of comparisons."""
    if not ends:
        return F.lit(0)
    struct = lambda cells: F.struct(*[F.lit(x).cast(t).alias(f"k{i}") for i, (x, t) in enumerate(zip(cells, types, strict=True))])
    own = F.struct(*[c.cast(t).alias(f"k{i}") for i, (c, t) in enumerate(zip(order, types, strict=True))])
    step = max(1, round(len(ends) ** 0.5))
    all_ends = F.array(*[struct(e) for e in ends])
    tops = F.array(*[struct(e) for e in ends[step - 1 :: step]])
    upto = lambda a, x: F.size(F.filter(a, lambda e: e <= x))
    coarse = upto(tops, own)
    return (coarse * step + upto(F.slice(all_ends, coarse * step + 1, step), own)).cast("int")


def running_totals(df: DataFrame, keys: list[str], order: list[Column], totals: Mapping[str, Column], ranges: int | None = None) -> DataFrame:
    """df with each of `totals` (name to a numeric column) summed over the rows of the same keys up to and with the row, in the order given (rising, nulls first).

    Rows that are equal in keys and order follow one another in any order, so give a total order where that matters. No rows, no result. Runs one
    job for the sample when called (see range_ends); df should be cheap to read or stored.
    """
    by = [F.col(k) for k in keys] + order
    names = [f"__o{i}" for i in range(len(order))]
    marked = df.withColumns(dict(zip(names, order, strict=True)) | {f"__t{i}": c for i, c in enumerate(totals.values())})
    types = [t for _, t in df.select(*[c.alias(f"k{i}") for i, c in enumerate(by)]).dtypes]
    ends = range_ends(df, by, ranges)
    marked = marked.withColumn("__range", range_number([F.col(k) for k in keys] + [F.col(n) for n in names], ends, types))
    sums = {f"__t{i}": f"__b{i}" for i in range(len(totals))}
    each = marked.groupBy(*keys, "__range").agg(*[F.sum(t).alias(b) for t, b in sums.items()])
    earlier = Window.partitionBy(*keys).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1) if keys else Window.partitionBy(F.lit(0)).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    starts = each.select(*[F.col(c).alias(f"__k_{c}") for c in (*keys, "__range")], *[F.coalesce(F.sum(b).over(earlier), F.lit(0)).alias(f"{b}s") for b in sums.values()])
    own = Window.partitionBy(*keys, "__range").orderBy(*names).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    within = marked.withColumns({f"__w{i}": F.sum(f"__t{i}").over(own) for i in range(len(totals))})
    on = [F.col(c).eqNullSafe(F.col(f"__k_{c}")) for c in (*keys, "__range")]
    out = within.join(starts, on)  # a row for each key and range
    return out.select(*df.columns, *[(F.col(f"__w{i}") + F.col(f"__b{i}s")).alias(name) for i, name in enumerate(totals)])


def discrete_quantiles(df: DataFrame, keys: list[str], value: str, probabilities: tuple[float, ...], ranges: int | None = None) -> DataFrame:
    """keys, probability and quantile: the least value that at least this share of the key's rows (one row at least) doesn't exceed. Nulls are left out.

    What is ordered is one row for each different value, in ranges. Keys without a value give no rows.
    """
    steps = df.filter(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("__value")).agg(F.count("*").alias("__n"))
    steps = running_totals(steps, keys, [F.col("__value")], {"__upto": F.col("__n")}, ranges)
    same = [F.col(k).eqNullSafe(F.col(f"__all_{k}")) for k in keys]
    rows = df.filter(F.col(value).isNotNull()).groupBy(*[F.col(k).alias(f"__all_{k}") for k in keys]).agg(F.count("*").alias("__rows"))
    steps = steps.join(rows, same) if keys else steps.crossJoin(F.broadcast(rows))
    need = lambda p: F.greatest(F.lit(1), F.col("__rows") - F.floor(F.col("__rows") - F.col("__rows") * F.lit(p)))
    cuts = [F.min(F.when(F.col("__upto") >= need(p), F.col("__value"))).alias(f"__q{i}") for i, p in enumerate(probabilities)]
    found = steps.groupBy(*keys).agg(*cuts)
    each = F.explode(F.array(*[F.struct(F.lit(p).alias("probability"), F.col(f"__q{i}").alias("quantile")) for i, p in enumerate(probabilities)]))
    return found.select(*keys, each.alias("__q")).select(*keys, "__q.*")

"""Totals over a trailing time window, at every row: count, distinct count and sum.

A sliding RANGE frame recomputes its aggregate for each row, and DISTINCT is not allowed in one. Here every row enters the window at
its time and leaves it after the window's length; a running sum over these events, in order, is the window's
content. The work is n log n, whatever the number of rows in a window, and long histories of one key are cut at time buckets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exact, microseconds


def trailing_totals(df: DataFrame, keys: list[str], ts: str, hours: int, amount: str, item: str | None = None, bucket_windows: int = 8) -> DataFrame:
    """keys, ts, n and total for every row of df: rows (or distinct items) and sum of amounts of the same key in [ts - hours, ts].

    Both ends are closed and rows of the same time see one another. total is a decimal. Rows stand in buckets of `bucket_windows` windows and, where
    they still count in the next bucket, also there, so a busy key is spread over time.
    """
    width = hours * 3_600_000_000
    span = width * bucket_windows
    at = microseconds(F.col(ts))  # whole seconds would let rows into a window that are up to a second too old, or not yet there
    home = F.floor(F.col("__at") / span).cast("bigint")
    last = F.floor((F.col("__at") + width) / span).cast("bigint")
    rows = df.select(*keys, F.col(ts).alias("__ts"), at.alias("__at"), exact(F.col(amount)).alias("__amount"), (F.col(item) if item else F.lit(None).cast("string")).alias("__item"))
    rows = rows.withColumn("__home", home).withColumn("__bucket", F.explode(F.sequence(F.col("__home"), last)))
    if item:
        same = Window.partitionBy(*keys, "__bucket", "__item").orderBy("__at")
        before, after = F.lag("__at").over(same), F.lead("__at").over(same)
        enters = F.when(before.isNull() | (F.col("__at") > before + width), 1).otherwise(0)
        leaves = F.when(after.isNull() | (after > F.col("__at") + width), -1).otherwise(0)
    else:
        enters, leaves = F.lit(1), F.lit(-1)
    rows = rows.withColumn("__enters", enters).withColumn("__leaves", leaves)
    # at one time: entries, then readings, then exits (a row exactly `hours` old still counts)
    nothing = F.lit(0).cast("decimal(28,8)")
    events = F.array(
        F.struct(F.col("__at").alias("t"), F.lit(0).alias("kind"), F.col("__enters").alias("d"), F.col("__amount").alias("a")),
        F.struct((F.col("__at") + width).alias("t"), F.lit(2).alias("kind"), F.col("__leaves").alias("d"), (-F.col("__amount")).cast("decimal(28,8)").alias("a")),
        F.struct(F.when(F.col("__bucket") == F.col("__home"), F.col("__at")).alias("t"), F.lit(1).alias("kind"), F.lit(0).alias("d"), nothing.alias("a")),
    )
    flat = rows.select(*keys, "__bucket", "__ts", F.explode(events).alias("e")).filter("e.t is not null")
    so_far = Window.partitionBy(*keys, "__bucket").orderBy("e.t", "e.kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    read = flat.withColumn("n", F.sum("e.d").over(so_far)).withColumn("total", F.sum("e.a").over(so_far)).filter("e.kind = 1")
    return read.select(*keys, F.col("__ts").alias(ts), "n", "total")


def trailing_totals_by_frame(df: DataFrame, keys: list[str], ts: str, hours: int, amount: str, item: str | None = None) -> DataFrame:
    """The same by a sliding RANGE frame: shorter, and quadratic in the rows of a window."""
    frame = f"partition by {', '.join(keys)} order by {ts} range between interval {hours} hours preceding and current row"
    n = f"size(collect_set({item}) over ({frame}))" if item else f"count(*) over ({frame})"
    return df.select(*keys, ts, F.expr(n).cast("bigint").alias("n"), F.expr(f"sum(cast({amount} as decimal(28,8))) over ({frame})").alias("total"))

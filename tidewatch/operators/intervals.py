"""Events of one table that follow those of another within a bounded time: as pairs, or as the first at which their running total is large enough."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exact, seconds


def within_hours(first: DataFrame, second: DataFrame, key: tuple[str, str], ts: tuple[str, str], hours: int) -> DataFrame:
    """Pairs with equal keys and second's time in (first's, first's + hours].

    Both sides carry the time bucket of one window's length as a second join key, the first side also the next one, so the
    pairs looked at are those of two buckets and not of a key's whole history.
    """
    width = hours * 3600
    at = F.floor(seconds(F.col(ts[0])) / width).cast("bigint")
    left = first.withColumn("__bucket", F.explode(F.array(at, at + 1)))
    right = second.withColumn("__slot", F.floor(seconds(F.col(ts[1])) / width).cast("bigint"))
    near = (F.col(ts[1]) > F.col(ts[0])) & (F.col(ts[1]) <= F.col(ts[0]) + F.expr(f"interval {hours} hours"))
    return left.join(right, (F.col(key[0]) == F.col(key[1])) & (F.col("__bucket") == F.col("__slot")) & near).drop("__bucket", "__slot")


def first_reaching(needs: DataFrame, flows: DataFrame, hours: int, bucket_windows: int = 8) -> DataFrame:
    """id, at and total: for each need, the first flow of its account, to another party than its own, with which the total since the need reaches its amount within the window.

    needs are (id, account, party, at, need), flows (account, party, at, tie, amount): times in seconds, amounts decimals, flows none below 0, needs above 0; flows
    of one time are ordered by tie. Only flows after the need's time count, up to `hours` later; a need that is not reached gives no row.

    No need meets a flow in a join. The total that counts is a difference of prefix sums: of all flows of the account, less those to the need's party. It never
    falls, so the flow sought is the first whose sum is high enough. Sorted by value instead of time, each need finds it as its nearest neighbour: first among the
    flows to its own party, which tells what is to be taken off, then among all flows. Each row of either table is one row in every sort, in its time
    bucket (flows also in the bucket before, where they still can follow a need).
    """
    width = hours * 3600
    span = width * bucket_windows
    money = "decimal(28,8)"  # differences of wider ones would lose places
    bucket = lambda c: F.floor(c / span).cast("bigint")
    out = flows.withColumn("bucket", F.explode(F.sequence(bucket(F.col("at") - width), bucket(F.col("at")))))
    key, own = ["account", "bucket"], ["account", "bucket", "party"]
    by_time = lambda keys: Window.partitionBy(*keys).orderBy("at", "kind", "tie").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = needs.select("id", "account", bucket(F.col("at")).alias("bucket"), "party", "at", F.lit(1).alias("kind"), F.lit(None).cast("bigint").alias("tie"), F.col("need").cast(money).alias("need"), F.lit(0).cast(money).alias("amount"))
    rows = rows.unionByName(out.select(F.lit(None).cast(needs.schema["id"].dataType).alias("id"), "account", "bucket", "party", "at", F.lit(0).alias("kind"), F.col("tie").cast("bigint").alias("tie"), F.lit(None).cast(money).alias("need"), F.col("amount").cast(money).alias("amount")))
    # at one time flows come before needs: they don't follow them
    rows = rows.withColumn("all", F.sum("amount").over(by_time(key)).cast(money)).withColumn("theirs", F.sum("amount").over(by_time(own)).cast(money))
    rows = rows.withColumn("base", F.col("all") - F.col("theirs"))
    need = F.col("kind") == 1
    # by falling value, flows before needs and late ones before early ones: the last flow seen is the first one that is high enough
    falling = lambda keys: Window.partitionBy(*keys).orderBy(F.desc("value"), "kind", F.desc("at"), F.desc("tie")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("value", F.when(need, F.col("base") + F.col("need")).otherwise(F.col("base")).cast(money))
    taken = F.last(F.when(~need, F.col("theirs") - F.col("amount")), ignorenulls=True).over(falling(own))
    whole = F.max(F.when(~need, F.col("theirs"))).over(Window.partitionBy(*own))
    rows = rows.withColumn("off", F.when(need, F.coalesce(taken, whole, F.lit(0).cast(money))))
    rows = rows.withColumn("value", F.when(need, F.col("value") + F.col("off")).otherwise(F.col("all")).cast(money))
    found = F.last(F.when(~need, F.struct("at", "all")), ignorenulls=True).over(falling(key))
    reached = rows.withColumn("flow", found).filter(need & (F.col("flow.at") <= F.col("at") + width))
    return reached.select("id", F.col("flow.at").alias("at"), (F.col("flow.all") - F.col("off") - F.col("base")).alias("total"))


def least_decimal(x, scale: int = 8):
    """The least decimal of this scale that is, as a double, not below the double x: so that totals compare as they would as doubles."""
    near = exact(x, scale)
    return F.when(near.cast("double") >= x, near).otherwise(near + F.lit(f"1e-{scale}").cast(f"decimal(28,{scale})"))

"""Raw transaction tables derived from a generic event table, so that the engine runs where no bank data is at hand."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PATTERN_TYPES = ("FAN-OUT", "FAN-IN", "GATHER-SCATTER", "SCATTER-GATHER", "CYCLE", "BIPARTITE", "STACK", "RANDOM")


def _transactions(events: DataFrame) -> DataFrame:
    users = events.agg(F.countDistinct("user_id").alias("nu"))  # one row
    e = events.withColumn("k", F.regexp_extract("props", "([0-9]+)", 1).cast("bigint")).crossJoin(F.broadcast(users))
    k, u = F.col("k"), F.col("user_id")
    dst = F.when(k < 12, u).when(k < 40, (u + 1 + k % 3) % F.col("nu")).when(k < 60, F.expr("event_id div 40") % F.col("nu")).otherwise((u * 3 + k) % F.col("nu"))
    e = e.withColumn("dst", dst)
    amount = F.round(F.greatest("value", F.lit(0.01)) * F.when(k % 10 == 0, 200).otherwise(40), 2).cast("decimal(18,2)").cast("string")
    third = F.when(F.col("event_id") % 4 == 0, "Euro").when(F.col("event_id") % 4 == 1, "UK Pound").otherwise("US Dollar")
    kind = F.col("event_type")
    paid_by = F.when(kind == "error", "Cash").when(kind == "click", "ACH").when(kind == "view", "Wire").when(kind == "signup", "Cheque").otherwise("Credit Card")
    padded = lambda c: F.concat(F.lit("0"), (c % 10).cast("string"))
    return e.select(
        "event_id",
        F.date_format("ts", "yyyy/MM/dd HH:mm").alias("timestamp"),
        padded(u).alias("from_bank"), F.concat(F.lit("U"), u.cast("string")).alias("from_account"),
        padded(F.col("dst")).alias("to_bank"), F.concat(F.lit("U"), F.col("dst").cast("string")).alias("to_account"),
        amount.alias("amount_received"), third.alias("receiving_currency"),
        amount.alias("amount_paid"), F.when(k % 25 == 0, "Canadian Dollar").otherwise(third).alias("payment_currency"),
        F.when(u == F.col("dst"), "Reinvestment").otherwise(paid_by).alias("payment_format"),
        F.when((F.col("event_id") * 7919 + k * 31) % 97 < 2, "1").otherwise("0").alias("is_laundering"),
    )


def raw_from_events(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """transactions, accounts and patterns of the raw layer, all strings but pattern_id."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    moved = _transactions(events)
    u = F.col("u")
    accounts = events.select(F.col("user_id").alias("u")).distinct().select(
        F.concat(F.when(u % 3 == 0, "Brazil").when(u % 3 == 1, "Canada").otherwise("Spain"), F.lit(" Bank #"), (u % 10).cast("string")).alias("bank_name"),
        (u % 10).cast("string").alias("bank_id"), F.concat(F.lit("U"), u.cast("string")).alias("account_number"), F.concat(F.lit("E"), F.expr("u div 2").cast("string")).alias("entity_id"),
        F.concat(F.when(u % 3 == 0, "Corporation").when(u % 3 == 1, "Partnership").otherwise("Sole Proprietorship"), F.lit(" #"), u.cast("string")).alias("entity_name"),
    )
    pid = F.expr("event_id div 500 + 1")
    kinds = F.array(*[F.lit(t) for t in PATTERN_TYPES])
    patterns = moved.filter("is_laundering = '1' and event_id % 5 < 3").select(pid.alias("pattern_id"), F.get(kinds, (pid % 8).cast("int")).alias("pattern_type"), *[c for c in moved.columns if c != "event_id"])
    return {"transactions": moved.drop("event_id"), "accounts": accounts, "patterns": patterns}

"""Structuring as a stream: sliding windows with a watermark. It alerts for windows that end on a step, where the batch rule has one at every payment."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import grouped
from ..plans.params import StructuringParams


def structuring_stream(payments: DataFrame, p: StructuringParams = StructuringParams(), step_hours: int = 6, late_hours: int = 24) -> DataFrame:
    """Alerts from a stream of payments (account_id, ts timestamp, amount_usd); later than late_hours is dropped."""
    band = payments.filter((F.col("amount_usd") >= F.lit(p.floor_usd)) & (F.col("amount_usd") < F.lit(float(p.threshold_usd))))
    w = F.window("ts", f"{p.window_hours} hours", f"{step_hours} hours")
    found = band.withWatermark("ts", f"{late_hours} hours").groupBy("account_id", w).agg(F.count("*").alias("n"), F.sum("amount_usd").alias("usd"), F.max("ts").alias("alert_ts")).filter(F.col("n") >= p.min_txns)
    reason = F.concat(F.lit("structuring: "), F.col("n").cast("string"), F.lit(f" payments within {p.window_hours}h, "), grouped(F.col("usd")), F.lit(" USD total"))
    return found.select(F.lit("rule_structuring").alias("rule_id"), "account_id", "alert_ts", F.col("n").cast("double").alias("score"), reason.alias("reason"))

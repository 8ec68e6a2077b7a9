"""A small hand-made case for each rule, with parameters of its own: what must hold before a rule is worth evaluating on data."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import rules
from .params import BaselineParams, CycleParams, FanParams, PassThroughParams, StructuringParams

START = datetime(2024, 3, 1)


def _at(hours: float) -> datetime:
    return START + timedelta(hours=hours)


def _edges(spark: SparkSession, rows: list[tuple[float, str, str, float]]) -> DataFrame:
    cells = [(k, _at(h), a, b, usd, 0) for k, (h, a, b, usd) in enumerate(rows)]
    return spark.createDataFrame(cells, "txn_id long, txn_ts timestamp_ntz, src string, dst string, amount_usd double, is_laundering int")


def _fan(spark: SparkSession) -> tuple[DataFrame, set]:
    rows = [(k, f"s{k}", "collects", 50.0) for k in range(3)] + [(k, "spreads", f"r{k}", 50.0) for k in (0, 4, 8)]
    rows += [(k, "one", "repeats", 50.0) for k in range(5)] + [(9.0 * k, f"t{k}", "slow", 50.0) for k in range(4)]
    return rules.fan_in_out(_edges(spark, rows), FanParams(3, 8)), {("collects", _at(2)), ("spreads", _at(8))}


def _structuring(spark: SparkSession) -> tuple[DataFrame, set]:
    rows = [("low", h, 9_400.0, False) for h in (0, 20, 40)] + [("spread", h, 9_400.0, False) for h in (0, 60, 120)] + [("own", h, 9_400.0, True) for h in (0, 1, 2)] + [("above", h, 10_000.0, False) for h in (0, 1, 2)]
    txns = spark.createDataFrame([(a, _at(h), usd, own) for a, h, usd, own in rows], "from_account_id string, txn_ts timestamp_ntz, amount_usd double, is_self_transfer boolean")
    return rules.structuring(txns, StructuringParams(10_000, 0.1, 3, 48)), {("low", _at(40))}


def _pass_through(spark: SparkSession) -> tuple[DataFrame, set]:
    rows = [(0, "a", "mule", 8_000.0), (1, "mule", "b", 4_000.0), (2, "mule", "c", 3_000.0), (0, "a", "returns", 8_000.0), (1, "returns", "a", 8_000.0), (0, "a", "late", 8_000.0), (30, "late", "b", 8_000.0)]
    return rules.pass_through(_edges(spark, rows), PassThroughParams(5_000, 0.8, 24)), {("mule", _at(2))}


def _cycles(spark: SparkSession) -> tuple[DataFrame, set]:
    rows = [(0, "a", "b", 900.0), (1, "b", "c", 900.0), (2, "c", "a", 900.0), (2, "d", "e", 900.0), (1, "e", "f", 900.0), (3, "f", "d", 900.0), (0, "g", "h", 900.0), (1, "h", "g", 900.0)]
    profile = spark.createDataFrame([(n, 2, 2) for n in "abcdefgh"], "account_id string, out_degree long, in_degree long")
    return rules.cycles(_edges(spark, rows), profile, CycleParams(3, 4, 500, 24, 5, None)), {(n, _at(2)) for n in "abc"}


def _baseline(spark: SparkSession) -> tuple[DataFrame, set]:
    days = {"jumps": [900, 1_000, 1_100, 9_000], "grows": [2_000, 4_000, 6_000, 8_000], "new": [900, 9_000], "small": [10, 10, 10, 90]}
    rows = [(a, _at(24 * k).date(), float(x), 0.0) for a, xs in days.items() for k, x in enumerate(xs)]
    daily = spark.createDataFrame(rows, "account_id string, day date, sent_usd double, recv_usd double")
    return rules.baseline_anomaly(daily, BaselineParams(3, 3, 5_000)), {("jumps", _at(72))}


FIXTURES = {"rule_fan_in_out": _fan, "rule_structuring": _structuring, "rule_pass_through": _pass_through, "rule_cycles": _cycles, "rule_baseline_anomaly": _baseline}


def faults(spark: SparkSession, rule_id: str) -> list[str]:
    """What a rule's fixture finds wrong, one line each; none for a rule without a fixture. Accounts, times, scores and reasons are looked at."""
    if rule_id not in FIXTURES:
        return []
    alerts, want = FIXTURES[rule_id](spark)
    rows = alerts.withColumn("alert_ts", F.col("alert_ts").cast("timestamp_ntz")).collect()
    got = {(r.account_id, r.alert_ts) for r in rows}
    out = [f"missing: {a} at {t}" for a, t in sorted(want - got)] + [f"not expected: {a} at {t}" for a, t in sorted(got - want)]
    return out + [f"no score or reason: {r.account_id}" for r in rows if not r.score or not r.reason or r.rule_id != rule_id]

"""Detection rules: each gives alerts of one shape, with a score and a reason."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import exact, grouped, plain, seconds
from ..operators.intervals import first_reaching, least_decimal
from ..operators.medians import earlier_medians
from ..operators.trailing import trailing_totals
from ..operators.walks import closed_walks
from .params import BaselineParams, CycleParams, FanParams, PassThroughParams, StructuringParams

ALERT = T.StructType([T.StructField("rule_id", T.StringType()), T.StructField("account_id", T.StringType()), T.StructField("alert_ts", T.TimestampNTZType()), T.StructField("score", T.DoubleType()), T.StructField("reason", T.StringType())])
REAL_RULES = ("rule_fan_in_out", "rule_structuring", "rule_pass_through", "rule_cycles", "rule_baseline_anomaly")
HEADLINE_RULES = REAL_RULES[:4]
WIRED_RULES = ("rule_dummy_all", "rule_dummy_none", *REAL_RULES)
COMBINED = {"combined_excl_baseline": HEADLINE_RULES, "combined_incl_baseline": REAL_RULES}
TARGETS = (*WIRED_RULES, *COMBINED)


def _alerts(df: DataFrame, rule: str, score: Column, *reason: Column | str) -> DataFrame:
    text = F.concat(*[F.lit(r) if isinstance(r, str) else r.cast("string") for r in reason])
    return df.select(F.lit(rule).alias("rule_id"), "account_id", "alert_ts", score.cast("double").alias("score"), text.alias("reason"))


def fan_in_out(edge: DataFrame, p: FanParams = FanParams()) -> DataFrame:
    """Accounts that meet at least k different counterparties in a trailing window, as receivers or senders; one alert for each side and day, with the day's peak.

    A window lies in two neighbouring time buckets of its length, so what stands in buckets that don't meet k counterparties with either neighbour
    leaves before the window: no window that meets k reads it. Of equal peaks the earliest gives the amount.
    """
    sides = [("in", "dst", "src"), ("out", "src", "dst")]
    rows = reduce(DataFrame.unionByName, [edge.select(F.lit(s).alias("side"), F.col(me).alias("account_id"), F.col(other).alias("counterparty"), "txn_ts", "amount_usd") for s, me, other in sides])
    rows = rows.withColumn("bucket", F.floor(seconds(F.col("txn_ts")) / (p.window_hours * 3600)).cast("bigint"))
    met = rows.groupBy("side", "account_id", "bucket").agg(F.countDistinct("counterparty").alias("n"))
    by_time = Window.partitionBy("side", "account_id").orderBy("bucket")
    beside = [F.when(F.abs(of("bucket").over(by_time) - F.col("bucket")) == 1, of("n").over(by_time)).otherwise(0) for of in (F.lag, F.lead)]
    wide = met.withColumn("most", F.col("n") + F.greatest(*beside)).filter(F.col("most") >= p.min_counterparties).select("side", "account_id", "bucket")
    near = rows.join(wide, ["side", "account_id", "bucket"], "left_semi")
    seen = trailing_totals(near, ["side", "account_id"], "txn_ts", p.window_hours, "amount_usd", "counterparty").filter(F.col("n") >= p.min_counterparties)
    daily = seen.groupBy("side", "account_id", F.to_date("txn_ts").alias("day")).agg(F.min("txn_ts").alias("alert_ts"), F.max("n").alias("peak"), F.min_by("total", F.struct(-F.col("n"), F.col("txn_ts"))).alias("usd"))
    who = F.when(F.col("side") == "in", F.concat(F.lit("fan-in: "), F.col("peak").cast("string"), F.lit(" distinct senders"))).otherwise(F.concat(F.lit("fan-out: "), F.col("peak").cast("string"), F.lit(" distinct receivers")))
    return _alerts(daily, "rule_fan_in_out", F.col("peak"), who, f" within {p.window_hours}h, ", grouped(F.col("usd").cast("double")), " USD in that window")


def structuring(txns: DataFrame, p: StructuringParams = StructuringParams()) -> DataFrame:
    """Several payments just below a threshold within a trailing window; one alert for each account and day."""
    band = txns.filter(~F.col("is_self_transfer") & (F.col("amount_usd") >= F.lit(p.floor_usd)) & (F.col("amount_usd") < F.lit(float(p.threshold_usd))))
    seen = trailing_totals(band.select(F.col("from_account_id").alias("account_id"), "txn_ts", "amount_usd"), ["account_id"], "txn_ts", p.window_hours, "amount_usd").filter(F.col("n") >= p.min_txns)
    daily = seen.groupBy("account_id", F.to_date("txn_ts").alias("day")).agg(F.min("txn_ts").alias("alert_ts"), F.max("n").alias("peak"), F.min_by("total", F.struct(-F.col("n"), F.col("txn_ts"))).alias("usd"))
    bounds = f" payments of {p.floor_usd:,.0f}-{float(p.threshold_usd):,.0f} USD within {p.window_hours}h, "
    return _alerts(daily, "rule_structuring", F.col("peak"), "structuring: ", F.col("peak"), bounds, grouped(F.col("usd").cast("double")), " USD total")


def pass_through(edge: DataFrame, p: PassThroughParams = PassThroughParams()) -> DataFrame:
    """Money that soon leaves again to others than its sender; alert at the payment that completes the ratio, one for each account and day. Payments of no or less money don't count as forwarded."""
    into = edge.filter(F.col("amount_usd") >= F.lit(float(p.min_amount_usd))).select(F.struct(F.col("dst").alias("account_id"), F.col("amount_usd").alias("a_in")).alias("id"), F.col("dst").alias("account"), F.col("src").alias("party"), seconds(F.col("txn_ts")).alias("at"))
    needs = into.withColumn("need", least_decimal(F.lit(float(p.forward_ratio)) * F.col("id.a_in")))
    flows = edge.filter("amount_usd > 0").select(F.col("src").alias("account"), F.col("dst").alias("party"), seconds(F.col("txn_ts")).alias("at"), F.col("txn_id").alias("tie"), exact(F.col("amount_usd")).alias("amount"))
    reached = first_reaching(needs.filter("need > 0"), flows, p.window_hours)
    moment = F.timestamp_add("SECOND", F.col("at"), F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))
    hits = reached.select("id.account_id", "id.a_in", moment.alias("alert_ts"), F.col("total").cast("double").alias("forwarded"))
    daily = hits.groupBy("account_id", F.to_date("alert_ts").alias("day")).agg(F.min("alert_ts").alias("alert_ts"), F.max(F.struct("forwarded", "a_in")).alias("best"))
    a_in, sent = F.col("best.a_in"), F.col("best.forwarded")
    return _alerts(daily, "rule_pass_through", sent, "pass-through: ", grouped(a_in), " USD received, ", grouped(sent), " USD (", plain(F.lit(100) * sent / a_in), f"%) forwarded to other accounts within {p.window_hours}h")


def cycle_edges(edge: DataFrame, profile: DataFrame, p: CycleParams = CycleParams()) -> DataFrame:
    """The payments that can be part of a cycle: large enough, between no hubs, from accounts that also receive to accounts that also send."""
    hubs = profile.filter((F.col("out_degree") > p.max_degree) | (F.col("in_degree") > p.max_degree)).select("account_id")
    e = edge.filter(F.col("amount_usd") >= F.lit(float(p.min_amount_usd))).select("src", "dst", "txn_ts", "amount_usd")
    e = e.join(hubs.withColumnRenamed("account_id", "src"), "src", "left_anti").join(hubs.withColumnRenamed("account_id", "dst"), "dst", "left_anti")
    return e.join(e.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(e.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi")


def cycles(edge: DataFrame, profile: DataFrame, p: CycleParams = CycleParams(), keep: Callable[[str, DataFrame], DataFrame] | None = None) -> DataFrame:
    """Payments that run in a loop back to their start; every member alerts at the closing payment, once a day, with the loop of the largest smallest leg (of equal ones the shortest).

    `keep` (name, frame) should store the payments, which then are pruned to those that can close a loop, and the shorter half walks. Such a search is whole however many
    half walks there are: their number grows with the payments, so no fixed budget may end it. Without `keep` nothing is pruned, and each length is counted from the payments on and held against the row budget.
    """
    loops = closed_walks(cycle_edges(edge, profile, p), p.min_hops, p.max_hops, p.window_hours, None if keep else p.row_budget, keep)
    members = loops.select(F.explode("path").alias("account_id"), "hops", "closed_ts", "smallest")
    daily = members.groupBy("account_id", F.to_date("closed_ts").alias("day")).agg(F.min("closed_ts").alias("alert_ts"), F.min(F.struct(-F.col("smallest"), F.col("hops"))).alias("best"), F.count("*").alias("n"))
    leg = F.lit(-1) * F.col("best.col1")
    return _alerts(daily, "rule_cycles", leg, "cycle: ", F.col("best.hops"), f"-hop loop back to the same account within {p.window_hours}h, smallest leg ", grouped(leg), " USD (", F.col("n"), " cycle(s) that day)")


def baseline_anomaly(daily: DataFrame, p: BaselineParams = BaselineParams()) -> DataFrame:
    """Days on which an account moves a multiple of the median of its own earlier active days."""
    d = daily.select("account_id", "day", (F.col("sent_usd") + F.col("recv_usd")).alias("total"))
    d = earlier_medians(d, ["account_id"], ["day"], "total", "n_hist", "usual")
    d = d.filter((F.col("n_hist") >= p.min_history_days) & (F.col("total") >= F.lit(float(p.min_usd))) & (F.col("usual") > 0) & (F.col("total") >= F.lit(float(p.ratio)) * F.col("usual")))
    d = d.withColumn("alert_ts", F.col("day").cast("timestamp_ntz"))
    times = F.try_divide(F.col("total"), F.col("usual"))
    return _alerts(d, "rule_baseline_anomaly", times, "baseline anomaly: ", grouped(F.col("total")), " USD moved in a day, ", plain(times, 1), "x the median of its ", F.col("n_hist"), " earlier active days (", grouped(F.col("usual")), " USD)")


def dummy_all(activity: DataFrame) -> DataFrame:
    return _alerts(activity.withColumn("alert_ts", F.col("day").cast("timestamp_ntz")), "rule_dummy_all", F.lit(1.0), "dummy: alert every active account (harness check)")


def dummy_none(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], ALERT)


def combined(alerts: DataFrame, rule_id: str, rules: tuple[str, ...]) -> DataFrame:
    """One alert for each account and day on which any of the rules fired; the score is the number of different rules."""
    names = F.array_sort(F.collect_set("rule_id"))  # at most as many as there are rules
    days = alerts.filter(F.col("rule_id").isin(*rules)).groupBy("account_id", F.to_date("alert_ts").alias("day")).agg(F.min("alert_ts").alias("alert_ts"), names.alias("names"))
    return _alerts(days, rule_id, F.size("names"), "combined: ", F.array_join("names", ", "))

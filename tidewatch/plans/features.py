"""Point-in-time features of accounts: every f_ column comes from the split's own days only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import day_number, exact
from .evaluate import in_splits, numbered_alerts, split_days
from .layers import usd_sum
from .rules import REAL_RULES


def alert_features(labels: DataFrame, accounts: DataFrame, txns: DataFrame, activity: DataFrame, daily: DataFrame, alerts: DataFrame, tune_last_day: int = 7) -> DataFrame:
    """One row for each account of the splits tune and validate: label, 24 f_ and 10 rf_ columns."""
    key = ["split", "account_id"]
    real = F.col("split") != "all"
    t = in_splits(txns, tune_last_day).filter(real)
    moved = t.filter(~F.col("is_self_transfer"))

    def side(me: str, other: str, name: str, extra: list) -> DataFrame:
        return moved.groupBy("split", F.col(me).alias("account_id")).agg(
            F.count("*").alias(f"n_{name}"), usd_sum(F.col("amount_usd")).alias(f"{name}_usd"), F.countDistinct(other).alias(f"deg_{name}"), F.max("amount_usd").alias(f"max_{name}"),
            (F.sum(exact(F.col("amount_usd"))).cast("double") / F.count("*")).alias(f"avg_{name}"),
            F.sum((F.col("format_risk_weight") >= 2).cast("int")).alias(f"risky_{name}"), F.sum(F.col("is_cross_currency").cast("int")).alias(f"cross_{name}"), *extra,
        )

    sent = side("from_account_id", "to_account_id", "sent", [F.countDistinct("payment_currency").alias("n_currencies")])
    recv = side("to_account_id", "from_account_id", "recv", [])
    own = t.filter("is_self_transfer").groupBy("split", F.col("from_account_id").alias("account_id")).agg(F.count("*").alias("n_self"))
    act = in_splits(activity, tune_last_day).filter(real).groupBy(*key).agg(F.count("*").alias("active_days"), F.max("n_txns").alias("max_txns_day"), F.min("day_index").alias("first_day"))
    start = activity.agg(F.min("day").alias("d0"), F.max("day_index").alias("last_day"))  # one row
    days = daily.crossJoin(F.broadcast(start)).withColumn("day_index", day_number(F.col("day"), F.col("d0")))
    cp = in_splits(days, tune_last_day).filter(real).groupBy(*key).agg(F.max("sent_distinct_counterparties").alias("max_sent_cp"), F.max("recv_distinct_counterparties").alias("max_recv_cp"))
    found = in_splits(numbered_alerts(alerts.filter(F.col("rule_id").isin(*REAL_RULES)), activity), tune_last_day).filter(real)
    per_rule = [x for r in REAL_RULES for x in (F.count_if(F.col("rule_id") == r).alias(f"rf_{r}_n"), F.max(F.when(F.col("rule_id") == r, F.col("score"))).alias(f"rf_{r}_max"))]
    rules = found.groupBy(*key).agg(*per_rule)

    bounds = {name: (lo, hi) for name, lo, hi in split_days(tune_last_day) if name != "all"}
    base = labels.filter(real).crossJoin(F.broadcast(start)).join(accounts.select("account_id", "entity_type", "bank_country"), "account_id")
    lo = reduce(lambda c, s: c.when(F.col("split") == s, bounds[s][0]), bounds, F)
    hi = reduce(lambda c, s: c.when(F.col("split") == s, bounds[s][1]), bounds, F)
    base = base.withColumn("day_from", lo).withColumn("n_days", F.least(hi, F.col("last_day")) - F.col("day_from") + 1)
    x = reduce(lambda a, b: a.join(b, key, "left"), [sent, recv, own, act, cp, rules], base)
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    n_days = F.col("n_days")
    both = F.nullif(zero("n_sent") + zero("n_recv"), F.lit(0))
    f = {
        "n_sent": zero("n_sent"), "n_recv": zero("n_recv"), "sent_usd": zero("sent_usd"), "recv_usd": zero("recv_usd"), "out_degree": zero("deg_sent"), "in_degree": zero("deg_recv"),
        "max_sent_usd": zero("max_sent"), "max_recv_usd": zero("max_recv"), "avg_sent_usd": zero("avg_sent"), "avg_recv_usd": zero("avg_recv"), "n_self": zero("n_self"), "n_currencies": zero("n_currencies"),
        "sent_recv_ratio": (zero("sent_usd") + 1) / (zero("recv_usd") + 1),
        "frac_risky_format": (zero("risky_sent") + zero("risky_recv")) / both, "frac_cross_currency": (zero("cross_sent") + zero("cross_recv")) / both,
        "active_days": zero("active_days"), "max_txns_day": zero("max_txns_day"), "first_day_frac": (F.col("first_day") - F.col("day_from")) / n_days,
        "max_sent_cp_day": zero("max_sent_cp"), "max_recv_cp_day": zero("max_recv_cp"),
        "n_sent_per_day": zero("n_sent") / n_days, "n_recv_per_day": zero("n_recv") / n_days, "sent_usd_per_day": zero("sent_usd") / n_days, "recv_usd_per_day": zero("recv_usd") / n_days,
    }
    rf = [zero(f"rf_{r}_{k}").alias(f"rf_{r}_{k}") for r in REAL_RULES for k in ("n", "max")]
    return x.select("split", "account_id", F.col("is_laundering_account").alias("label"), "entity_type", "bank_country", *[c.alias(f"f_{k}") for k, c in f.items()], *rf)

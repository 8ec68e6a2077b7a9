"""Evaluation of alerts on time splits, for all rules in one pass."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import day_number
from ..operators.ranges import discrete_quantiles
from .rules import TARGETS, WIRED_RULES

CUTOFFS = (0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 0.99)
LAST = 100_000


def split_days(tune_last_day: int) -> tuple[tuple[str, int, int], ...]:
    return (("all", 1, LAST), ("tune", 1, tune_last_day), ("validate", tune_last_day + 1, LAST))


def in_splits(df: DataFrame, tune_last_day: int) -> DataFrame:
    """Each row once for every split whose days include its day_index; no join."""
    has = [F.when(F.col("day_index").between(lo, hi), F.lit(name)) for name, lo, hi in split_days(tune_last_day)]
    return df.withColumn("split", F.explode(F.array_compact(F.array(*has))))


def split_labels(activity: DataFrame, tune_last_day: int) -> DataFrame:
    """Accounts active in a split, labelled only by transactions inside it."""
    s = in_splits(activity, tune_last_day).groupBy("split", "account_id").agg(F.sum("n_txns").alias("n_txns"), F.sum("n_laundering_txns").alias("n_laundering_txns"))
    return s.withColumn("is_laundering_account", F.col("n_laundering_txns") > 0)


def numbered_alerts(alerts: DataFrame, activity: DataFrame) -> DataFrame:
    start = activity.agg(F.min("day").alias("first_day"))  # one row
    return alerts.crossJoin(F.broadcast(start)).withColumn("day_index", day_number(F.to_date("alert_ts"), F.col("first_day"))).drop("first_day")


class Evaluation:
    """Alerts of many rules (tagged by rule_id) against population, labels and laundering transactions of each split.

    rules: those that get rows even if they never alert.
    """

    def __init__(self, alerts: DataFrame, activity: DataFrame, labels: DataFrame, txns: DataFrame, tune_last_day: int = 7, rules: tuple[str, ...] = TARGETS):
        spark = alerts.sparkSession
        self.rules = spark.createDataFrame([(r,) for r in rules], "rule_id string")
        self.pop = labels.select("split", "account_id", (F.col("n_laundering_txns") > 0).alias("is_lab"))
        self.rows = in_splits(numbered_alerts(alerts, activity), tune_last_day)
        self.accounts = self.rows.groupBy("rule_id", "split", "account_id").agg(F.max("score").alias("score")).join(self.pop, ["split", "account_id"])
        self.bad = in_splits(txns.filter("is_laundering = 1"), tune_last_day)

    def caught(self) -> DataFrame:
        """rule_id, split, txn_id of laundering transactions with an alerted account at either end."""
        ends = self.bad.select("split", "txn_id", "pattern_type", F.explode(F.array_distinct(F.array("from_account_id", "to_account_id"))).alias("account_id"))
        return ends.join(self.accounts.select("rule_id", "split", "account_id"), ["split", "account_id"]).select("rule_id", "split", "txn_id", "pattern_type").distinct()

    def performance(self) -> DataFrame:
        by = ["rule_id", "split"]
        pop = self.pop.groupBy("split").agg(F.count("*").alias("n_population"), F.sum(F.col("is_lab").cast("int")).alias("n_labelled_accounts"))
        rows = self.rows.groupBy(*by).agg(F.count("*").alias("n_alert_rows"))
        lab = F.col("is_lab").cast("int")
        hit = self.accounts.groupBy(*by).agg(F.count("*").alias("n_alerted_accounts"), F.sum(lab).alias("tp_accounts"))
        rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), "account_id"))
        top = self.accounts.withColumn("rk", rank).filter("rk <= 1000").groupBy(*by).agg(F.sum(F.when(F.col("rk") <= 100, lab)).alias("top100"), F.sum(lab).alias("top1000"))
        txn = self.bad.groupBy("split").agg(F.count("*").alias("n_laundering_txns"))
        got = self.caught().groupBy(*by).agg(F.count("*").alias("n_caught"))
        t = self.rules.crossJoin(F.broadcast(pop)).join(rows, by, "left").join(hit, by, "left").join(top, by, "left").join(F.broadcast(txn), "split", "left").join(got, by, "left")
        n, tp, lab_n, bad = F.col("n_alerted_accounts"), F.col("tp_accounts"), F.col("n_labelled_accounts"), F.col("n_laundering_txns")
        zero = lambda c: F.coalesce(c, F.lit(0))
        at = lambda c, k: F.when(n >= k, F.col(c) / F.lit(float(k)))
        return t.select(
            *by, "n_population", "n_labelled_accounts", zero(F.col("n_alert_rows")).alias("n_alert_rows"), zero(n).alias("n_alerted_accounts"), zero(tp).alias("tp_accounts"),
            (tp / F.nullif(n, F.lit(0))).alias("precision"), (zero(tp) / F.nullif(lab_n, F.lit(0))).alias("account_recall"), (zero(n) * F.lit(1000.0).cast("double") / F.col("n_population")).alias("alerts_per_1000_accounts"),
            "n_laundering_txns", (zero(F.col("n_caught")) / F.nullif(bad, F.lit(0))).alias("txn_recall"), at("top100", 100).alias("precision_at_100"), at("top1000", 1000).alias("precision_at_1000"),
        )

    def pattern_recall(self) -> DataFrame:
        kind = F.coalesce("pattern_type", F.lit("UNTAGGED")).alias("pattern_type")
        total = self.bad.groupBy("split", kind).agg(F.count("*").alias("n_laundering_txns"))
        got = self.caught().groupBy("rule_id", "split", kind).agg(F.count("*").alias("n_caught"))
        t = self.rules.crossJoin(F.broadcast(total)).join(got, ["rule_id", "split", "pattern_type"], "left").fillna(0, ["n_caught"])
        return t.select("rule_id", "split", "pattern_type", "n_laundering_txns", "n_caught", (F.col("n_caught") / F.col("n_laundering_txns")).alias("txn_recall"))

    def threshold_sensitivity(self) -> DataFrame:
        own = self.accounts.filter("split = 'all'")
        cuts = discrete_quantiles(own, ["rule_id"], "score", CUTOFFS).select("rule_id", F.col("probability").alias("cutoff_pct"), F.col("quantile").alias("score_cutoff"))
        base = self.pop.filter("split = 'all'").agg(F.count("*").alias("n_pop"), F.sum(F.col("is_lab").cast("int")).alias("n_lab"))  # one row
        lab = F.sum(F.col("is_lab").cast("int"))
        kept = own.join(F.broadcast(cuts), "rule_id").filter(F.col("score") >= F.col("score_cutoff"))  # cuts: at most 7 rows a rule
        t = kept.groupBy("rule_id", "cutoff_pct", "score_cutoff").agg(F.count("*").alias("n_alerted_accounts"), lab.alias("tp_accounts")).crossJoin(F.broadcast(base))
        n, tp = F.col("n_alerted_accounts"), F.col("tp_accounts")
        return t.select("rule_id", "cutoff_pct", "score_cutoff", "n_alerted_accounts", "tp_accounts", (tp / n).alias("precision"), (tp / F.nullif("n_lab", F.lit(0))).alias("account_recall"), (n * F.lit(1000.0).cast("double") / F.col("n_pop")).alias("alerts_per_1000_accounts"))


def rule_overlap(alerts: DataFrame, accounts: DataFrame, rules: tuple[str, ...] = WIRED_RULES) -> DataFrame:
    """All pairs of rules: accounts that both alert, over the whole window. An account's rules, seven at most, stand in one row, so no self-join."""
    spark = alerts.sparkSession
    own = alerts.filter(F.col("account_id").isNotNull() & F.col("rule_id").isin(*rules)).groupBy("account_id").agg(F.array_sort(F.collect_set("rule_id")).alias("r"))
    names = spark.createDataFrame([(a, b) for a in sorted(rules) for b in sorted(rules) if a < b], "rule_a string, rule_b string")
    size = own.select(F.explode("r").alias("rule")).groupBy("rule").agg(F.count("*").alias("n"))
    pairs = own.withColumn("p", F.explode(F.expr("flatten(transform(r, a -> transform(filter(r, b -> b > a), b -> struct(a as rule_a, b as rule_b))))"))).select("account_id", "p.*")
    both = pairs.join(accounts.select("account_id", "is_laundering_account"), "account_id").groupBy("rule_a", "rule_b").agg(F.count("*").alias("n_both"), F.sum(F.col("is_laundering_account").cast("int")).alias("n_both_labelled"))
    a, b = size.select(F.col("rule").alias("rule_a"), F.col("n").alias("n_alerted_a")), size.select(F.col("rule").alias("rule_b"), F.col("n").alias("n_alerted_b"))
    t = names.join(a, "rule_a", "left").join(b, "rule_b", "left").join(both, ["rule_a", "rule_b"], "left").fillna(0)
    union = F.col("n_alerted_a") + F.col("n_alerted_b") - F.col("n_both")
    return t.select("rule_a", "rule_b", "n_alerted_a", "n_alerted_b", "n_both", "n_both_labelled", (F.col("n_both") / F.nullif(union, F.lit(0))).alias("jaccard"))

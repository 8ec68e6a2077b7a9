"""Data tests: each gives the rows that break it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import day_number
from ..sources import seeds
from .evaluate import in_splits
from .pipeline import Pipeline

LABEL_LIKE = ("label", "laundering", "pattern")


def not_null(df: DataFrame, *cols: str) -> DataFrame:
    return df.filter(reduce(lambda a, b: a | b, [F.col(c).isNull() for c in cols]))


def unique(df: DataFrame, *cols: str) -> DataFrame:
    return df.groupBy(*cols).agg(F.count("*").alias("n")).filter("n > 1")


def positive(df: DataFrame, col: str) -> DataFrame:
    return df.filter(F.col(col).isNull() | (F.col(col) <= 0))


def accepted(df: DataFrame, col: str, *values: str) -> DataFrame:
    return df.filter(F.col(col).isNotNull() & ~F.col(col).isin(*values))


def references(df: DataFrame, col: str, to: DataFrame, key: str) -> DataFrame:
    keys = to.select(F.col(key).alias(col)).distinct()
    return df.filter(F.col(col).isNotNull()).join(keys, col, "left_anti")


def same_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.subtract(b).withColumn("only_in", F.lit("first")).unionByName(b.subtract(a).withColumn("only_in", F.lit("second")))


def label_columns(df: DataFrame) -> list[str]:
    """Feature columns whose names betray a label."""
    return [c for c in df.columns if c.startswith(("f_", "rf_")) and any(w in c for w in LABEL_LIKE)]


# What each table's columns must be: (kind, columns) or (kind, column, more). The accepted values are fixed values of the file format.
COLUMNS = {
    "fx_rates": [("unique", "currency"), ("not_null", "currency", "usd_per_unit"), ("positive", "usd_per_unit")],
    "format_risk": [("unique", "payment_format"), ("not_null", "payment_format", "risk_weight")],
    "stg_transactions": [
        ("unique", "txn_id"), ("not_null", "txn_id", "txn_ts", "from_account_id", "to_account_id"), ("positive", "amount_paid", "amount_received"), ("accepted", "is_laundering", (0, 1)),
        *(("references", c, "stg_accounts", "account_id") for c in ("from_account_id", "to_account_id")), *(("references", c, "fx_rates", "currency") for c in ("payment_currency", "receiving_currency")), ("references", "payment_format", "format_risk", "payment_format"),
    ],
    "stg_accounts": [("unique", "account_id"), ("not_null", "account_id", "entity_id")],
    "stg_patterns": [("not_null", "pattern_id"), ("accepted", "pattern_type", ("FAN-OUT", "FAN-IN", "GATHER-SCATTER", "SCATTER-GATHER", "CYCLE", "BIPARTITE", "STACK", "RANDOM")), ("accepted", "is_laundering", (1,))],
    "int_txn_enriched": [("unique", "txn_id"), ("not_null", "txn_id", "amount_usd", "amount_received_usd", "format_risk_weight", "day_index"), ("positive", "amount_usd", "amount_received_usd"), ("references", "txn_id", "stg_transactions", "txn_id")],
    "int_edges": [("unique", "txn_id"), ("not_null", "txn_id", "src", "dst"), ("references", "txn_id", "stg_transactions", "txn_id"), *(("references", c, "stg_accounts", "account_id") for c in ("src", "dst"))],
    "int_account_daily": [("key", "account_id", "day"), ("not_null", "account_id", "day"), ("references", "account_id", "stg_accounts", "account_id")],
    "int_account_activity_days": [("key", "account_id", "day")],
    "int_account_profile": [("unique", "account_id"), ("not_null", "account_id", "is_laundering_account"), ("references", "account_id", "stg_accounts", "account_id")],
    "dim_account": [("unique", "account_id"), ("not_null", "account_id", "is_laundering_account"), ("references", "account_id", "stg_accounts", "account_id")],
    "fct_transactions": [("unique", "txn_id"), ("not_null", "txn_id"), ("positive", "amount_usd"), *(("references", c, "dim_account", "account_id") for c in ("from_account_id", "to_account_id"))],
    "fct_account_split_label": [("key", "split", "account_id"), ("not_null", "is_laundering_account"), ("accepted", "split", ("all", "tune", "validate")), ("references", "account_id", "dim_account", "account_id")],
    "fct_alert_features": [("key", "split", "account_id"), ("not_null", "label", "f_n_sent"), ("accepted", "split", ("tune", "validate"))],
    "fct_alerts": [("not_null", "rule_id", "account_id", "alert_ts", "score", "reason"), ("references", "account_id", "dim_account", "account_id")],
    "fct_alerts_combined_headline": [("not_null", "account_id", "reason"), ("references", "account_id", "dim_account", "account_id")],
    "fct_alerts_combined_all": [("not_null", "account_id", "reason"), ("references", "account_id", "dim_account", "account_id")],
    "fct_rule_performance": [("key", "rule_id", "split"), ("accepted", "split", ("all", "tune", "validate"))],
    "fct_rule_pattern_recall": [("key", "rule_id", "split", "pattern_type")],
    "fct_rule_overlap": [("key", "rule_a", "rule_b")],
}


def _table(p: Pipeline, name: str) -> DataFrame:
    spark = p.raw["transactions"].sparkSession
    return {"fx_rates": seeds.fx_rates, "format_risk": seeds.format_risk}[name](spark) if name in ("fx_rates", "format_risk") else getattr(p, name)


def column_checks(p: Pipeline) -> dict[str, DataFrame]:
    """One check for each column and kind, by `table.column.kind`."""
    out: dict[str, DataFrame] = {}
    for name, rules in COLUMNS.items():
        df = _table(p, name)
        for kind, *args in rules:
            if kind == "key":
                out[f"{name}.{'+'.join(args)}.unique"] = unique(df, *args)
            elif kind in ("unique", "not_null", "positive"):
                out |= {f"{name}.{c}.{kind}": {"unique": unique, "not_null": not_null, "positive": positive}[kind](df, c) for c in args}
            elif kind == "accepted":
                out[f"{name}.{args[0]}.accepted"] = accepted(df, args[0], *args[1])
            else:
                out[f"{name}.{args[0]}.references"] = references(df, args[0], _table(p, args[1]), args[2])
    return out


def audit(p: Pipeline) -> DataFrame:
    """(check, violations) for every column check: those that look at single rows in one pass a table, keys and references by one aggregate each."""
    parts = []
    singles = {"not_null": lambda c: F.col(c).isNull(), "positive": lambda c: F.col(c).isNull() | (F.col(c) <= 0)}
    all_ = column_checks(p)
    for name, rules in COLUMNS.items():
        marks = {f"{name}.{c}.{kind}": singles[kind](c) for kind, *args in rules if kind in singles for c in args}
        marks |= {f"{name}.{args[0]}.accepted": F.col(args[0]).isNotNull() & ~F.col(args[0]).isin(*args[1]) for kind, *args in rules if kind == "accepted"}
        if marks:
            counts = _table(p, name).agg(*[F.count_if(m).alias(f"m{k}") for k, m in enumerate(marks.values())])
            parts.append(counts.select(F.explode(F.array(*[F.struct(F.lit(check).alias("check"), F.col(f"m{k}").alias("violations")) for k, check in enumerate(marks)])).alias("r")).select("r.*"))
        parts += [df.agg(F.count("*").alias("violations")).select(F.lit(check).alias("check"), "violations") for check, df in all_.items() if check.startswith(f"{name}.") and check.endswith((".unique", ".references"))]
    return reduce(DataFrame.unionByName, parts)


def all_checks(p: Pipeline) -> dict[str, DataFrame]:
    """Reconciliations between layers and with the raw tables; all must be empty. column_checks has those of single columns."""
    t, e, prof = p.stg_transactions, p.int_txn_enriched, p.int_account_profile
    alerts, labels, feats, perf = p.fct_alerts, p.fct_account_split_label, p.fct_alert_features, p.fct_rule_performance
    start = t.agg(F.min("txn_date").alias("d0"))
    window = t.crossJoin(F.broadcast(start)).withColumn("day_index", day_number(F.col("txn_date"), F.col("d0"))).filter(F.col("day_index") <= p.params.tune_last_day)
    moved = window.filter(~F.col("is_self_transfer"))
    sent = moved.groupBy(F.col("from_account_id").alias("account_id")).agg(F.count("*").alias("x_sent"), F.countDistinct("to_account_id").alias("x_deg"))
    recv = moved.groupBy(F.col("to_account_id").alias("account_id")).agg(F.count("*").alias("x_recv"))
    own = window.filter("is_self_transfer").groupBy(F.col("from_account_id").alias("account_id")).agg(F.count("*").alias("x_self"))
    again = feats.filter("split = 'tune'").join(sent, "account_id", "left").join(recv, "account_id", "left").join(own, "account_id", "left").fillna(0, ["x_sent", "x_deg", "x_recv", "x_self"])
    bad_ends = e.filter("is_laundering = 1").select(F.explode(F.array("from_account_id", "to_account_id")).alias("account_id")).distinct()
    counts = lambda df, bad: df.agg(F.count("*").alias("n"), F.sum(F.col(bad).cast("int")).alias("bad"))
    staged = t.crossJoin(F.broadcast(start)).withColumn("day_index", day_number(F.col("txn_date"), F.col("d0"))).filter("is_laundering = 1").withColumn("account_id", F.explode(F.array("from_account_id", "to_account_id")))
    in_window = in_splits(staged, p.params.tune_last_day).select("split", "account_id").distinct()
    bad_staged = staged.select("account_id").distinct()
    accounts_of = lambda df: df.agg(F.count("*").alias("n"))
    whole = labels.filter("split = 'all' and is_laundering_account").select("account_id")
    return {
        "amounts_not_negative": t.filter("amount_paid < 0 or amount_received < 0"),
        "alert_reason": alerts.filter("reason is null or trim(reason) = ''"),
        "raw_and_staged_counts": same_rows(counts(p.raw["transactions"], "is_laundering"), counts(t, "is_laundering")),
        "staged_and_enriched_counts": same_rows(counts(t, "is_laundering"), counts(e, "is_laundering")),
        "patterns_all_matched": p.stg_patterns.join(e.select("pattern_id").distinct(), "pattern_id", "left_anti"),
        "profile_label": same_rows(prof.filter("is_laundering_account").select("account_id"), bad_ends),
        "split_label_whole_window": same_rows(whole, bad_ends),
        "features_point_in_time": again.filter("f_n_sent <> x_sent or f_n_recv <> x_recv or f_n_self <> x_self or f_out_degree <> x_deg").select("account_id"),
        "alert_account_in_accounts": references(alerts, "account_id", p.stg_accounts, "account_id"),
        "split_labels_in_window": same_rows(labels.filter("is_laundering_account").select("split", "account_id"), in_window),
        "mart_counts": same_rows(counts(t, "is_laundering"), counts(p.fct_transactions, "is_laundering")).select("n", "bad").unionByName(accounts_of(bad_staged).join(accounts_of(p.dim_account.filter("is_laundering_account").select("account_id")), "n", "left_anti").select("n", F.lit(None).cast("bigint").alias("bad"))),
        "dummies": perf.filter("(rule_id = 'rule_dummy_all' and (account_recall <> 1 or txn_recall <> 1 or n_alerted_accounts <> n_population or abs(precision - n_labelled_accounts / n_population) > 1e-12)) or (rule_id = 'rule_dummy_none' and (account_recall <> 0 or txn_recall <> 0 or n_alerted_accounts <> 0))"),
    }

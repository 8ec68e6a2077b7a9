"""The model as a registry of lazily built frames: each by name, built once."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from functools import cached_property, reduce

from pyspark.sql import DataFrame, SparkSession

from ..sources.events import raw_from_events
from ..sources.raw import load_raw
from . import evaluate, features, layers, rules
from .params import Params
from .storage import stored as stored


class Pipeline:
    """Raw tables to marts. Frames are plans: nothing runs until one is used.

    `keep` stores a frame that several others read (see stored and build); without it Spark plans each mart from the raw tables.
    """

    TABLES = ("stg_transactions", "stg_accounts", "stg_patterns", "int_txn_enriched", "int_edges", "int_account_daily", "int_account_activity_days", "int_account_profile", "rule_fan_in_out", "rule_structuring", "rule_pass_through", "rule_cycles", "rule_baseline_anomaly", "rule_dummy_all", "rule_dummy_none", "fct_alerts", "fct_alerts_combined_headline", "fct_alerts_combined_all", "fct_account_split_label", "dim_account", "fct_transactions", "fct_alert_features", "fct_rule_performance", "fct_rule_pattern_recall", "fct_rule_threshold_sensitivity", "fct_rule_overlap")
    SHARED = ("int_txn_enriched", "int_account_daily", "int_account_activity_days", "int_account_profile", "fct_alerts", "fct_account_split_label", "fct_alert_features")

    def __init__(self, raw: dict[str, DataFrame], params: Params = Params(), keep: Callable[[str, DataFrame], DataFrame] | None = None):
        self.raw, self.params, self.keep, self.keeps = raw, params, keep or (lambda name, df: df), keep is not None

    @classmethod
    def from_events(cls, spark: SparkSession, sf_dir: str, params: Params = Params(), **k) -> Pipeline:
        return cls(raw_from_events(spark, sf_dir), params, **k)

    @classmethod
    def from_files(cls, spark: SparkSession, folder: str, dataset: str = "hi", params: Params = Params(), **k) -> Pipeline:
        return cls(load_raw(spark, folder, dataset), params, **k)

    @cached_property
    def stg_transactions(self) -> DataFrame:
        return layers.staged_transactions(self.raw["transactions"])

    @cached_property
    def stg_accounts(self) -> DataFrame:
        return layers.staged_accounts(self.raw["accounts"])

    @cached_property
    def stg_patterns(self) -> DataFrame:
        return layers.staged_patterns(self.raw["patterns"])

    @cached_property
    def int_txn_enriched(self) -> DataFrame:
        return self.keep("int_txn_enriched", layers.enriched(self.stg_transactions, self.stg_patterns))

    @cached_property
    def int_edges(self) -> DataFrame:
        return layers.edges(self.int_txn_enriched)

    @cached_property
    def int_pair_days(self) -> DataFrame:
        return layers.pair_days(self.int_edges)

    @cached_property
    def int_account_daily(self) -> DataFrame:
        return self.keep("int_account_daily", layers.account_daily(self.int_pair_days))

    @cached_property
    def int_account_activity_days(self) -> DataFrame:
        return self.keep("int_account_activity_days", layers.activity_days(self.int_txn_enriched))

    @cached_property
    def int_account_profile(self) -> DataFrame:
        return self.keep("int_account_profile", layers.account_profile(self.stg_accounts, self.int_txn_enriched, self.int_pair_days))

    @cached_property
    def rule_fan_in_out(self) -> DataFrame:
        return rules.fan_in_out(self.int_edges, self.params.fan)

    @cached_property
    def rule_structuring(self) -> DataFrame:
        return rules.structuring(self.int_txn_enriched, self.params.structuring)

    @cached_property
    def rule_pass_through(self) -> DataFrame:
        return rules.pass_through(self.int_edges, self.params.pass_through)

    @cached_property
    def rule_cycles(self) -> DataFrame:
        if self.keeps:
            return rules.cycles(self.int_edges, self.int_account_profile, self.params.cycles, self.keep)
        return rules.cycles(self.int_edges, self.int_account_profile, replace(self.params.cycles, row_budget=None))  # a mere plan counts nothing

    @cached_property
    def rule_baseline_anomaly(self) -> DataFrame:
        return rules.baseline_anomaly(self.int_account_daily, self.params.baseline)

    @cached_property
    def rule_dummy_all(self) -> DataFrame:
        return rules.dummy_all(self.int_account_activity_days)

    @cached_property
    def rule_dummy_none(self) -> DataFrame:
        return rules.dummy_none(self.stg_transactions.sparkSession)

    @cached_property
    def fct_alerts(self) -> DataFrame:
        return self.keep("fct_alerts", reduce(DataFrame.unionByName, [getattr(self, r) for r in rules.WIRED_RULES]))

    @cached_property
    def fct_alerts_combined_headline(self) -> DataFrame:
        return rules.combined(self.fct_alerts, "combined_excl_baseline", rules.HEADLINE_RULES)

    @cached_property
    def fct_alerts_combined_all(self) -> DataFrame:
        return rules.combined(self.fct_alerts, "combined_incl_baseline", rules.REAL_RULES)

    @cached_property
    def fct_account_split_label(self) -> DataFrame:
        return self.keep("fct_account_split_label", evaluate.split_labels(self.int_account_activity_days, self.params.tune_last_day))

    @cached_property
    def dim_account(self) -> DataFrame:
        return layers.dim_account(self.int_account_profile, self.stg_accounts)

    @property
    def fct_transactions(self) -> DataFrame:
        return self.int_txn_enriched

    @cached_property
    def fct_alert_features(self) -> DataFrame:
        return self.keep("fct_alert_features", features.alert_features(self.fct_account_split_label, self.stg_accounts, self.int_txn_enriched, self.int_account_activity_days, self.int_account_daily, self.fct_alerts, self.params.tune_last_day))

    @cached_property
    def evaluation(self) -> evaluate.Evaluation:
        tagged = self.fct_alerts.unionByName(self.fct_alerts_combined_headline).unionByName(self.fct_alerts_combined_all)
        e = evaluate.Evaluation(tagged, self.int_account_activity_days, self.fct_account_split_label, self.int_txn_enriched, self.params.tune_last_day)
        e.accounts = self.keep("alerted_accounts", e.accounts)
        return e

    @cached_property
    def fct_rule_performance(self) -> DataFrame:
        return self.evaluation.performance()

    @cached_property
    def fct_rule_pattern_recall(self) -> DataFrame:
        return self.evaluation.pattern_recall()

    @cached_property
    def fct_rule_threshold_sensitivity(self) -> DataFrame:
        return self.evaluation.threshold_sensitivity()

    @cached_property
    def fct_rule_overlap(self) -> DataFrame:
        return evaluate.rule_overlap(self.fct_alerts, self.int_account_profile)


def evaluate_rule(pipeline: Pipeline, alerts: DataFrame, rule_id: str) -> dict[str, DataFrame]:
    """The three evaluations of one set of alerts, before it is wired in."""
    e = evaluate.Evaluation(alerts, pipeline.int_account_activity_days, pipeline.fct_account_split_label, pipeline.int_txn_enriched, pipeline.params.tune_last_day, (rule_id,))
    return {"performance": e.performance(), "pattern_recall": e.pattern_recall(), "threshold_sensitivity": e.threshold_sensitivity()}


def build(pipeline: Pipeline, folder: str, names: tuple[str, ...] = Pipeline.TABLES) -> dict[str, DataFrame]:
    """Write the tables; those that several others read are written first and read back, so no work is done twice."""
    out: dict[str, DataFrame] = {}

    def keep(name: str, df: DataFrame) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{folder}/{name}")
        return df.sparkSession.read.schema(df.schema).parquet(f"{folder}/{name}")

    pipeline.keep, pipeline.keeps = keep, True
    for name in names:
        df = getattr(pipeline, name)
        out[name] = df if name in pipeline.SHARED else keep(name, df)
    return out

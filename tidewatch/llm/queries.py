"""The registered queries of this subpackage and, where SQL can say the same, their oracle."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import sql

NAMES = {
    "op1_decontaminate": "decontaminate",
    "op2_sharding": "sharding",
    "op3_quality": "quality",
    "op4_toxicity": "toxicity",
    "op5_pii": "pii",
    "op6_lm_scoring": "lm_scoring",
    "op7_ngram_join": "ngram_join",
    "op8_media": "media",
    "op9_mixing": "mixing",
    "op10_url_filter": "url_filter",
    "op11_exact_dedup": "exact_dedup",
    "op12_fim": "fim",
    "op13_hard_negatives": "hard_negatives",
}


# Columns of the operators' results that SQL can say, over whole tables.
PARTS = {
    "part1_exact_leaks": ("op1_decontaminate", lambda df: df.filter("edits = 0").select("doc_id", "item_id", "item_words")),
    "part8_media_bytes": ("op8_media", lambda df: df.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "media_bytes", "media_sha256")),
    "part9_mix_targets": ("op9_mixing", lambda df: df.select("doc_id", "size", "source_size", F.round("target", 3).alias("target"))),
    "part10_url_rules": ("op10_url_filter", lambda df: df.select("page_id", "host", "path", "rule")),
}
ORACLES = {"op7_ngram_join": sql.NGRAM_JOIN, "part1_exact_leaks": sql.EXACT_LEAKS, "part8_media_bytes": sql.MEDIA_BYTES, "part9_mix_targets": sql.MIX_TARGETS, "part10_url_rules": sql.URL_RULES, "op11_exact_dedup": sql.EXACT_DEDUP, "op12_fim": sql.FIM, "op13_hard_negatives": sql.HARD_NEGATIVES}


def _late(name: str, module: str) -> Callable[[SparkSession, str], DataFrame]:
    """The query, its module imported when it is called: one that can't be imported fails alone."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return getattr(import_module(f"{__package__}.{module}"), name)(spark, sf_dir)

    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out = {name: _late(name, module) for name, module in NAMES.items()}
    return out | {name: (lambda spark, sf_dir, of=of, part=part: part(out[of](spark, sf_dir))) for name, (of, part) in PARTS.items()}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)

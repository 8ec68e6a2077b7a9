"""The comparison of a model with the rules at equal alert volume."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce
from math import log

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import hash_bucket
from ..operators import boosting
from ..operators.boosting import BoostParams
from ..operators.ranked_metrics import average_precision, top_n_shared
from .rules import HEADLINE_RULES, REAL_RULES
from .storage import stored

Scorer = Callable[[DataFrame], DataFrame]

ENTITY_TYPES = ("Corporation", "Partnership", "Sole Proprietorship")
BUDGETS = (1, 5, 10)  # alerts per 1,000 accounts
# Features that the data generator may give away.
ARTIFACTS = ("f_frac_risky_format", "f_frac_cross_currency", "f_n_self", "f_n_currencies")

# Whether rule features are in, and what is left out.
FEATURE_SETS = {"model_base": (False, ()), "model_base_rules": (True, ()), "model_no_artifacts": (False, ARTIFACTS)}


def train_group(account_id="account_id"):
    """7 of 10 accounts, by hash, so that no account is on both sides."""
    return hash_bucket(F.col(account_id)) < 7


def design(features: DataFrame, rules: bool = True, without: tuple[str, ...] = ()) -> tuple[DataFrame, list[str]]:
    """Numeric inputs: features (missing ones stay null) and one column for each entity type."""
    cols = [c for c in features.columns if (c.startswith("f_") or rules and c.startswith("rf_")) and c not in without]
    out = features.withColumns({c: F.col(c).cast("double") for c in cols})
    kinds = {f"entity_{t.replace(' ', '_')}": (F.col("entity_type") == t).cast("double") for t in ENTITY_TYPES}
    return out.withColumns({k: F.coalesce(v, F.lit(0.0)) for k, v in kinds.items()}), cols + list(kinds)


def training_rows(features: DataFrame) -> DataFrame:
    return features.filter((F.col("split") == "tune") & train_group())


def fit_sets(features: DataFrame, p: BoostParams = BoostParams(), sets: dict[str, tuple[bool, tuple[str, ...]]] = FEATURE_SETS, keep: Callable[[str, DataFrame], DataFrame] | None = None) -> dict[str, Scorer]:
    """Train a model for each feature set on the tune rows of the training group, all in the same passes; each gives what adds model_score to rows of features."""
    table = design(features)[0]
    columns = {name: design(features, rules, without)[1] for name, (rules, without) in sets.items()}
    models = boosting.fit(training_rows(table), "label", columns, keep or stored(features.sparkSession), p)
    return {name: (lambda rows, model=model: model.scored(design(rows)[0])) for name, model in models.items()}


def fit(features: DataFrame, p: BoostParams = BoostParams(), rules: bool = True, without: tuple[str, ...] = ()) -> Scorer:
    return fit_sets(features, p, {"model": (rules, without)})["model"]


def fit_and_score(features: DataFrame, p: BoostParams = BoostParams(), rules: bool = True, without: tuple[str, ...] = (), split: str = "validate") -> DataFrame:
    """Train as fit does, score the rows of a split whose accounts training did not see."""
    return fit(features, p, rules, without)(features.filter((F.col("split") == split) & ~train_group()))


def first_splits(features: DataFrame, p: BoostParams = BoostParams(), rules: bool = False, without: tuple[str, ...] = ()) -> DataFrame:
    """The best split of each feature at the root of the first tree: feature, up_to (rows up to this value go left), missing_left, n_left, n_right and gain."""
    table, columns = design(features, rules, without)
    rows = training_rows(table)
    ends = boosting.bin_ends(rows, columns, p.bins)
    size = rows.agg(F.count("label").alias("n"), F.sum(F.col("label").cast("int")).alias("hits")).first()
    if not size["hits"] or size["hits"] == size["n"]:
        return features.sparkSession.createDataFrame([], "feature string, up_to double, missing_left boolean, n_left long, n_right long, gain double")
    start = boosting.Tree(values={1: log(size["hits"] / (size["n"] - size["hits"]))})
    binned = boosting.binned(rows.filter("label is not null"), "label", columns, ends, 1)
    sums = boosting.histograms(binned, [list(range(len(columns)))], len(columns), [[start]], [boosting.Tree()], [[1]])
    best = boosting.split_gains(sums, ["model", "node"], p.least_rows, p.l2)
    names = F.create_map(*[x for k, c in enumerate(columns) for x in (F.lit(k), F.lit(c))])
    values = F.create_map(*[x for k, c in enumerate(columns) if ends[c] for x in (F.lit(k), F.array(*[F.lit(e) for e in ends[c]]))])
    return best.select(names[F.col("feature")].alias("feature"), F.get(values[F.col("feature")], F.col("bin")).alias("up_to"), "missing_left", F.col("n_left"), (F.col("n_all") - F.col("n_left")).alias("n_right"), "gain")


def rule_scores(features: DataFrame) -> DataFrame:
    """split, account_id, label, method, score, eligible: each rule's best score, and the number of headline rules that fired."""
    methods = [F.struct(F.lit(r).alias("method"), F.col(f"rf_{r}_max").cast("double").alias("score"), (F.col(f"rf_{r}_n") > 0).alias("eligible")) for r in REAL_RULES]
    fired = reduce(lambda a, b: a + b, [(F.col(f"rf_{r}_n") > 0).cast("int") for r in HEADLINE_RULES])
    methods.append(F.struct(F.lit("combined_excl_baseline").alias("method"), fired.cast("double").alias("score"), (fired > 0).alias("eligible")))
    return features.select("split", "account_id", "label", F.explode(F.array(*methods)).alias("m")).select("split", "account_id", "label", "m.*")


def model_rows(scored: DataFrame, name: str) -> DataFrame:
    return scored.select("split", "account_id", "label", F.lit(name).alias("method"), F.col("model_score").alias("score"), F.lit(True).alias("eligible"))


def compare(scores: DataFrame) -> DataFrame:
    """method, budget, average_precision, precision, recall, volume_per_1000: all methods on the same accounts at equal volume; ties shared out."""
    key = ["method"]
    ap = average_precision(scores, key, F.when(F.col("eligible"), F.col("score")).otherwise(-1.0), "label")
    size = scores.groupBy(*key).agg(F.count("*").alias("accounts"), F.sum(F.col("label").cast("int")).alias("positives"))
    parts, sized = [], scores.join(F.broadcast(size.select("method", "accounts")), "method")  # a row for each method
    for b in BUDGETS:
        counted = sized.withColumn("n_top", F.bround(F.lit(b / 1000) * F.col("accounts")).cast("bigint"))
        top = top_n_shared(counted.withColumn("label", F.col("label").cast("int")), key, "score", "label", F.col("n_top"), F.col("eligible"))
        parts.append(top.withColumn("budget", F.lit(b)))
    t = reduce(DataFrame.unionByName, parts).join(size, key).join(ap, key)
    hits, taken = F.col("hits"), F.col("n_taken")
    return t.select("method", "budget", "average_precision", (hits / F.nullif(taken, F.lit(0))).alias("precision"), (hits / F.nullif("positives", F.lit(0))).alias("recall"), (taken * F.lit(1000.0).cast("double") / F.col("accounts")).alias("volume_per_1000"))


def permutation_importance(features: DataFrame, score: Scorer, columns: list[str], repeats: int = 3, seed: int = 1, rows: int = 40_000, keep: Callable[[str, DataFrame], DataFrame] | None = None) -> DataFrame:
    """column, importance (drop in average precision when its values are dealt out anew) and share (of all drops, none below 0); `score` adds model_score to features.

    Measured on the first `rows` rows by hash. Within a split, the row of hash rank k takes the value of the row of rank k by another hash. Every row stands once
    for each column and repeat in one plan, so all of them are scored in one pass and measured in one grouped aggregate.
    """
    keep = keep or stored(features.sparkSession)
    key = lambda s: F.xxhash64(s, "split", "account_id")
    sample = features.orderBy(key(F.lit(seed)), "split", "account_id").limit(rows)
    each = sample.withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    ranked = lambda s: F.row_number().over(Window.partitionBy("split", "repeat").orderBy(key(s)))
    takes = each.withColumn("__k", ranked(-F.lit(1 + seed) - F.col("repeat")))
    gives = each.withColumn("__k", ranked(F.lit(seed) + F.col("repeat"))).select("split", "repeat", "__k", F.struct(*columns).alias("__new"))
    dealt = takes.join(gives, ["split", "repeat", "__k"]).withColumn("column", F.explode(F.array(*[F.lit(c) for c in columns])))
    dealt = dealt.withColumns({c: F.when(F.col("column") == c, F.col(f"__new.{c}")).otherwise(F.col(c)) for c in columns}).drop("__k", "__new")
    whole = sample.withColumn("repeat", F.lit(0)).withColumn("column", F.lit(""))
    scored = keep(f"importance_{uuid.uuid4().hex}", score(whole.unionByName(dealt)).select("column", "repeat", "label", "model_score"))
    measured = average_precision(scored, ["column", "repeat"], F.col("model_score"), "label")
    base = measured.filter("column = ''").select(F.col("average_precision").alias("whole"))  # one row
    drops = measured.filter("column <> ''").crossJoin(F.broadcast(base)).groupBy("column").agg((F.sum(F.col("whole") - F.col("average_precision")) / repeats).alias("importance"))
    kept = F.greatest(F.lit(0.0), F.col("importance"))
    total = drops.agg(F.sum(kept).alias("total"))  # one row
    return drops.crossJoin(F.broadcast(total)).select("column", "importance", F.coalesce(F.try_divide(kept, F.col("total")), F.lit(0.0)).alias("share"))


def verdict(model: float, best_rule: float, band: float = 0.05) -> str:
    """beats, level with or does not beat, within a relative band."""
    if model > best_rule * (1 + band):
        return "beats"
    return "level with" if model >= best_rule * (1 - band) else "does not beat"

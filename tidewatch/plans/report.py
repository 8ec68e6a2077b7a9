"""Reports of a built model: rules, a rule before it is wired in, and models against rules; as Markdown and JSON.

python -m tidewatch.plans.report FOLDER [--dataset hi] [--out DIR] [--readme FILE] [--profile] [--models] [--transfer FOLDER2 --transfer-dataset li]
python -m tidewatch.plans.report FOLDER --rule rule_cycles [--tune-last-day 7]   one rule: its fixture first, then its tables
"""

from __future__ import annotations

import argparse
import json
from functools import reduce
from pathlib import Path

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..sources.sinks import markdown_table, rewrite_block
from . import fixtures, ml, profile
from .params import Params
from .pipeline import Pipeline, evaluate_rule, stored
from .rules import WIRED_RULES


def base_rates(p: Pipeline) -> DataFrame:
    lab = F.sum(F.col("is_laundering_account").cast("int"))
    return p.fct_account_split_label.groupBy("split").agg(F.count("*").alias("accounts"), lab.alias("labelled"), (lab / F.count("*")).alias("base_rate")).orderBy("split")


def with_lift(performance: DataFrame) -> DataFrame:
    """How many times the base rate of its split a rule's precision is."""
    base = F.col("n_labelled_accounts") / F.nullif(F.col("n_population"), F.lit(0))
    return performance.withColumn("lift", F.try_divide(F.col("precision"), base))


def rule_tables(p: Pipeline) -> dict[str, DataFrame]:
    """The tables of the rule report: base rates, performance by rule and split, combined sets, recall by pattern, thresholds, overlap."""
    perf = with_lift(p.fct_rule_performance).orderBy("rule_id", "split")
    return {
        "Base rate": base_rates(p),
        "Performance of the rules": perf.filter("rule_id not like 'combined%'"),
        "Combined alert sets": perf.filter("rule_id like 'combined%'"),
        "Recall by pattern (whole window)": p.fct_rule_pattern_recall.filter("split = 'all'").orderBy("rule_id", "pattern_type"),
        "Score cutoffs (whole window)": p.fct_rule_threshold_sensitivity.orderBy("rule_id", "cutoff_pct"),
        "Overlap of the rules": p.fct_rule_overlap.filter("rule_a not like '%dummy%' and rule_b not like '%dummy%'").orderBy("rule_a", "rule_b"),
    }


def rule_report(p: Pipeline, title: str = "Rules") -> str:
    days = f"Unit: account. Splits: tune is days 1 to {p.params.tune_last_day}, validate the days after, labels by split. A rule's precision stands against the base rate."
    return "\n".join([f"# {title}", "", days, *(f"\n## {name}\n\n{markdown_table(df)}" for name, df in rule_tables(p).items())])


def tuning_report(p: Pipeline, alerts: DataFrame, rule_id: str) -> str:
    """All evaluations of one set of alerts that is not part of the model."""
    order = {"performance": ["split"], "pattern_recall": ["split", "pattern_type"], "threshold_sensitivity": ["cutoff_pct"]}
    return "\n".join([f"# {rule_id}", *(f"\n## {name}\n\n{markdown_table(df.orderBy(*order[name]))}" for name, df in evaluate_rule(p, alerts, rule_id).items())])


def compared(features: DataFrame, models: dict, split: str, unseen: bool = True) -> DataFrame:
    """Every model and rule on the same accounts of a split: those that training did not see, or all of another dataset."""
    rows = features.filter(F.col("split") == split)
    rows = rows.filter(~ml.train_group()) if unseen else rows
    scored = [ml.model_rows(score(rows), name) for name, score in models.items()]
    return ml.compare(reduce(DataFrame.unionByName, [*scored, ml.rule_scores(rows)]))


def verdicts(rows: list) -> list[str]:
    """For each model and budget: how its precision stands to that of the best rule that fills the budget."""
    out, fills = [], lambda r: r.volume_per_1000 >= 0.95 * r.budget
    for r in sorted((r for r in rows if r.method.startswith("model")), key=lambda r: (r.method, r.budget)):
        rules = [x for x in rows if not x.method.startswith("model") and x.budget == r.budget and fills(x) and x.precision is not None]
        if not rules or r.precision is None:
            out.append(f"{r.method} at {r.budget} per 1,000: no rule fills this volume.")
            continue
        best = max(rules, key=lambda x: (x.precision, x.method))
        out.append(f"{r.method} at {r.budget} per 1,000 {ml.verdict(r.precision, best.precision)} {best.method}: precision {r.precision:.4f} against {best.precision:.4f}.")
    return out


def ablation(rows: list, full: str = "model_base", less: str = "model_no_artifacts") -> list[dict]:
    """For each budget what the model without artifact features keeps: precision of both and its share, average precision likewise (budget null)."""
    by, share = {(r.method, r.budget): r for r in rows}, lambda a, b: b / a if a and b is not None else None
    out = []
    for b in sorted({r.budget for r in rows}):
        a, c = by[full, b].precision, by[less, b].precision
        out.append({"budget": b, "measure": "precision", "full": a, "without": c, "kept": share(a, c)})
    some = min(r.budget for r in rows)
    a, c = by[full, some].average_precision, by[less, some].average_precision
    return [*out, {"budget": None, "measure": "average precision", "full": a, "without": c, "kept": share(a, c)}]


def headline(performance: list, rows: list, budget: int = 5, model: str = "model_no_artifacts") -> str:
    """One sentence on the best rule of the validate split and one on how a model stands to it at equal volume; every number and word comes from the tables."""
    found = [r for r in performance if r.split == "validate" and r.rule_id in ml.HEADLINE_RULES and r.precision is not None]
    if not found:
        return "No rule alerts in the validate split."
    best = max(found, key=lambda r: (r.precision, r.rule_id))
    base = best.n_labelled_accounts / best.n_population
    text = f"The most precise rule, {best.rule_id}, alerts on {best.alerts_per_1000_accounts:.1f} of 1,000 accounts at a precision of {best.precision:.1%}, {best.precision / base:.1f} times the base rate of {base:.2%}." if base else f"{best.rule_id} alerts on {best.alerts_per_1000_accounts:.1f} of 1,000 accounts; none is labelled."
    own = next((r for r in rows if (r.method, r.budget) == (model, budget)), None)
    rule = next((r for r in rows if (r.method, r.budget) == (best.rule_id, budget)), None)
    if own is None or rule is None or own.precision is None or rule.precision is None:
        return text
    word = {"beats": "ahead of", "level with": "level with", "does not beat": "behind"}[ml.verdict(own.precision, rule.precision)]
    return f"{text} At {budget} alerts per 1,000 accounts {model} is {word} it: {own.precision:.1%} against {rule.precision:.1%}."


def profile_report(p: Pipeline, title: str = "Profile") -> str:
    """Counts, groups and split counts of the raw data."""
    groups = profile.profile_groups(p.raw)
    tables = {"Counts": profile.profile_counts(p.raw).orderBy("metric"), **{f"By {kind}": groups.filter(F.col("kind") == kind).drop("kind").orderBy(F.desc("rows"), "name") for kind in ("day", "currency", "format")}}
    tables |= {"Days": profile.split_counts(p.int_txn_enriched).orderBy("day_index"), "Labelled accounts if validation starts on a day": profile.labelled_from_day(p.int_txn_enriched).orderBy("day_index")}
    return "\n".join([f"# {title}", *(f"\n## {name}\n\n{markdown_table(df)}" for name, df in tables.items())])


def one_rule(p: Pipeline, rule_id: str) -> str:
    """The tables of one rule, after its fixture has passed; SystemExit with what is wrong, before any data is read, if it doesn't."""
    if rule_id not in WIRED_RULES:
        raise SystemExit(f"no rule {rule_id}; there are {', '.join(WIRED_RULES)}")
    if wrong := fixtures.faults(p.raw["transactions"].sparkSession, rule_id):
        raise SystemExit("\n".join([f"The fixture of {rule_id} fails:", *wrong]))
    return tuning_report(p, getattr(p, rule_id), rule_id)


def model_report(p: Pipeline, params: ml.BoostParams = ml.BoostParams(), others: dict[str, Pipeline] | None = None, importance_rows: int = 40_000, top: int = 10, importance_of: tuple[str, ...] = ()) -> tuple[str, dict]:
    """Three models (base features, with rule features, without artifacts) trained once, compared with the rules on both splits of this dataset and of others.

    Returns Markdown and what stands in it as plain values. importance_of: the features to measure, all of a model if empty.
    """
    feats = p.keep("report_features", p.fct_alert_features)
    models = ml.fit_sets(feats, params, keep=p.keep if p.keeps else None)
    sections = [(f"{split}, accounts not seen in training", feats, split, True) for split in ("validate", "tune")]
    tables = {name: q.keep(f"report_features_{name}", q.fct_alert_features) for name, q in (others or {}).items()}
    sections += [(f"{name} {split}, models as trained above", table, split, False) for name, table in tables.items() for split in ("validate", "tune")]
    text, data = ["# Models against rules at equal volume", ""], {}
    for title, table, split, unseen in sections:
        result = compared(table, models, split, unseen).orderBy("method", "budget")
        rows = result.collect()
        data[title] = {"rows": [r.asDict() for r in rows], "verdicts": verdicts(rows), "ablation": ablation(rows)}
        text += [f"## {title[0].upper()}{title[1:]}", "", markdown_table(result.sparkSession.createDataFrame(rows, result.schema)), *(f"- {v}" for v in data[title]["verdicts"]), ""]
        text += ["Without artifact features:", "", *(f"- {a['measure']}{f' at {a["budget"]} per 1,000' if a['budget'] else ''}: {a['without'] or 0:.4f} of {a['full'] or 0:.4f}" + (f" ({a['kept']:.0%} kept)" if a["kept"] is not None else "") for a in data[title]["ablation"]), ""]
    first = data[sections[0][0]]["rows"]
    data["headline"] = headline(p.fct_rule_performance.collect(), [Row(**r) for r in first])
    text[1:1] = ["", data["headline"]]
    train = ml.training_rows(feats)
    for name in ("model_base", "model_no_artifacts"):
        rules, without = ml.FEATURE_SETS[name]
        columns = [c for c in ml.design(feats, rules, without)[1] if c in feats.columns and (not importance_of or c in importance_of)]
        shares = ml.permutation_importance(train, models[name], columns, rows=importance_rows).orderBy(F.desc("share"), "column").limit(top)
        data[f"importance of {name}"] = [r.asDict() for r in shares.collect()]
        text += [f"## Importance of {name} (share of the loss in average precision, {importance_rows:,} rows at most)", "", markdown_table(shares), ""]
    return "\n".join(text), data


def main(args: list[str] | None = None) -> None:
    a = argparse.ArgumentParser(description=__doc__)
    a.add_argument("folder")
    a.add_argument("--dataset", default="hi", choices=("hi", "li"))
    a.add_argument("--out", default="reports")
    a.add_argument("--readme", help="a file whose `rules` block is rewritten with the performance table")
    a.add_argument("--models", action="store_true", help="train and compare the models too")
    a.add_argument("--trees", type=int, default=ml.BoostParams().iterations)
    a.add_argument("--transfer", help="folder of another dataset that the models are applied to")
    a.add_argument("--transfer-dataset", default="li", choices=("hi", "li"))
    a.add_argument("--profile", action="store_true", help="describe the raw data too")
    a.add_argument("--rule", help="evaluate this rule alone and print its tables")
    a.add_argument("--tune-last-day", type=int, default=Params().tune_last_day)
    x = a.parse_args(args)
    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    p = Pipeline.from_files(spark, x.folder, x.dataset, Params(tune_last_day=x.tune_last_day), keep=stored(spark))
    if x.rule:
        print(one_rule(p, x.rule))
        return
    out = Path(x.out)
    out.mkdir(parents=True, exist_ok=True)
    (out / f"rules_{x.dataset}.md").write_text(rule_report(p, f"Rules ({x.dataset})"))
    if x.profile:
        (out / f"profile_{x.dataset}.md").write_text(profile_report(p, f"Profile ({x.dataset})"))
    if x.readme:
        readme = Path(x.readme)
        readme.write_text(rewrite_block(readme.read_text(), "rules", markdown_table(rule_tables(p)["Performance of the rules"])))
    if x.models:
        others = {x.transfer_dataset: Pipeline.from_files(spark, x.transfer, x.transfer_dataset, Params(), keep=stored(spark))} if x.transfer else None
        text, data = model_report(p, ml.BoostParams(iterations=x.trees), others)
        (out / "models.md").write_text(text)
        (out / "models.json").write_text(json.dumps(data, indent=1) + "\n")


if __name__ == "__main__":
    main()

"""The model end to end on the smallest tables: data tests, evaluation of empty rules, point-in-time features, the stream."""

import pytest

from tidewatch.plans import checks, ml
from tidewatch.plans.pipeline import Pipeline, build, evaluate_rule, stored
from tidewatch.queries import DRIVER

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    p = Pipeline.from_events(spark, SF, DRIVER)
    return p, build(p, str(tmp_path_factory.mktemp("marts")))


def test_data_tests(built):
    p, tables = built
    assert checks.label_columns(tables["fct_alert_features"]) == []
    bad = {name: n for name, df in checks.all_checks(p).items() if (n := df.limit(5).count())}
    assert not bad
    rows = checks.audit(p).collect()
    assert {r.check for r in rows} == set(checks.column_checks(p)) and len(rows) == len(checks.column_checks(p)) > 80
    assert not [r for r in rows if r.violations]


def test_checks_find_faults(spark):
    bad = spark.createDataFrame([(1, None, -1.0, "x"), (1, "a", 2.0, "all")], "k int, a string, x double, s string")
    assert checks.unique(bad, "k").count() == checks.not_null(bad, "a").count() == checks.positive(bad, "x").count() == checks.accepted(bad, "s", "all").count() == 1
    assert checks.references(bad, "a", bad.filter("k > 1"), "a").count() == 1


def files(spark, folder, name):
    """The tables of the smallest events as the published files of a dataset."""
    from tidewatch.sources.raw import ACCOUNT_COLUMNS, TRANSACTION_COLUMNS

    raw = Pipeline.from_events(spark, SF, DRIVER).raw
    for table, columns, file in (("transactions", TRANSACTION_COLUMNS, "Trans.csv"), ("accounts", ACCOUNT_COLUMNS, "accounts.csv")):
        rows = raw[table].select(*columns).collect()
        (folder / f"{name}_{file}").write_text("\n".join([",".join(columns), *(",".join(v or "" for v in r) for r in rows)]) + "\n")
    blocks = {}
    for r in raw["patterns"].collect():
        blocks.setdefault((r.pattern_id, r.pattern_type), []).append(",".join(r[c] for c in TRANSACTION_COLUMNS))
    lines = [x for (_, kind), rows in sorted(blocks.items()) for x in (f"BEGIN LAUNDERING ATTEMPT - {kind}", *rows, f"END LAUNDERING ATTEMPT - {kind}", "")]
    (folder / f"{name}_Patterns.txt").write_text("\n".join(lines))
    return lines


def test_reports_of_another_dataset(spark, tmp_path):
    from tidewatch.plans import report

    files(spark, tmp_path, "LI-Small")
    (tmp_path / "README.md").write_text("a <!-- rules:begin -->old<!-- rules:end --> b")
    report.main([str(tmp_path), "--dataset", "li", "--out", str(tmp_path / "out"), "--readme", str(tmp_path / "README.md")])
    text = (tmp_path / "out" / "rules_li.md").read_text()
    assert all(f"## {t}" in text for t in ("Base rate", "Combined alert sets", "Overlap of the rules")) and "| rule_dummy_all | validate |" in text
    assert "rule_dummy_all" in (tmp_path / "README.md").read_text() and "old" not in (tmp_path / "README.md").read_text()


def test_model_report(spark, built):
    from tidewatch.plans import report

    p, tables = built
    text, data = report.model_report(p, ml.BoostParams(iterations=2, leaves=4, least_rows=1), {"other": p}, importance_rows=50, top=3, importance_of=("f_n_sent", "f_n_recv"))
    assert len(data) == 7 and data["headline"] in text and "## Importance of model_no_artifacts" in text
    rows = data["validate, accounts not seen in training"]["rows"]
    assert {r["method"] for r in rows} == {*ml.FEATURE_SETS, "combined_excl_baseline", *ml.REAL_RULES} and len(data["other tune, models as trained above"]["verdicts"]) == 9
    assert report.tuning_report(p, p.rule_structuring, "rule_structuring").count("| rule_structuring |") >= 3 + 7


def test_fixtures_gate_a_rule(spark, built, monkeypatch):
    from tidewatch.plans import fixtures, report, rules

    p, _ = built
    assert all(fixtures.faults(spark, r) == [] for r in fixtures.FIXTURES) and set(fixtures.FIXTURES) == set(rules.REAL_RULES)
    assert "## threshold_sensitivity" in report.one_rule(p, "rule_structuring")
    monkeypatch.setattr(rules, "structuring", lambda txns, params: rules.dummy_none(spark))
    with pytest.raises(SystemExit, match="missing: low"):
        report.one_rule(p, "rule_structuring")
    with pytest.raises(SystemExit, match="no rule"):
        report.one_rule(p, "rule_none")


def test_headline_and_ablation():
    from pyspark.sql import Row

    from tidewatch.plans import report

    perf = [Row(rule_id="rule_cycles", split="validate", precision=0.2, alerts_per_1000_accounts=4.0, n_labelled_accounts=10, n_population=1000), Row(rule_id="rule_fan_in_out", split="validate", precision=None, alerts_per_1000_accounts=0.0, n_labelled_accounts=10, n_population=1000)]
    row = lambda m, b, x, ap=0.4: Row(method=m, budget=b, precision=x, average_precision=ap)
    for model, word in ((0.3, "ahead of it"), (0.205, "level with it"), (0.1, "behind it")):
        rows = [row("rule_cycles", 5, 0.2), row("model_no_artifacts", 5, model, 0.1), row("model_base", 5, 0.4)]
        text = report.headline(perf, rows)
        assert "20.0 times the base rate of 1.00%" in text and word in text and f"{model:.1%} against 20.0%" in text
    assert [a["kept"] for a in report.ablation(rows)] == [0.25, 0.25]
    assert report.headline([], rows) == "No rule alerts in the validate split."


def test_profile_report(built):
    from tidewatch.plans import report

    text = report.profile_report(built[0])
    assert all(f"## {t}" in text for t in ("Counts", "By day", "By currency", "By format", "Days")) and "| transactions | 1,000 |" in text


def test_sample_with_accounts_and_patterns(spark, tmp_path):
    from tidewatch.sources.sinks import stratified_sample, write_sample

    lines = files(spark, tmp_path, "HI-Small")
    raw = Pipeline.from_files(spark, str(tmp_path)).raw
    s = stratified_sample(raw["transactions"], 200, 80)
    made = write_sample(s, str(tmp_path / "s"), "h", raw["accounts"], "a", lines)
    again = Pipeline.from_files(spark, str(tmp_path / "s")).raw
    assert again["transactions"].count() == made["transactions"] and again["accounts"].count() == made["accounts"] > 0 and len(made["sha256"]) == 3
    assert again["patterns"].count() == raw["patterns"].count()
    assert made == write_sample(s, str(tmp_path / "t"), "h", raw["accounts"], "a", lines)
    with pytest.raises(ValueError):
        write_sample(s, str(tmp_path / "u"), "h", pattern_lines=["2024/01/01 00:00,1"])


def test_every_rule_alerts(built):
    _, tables = built
    assert all(tables[r].count() > 0 for r in ("rule_fan_in_out", "rule_structuring", "rule_pass_through", "rule_cycles", "rule_baseline_anomaly"))


def test_empty_rule_goes_through_every_mart(built):
    p, _ = built
    out = evaluate_rule(p, p.rule_dummy_none, "rule_dummy_none")
    rows = out["performance"].collect()
    assert {r.split for r in rows} == {"all", "tune", "validate"} and all(r.precision is None and r.account_recall == 0 for r in rows)
    assert out["threshold_sensitivity"].count() == 0 and out["pattern_recall"].filter("n_caught > 0").count() == 0


def test_tune_features_ignore_the_future(spark, built):
    p, tables = built
    raw = dict(p.raw)
    raw["transactions"] = raw["transactions"].filter("timestamp < '2024/01/08'")
    early = Pipeline(raw, DRIVER, keep=stored(spark)).fct_alert_features.filter("split = 'tune'")
    cols = [c for c in early.columns if c.startswith("f_")]
    whole = tables["fct_alert_features"].filter("split = 'tune'")
    assert early.select("account_id", "label", *cols).subtract(whole.select("account_id", "label", *cols)).count() == 0


def test_model_protocol(built):
    _, tables = built
    scored = ml.fit_and_score(tables["fct_alert_features"], ml.BoostParams(iterations=2, leaves=4, least_rows=1), without=ml.ARTIFACTS)
    rows = ml.compare(ml.model_rows(scored, "model").unionByName(ml.rule_scores(tables["fct_alert_features"].filter("split = 'validate'")))).collect()
    assert {r.method for r in rows} == {"model", "combined_excl_baseline", *ml.REAL_RULES} and len(rows) == 21
    assert (ml.verdict(1.1, 1.0), ml.verdict(1.0, 1.0), ml.verdict(0.9, 1.0)) == ("beats", "level with", "does not beat")


def test_registered_comparison_is_whole(spark, monkeypatch):
    from tidewatch import queries

    seen, fit = [], ml.fit_sets

    def quick(features, p=ml.BoostParams(), sets=ml.FEATURE_SETS, keep=None):
        seen.append((p, dict(sets)))
        return fit(features, ml.BoostParams(iterations=1, leaves=3), sets, keep)

    monkeypatch.setattr(ml, "fit_sets", quick)
    rows = queries.QUERIES["l03_model_comparison"](spark, "/root/testdata/sf0.001").collect()
    assert seen == [(ml.BoostParams(), {"model_base": (False, ()), "model_base_rules": (True, ()), "model_no_artifacts": (False, ml.ARTIFACTS)})]
    assert {(r.method, r.budget) for r in rows} == {(m, b) for m in ml.FEATURE_SETS for b in ml.BUDGETS} and len(rows) == 9


def test_permutation_importance(built):
    from pyspark.sql import functions as F

    _, tables = built
    tune = tables["fct_alert_features"].filter("split = 'tune'")
    score = lambda df: df.withColumn("model_score", F.col("f_n_sent").cast("double"))
    rows = {r.column: r.importance for r in ml.permutation_importance(tune, score, ["f_n_sent", "f_n_recv"], repeats=1).collect()}
    assert rows["f_n_recv"] == 0 and rows["f_n_sent"] != 0
    shares = {r.column: r.share for r in ml.permutation_importance(tune, score, ["f_n_sent", "f_n_recv"], repeats=2, rows=40).collect()}
    assert shares["f_n_recv"] == 0 and shares["f_n_sent"] in (0, 1)


def test_importance_equals_a_loop(built):
    import numpy as np
    from pyspark.sql import functions as F

    _, tables = built
    tune = tables["fct_alert_features"].filter("split = 'tune'")
    score = lambda df: df.withColumn("model_score", F.log1p(F.col("f_sent_usd").cast("double")) + F.col("f_in_degree") * 0.5)
    got = {r.column: r.importance for r in ml.permutation_importance(tune, score, ["f_sent_usd", "f_in_degree"], repeats=3, seed=5).collect()}
    keys = [F.xxhash64(F.lit(s), "split", "account_id").alias(f"k{j}") for j, s in enumerate([5, 6, 7, -6, -7, -8])]
    rows = tune.select("label", "f_sent_usd", F.col("f_in_degree").cast("double").alias("f_in_degree"), *keys).toPandas()

    def precision(x, y):
        total, value = y.sum(), 0.0
        for s in sorted(set(x), reverse=True):
            value += y[x == s].sum() / total * y[x >= s].mean()
        return value

    label = rows["label"].to_numpy().astype(float)
    of = lambda r: np.log1p(r["f_sent_usd"].to_numpy()) + r["f_in_degree"].to_numpy() * 0.5
    for c in got:
        loss = []
        for r in range(3):
            dealt = rows.copy()
            gives = rows[c].to_numpy()[np.argsort(rows[f"k{r}"].to_numpy())]
            column = np.empty(len(rows))
            column[np.argsort(rows[f"k{r + 3}"].to_numpy())] = gives
            dealt[c] = column
            loss.append(precision(of(rows), label) - precision(of(dealt), label))
        assert abs(got[c] - np.mean(loss)) < 1e-9


def test_stream(spark, tmp_path):
    from datetime import datetime, timedelta

    from tidewatch.streaming.structuring import structuring_stream

    t0 = datetime(2024, 1, 1)
    rows = [("A", t0 + timedelta(hours=k), 9_000.0) for k in range(4)] + [("B", t0, 9_000.0), ("Z", t0 + timedelta(days=30), 1.0), ("Z", t0 + timedelta(days=30), 9_999.0)]
    spark.createDataFrame(rows, "account_id string, ts timestamp, amount_usd double").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("account_id string, ts timestamp, amount_usd double").parquet(str(tmp_path / "in"))
    q = structuring_stream(stream).writeStream.format("memory").queryName("alerts").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert {r.account_id for r in spark.sql("select account_id from alerts").collect()} == {"A"}

"""Boosting against a plain version, split by split; ranges against plain orders."""

import heapq
from math import inf, log

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.operators import boosting
from tidewatch.operators.boosting import MISSING, BoostParams
from tidewatch.operators.ranges import discrete_quantiles, running_totals
from tidewatch.plans.storage import stored


def plain_best(bins, g, h, rows, params):
    """The best split of some rows: (gain, feature, bin, missing_left), one candidate after the other."""
    best = None
    whole = g[rows].sum() ** 2 / (h[rows].sum() + params.l2)
    for f in range(bins.shape[1]):
        b = bins[rows, f]
        gap = b == MISSING
        for at in sorted(set(b[~gap].tolist())):
            left = ~gap & (b <= at)
            sides = (False, True) if gap.any() else (bool(2 * left.sum() >= len(rows)),)
            for side in sides:
                here = left | (gap & side)
                if min(here.sum(), len(rows) - here.sum()) < params.least_rows:
                    continue
                gain = g[rows][here].sum() ** 2 / (h[rows][here].sum() + params.l2) + g[rows][~here].sum() ** 2 / (h[rows][~here].sum() + params.l2) - whole
                if best is None or gain > best[0] + 1e-7:
                    best = (gain, f, at, side, rows[here], rows[~here])
    return best


def plain_fit(bins, y, params):
    start = log(y.sum() / (len(y) - y.sum()))
    margin, trees = np.full(len(y), start), []
    for _ in range(params.iterations):
        g, h = (x / boosting.UNIT for x in boosting.gradients(y, margin))
        splits, leaves = [], {1: np.arange(len(y))}
        heap = []

        def offer(node, rows):
            best = plain_best(bins, g, h, rows, params)
            if best and best[0] > 1e-9:
                heapq.heappush(heap, (-best[0], node, best))

        offer(1, leaves[1])
        while heap and len(leaves) < params.leaves:
            _, node, (_, f, at, side, left, right) = heapq.heappop(heap)
            splits.append((node, f, at, side))
            del leaves[node]
            for child, rows in ((2 * node, left), (2 * node + 1, right)):
                leaves[child] = rows
                offer(child, rows)
        if splits:
            for rows in leaves.values():
                margin[rows] -= params.step * g[rows].sum() / (h[rows].sum() + params.l2)
        trees.append((splits, {n: -params.step * g[r].sum() / (h[r].sum() + params.l2) if splits else 0.0 for n, r in leaves.items()}))
    return margin, trees


def made(n, seed):
    r = np.random.default_rng(seed)
    x = np.column_stack([r.normal(size=n), r.integers(0, 4, n).astype(float), np.exp(r.normal(size=n)), r.normal(size=n)])
    x[r.random((n, 4)) < 0.15] = np.nan
    y = (np.nan_to_num(x[:, 0], nan=1.5) + 0.7 * (np.nan_to_num(x[:, 1]) > 1) + 0.5 * r.normal(size=n) > 0.8).astype(int)
    return x, y


@pytest.mark.parametrize(("params", "seed"), [(BoostParams(4, 0.3, 15, 20, 1.0, store_every=3), 1), (BoostParams(3, 0.1, 6, 5, 0.5, bins=16, store_every=1), 2)])
def test_equal_to_a_plain_version(spark, params, seed):
    x, y = made(900, seed)
    rows = spark.createDataFrame([(int(t), *[None if np.isnan(c) else float(c) for c in v]) for v, t in zip(x, y)], "label int, a double, b double, c double, d double").repartition(3)
    sets = {"all": ["a", "b", "c", "d"], "two": ["d", "b"]}
    models = boosting.fit(rows, "label", sets, stored(spark), params)
    for name, columns in sets.items():
        model = models[name]
        bins = boosting.in_bins(x[:, ["abcd".index(c) for c in columns]], [model.ends[c] for c in columns])
        assert all(len(e) <= params.bins for e in model.ends.values())
        order = sorted(range(len(columns)), key=lambda k: columns[k])  # of equal gains the first feature by name
        margin, trees = plain_fit(bins[:, order], y, params)
        for got, (splits, values) in zip(model.trees, trees, strict=True):
            assert [(s.node, s.feature, s.bin, s.missing_left) for s in got.splits] == [(n, order[f], b, side) for n, f, b, side in splits]
            assert got.values.keys() == values.keys() and all(abs(got.values[k] - values[k]) < 1e-9 for k in values)
        assert any(s.missing_left for t in model.trees for s in t.splits) or name == "two"
        scored = model.scored(rows).select(*columns, "model_score").toPandas()
        again = boosting.in_bins(scored[columns].to_numpy(dtype=float), [model.ends[c] for c in columns])
        whole = np.full(len(again), model.start)
        for t in model.trees:
            t.add_to(whole, again)
        assert np.abs(1 / (1 + np.exp(-whole)) - scored["model_score"]).max() < 1e-12
        assert abs(np.sort(1 / (1 + np.exp(-margin))) - np.sort(scored["model_score"])).max() < 1e-9


def test_splits_of_nodes_equal_those_of_the_plan(spark):
    r = np.random.default_rng(3)
    for gaps in (0.0, 0.2):
        bins = np.where(r.random((400, 3)) < gaps, MISSING, r.integers(2, 9, (400, 3))).astype(np.uint8)
        y = (bins[:, 0] + r.integers(0, 6, 400) > 8).astype(np.int32)
        sums = boosting.node_sums([(bins, y, np.zeros((400, 1)))], [[0, 1, 2]], 3, [[]], [boosting.Tree()], [[1]])[0, 1].astype(np.int64).reshape(3, 3, 256)
        cells = [(0, 1, f, b, *(int(x) for x in sums[:, f, b])) for f in range(3) for b in range(256) if sums[2, f, b]]
        plan = boosting.split_gains(spark.createDataFrame(cells, "model int, node int, feature int, bin int, g long, h long, n long"), ["model", "node"], 20, 1.0)
        want = max(plan.collect(), key=lambda x: (x.gain, -x.feature)).asDict()
        assert boosting.best_split(sums, 20, 1.0) == {k: v for k, v in want.items() if k not in ("model", "node")}
    assert boosting.best_split(sums, 300, 1.0) is None


def test_a_pass_is_one_small_job(spark):
    """Rows of a small table are read by one task a pass, those of a larger one by several, with the same model."""
    x, y = made(900, 5)
    rows = spark.createDataFrame([(int(t), *[None if np.isnan(c) else float(c) for c in v]) for v, t in zip(x, y)], "label int, a double, b double, c double, d double").repartition(6)
    fits = [boosting.fit(rows, "label", {"m": ["a", "b", "c"]}, stored(spark), BoostParams(3, 0.3, 7, 20, store_every=2, block_rows=n))["m"] for n in (20_000, 250)]
    assert fits[0].trees == fits[1].trees and fits[0].trees[0].splits
    ids = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("small passes", "")
    boosting.fit(rows, "label", {"m": ["a", "b", "c"]}, stored(spark), BoostParams(3, 0.3, 7, 20))
    jobs = [ids.getJobInfo(j) for j in ids.getJobIdsForGroup("small passes")]
    assert sum(len(j.stageIds) == 1 for j in jobs) >= 6


def test_rows_of_one_block_take_a_job_for_many_trees(spark):
    x, y = made(600, 7)
    rows = spark.createDataFrame([(int(t), float(np.nan_to_num(v[0])), float(np.nan_to_num(v[1]))) for v, t in zip(x, y)], "label int, a double, b double").coalesce(1)
    ids, sets = spark.sparkContext.statusTracker(), {"two": ["a", "b"], "one": ["b"]}
    spark.sparkContext.setJobGroup("one block", "")
    models = boosting.fit(rows, "label", sets, stored(spark), BoostParams(24, 0.3, 5, 20))
    assert len(ids.getJobIdsForGroup("one block")) < 24 and {len(m.trees) for m in models.values()} == {24}
    spark.sparkContext.setJobGroup("small passes of others", "")
    for least in (20, 280):  # of 600 rows no split of b leaves 280 on both sides, so that model stops first
        fits = [boosting.fit(rows, "label", sets, stored(spark), BoostParams(4, 0.3, 5, least, store_every=3, block_rows=n)) for n in (20_000, 250)]
        assert all(fits[0][name].trees == fits[1][name].trees for name in sets)
    assert not any(t.splits for t in fits[0]["one"].trees) and fits[0]["two"].trees[0].splits


def test_odd_labels(spark):
    table = spark.createDataFrame([(1, 1.0), (1, None), (None, 3.0)], "label int, a double")
    for rows in (table, table.limit(0)):
        model = boosting.fit(rows, "label", {"m": ["a"]}, stored(spark), BoostParams(3))["m"]
        assert not model.trees and {r.model_score for r in model.scored(table).collect()} == {0.5}


def test_running_totals(spark):
    r = np.random.default_rng(1)
    rows = [(("x", "y", None)[int(k)], float(v) if v > -1 else None, i) for i, (k, v) in enumerate(zip(r.choice(3, 700, p=[0.8, 0.1, 0.1]), r.integers(-2, 40, 700)))]
    df = spark.createDataFrame(rows, "key string, value double, id int").repartition(5)
    got = {x.id: (x.n, x.total) for x in running_totals(df, ["key"], [F.col("value"), F.col("id")], {"n": F.lit(1), "total": F.col("id")}, ranges=16).collect()}
    for key in ("x", "y", None):
        own = sorted((x for x in rows if x[0] == key), key=lambda x: (-inf if x[1] is None else x[1], x[2]))
        total = 0
        for n, x in enumerate(own, 1):
            total += x[2]
            assert got[x[2]] == (n, total)
    plan = running_totals(df, ["key"], [F.col("value"), F.col("id")], {"n": F.lit(1)}, ranges=16)._jdf.queryExecution().toString()
    assert "SinglePartition" not in plan
    assert running_totals(df.limit(0), [], [F.col("id")], {"n": F.lit(1)}).count() == 0
    for key, p in ((k, p) for k in ("x", "y", None) for p in (0.0, 0.3, 0.5, 1.0)):
        own = sorted(x[1] for x in rows if x[0] == key and x[1] is not None)
        q = {(x.key, x.probability): x.quantile for x in discrete_quantiles(df, ["key"], "value", (0.0, 0.3, 0.5, 1.0), ranges=8).collect()} if (key, p) == ("x", 0.0) else q
        assert q[key, p] == own[max(1, len(own) - int(np.floor(len(own) - len(own) * p))) - 1]


def test_pattern_file_in_ranges_and_splits(spark, tmp_path):
    from tidewatch.sources.raw import parse_patterns, read_patterns

    cells = ",".join("abcdefghij")
    lines, want, number = [], [], 0
    for k in range(60):
        number += 1
        lines += [f"BEGIN LAUNDERING ATTEMPT - KIND{k % 7}: 3 hops", *[f"{k}-{j},{cells}" for j in range(k % 5)], "", f"END LAUNDERING ATTEMPT - KIND{k % 7}", "stray," + cells]
        want += [(number, f"KIND{k % 7}", f"{k}-{j}") for j in range(k % 5)]
    df = spark.createDataFrame(list(enumerate(lines)), "pos long, line string")
    for ranges in (1, 7, 64):
        assert sorted((r.pattern_id, r.pattern_type, r.timestamp) for r in parse_patterns(df, ranges).collect()) == sorted(want)
    (tmp_path / "p.txt").write_text("\n".join(lines) + "\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    try:
        assert spark.read.text(str(tmp_path / "p.txt")).rdd.getNumPartitions() > 5
        assert sorted((r.pattern_id, r.pattern_type, r.timestamp) for r in read_patterns(spark, str(tmp_path / "p.txt")).collect()) == sorted(want)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)

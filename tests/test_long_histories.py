"""Operators on hubs and long histories, against plain loops; the sweep against single runs."""

import random
import statistics
import time
from datetime import datetime, timedelta
from decimal import Decimal

from pyspark.sql import functions as F

from tidewatch.operators.intervals import first_reaching
from tidewatch.operators.medians import earlier_medians
from tidewatch.plans import rules
from tidewatch.plans.params import Params, StructuringParams
from tidewatch.plans.pipeline import Pipeline, stored
from tidewatch.plans.sweep import StructuringGrid, structuring_sweep

NEEDS, FLOWS = "id long, account string, party string, at long, need decimal(28,8)", "account string, party string, at long, tie long, amount decimal(28,8)"


def reached(needs, flows, width):
    out = []
    for k, account, party, at, need in needs:
        total = Decimal(0)
        for _, _, t, _, amount in sorted((f for f in flows if f[0] == account and f[1] != party and at < f[2] <= at + width), key=lambda f: (f[2], f[3])):
            total += amount
            if total >= need:
                out.append((k, t, total))
                break
    return sorted(out)


def test_first_reaching_equals_a_loop(spark):
    r = random.Random(4)
    for spread, parties in ((400, "xyz"), (40, "xy"), (3000, "wxyz")):
        money = lambda: Decimal(r.choice([1, 2, 5, 5, 10, 33])) / r.choice([1, 1, 3])
        flows = [(r.choice("AB"), r.choice(parties), 3600 * r.randrange(spread) // 7, k, round(money(), 8)) for k in range(250)]
        needs = [(k, r.choice("ABC"), r.choice(parties), 3600 * r.randrange(spread) // 7, round(money() * r.choice([1, 3, 8]), 8)) for k in range(200)]
        got = first_reaching(spark.createDataFrame(needs, NEEDS), spark.createDataFrame(flows, FLOWS), 10, bucket_windows=2)
        assert sorted((x.id, x.at, x.total) for x in got.collect()) == reached(needs, flows, 36_000)
    assert first_reaching(spark.createDataFrame([], NEEDS), spark.createDataFrame(flows, FLOWS), 10).count() == 0


def test_a_hub_never_pairs_up(spark):
    n = 100_000
    start = datetime(2024, 1, 1)
    at = (F.lit(start).cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.col("id") % 80_000)).alias("txn_ts")
    party = F.concat(F.lit("p"), (F.col("id") % 7).cast("string"))
    into = spark.range(n).select(F.col("id").alias("txn_id"), at, party.alias("src"), F.lit("hub").alias("dst"), F.lit(6000.0).alias("amount_usd"))
    out = spark.range(n).select((F.col("id") + n).alias("txn_id"), at, F.lit("hub").alias("src"), party.alias("dst"), (F.col("id") % 90).cast("double").alias("amount_usd"))
    began = time.time()
    df = rules.pass_through(into.unionByName(out))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert len(df.collect()) == 1 and time.time() - began < 60
    joins = [line for line in plan.splitlines() if "Join" in line]
    assert all("account" not in line and "party" not in line for line in joins)  # only results meet their payments, by id


def test_medians_equal_plain_ones(spark):
    r = random.Random(2)
    rows = [(r.choice(["a", "b", None]), k, r.choice([None, 1.0, 2.0, r.random()])) for k in range(600)]
    got = {x.k: (x.n_before, x.median_before) for x in earlier_medians(spark.createDataFrame(rows, "key string, k int, x double").repartition(5), ["key"], ["k"], "x").collect()}
    for key, k, _ in rows:
        before = [x for a, b, x in rows if a == key and b < k]
        held = [x for x in before if x is not None]
        want = statistics.median(held) if held else None
        assert got[k][0] == len(before) and (got[k][1] is None if want is None else abs(got[k][1] - want) < 1e-12)
    near = spark.createDataFrame([("a", 1, 624.53), ("a", 2, 2732.47), ("a", 3, 0.0)], "key string, k int, x double")  # the lower plus half the distance is 1678.5000000000002
    assert earlier_medians(near, ["key"], ["k"], "x").filter("k = 3").first().median_before == 1678.5
    long = spark.range(100_000).select(F.lit("one").alias("key"), "id", F.rand(1).alias("x"))
    began = time.time()
    assert earlier_medians(long, ["key"], ["id"], "x").agg(F.max("n_before")).first()[0] == 99_999 and time.time() - began < 30


def test_every_cell_equals_its_own_run(spark):
    p = Pipeline.from_events(spark, "/root/testdata/sf0.001", Params(), keep=stored(spark))
    grid = StructuringGrid(10_000, (0.1, 0.5), (3, 4), (24, 72, 168), 500)
    cells = {(x.band_pct, x.min_txns, x.window_hours): x for x in structuring_sweep(p.int_txn_enriched, p.fct_account_split_label, 7, grid).collect()}
    pop = {x.account_id: x.n_laundering_txns > 0 for x in p.fct_account_split_label.filter("split = 'tune'").collect()}
    early = p.int_txn_enriched.filter("day_index <= 7")
    assert len(cells) == 12 and sum(x.chosen for x in cells.values()) == 1
    for (b, n, w), x in cells.items():
        alerts = rules.structuring(early, StructuringParams(10_000, b, n, w)).collect()
        accounts = {a.account_id for a in alerts}
        assert (x.n_alert_rows, x.n_alerted_accounts, x.tp_accounts) == (len(alerts), len(accounts), sum(pop[a] for a in accounts))
    best = next(x for x in cells.values() if x.chosen)
    assert all(x.account_recall <= best.account_recall for x in cells.values() if 0 < x.alerts_per_1000_accounts <= 500)
    assert not any(x.chosen for x in structuring_sweep(p.int_txn_enriched.limit(0), p.fct_account_split_label, 7, grid).collect())

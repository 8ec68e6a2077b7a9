"""Hand-made cases of each rule: what must alert, and near misses."""

import random
from datetime import datetime, timedelta

import pytest

from tidewatch.plans import evaluate, rules
from tidewatch.plans.params import BaselineParams, CycleParams, FanParams, PassThroughParams, StructuringParams

EDGE = "txn_id long, txn_ts timestamp_ntz, src string, dst string, amount_usd double"


def at(day, hour, minute=0):
    return datetime(2022, 9, day, hour, minute)


def edges(spark, rows):
    return spark.createDataFrame([(k, *r) for k, r in enumerate(rows, 1)], EDGE)


def found(df):
    return {(r.account_id, r.alert_ts): r for r in df.collect()}


def test_fan(spark):
    rows = [(at(1, 8 + k), f"s{k}", "A", 100.0) for k in range(5)]
    rows += [(at(1, 8 + k), f"t{k}", "B", 100.0) for k in range(4)]
    rows += [(t, f"u{k}", "C", 100.0) for k, t in enumerate([at(1, 8), at(2, 4), at(3, 0), at(3, 20), at(4, 16)])]
    rows += [(at(1, 8 + 2 * k), "D", f"r{k}", 100.0) for k in range(5)]
    rows += [(at(1, 8 + k), "E", "Z", 100.0) for k in range(6)]
    got = found(rules.fan_in_out(edges(spark, rows), FanParams(5, 24)))
    assert set(got) == {("A", at(1, 12)), ("D", at(1, 16))}
    assert got["A", at(1, 12)].score == 5 and got["A", at(1, 12)].reason == "fan-in: 5 distinct senders within 24h, 500 USD in that window"
    assert got["D", at(1, 16)].reason.startswith("fan-out: 5 distinct receivers")


@pytest.mark.parametrize("least", [2, 4, 6])
def test_fan_windows_across_bucket_edges(spark, least):
    r = random.Random(8)
    rows = [(at(1 + r.randrange(4), r.choice([0, 1, 5, 6, 11, 12, 18, 23]), r.choice([0, 0, 1, 59])), f"s{r.randrange(9)}", f"d{r.randrange(3)}", float(r.randrange(1, 900))) for _ in range(150)]
    want = {}
    for name, me, other in (("fan-in", 2, 1), ("fan-out", 1, 2)):
        for e in rows:
            n = len({x[other] for x in rows if x[me] == e[me] and timedelta(0) <= e[0] - x[0] <= timedelta(hours=6)})
            if n >= least:
                first, peak = want.get((name, e[me], e[0].date()), (e[0], 0))
                want[name, e[me], e[0].date()] = (min(first, e[0]), max(peak, n))
    alerts = rules.fan_in_out(edges(spark, rows), FanParams(least, 6)).collect()
    assert want and {(a.reason.split(":")[0], a.account_id, a.alert_ts.date()): (a.alert_ts, int(a.score)) for a in alerts} == want and len(alerts) == len(want)


def test_window_is_closed_at_both_ends_and_sees_its_own_minute(spark):
    rows = [(at(1, 8), "a", "X", 1.0), (at(1, 14), "b", "X", 2.0), (at(1, 14), "c", "X", 4.0)]  # the first is exactly 6 h old
    got = found(rules.fan_in_out(edges(spark, rows), FanParams(3, 6)))
    assert set(got) == {("X", at(1, 14))} and "7 USD" in got["X", at(1, 14)].reason
    later = [(at(1, 8), "a", "X", 1.0), (at(1, 14, 1), "b", "X", 2.0), (at(1, 14, 1), "c", "X", 4.0)]
    assert not found(rules.fan_in_out(edges(spark, later), FanParams(3, 6)))


def test_structuring(spark):
    rows = [("A", 9500, at(1, 8)), ("A", 9800, at(2, 4)), ("A", 9200, at(3, 0)), ("B", 9500, at(1, 8)), ("B", 9800, at(2, 4)), ("C", 9500, at(1, 8)), ("C", 9800, at(5, 8)), ("C", 9200, at(9, 16))]
    rows += [(a, x, t) for a, x in (("D", 10500), ("E", 8000), ("F", 9500)) for t in (at(1, 8), at(1, 18), at(2, 4))]
    df = spark.createDataFrame([(a, float(x), t, a == "F") for a, x, t in rows], "from_account_id string, amount_usd double, txn_ts timestamp_ntz, is_self_transfer boolean")
    got = found(rules.structuring(df, StructuringParams(10_000, 0.1, 3, 72)))
    assert set(got) == {("A", at(3, 0))}
    assert got["A", at(3, 0)].reason == "structuring: 3 payments of 9,000-10,000 USD within 72h, 28,500 USD total"
    with pytest.raises(ValueError):
        StructuringParams(min_txns=2)


def test_pass_through(spark):
    rows = [(at(1, 8), "S1", "M", 5000.0), (at(1, 10), "M", "X", 4800.0), (at(1, 8), "S2", "N", 5000.0), (at(1, 10), "N", "X", 2000.0), (at(1, 8), "S3", "O", 5000.0), (at(2, 14), "O", "X", 5000.0)]
    rows += [(at(1, 8), "S5", "P", 500.0), (at(1, 10), "P", "X", 500.0), (at(1, 8), "S4", "Q", 5000.0), (at(1, 10), "Q", "S4", 5000.0), (at(1, 8), "S6", "R", 5000.0), (at(1, 9), "R", "Y1", 2500.0), (at(1, 13), "R", "Y2", 2500.0)]
    got = found(rules.pass_through(edges(spark, rows), PassThroughParams(1000, 0.9, 24)))
    assert set(got) == {("M", at(1, 10)), ("R", at(1, 13))}
    assert got["M", at(1, 10)].reason == "pass-through: 5,000 USD received, 4,800 USD (96%) forwarded to other accounts within 24h"


def test_cycles(spark):
    d, h = lambda *x: [(a, b) for a, b in zip(x, x[1:] + x[:1])], 5000.0
    rows = [(at(1, 8 + k), a, b, h) for k, (a, b) in enumerate(d("A", "B", "C"))]
    rows += [(at(1, 13), "D", "E", h), (at(1, 9), "E", "F", h), (at(1, 14), "F", "D", h)]
    rows += [(at(1, 8 + k), a, b, h) for k, (a, b) in enumerate(d("G", "H", "I", "J", "K", "L"))]
    rows += [(at(1, 8 + k), a, b, 500.0) for k, (a, b) in enumerate(d("M", "N", "O"))]
    rows += [(at(1, 8 + k), a, b, h) for k, (a, b) in enumerate(d("P", "Q", "R"))]
    rows += [(at(1, 8), "S", "T", h), (at(3, 0), "T", "U", h), (at(4, 16), "U", "S", h), (at(1, 8), "V", "W", h), (at(1, 9), "W", "V", h)]
    e = edges(spark, rows)
    nodes = {x for r in rows for x in r[1:3]}
    profile = spark.createDataFrame([(n, 100 if n == "P" else 2, 2) for n in nodes], "account_id string, out_degree long, in_degree long")
    got = found(rules.cycles(e, profile, CycleParams(3, 5, 1000, 72, 50)))
    assert set(got) == {(n, at(1, 10)) for n in "ABC"}
    assert got["A", at(1, 10)].reason == "cycle: 3-hop loop back to the same account within 72h, smallest leg 5,000 USD (1 cycle(s) that day)"
    with pytest.raises(RuntimeError):
        rules.cycles(e, profile, CycleParams(3, 5, 1000, 72, 50, row_budget=1))


def test_stored_cycles_are_whole_beyond_the_row_budget(spark):
    """17 half walks of three payments a payment of the test events: with 36 million a fixed number of walks stopped the query."""
    rows = [(at(1, 8 + k), f"n{k}", f"n{(k + 1) % 6}", 5000.0 + k) for k in range(6)] + [(at(2, k), f"m{k}", f"m{(k + 1) % 3}", 3000.0) for k in range(3)]
    e = edges(spark, rows)
    profile = spark.createDataFrame([(x, 2, 2) for r in rows for x in r[1:2]], "account_id string, out_degree long, in_degree long")
    kept = []
    keep = lambda name, frame: kept.append(name) or frame.persist()
    got = found(rules.cycles(e, profile, CycleParams(3, 6, 1000, 72, 50, row_budget=1), keep))
    assert set(got) == {(f"n{k}", at(1, 13)) for k in range(6)} | {(f"m{k}", at(2, 2)) for k in range(3)}
    assert "walks_of_2_hops" in kept and "walks_of_3_hops" not in kept  # what is read once is not stored


def test_baseline(spark):
    days = {"A": [1000, 1200, 900, 1100, 9000], "B": [1000, 1200, 900, 1100, 4000], "C": [1000, 1200, 20000], "D": [100, 100, 100, 800], "E": [1000] * 4 + [10000, 1000], "Z": [0, 0, 0, 9000]}
    df = spark.createDataFrame([(a, at(k, 0).date(), float(x), 0.0) for a, xs in days.items() for k, x in enumerate(xs, 1)], "account_id string, day date, sent_usd double, recv_usd double")
    got = found(rules.baseline_anomaly(df, BaselineParams(5, 3, 5000)))
    assert set(got) == {("A", at(5, 0)), ("E", at(5, 0))}
    assert got["E", at(5, 0)].reason == "baseline anomaly: 10,000 USD moved in a day, 10.0x the median of its 4 earlier active days (1,000 USD)"


def test_split_labels(spark):
    rows = [("early", 2, 1, 1), ("early", 5, 1, 0), ("late", 1, 3, 0), ("late", 5, 2, 1), ("both", 3, 1, 1), ("both", 4, 1, 1), ("clean", 1, 4, 0)]
    df = spark.createDataFrame(rows, "account_id string, day_index long, n_txns long, n_laundering_txns long")
    got = {(r.split, r.account_id): r.is_laundering_account for r in evaluate.split_labels(df, 3).collect()}
    assert got == {("all", "early"): True, ("all", "late"): True, ("all", "both"): True, ("all", "clean"): False, ("tune", "early"): True, ("tune", "late"): False, ("tune", "both"): True, ("tune", "clean"): False, ("validate", "early"): False, ("validate", "late"): True, ("validate", "both"): True}

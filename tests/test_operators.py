"""Operators against brute force."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidewatch.functions import hash_bucket
from tidewatch.operators.ranked_metrics import average_precision, top_n_shared
from tidewatch.operators.ranking import global_row_number
from tidewatch.operators.trailing import trailing_totals, trailing_totals_by_frame
from tidewatch.operators.walks import RowBudgetExceeded, closed_walks, facing, half_walks, matched
from tidewatch.sources.raw import parse_patterns, read_transactions
from tidewatch.sources.sinks import markdown_table, rewrite_block, stratified_sample, write_sample

START = datetime(2024, 1, 1)


def test_trailing_totals_equal_brute_force_and_frames(spark):
    r = random.Random(4)
    rows = [(r.choice("ab"), START + timedelta(minutes=30 * r.randrange(400)), r.choice("uvwxyz"), float(r.randrange(1, 50))) for _ in range(300)]
    df = spark.createDataFrame(rows, "k string, ts timestamp_ntz, item string, usd double")
    for item in (None, "item"):
        inside = lambda k, t: [x for x in rows if x[0] == k and t - timedelta(hours=6) <= x[1] <= t]
        want = sorted((k, t, len({x[2] for x in inside(k, t)}) if item else len(inside(k, t)), sum(x[3] for x in inside(k, t))) for k, t, _, _ in rows)
        for f in (trailing_totals, trailing_totals_by_frame):
            got = sorted((x.k, x.ts, x.n, float(x.total)) for x in f(df, ["k"], "ts", 6, "usd", item).collect())
            assert got == want


def test_trailing_totals_tell_parts_of_a_second_apart(spark):
    rows = [("a", START + timedelta(microseconds=x), "u", 1.0) for x in (100, 900_000, 6 * 3_600_000_000 + 100, 6 * 3_600_000_000 + 101, 6 * 3_600_000_000 + 900_001)]
    df = spark.createDataFrame(rows, "k string, ts timestamp_ntz, item string, usd double")
    assert [(x.n, float(x.total)) for x in trailing_totals(df, ["k"], "ts", 6, "usd").orderBy("ts").collect()] == [(1, 1.0), (2, 2.0), (3, 3.0), (3, 3.0), (3, 3.0)]
    assert [x.n for x in trailing_totals(df, ["k"], "ts", 6, "usd", "item").orderBy("ts").collect()] == [1] * 5


def test_walks_equal_brute_force(spark):
    r = random.Random(9)
    rows = sorted({(r.choice("abcde"), r.choice("abcde"), START + timedelta(hours=r.randrange(60)), float(r.randrange(1, 9))) for _ in range(40)})
    rows = [x for x in rows if x[0] != x[1]]
    want = []

    def go(path, first, last, smallest):
        for a, b, t, usd in rows:
            if a == path[-1] and last < t <= first + timedelta(hours=24):
                if b == path[0]:
                    if len(path) >= 3:
                        want.append((tuple(path), len(path), t, min(smallest, usd)))
                elif b not in path and len(path) < 4:
                    go([*path, b], first, t, min(smallest, usd))

    for a, b, t, usd in rows:
        go([a, b], t, t, usd)
    df = spark.createDataFrame(rows, "src string, dst string, txn_ts timestamp_ntz, amount_usd double")
    got = [(tuple(x.path), x.hops, x.closed_ts, x.smallest) for x in closed_walks(df, 3, 4, 24).collect()]
    assert sorted(got) == sorted(want) and want


def test_pruning_keeps_all_closed_walks(spark):
    r = random.Random(12)
    rows = [(f"n{r.randrange(30)}", f"n{r.randrange(30)}", START + timedelta(hours=r.randrange(300)), float(r.randrange(1, 9))) for _ in range(400)]
    df = spark.createDataFrame([x for x in rows if x[0] != x[1]], "src string, dst string, txn_ts timestamp_ntz, amount_usd double")
    kept = {}
    keep = lambda name, frame: kept.setdefault(name, frame.persist())
    found = lambda df: sorted((tuple(x.path), x.hops, x.closed_ts, x.smallest) for x in df.collect())
    for hops, hours in ((6, 30),):
        kept.clear()
        whole = found(closed_walks(df, 2, hops, hours))
        assert whole == found(closed_walks(df, 2, hops, hours, 10**6, keep)) and {x[1] for x in whole} >= {2, 3, 4}
        assert kept["cycle_edges_0"].count() < kept["cycle_edges"].count()


def test_row_numbers(spark):
    df = spark.createDataFrame([("b", 2), ("a", 5), ("b", 1), ("a", 5), (None, 3)], "g string, x int")
    got = sorted((r.n, r.g or "", r.x) for r in global_row_number(df, ["g"], ["x"], "n").collect())
    assert got == [(1, "", 3), (2, "a", 5), (3, "a", 5), (4, "b", 1), (5, "b", 2)]


def test_row_numbers_over_levels(spark):
    r = random.Random(6)
    rows = [(r.choice([None, "2024/01/01 00:0%d" % r.randrange(9), "2024/01/0%d 10:00" % r.randrange(1, 9), "2023"]), r.choice("abc"), r.randrange(50)) for _ in range(400)]
    df = spark.createDataFrame(rows, "ts string, g string, x int")
    got = sorted((x.n, x.ts, x.g, x.x) for x in global_row_number(df, ["ts", "g"], ["x"], "n", (F.substring("ts", 1, 10),)).collect())
    assert [x[1:] for x in got] == sorted(rows, key=lambda x: (x[0] is not None, x[0] or "", *x[1:])) and [x[0] for x in got] == list(range(1, 401))


def test_walks_of_six_hops_and_budget(spark):
    edges = [(f"n{k}", f"n{(k + 1) % 6}", START + timedelta(hours=3 * k), 10.0 + k) for k in range(6)] + [("n5", "n4", START + timedelta(hours=16), 1.0)]
    df = spark.createDataFrame(edges, "src string, dst string, txn_ts timestamp_ntz, amount_usd double")
    kept = []
    keep = lambda name, frame: kept.append(name) or frame.persist()
    got = [(tuple(x.path), x.hops, x.smallest) for x in closed_walks(df, 3, 6, 20, 100, keep).collect()]
    assert got == [(("n0", "n1", "n2", "n3", "n4", "n5"), 6, 10.0)] and kept[-2:] == ["walks_of_2_hops", "walks_of_3_hops"] and kept[0] == "cycle_edges"
    assert closed_walks(df, 3, 6, 14).count() == 0
    with pytest.raises(RowBudgetExceeded):
        closed_walks(df, 3, 6, 20, 2, keep)


def test_only_half_walks_that_close_are_joined_whole(spark):
    r = random.Random(5)
    onward = [(f"n{k}", f"n{k + r.randrange(1, 4)}", START + timedelta(minutes=60 * k + r.randrange(60)), 5.0) for k in range(200) for _ in range(3)]  # no way leads back
    loop = [(f"a{k}", f"a{(k + 1) % 6}", START + timedelta(hours=3 * k), 10.0 + k) for k in range(6)]
    df = spark.createDataFrame(onward + loop, "src string, dst string, txn_ts timestamp_ntz, amount_usd double")
    stored = {}

    def keep(name, frame):
        stored[name] = frame.persist()
        return stored[name]

    keep.kept = []
    walks = half_walks(df.select("src", "dst", F.unix_seconds(F.col("txn_ts").cast("timestamp")).alias("at"), F.col("amount_usd").alias("usd")), 3, 20, 10**6, keep)
    assert stored["walks_of_3_hops"].columns == ["start", "end", "first", "last"] and walks[3].count() > 500
    near = facing(walks, 20)
    assert near.count() < 20 and sorted(x.hops for x in matched(near, 3, 6, 20).collect()) == [3, 3]
    got = closed_walks(df, 3, 6, 20, 10**6, keep).collect()
    assert [(x.path, x.smallest) for x in got] == [(["a0", "a1", "a2", "a3", "a4", "a5"], 10.0)] and [x.count() for x in keep.kept] == [2]


def test_loops_between_accounts_of_equal_hashes(spark):
    same = spark.range(400_000).select(F.concat(F.lit("n"), "id").alias("a")).groupBy(F.hash("a").alias("h")).agg(F.collect_list("a").alias("both")).filter("size(both) > 1").first().both
    path = [same[0], "p", same[1], "q"]
    edges = [(path[k], path[(k + 1) % 4], START + timedelta(hours=k), 1.0 + k) for k in range(4)]
    df = spark.createDataFrame(edges, "src string, dst string, txn_ts timestamp_ntz, amount_usd double")
    got = closed_walks(df, 3, 4, 20, 100, lambda name, frame: frame.persist()).collect()
    assert [(x.path, x.hops, x.smallest) for x in got] == [(path, 4, 1.0)]


def test_top_n_shares_ties(spark):
    df = spark.createDataFrame([("m", s, y, e) for s, y, e in zip([2.0, 1.0, 1.0, 1.0, 1.0], [0, 1, 0, 0, 0], [True] * 5)], "method string, score double, label int, ok boolean")
    row = top_n_shared(df, ["method"], "score", "label", F.lit(3), F.col("ok")).first()
    assert (row.n_taken, row.hits) == (3, 0.5)
    row = top_n_shared(df, ["method"], "score", "label", F.lit(3), F.col("score") > 1).first()
    assert (row.n_taken, row.hits) == (1, 0)
    assert average_precision(df, ["method"], F.col("score"), "label").first().average_precision == 0.2


def test_hash_bucket(spark):
    import hashlib

    got = spark.createDataFrame([("1|U7",)], "a string").select(hash_bucket(F.col("a")).alias("b")).first().b
    assert got == int(hashlib.md5(b"1|U7").hexdigest()[:8], 16) % 10


def test_patterns_and_csv(spark, tmp_path):
    line = "2022/09/01 00:05,0{},A,011,B,1.00,Euro,1.00,Euro,ACH,1"
    text = ["junk", "BEGIN LAUNDERING ATTEMPT - FAN-OUT:  Max 3", line.format(1), "", line.format(2), "END LAUNDERING ATTEMPT - FAN-OUT", line.format(9), "BEGIN LAUNDERING ATTEMPT - CYCLE", line.format(3), "END LAUNDERING ATTEMPT"]
    got = parse_patterns(spark.createDataFrame(list(enumerate(text)), "pos int, line string")).collect()
    assert sorted((r.pattern_id, r.pattern_type, r.from_bank) for r in got) == [(1, "FAN-OUT", "01"), (1, "FAN-OUT", "02"), (2, "CYCLE", "03")]
    import gzip

    with gzip.open(tmp_path / "t.csv.gz", "wt") as f:
        f.write("Timestamp,From Bank,Account,To Bank,Account,Amount Received,Receiving Currency,Amount Paid,Payment Currency,Payment Format,Is Laundering\n" + line.format(1) + "\n")
    assert read_transactions(spark, str(tmp_path / "t.csv")).first().from_bank == "01"


def test_sample_is_reproducible(spark, tmp_path):
    from tidewatch.sources.events import raw_from_events

    s = stratified_sample(raw_from_events(spark, "/root/testdata/sf0.001")["transactions"], 200, 80)
    one, two = write_sample(s, str(tmp_path / "a"), "h"), write_sample(s, str(tmp_path / "b"), "h")
    assert one == two and list(one["sha256"]) == ["HI-Small_Trans.csv.gz"] and one["transactions"] == s.count() <= 200 and one["laundering_transactions"] == 14
    assert "| n |" in markdown_table(s.selectExpr("count(*) as n"))
    assert rewrite_block("<!-- x:begin -->old<!-- x:end -->.", "x", "new") == "<!-- x:begin -->\nnew\n<!-- x:end -->."

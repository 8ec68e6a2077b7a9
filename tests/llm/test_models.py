"""Quality, toxicity, scoring and URL filters: held-out accuracy, gradients, odd tables."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.llm import lm_scoring as lm
from tidewatch.llm.quality import keep_good, score_quality
from tidewatch.llm.toxicity import Voters, score_toxicity
from tidewatch.llm.url_filter import FEATURES, RULES, TreeConfig, fit_trees, grow, judge_urls, lexical, with_rates

SF = "/root/testdata/sf0.01"


def auc(score, y):
    order = np.argsort(np.argsort(score)) + 1.0
    n1 = y.sum()
    return (order[y == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * (len(y) - n1))


@pytest.mark.parametrize("score,label,least", [(score_quality, "quality", 0.97), (score_toxicity, "toxic", 0.85)])
def test_held_out_accuracy(spark, score, label, least):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    out = score(docs, labels)
    assert out.count() == docs.count()
    rows = out.join(labels, "doc_id").filter("held_out").collect()
    y, s = np.array([r[label] for r in rows]), np.array([r.score for r in rows])
    assert auc(s + 1e-9 * np.arange(len(s)), y) >= least and s.min() >= 0 and s.max() <= 1
    again = {r.doc_id: r.predicted for r in score(docs, labels.withColumn(label, F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, 1 - F.col(label)).otherwise(F.col(label)))).collect()}
    assert again == {r.doc_id: r.predicted for r in out.collect()}  # held-out labels change nothing


def test_odd_tables(spark, odd, none, labels):
    for score in (score_quality, score_toxicity):
        for table, marks in ((odd, labels), (odd, labels.limit(0)), (none, labels)):
            rows = score(table, marks).collect()
            assert len(rows) == table.count() and all(0 <= r.score <= 1 for r in rows)
    assert keep_good(odd, labels.limit(0)).count() == odd.count() and keep_good(none, labels).count() == 0


def test_voters_see_disguises():
    v = Voters(["lowei", "bad$"])
    names = lambda t: {v.names[k] for k in v(t)}
    assert names("so loweischaft") == {"stem:lowei"} and names("bad badge xlowei") == {"stem:bad$"}
    assert names("an 1d10t") == {"leet"} and names("s-t-u-p-i-d man") == {"spaced"} and "aimed" in names("you are an idiot") and not names("studious people")


def test_long_words_take_linear_time():
    v = Voters(["lowei", "bad$"])
    for unit in ("a", "ab", "a1", "1", "aaa1", "a ", "\u4e2d\u6587", "9@", "bad", "a.b-", "you "):
        text = unit * (400_000 // len(unit))
        began = time.perf_counter()
        v(text)
        assert time.perf_counter() - began < 4, unit
    assert {v.names[k] for k in v("x" * 100_000 + " iiidiot " + "loweei" * 9)} == {"stretched"}


def test_label_model_equals_plain_rounds(spark):
    """The same rounds over all texts at once, text by text and voter by voter; the objective never falls."""
    from tidewatch.llm import toxicity as tox

    r = np.random.default_rng(5)
    toxic = r.random(3000) < 0.1
    fired = r.random((3000, 7)) < np.where(toxic[:, None], [0.6, 0.5, 0.3, 0.2, 0.05, 0.6, 0.5], [0.01, 0.02, 0.001, 0.001, 0.04, 0.01, 0.02])
    fired[:, 5] = np.where(r.random(3000) < 0.97, fired[:, 0], fired[:, 5])  # repeats the first
    fired[:, 6] = np.where(r.random(3000) < 0.9, fired[:, 5], fired[:, 6])  # repeats the repeated one
    rows = [([int(k) for k in np.flatnonzero(f)], [1] * int(f.sum())) for f in fired]
    votes = spark.createDataFrame(rows, "at array<int>, n array<int>").repartition(5)
    model, told = tox.fit_label_model(votes, 7, 9)
    linked = {frozenset((k, int(q))) for k, q in enumerate(model.parent) if q >= 0}
    assert linked <= {frozenset(x) for x in ((0, 5), (5, 6), (0, 6))} and len(linked) == 2
    assert len(told) == 6 and all(b >= a - 1e-6 * abs(a) for a, b in zip(told, told[1:])) and told[-1] > told[0]

    def joints(m):
        out = np.zeros((len(fired), 2))
        for t, f in enumerate(fired):
            for c, (p, share) in enumerate(((m.toxic, m.prior), (m.other, 1 - m.prior))):
                out[t, c] = np.log(share)
                for k in range(7):
                    q = p[k, int(m.parent[k] >= 0 and f[m.parent[k]])]
                    out[t, c] += np.log(q if f[k] else 1 - q)
        return out

    def plain_round(m):
        j = joints(m)
        post = 1 / (1 + np.exp(j[:, 1] - j[:, 0]))
        toxic, other = np.zeros((7, 2)), np.zeros((7, 2))
        for k in range(7):
            up = fired[:, m.parent[k]] if m.parent[k] >= 0 else np.zeros(len(fired), bool)
            a1, n1, a0, n0 = ((w * (fired[:, k] & ~up)).sum() if hit else (w * ~up).sum() for w in (post, 1 - post) for hit in (True, False))
            def objective(p1, p0, a1=a1, n1=n1, a0=a0, n0=n0):
                return (a1 + 0.02) * np.log(p1) + (n1 - a1 + 0.08) * np.log1p(-p1) + (a0 + 0.001) * np.log(p0) + (n0 - a0 + 0.999) * np.log1p(-p0)
            p1, p0 = (a1 + 0.02) / (n1 + 0.1), (a0 + 0.001) / (n0 + 1)
            if p1 < 3 * p0:  # the best pair with the least ratio, by trying
                grid = np.linspace(1e-6, 0.33, 400_001)
                p0 = grid[np.argmax(objective(3 * grid, grid))]
                p1 = 3 * p0
            toxic[k], other[k] = np.clip(p1, 1e-5, 0.95), np.clip(p0, 1e-7, 0.3)
            if m.parent[k] >= 0:
                toxic[k, 1] = np.clip(((post * (fired[:, k] & up)).sum() + m.pooled[k]) / ((post * up).sum() + 1), 1e-4, 1 - 1e-4)
                other[k, 1] = np.clip((((1 - post) * (fired[:, k] & up)).sum() + m.pooled[k]) / (((1 - post) * up).sum() + 1), 1e-4, 1 - 1e-4)
        return tox.LabelModel(float(np.clip(post.mean(), 1e-4, 0.5)), toxic, other, m.parent, m.pooled), np.logaddexp(j[:, 0], j[:, 1]).sum() + m.log_prior()

    for start in (tox.LabelModel.started(7), model):
        (got, value), (want, plain) = tox.em_round(votes, start), plain_round(start)
        assert abs(value - plain) < 1e-6 * abs(plain) and abs(got.prior - want.prior) < 1e-9
        assert np.allclose(got.toxic, want.toxic, rtol=1e-4, atol=3e-6) and np.allclose(got.other, want.other, rtol=1e-4, atol=1e-6)
    post = 1 / (1 + np.exp(np.diff(joints(model))[:, 0]))
    assert ((post > 0.5) == toxic).mean() > 0.93


def test_any_number_of_stems_vote(spark):
    from tidewatch.llm import toxicity as tox

    letters = "abcdefghijklmnopqrst"
    stems = [a + b + c + "zu" for a in letters for b in letters for c in "xyz"]  # 1,200 stems
    r = random.Random(1)
    rows = [(k, " ".join(r.sample(stems, 6))) for k in range(1500)] + [(2000 + k, " ".join(r.choice(["good", "plain", "words", "here"]) for _ in range(12))) for k in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = docs.select("doc_id", (F.col("doc_id") < 2000).cast("int").alias("toxic"))
    found = tox.find_stems(docs.join(labels, "doc_id").select(F.col("toxic").alias("label"), "text"), tox.ToxicConfig(least_odds=10))
    assert len(found) > 1000 and len(set(found)) == len(found) and not any(a != b and a.startswith(b) for a in found[:200] for b in found if not b.endswith("$"))
    out = tox.score_toxicity(docs, labels, tox.ToxicConfig(least_odds=10, em_rounds=4)).join(labels, "doc_id")
    assert out.filter("predicted <> toxic").count() < 30


def small_network():
    cfg = lm.LmConfig(digits=(4, 4), classes=4, hidden=3, batch=8)
    net, r = lm.Network(cfg), np.random.default_rng(0)
    net.flat[:] = r.normal(0, 0.5, len(net.flat))
    return cfg, net, r


def test_network_against_single_tokens():
    """Each token's probability by itself, from its neighbours in its own text; over all tokens they sum to 1."""
    cfg, net, r = small_network()
    token, first = r.integers(0, 16, 60), np.array([0, 25, 25, 26, 60])
    got = net.log_probability(token, first)
    for lo, hi in zip(first[:-1], first[1:]):
        text = [cfg.edge] * 2 + token[lo:hi].tolist() + [cfg.edge] * 2
        for at in range(2, len(text) - 2):
            h = np.tanh(net.offset + sum(net.embed[0][text[at - d]] + net.embed[1][text[at + d]] for d in (1, 2)))
            high = h @ net.high + net.high_bias
            p = {}
            for t in range(16):
                low = h @ net.low + net.low_bias[t // 4]
                p[t] = np.exp(high[t // 4]) / np.exp(high).sum() * np.exp(low[t % 4]) / np.exp(low).sum()
            assert sum(p.values()) == pytest.approx(1, abs=1e-5) and got[lo + at - 2] == pytest.approx(np.log(p[text[at]]), abs=1e-4)
    assert np.allclose(lm.scored(net, token[26:], np.array([0, 34]), most=5), got[26:], atol=1e-5)


def test_network_learns():
    cfg, net, r = small_network()
    token = np.repeat(r.integers(0, 16, 100), 4)
    first = np.array([0, 150, 150, 400])
    before = net.log_probability(token, first).mean()
    for _ in range(200):
        net.step(token, first, 0.5, 0.3)
    assert net.log_probability(token, first).mean() > before + 1


def test_network_beats_counts(spark):
    """On texts that it has not seen, each token given its neighbours is likelier than by its count alone."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    new = F.pmod(F.xxhash64("doc_id"), F.lit(5)) == 0
    counts, cfg = lm.word_counts(docs.filter(~new)).persist(), lm.LmConfig()
    tokens = lm.tokenise(docs, lm.vocabulary(counts, cfg), cfg).filter("key is not null").persist()
    codes = lm.token_codes(*lm.neighbours(tokens.filter(~new), cfg), cfg)
    net, unigram, gain, n = lm.train(tokens.filter(~new), codes, cfg), np.log((codes.counts + 0.1) / (codes.counts + 0.1).sum()), 0.0, 0
    for r in tokens.filter(new).select("tokens").collect():
        token = codes.number[np.frombuffer(r.tokens, cfg.token).astype(np.int64)]
        gain += (lm.scored(net, token, np.array([0, len(token)])) - unigram[token]).sum()
        n += len(token)
    assert gain / n > 0.5


def test_scores_do_not_hang_on_partitions(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    cfg = lm.LmConfig(group_tokens=5000)
    few, many = ({r.doc_id: r.log_likelihood for r in lm.score_documents(docs.repartition(n, F.rand(n)), cfg).collect()} for n in (2, 16))
    assert few.keys() == many.keys() and all(abs(few[k] - many[k]) <= 1e-6 * max(1, abs(few[k])) for k in few)


def test_scores(spark, make, odd, none):
    r = random.Random(2)
    usual = [" ".join(r.choice(["the cat sat", "a dog ran"]) for _ in range(40)) for _ in range(60)]
    strange = " ".join(r.choice(["cat", "the", "ran", "sat", "a", "dog"]) for _ in range(120))
    rows = {x.doc_id: x for x in lm.score_documents(make([*usual, strange, "", None])).collect()}
    assert rows[60].per_token < min(rows[k].per_token for k in range(60))
    assert rows[61].n_tokens == rows[62].n_tokens == 0 and rows[61].log_likelihood == 0 and rows[61].per_token is None
    assert lm.score_documents(odd).count() == odd.count() and lm.score_documents(none).count() == 0


def test_every_word_has_its_own_probability(spark, make):
    cfg = lm.LmConfig(digits=(4, 4), classes=2, rounds=1)
    usual = [" ".join(f"w{k}" for k in range(14))] * 60
    rows = {x.doc_id: x for x in lm.score_documents(make([*usual, *["w1 w2 seldom w3 w4"] * 6, "w1 w2 junk w3 w4", "w5 junk2 junk3 w6"]), cfg).collect()}
    assert rows[60].log_likelihood - rows[66].log_likelihood == pytest.approx(np.log(6), abs=1e-4)
    many = lm.score_documents(make([f"a{k} b{k} a{k % 7}" for k in range(3000)] + ["!!!"])).collect()
    assert len(many) == 3001 and all(x.log_likelihood < 0 for x in many if x.n_tokens) and sum(x.n_tokens for x in many) == 9000


def test_vocabulary_grows(spark):
    counts = spark.range(9000).selectExpr("id as word", "500L as n", "id as ending")
    assert lm.grown(lm.LmConfig(), counts) == lm.LmConfig()
    more = spark.range(9000).selectExpr("id as word", "50000L as n", "id as ending")
    cfg = lm.grown(lm.LmConfig(), more)
    assert cfg.words >= 9000 and cfg.digits[0] & (cfg.digits[0] - 1) == 0 and len(lm.vocabulary(more, cfg).hashes) == 9000 and lm.grown(cfg, more.limit(0)) == cfg


def test_rules_and_parts(spark):
    urls = ["https://WWW.Example.com/en/1", "http://a.example.com/en/2?x=1", "https://example.com/de/", "https://x.net/es/1", "x.net/es", None, "", "ftp://com", "https://a.com#/en/", "https://notcom/x", "https://h.org?q=1://b/c", "https://a.com?/z"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("host", F.lit("clash")).withColumn("rule", F.lit("clash"))
    got = {r.page_id: (r.host, r.path, r.rule) for r in judge_urls(df).collect()}
    assert got == {0: ("www.example.com", "/en/1", "www.example.com/en/"), 1: ("a.example.com", "/en/2", "example.com/en/"), 2: ("example.com", "/de/", "com/"), 3: ("x.net", "/es/1", "net/es/"), 4: ("", "", None), 5: ("", "", None), 6: ("", "", None), 7: ("com", "", None), 8: ("a.com", "", None), 9: ("notcom", "/x", None), 10: ("h.org", "", None), 11: ("a.com", "", None)}
    verdicts = {r.page_id: r.verdict for r in judge_urls(df).collect()}
    assert (verdicts[0], verdicts[1], verdicts[3]) == ("allow", "block", "block") and set(verdicts.values()) <= {"allow", "block"}
    assert judge_urls(df.limit(0)).count() == 0 and judge_urls(df.filter("page_id = 4")).first().verdict == "block"


def test_trees_learn_and_read_back_as_columns(spark):
    r = np.random.default_rng(1)
    x = r.integers(0, 9, (600, len(FEATURES))).astype(float)
    y = ((x[:, 2] > 4) ^ (x[:, 5] > 6)).astype(float)
    trees = grow(x, y)
    p = trees.predict(x)
    assert ((p > 0.5) == (y > 0)).mean() > 0.97
    df = spark.createDataFrame([tuple(map(float, row)) for row in x[:50]], ", ".join(f"{f} double" for f in FEATURES))
    assert np.allclose([v[0] for v in df.select(trees.column()).collect()], p[:50])
    assert len(RULES) == 5


def test_held_out_urls(spark):
    """A quarter of the ruled urls, by hash, are hidden from rates and trees."""
    table = lexical(spark.read.parquet("/root/testdata/sf0.1/pages.parquet")).filter("ruled is not null")
    hidden = F.pmod(F.xxhash64("key", F.lit(1)), F.lit(4)) == 0
    table = with_rates(table.withColumn("label", F.when(~hidden, (F.col("ruled") == "block").cast("double"))), TreeConfig()).persist()
    rows = table.withColumn("score", fit_trees(table, TreeConfig()).column()).filter("label is null").select("score", "ruled", "tld").collect()
    y, s = np.array([r.ruled == "block" for r in rows]), np.array([r.score for r in rows])
    com = np.array([r.tld == "com" for r in rows])
    assert auc(s, y) > 0.95 and auc(s[com], y[com]) > 0.95 and ((s >= 0.5) == y).mean() > 0.95


def test_rates_leave_out_the_own_fold(spark):
    rows = [(k, f"https://h{k % 3}.d.com/f{k % 2}/x", float(k % 4 == 0) if k % 5 else None) for k in range(60)]
    df = lexical(spark.createDataFrame(rows, "page_id long, url string, y double").select("page_id", "url")).join(spark.createDataFrame(rows, "page_id long, u string, label double").drop("u"), "page_id")
    cfg = TreeConfig()
    got = {r.page_id: r for r in with_rates(df, cfg).collect()}
    fold = {k: r.key % 5 for k, r in got.items()}
    known = {k: y for k, _, y in rows if y is not None}
    total = round(sum(known.values()) / len(known), 6)
    for k, r in got.items():
        mine = [y for j, y in known.items() if j % 3 == k % 3 and not (k in known and fold[j] == fold[k])]
        assert r.label_rate == pytest.approx((sum(mine) + cfg.smoothing * total) / (len(mine) + cfg.smoothing), abs=1e-5)


def test_odd_urls(spark):
    long = "https://a.com/" + "x/" * 200_000
    df = spark.createDataFrame([(1, long), (2, None), (2, None), (3, "http://b.net/es/1"), (3, "http://b.net/es/1"), (None, "q"), (4, "http://c.org/z")], "page_id long, url string").withColumns({c: F.lit("1") for c in ("label", "key", "score", "path", "tld", "s")})
    rows = judge_urls(df).collect()
    assert len(rows) == 7 and {r.rule for r in rows if r.page_id == 3} == {"net/es/"} and [len(r.path) for r in rows if r.page_id == 1] == [400_001]
    assert len({(r.verdict, r.score) for r in rows if r.page_id == 2}) == 1


def test_the_vocabulary_stops_at_its_ceiling(spark, make):
    from dataclasses import replace

    r = random.Random(3)
    words = ["".join(r.choice("abcdefghij") for _ in range(5)) for _ in range(100)]
    docs = make([" ".join(r.choice(words) for _ in range(60)) for _ in range(120)] + ["", None])
    counts = lm.word_counts(docs)
    small = lm.LmConfig(digits=(4, 4), classes=7, group_tokens=2000, marks=8)
    free, held = lm.grown(small, counts), lm.grown(replace(small, most_tokens=64), counts)
    assert free.size > 64 >= held.size > small.size
    rows = lm.score_documents(docs, replace(small, most_tokens=64)).collect()
    again = lm.score_documents(docs.repartition(3), replace(small, most_tokens=64)).collect()
    assert sorted((x.doc_id, x.n_tokens, round(x.log_likelihood, 6)) for x in rows) == sorted((x.doc_id, x.n_tokens, round(x.log_likelihood, 6)) for x in again)
    # every word has a probability of its own: a text of any 60 words is worth about the log of one in 100 a word, and none is free
    assert all(-7 < x.per_token < -3 for x in rows if x.n_tokens)

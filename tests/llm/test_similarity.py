"""N-gram join, decontamination and the text kernel against brute force."""

import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
import regex
from pyspark.sql import functions as F

from tidewatch.llm.components import connected_components
from tidewatch.llm.common import Scratch
from tidewatch.llm.decontaminate import EditConfig, find_leaks, near_distance, without_leaks
from tidewatch.llm.ngram_join import ForestConfig, classify, intersections, one_of_each
from tidewatch.llm.textkernel import iter_words

from .conftest import words


def grams(text, n=5):
    w = regex.findall(r"[\p{L}\p{N}\p{M}_]+", (text or "").lower())
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def brute(texts):
    n = len(texts)
    sets = [grams(t) for t in texts]
    near = lambda a, b: (9 * len(sets[a] & sets[b]) >= 4 * (len(sets[a]) + len(sets[b])) if sets[a] or sets[b] else (texts[a] or "") == (texts[b] or ""))
    links = [sum(near(a, b) for b in range(n) if b != a) for a in range(n)]
    label = list(range(n))
    for _ in range(n):
        label = [min(label[b] for b in range(n) if b == a or near(a, b)) for a in range(n)]
    return label, links


@pytest.fixture(scope="module")
def near_texts():
    r = random.Random(3)
    out = []
    for _ in range(12):
        base = words(r, r.randrange(6, 120)).split()
        for _ in range(r.randrange(1, 8)):
            w = list(base)
            for _ in range(r.randrange(0, max(1, len(w) // 25) + 1)):
                w[r.randrange(len(w))] = "zz" + words(r, 1)
            out.append(r.choice([" ", " ", ". "]).join(w).title() if r.random() < 0.2 else " ".join(w))
    return out + ["", "", None, "!!", "a b", "a b", "a b c"]


@pytest.mark.parametrize("cfg", [ForestConfig(), ForestConfig(node_rows=2, block_bytes=700)], ids=["whole", "in blocks"])
def test_classes_and_links_equal_brute_force(make, near_texts, cfg):
    label, links = brute(near_texts)
    got = {r.doc_id: r for r in classify(make(near_texts), cfg).collect()}
    assert [got[k].class_id for k in range(len(near_texts))] == label
    assert [got[k].n_links for k in range(len(near_texts))] == links


def test_recall_at_the_threshold(make):
    r = random.Random(12)
    texts = []
    while len(texts) < 4000:
        base = [f"{r.getrandbits(40):x}" for _ in range(60)]
        other = list(base)
        other[r.randrange(60)] = "x"
        if r.random() < 0.5:
            other[0] = "y"
        a, b = grams(" ".join(base)), grams(" ".join(other))
        if 0.8 <= len(a & b) / len(a | b) <= 0.86:
            texts += [" ".join(base), " ".join(other)]
    rows = {x.doc_id: x.n_links for x in classify(make(texts)).collect()}
    assert sum(rows.values()) >= 0.99 * len(texts) and max(rows.values()) == 1


def test_dense_nodes_follow_longer_prefixes(make):
    """One group of near texts much larger than a node, and texts at the threshold from it: the components are found whole."""
    r = random.Random(13)
    base = words(r, 60).split()
    texts = []
    for _ in range(120):
        w = list(base)
        for at in r.sample(range(60), r.choice([0, 1, 1, 2])):
            w[at] = r.choice(["aa", "bb", "cc"])
        texts.append(" ".join(w))
    label, links = brute(texts)
    got = {x.doc_id: x for x in classify(make(texts), ForestConfig(node_rows=8, block_bytes=4000)).collect()}
    assert [got[k].class_id for k in range(len(texts))] == label and [got[k].n_links for k in range(len(texts))] == links


def test_one_of_each_keeps_the_least_id(make, near_texts):
    label, _ = brute(near_texts)
    assert sorted(r.doc_id for r in one_of_each(make(near_texts)).collect()) == sorted(set(label))


def test_join_of_odd_tables(odd, none):
    rows = classify(odd).collect()
    assert len(rows) == odd.count()
    assert {r.class_id for r in rows if r.doc_id in (4, 5)} == {4, 5}  # the second text under id 5 stands alone
    assert sorted(r.n_links for r in rows if r.class_id == 4) == [2, 2, 2]
    kept = one_of_each(odd)
    assert kept.columns == odd.columns and kept.filter("doc_id = 4").count() == 1
    assert classify(none).count() == 0 and one_of_each(none).count() == 0
    tie = odd.filter("doc_id = 4").limit(1).withColumn("doc_id", F.explode(F.array(F.lit(None).cast("long"), F.lit(3).cast("long"))))
    assert [x.class_id for x in classify(tie).collect()] == [3, 3] and [x.doc_id for x in one_of_each(tie).collect()] == [3]


def test_words_of_any_script():
    text = "“Curly” «guillemets» dash–dash… ¿qué? ¡sí! „so“ e\u0301tude \u0e44\u0e17\u0e22\u0e21\u0e37\u0e2d \U0001f600x \u4e2d\u6587\u3002\u5b57 a_b ½ İx"
    for t in (text, text[::-1], "", "\u201c", "…a"):
        for _, _, w, _ in iter_words(pa.array([t])):
            assert len(w) == len(regex.findall(r"[\p{L}\p{N}\p{M}_]+", t.lower()))


def test_signs_of_other_scripts_part_words(spark, make):
    item = words(random.Random(3), 12)
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    signs = [("“", "”"), ("«", "»"), ("¿", "?"), ("–", "…"), ("„", "“")]
    docs = make([f"x {a}{b.join(item.split())}{b} y" if b != "?" else f"x {a}{item}{b} y" for a, b in signs])
    assert sorted((x.doc_id, x.edits) for x in find_leaks(docs, bench).collect()) == [(k, 0) for k in range(5)]


def test_common_pieces_without_the_passage(spark, make):
    r = random.Random(4)
    item = words(r, 40).split()
    texts = [" ".join(w for _ in range(60) for w in (*item[4 * (k % 9) : 4 * (k % 9) + 6], f"q{k}")) for k in range(40)] + [" ".join(item[:36])]
    bench = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    assert [(x.doc_id, x.edits) for x in find_leaks(make(texts), bench).collect()] == [(40, 4)]


def test_depth_reaches_the_target():
    cfg = ForestConfig()
    assert 1 - (1 - 0.8**cfg.depth) ** cfg.trees >= cfg.target_recall > 1 - (1 - 0.8 ** (cfg.depth + 1)) ** cfg.trees


def test_intersections():
    r = np.random.default_rng(0)
    sets = [np.unique(r.integers(0, 60, 30)).astype(np.uint64) for _ in range(9)]
    got = intersections(sets)
    for a in range(9):
        for b in range(9):
            if a != b:
                assert got[a, b] == len(np.intersect1d(sets[a], sets[b]))


def test_components(spark):
    edges = [("a", "b"), ("c", "b"), ("d", "c"), ("x", "y"), ("y", "y")] + [(f"n{k:03}", f"n{k + 1:03}") for k in range(60)]
    got = defaultdict(set)
    for r in connected_components(spark.createDataFrame(edges, "a string, b string"), Scratch(spark, "t")).collect():
        got[r.component].add(r.node)
    assert got["a"] == set("abcd") and got["x"] == set("xy") and len(got["n000"]) == 61 and len(got) == 3


def distance(pattern, text):
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        new = [i]
        for j, t in enumerate(text, 1):
            new.append(min(row[j - 1] + (p != t), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_bit_parallel_distance():
    r = random.Random(5)
    for _ in range(300):
        p, t = [r.randrange(4) for _ in range(r.randrange(1, 90))], [r.randrange(4) for _ in range(r.randrange(0, 40))]
        assert near_distance(p, t, 10**6)[0] == distance(p, t)


def test_leaks_equal_brute_force(spark, make):
    r = random.Random(8)
    items = [words(r, r.randrange(5, 70)) for _ in range(15)]
    texts = []
    for k in range(120):
        w = words(r, r.randrange(0, 80)).split()
        if k % 2:
            p = r.choice(items).split()
            for _ in range(r.randrange(0, len(p) // 3 + 1)):
                at = r.randrange(len(p))
                p[at : at + r.choice([0, 1, 1])] = r.choice([[], ["zzz"], ["zzz"]])
            at = r.randrange(len(w) + 1)
            w[at:at] = [x.upper() + "," for x in p]
        texts.append(" ".join(w))
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    want = {}
    for d, t in enumerate(texts):
        tw = regex.findall(r"[\p{L}\p{N}\p{M}_]+", t.lower())
        for i, item in enumerate(items):
            m = item.split()
            if (e := distance(m, tw)) <= int(0.2 * len(m)):
                want[d, i] = e
    for cfg in (EditConfig(), EditConfig(block_words=50)):
        got = {(x.doc_id, x.item_id): x.edits for x in find_leaks(make(texts), bench, cfg).collect()}
        assert got == want
    left = {x.doc_id for x in without_leaks(make(texts), bench).collect()}
    assert left == set(range(len(texts))) - {d for d, _ in want} and want


def test_leaks_of_odd_tables(spark, odd, none):
    bench = spark.createDataFrame([(None, None), (1, ""), (2, "one two three four five six seven"), (3, "two words")], "item_id long, text string")
    assert sorted(r.doc_id for r in find_leaks(odd, bench).collect()) == [4, 4, 5]
    assert without_leaks(odd, bench).count() == odd.count() - 3
    assert find_leaks(none, bench).count() == 0 and find_leaks(odd, bench.limit(0)).count() == 0 and without_leaks(odd, bench.limit(0)).count() == odd.count()


def test_short_items_are_found_exactly(spark, make):
    bench = spark.createDataFrame([(0, "Who wrote Faust?"), (1, "zebra"), (2, "..."), (3, "who wrote it")], "item_id long, text string")
    docs = make(["they asked: who wrote faust", "who then wrote Faust", "a Zebra, and another", "wrote faust who", "zebras", ""])
    assert sorted((x.doc_id, x.item_id, x.edits) for x in find_leaks(docs, bench).collect()) == [(0, 0, 0), (2, 1, 0)]
    assert sorted(x.doc_id for x in without_leaks(docs, bench).collect()) == [1, 3, 4, 5]


def test_words_do_not_run_over_texts():
    got = [(list(np.diff(first)), len(set(w))) for _, _, w, first in iter_words(pa.array(["ab cd", "ab", None, "", "ab cd\nÉt"]))]
    assert got == [([2, 1, 0, 0, 3], 3)]


def test_a_text_that_repeats_a_common_piece_is_read_in_bounded_runs():
    import resource
    import time

    from tidewatch.llm.decontaminate import EditConfig, Pieces, matches, near_distance

    r = np.random.default_rng(5)
    shared = np.array([11, 12, 13], np.uint64)
    items = [(k, np.concatenate([shared, r.integers(100, 10**9, 12, dtype=np.uint64)])) for k in range(500)]
    pieces = Pieces(items, EditConfig())
    text = np.tile(shared, 66_700)[:200_000].copy()
    planted = {7: (0, 50_000), 44: (2, 120_001), 300: (0, 199_900)}
    for k, (edits, at) in planted.items():
        passage = items[k][1].copy()
        passage[5 : 5 + edits] = np.uint64(5)
        text[at : at + 15] = passage
    text[80_000:80_015] = items[7][1]  # a second copy
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    began = time.time()
    got = matches(pieces, text, np.array([0, len(text)]))
    took, grown = time.time() - began, (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) / 1024
    assert [(t, i, e) for t, i, e, _, _ in got] == [(0, k, planted[k][0]) for k in sorted(planted)] and took < 10 and grown < 300
    for _, i, e, _, end in got:
        around = text[end - 40 : end + 40] if end > 40 else text[:80]
        assert near_distance(items[i][1].tolist(), around.tolist(), 3)[0] == e and end == planted[i][1] + 15
    short = text[49_900:50_100]
    want = [(0, k) for k, w in items if near_distance(w.tolist(), short.tolist(), 3)[0] <= 3]
    assert [(t, i) for t, i, *_ in matches(pieces, short, np.array([0, len(short)]))] == want == [(0, 7)]

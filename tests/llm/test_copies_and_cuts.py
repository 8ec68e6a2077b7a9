"""Block naming, cuts for fill-in-the-middle and hard negatives against plain versions, on small and odd tables."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.llm.exact_dedup import DedupConfig, exact_duplicates, without_copies
from tidewatch.llm.fim import FimConfig, Scan, automaton, draws, fill_in_middle, restored
from tidewatch.llm.hard_negatives import NegativeConfig, hard_negatives

from .conftest import words

SENTINELS = (b"<P>", b"<S>", b"<M>")


def plain_groups(rows):
    """(doc_id, text) to rows of the contract, by a dictionary of texts."""
    groups = {}
    for k, (doc_id, text) in enumerate(rows):
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", text or ""), []).append((-len(text or ""), doc_id is None, doc_id or 0, k))
    out = []
    for text, members in groups.items():
        best = min(members)
        out += [(rows[m[3]][0], rows[best[3]][0], len(members), m is best or m == best, hashlib.sha256(text.encode()).hexdigest()) for m in members]
    return sorted(out, key=str)


def test_names_equal_a_dictionary_of_texts(make):
    r = random.Random(3)
    base = [words(r, r.randrange(0, 60)) for _ in range(40)] + ["", " \t\n", "abcdabcdabcd", "abcdabcd", "abcd", "abcdabce", "dcbaabcd" * 9]
    texts = [None]
    for _ in range(400):
        t = r.choice(base)
        texts.append("".join(c + (r.choice(" \n\x0b") if r.random() < 0.05 else "") for c in t) + r.choice(["", "", "x", " "]))
    rows = list(enumerate(texts))
    for size, remembered in ((4, 1 << 20), (7, 300), (1 << 14, 1 << 20)):
        got = exact_duplicates(make(texts), DedupConfig(size, 5_000, remembered)).collect()
        assert sorted([(x.doc_id, x.keep_id, x.group_size, x.kept, x.text_sha256) for x in got], key=str) == plain_groups(rows)
        assert len({(x.depth, x.name) for x in got}) == len({x.text_sha256 for x in got})


def test_one_row_of_each_text_stays(make, odd, none):
    docs = make(["a b", "ab", "b a", "a  b", None, ""])
    assert sorted(x.doc_id for x in without_copies(docs).collect()) == [2, 3, 4]
    rows = odd.select("doc_id", "text").collect()
    got = exact_duplicates(odd, DedupConfig(16)).collect()
    assert sorted([(x.doc_id, x.keep_id, x.group_size, x.kept, x.text_sha256) for x in got], key=str) == plain_groups([tuple(x) for x in rows])
    assert sum(x.kept for x in got) == len({x.text_sha256 for x in got})
    assert exact_duplicates(none).count() == 0 == without_copies(none).count()


def test_a_hot_text_is_sent_once_by_each_task(spark, make):
    from tidewatch.llm.exact_dedup import blocks_of

    docs = make(["the same text again and again"] * 3000 + ["another"]).repartition(4)
    sent = blocks_of(docs).filter("block is not null").groupBy("block").count().collect()
    assert all(x["count"] <= 4 for x in sent) and exact_duplicates(docs).filter("kept").count() == 2


def test_query_has_the_columns_of_its_sql(spark):
    from tidewatch.llm.exact_dedup import op11_exact_dedup

    assert op11_exact_dedup(spark, "/root/testdata/sf0.001").columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]


@pytest.mark.parametrize("units", ["chars", "words"])
def test_scan_equals_one_reader(units):
    r, auto = random.Random(1), automaton(units, SENTINELS)
    starts = lambda t: [m.start() for m in re.finditer(r"(?s)." if units == "chars" else r"[^ \t-\r]+", t)]
    texts = ["".join(r.choice("ab é<PSM> 漢\n") for _ in range(r.randrange(0, 900))) for _ in range(40)] + ["", "<", "<P", "<P>", "<<P><S>"]
    for chunk in (1, 3, 64, 4096):
        scan = Scan(auto, [t.encode() for t in texts], chunk)
        state, total = scan.compose(np.zeros(len(texts), np.int32))
        for k, t in enumerate(texts):
            own = starts(t)
            assert total[k] == len(own) and (int(state[k]) in auto.found) == any(s.decode() in t for s in SENTINELS)
            at = sorted({0, len(own), *[r.randrange(len(own) + 1) for _ in range(4)]})
            for u, place in zip(at, scan.places(np.full(len(at), k), np.array(at)), strict=True):
                assert place == len(t[: own[u]].encode() if u < len(own) else t.encode())


def plain_fim(doc_id, text, units="chars"):
    h1, h2, h3, h4 = draws(doc_id, FimConfig())
    own = [m.start() for m in re.finditer(r"(?s)." if units == "chars" else r"[^ \t-\r]+", text)]
    if not own or any(s.decode() in text for s in SENTINELS) or h3 % 100 >= 90:
        return len(own), "plain", None, None, text
    a, b = sorted((h1 % (len(own) + 1), h2 % (len(own) + 1)))
    at = [*own, len(text)]
    p, m, s = text[: at[a]], text[at[a] : at[b]], text[at[b] :]
    spm = h4 % 100 < 20
    return len(own), "spm" if spm else "psm", a, b - a, f"<S>{s}<P>{p}<M>{m}" if spm else f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize(("units", "piece"), [("chars", 64 << 10), ("chars", 100), ("words", 128), ("chars", 33)])
def test_cuts_equal_plain_ones(make, units, piece):
    r = random.Random(5)
    texts = [None, "", " ", "x", "<M>", "a<P>b", "漢字 é \U0001f600" * 30] + [words(r, r.randrange(0, 80)) + r.choice(["", "\n é漢", "<S", " <S>"]) for _ in range(150)]
    config = FimConfig(units=units, piece_bytes=piece, chunk_bytes=32)
    got = fill_in_middle(make(texts), config).withColumn("back", restored("output", "form", config)).collect()
    assert len(got) == len(texts) and {x.form for x in got} == {"plain", "psm", "spm"}
    for x in got:
        text = texts[x.doc_id] or ""
        assert (x.n, x.form, x.prefix_units, x.middle_units, x.output) == plain_fim(x.doc_id, text, units) and x.back == text


def test_odd_tables_fim(odd, none):
    for piece in (64 << 10, 50):
        got = fill_in_middle(odd, FimConfig(piece_bytes=piece)).collect()
        want = [(x.doc_id, *plain_fim(x.doc_id, x.text or "")) for x in odd.select("doc_id", "text").collect()]
        assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert fill_in_middle(none).count() == 0


def plain_negatives(rows, config):
    rows = [(k, i, (lab + 1) % config.labels if i % 7 == 0 else lab, [np.floor(float(x) * 256) for x in v]) for k, (i, v, lab) in enumerate(rows) if i is not None and lab is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    dot = lambda a, b: int(sum(x * y for x, y in zip(a, b)))
    out = []
    for k, i, lab, v in rows:
        if i % config.anchor_every:
            continue
        scored = sorted((-dot(v, w), j, m, other) for m, j, other, w in rows if m != k)
        for s, j, _, _ in [x for x in scored if x[3] == lab][: config.positives]:
            band = [x for x in scored if x[3] != lab and 80 * -s <= 100 * -x[0] <= 100 * -s]
            out += [(i, j, n + 1, x[1], -s, -x[0]) for n, x in enumerate(band[: config.negatives])]
    return sorted(out)


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


@pytest.mark.parametrize("seed", [1, 2])
def test_negatives_equal_all_pairs(spark, seed):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(6, 5))
    rows = []
    for k in range(700):
        v = centres[k % 6] + 0.4 * r.normal(size=5) if k % 3 else centres[0] * (1 + k % 2)  # a third of the rows are two vectors
        rows.append((k, [float(np.float32(x)) for x in v], int(r.integers(0, 10))))
    rows += [(None, [1.0] * 5, 1), (701, None, 1), (702, [1.0, None, 0.0, 0.0, 0.0], 1), (703, [float("nan")] * 5, 1), (704, [float("inf")] * 5, 1), (705, [1.0] * 5, None), (800, [0.0] * 5, 3), (900, [-1.0, 0.0], 4), (706, [], 4)]
    config = NegativeConfig(anchor_every=20, anchors_per_group=4, least_pivots=3, block_bytes=64 * 8 * 5)
    got = sorted(tuple(x) for x in hard_negatives(vectors(spark, rows).repartition(3), config).collect())
    assert got == plain_negatives(rows, config) and len(got) > 300


def test_bounds_leave_out_far_groups(spark):
    from tidewatch.llm.hard_negatives import Space, _near

    r = np.random.default_rng(3)
    centres = 8 * r.normal(size=(12, 6))
    rows = [(k, [float(np.float32(x)) for x in centres[k % 12] + 0.05 * r.normal(size=6)], k // 12 % 10) for k in range(1200)]
    config = NegativeConfig(anchor_every=10, anchors_per_group=10, least_pivots=12)
    assert sorted(map(tuple, hard_negatives(vectors(spark, rows), config).collect())) == plain_negatives(rows, config)
    # a group that reaches no farther than its own cluster takes no candidates of the others
    space = Space(np.floor(centres * 256), float((np.floor(centres * 256) ** 2).sum(1).max() * 1.1))
    own = np.argmin([np.abs(space.pivots - np.floor(centres[0] * 256)).sum(1)][0])
    points = spark.createDataFrame([(k, k, 0, np.floor(256 * np.array(v)).tobytes()) for k, v, _ in rows], "row long, vec_id long, label int, v binary")
    d = space.distances(np.floor(256 * np.array([v for _, v, _ in rows[::12]])), True)[:, own].max()
    near = _near(points, space, {int(own): 0.0}, reach={int(own): float(d)}).select("vec_id").collect()
    assert {x.vec_id for x in near} >= set(range(0, 1200, 12)) and len(near) < 600


def test_odd_tables_negatives(spark):
    assert hard_negatives(vectors(spark, [])).count() == 0
    assert hard_negatives(vectors(spark, [(1, [1.0], 1)])).count() == 0
    assert hard_negatives(vectors(spark, [(100, [1.0], 1)])).count() == 0
    rows = [(100, [1.0, 0.0], 1), (100, [1.0, 0.0], 1), (3, [1.0, 0.0], 1), (5, [0.875, 0.125], 2), (5, [0.875, 0.125], 2), (6, [-1.0, 0.0], 2)]
    table = vectors(spark, rows).withColumns({c: F.lit("1") for c in ("row", "v", "grp", "block", "score", "rank", "cell")})
    assert sorted(map(tuple, hard_negatives(table).collect())) == plain_negatives(rows, NegativeConfig())

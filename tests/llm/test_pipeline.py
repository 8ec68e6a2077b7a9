"""The corpus pipeline: what each stage keeps and drops is what a brute-force version of it keeps and drops on the same input."""

from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import regex

import corpus_pipeline
from tidewatch.llm import queries
from tidewatch.llm.common import Scratch, small_batches
from tidewatch.llm.decontaminate import near_distance
from tidewatch.llm.mixing import MixConfig, source_targets
from tidewatch.llm.quality import statistics
from tidewatch.llm.sharding import MAP_SETTING, SlotMap

from .test_similarity import brute

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """Rows before and after each stage."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stage(spark, docs, SF).persist()
        seen[name] = (before.collect(), docs.collect())
        assert name == "sharding" or docs.columns == columns
    return seen


def dropped(stages, name):
    before, after = ({r.doc_id: r for r in rows} for rows in stages[name])
    assert all(before[d] == r for d, r in after.items()) and len(after) == len(stages[name][1])
    return before, before.keys() - after.keys()


def test_quality_drops_what_the_densities_reject(spark, stages):
    """The same discriminant, from the covariances and densities themselves: without factors, moments or batches."""
    before, gone = dropped(stages, "quality")
    import zlib

    labels = [r for r in spark.read.parquet(f"{SF}/labels.parquet").collect() if r.quality in (0, 1) and zlib.crc32(str(r.doc_id).encode()) % 5]
    stats = {d: statistics(pa.array([r.text]))[0] for d, r in before.items()}
    x, y = np.array([stats[r.doc_id] for r in labels]), np.array([r.quality for r in labels])
    centre, scale, p = x.mean(0), np.sqrt(np.maximum(x.var(0), 1e-6)), x.shape[1]
    z = (x - centre) / scale
    cov = [np.cov(z[y == k].T, bias=True) for k in (0, 1)]
    pooled = sum((y == k).mean() * cov[k] for k in (0, 1))
    shrunk = [0.7 * c + 0.3 * pooled for c in cov]
    shrunk = [0.95 * s + 0.05 * np.trace(s) / p * np.eye(p) for s in shrunk]

    def density(rows, k):
        d = np.clip((rows - centre) / scale, -12, 12) - z[y == k].mean(0)
        return -0.5 * ((d @ np.linalg.inv(shrunk[k])) * d).sum(1) - 0.5 * np.linalg.slogdet(shrunk[k])[1]

    squash = lambda v: np.sign(v) * np.log1p(np.abs(v))
    ids = sorted(before)
    rows = np.array([stats[d] for d in ids])
    u, v = squash(density(x, 1) - density(x, 0)), squash(density(rows, 1) - density(rows, 0))
    a, b = 1.0, 0.0
    for _ in range(200):  # the line from densities to odds, by plain Newton steps on the rows themselves
        q = 1 / (1 + np.exp(-(a * u + b)))
        g = np.array([((y - q) * u).sum() - (a - 1), (y - q).sum() - 1e-3 * b])
        w = q * (1 - q)
        a, b = np.array([a, b]) + np.linalg.solve(np.array([[(w * u * u).sum() + 1, (w * u).sum()], [(w * u).sum(), w.sum() + 1e-3]]), g)
    score = dict(zip(ids, 1 / (1 + np.exp(-(a * v + b)))))
    clear = {d for d in ids if abs(score[d] - 0.3) > 0.03}  # the operator fits the line on a histogram of 400 cells
    assert gone & clear == {d for d in clear if score[d] < 0.3} and len(clear) > 0.97 * len(ids) and 0 < len(gone) < len(ids) / 2


def test_one_text_of_each_class_stays(stages):
    before, gone = dropped(stages, "near_duplicates")
    ids = sorted(before)
    label, _ = brute([before[d].text for d in ids])
    assert gone == {d for k, d in enumerate(ids) if label[k] != k} and gone


def test_texts_with_a_test_item_go(spark, stages):
    before, gone = dropped(stages, "decontamination")
    split = lambda t: [hash(w) for w in regex.findall(r"[\p{L}\p{N}\p{M}_]+", (t or "").lower())]
    items = [w for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect() if (w := split(r.text))]
    want = {d for d, r in before.items() if any(near_distance(i, split(r.text), int(0.2 * len(i)))[0] <= int(0.2 * len(i)) for i in items)}
    assert gone == want and gone


def test_sources_meet_their_targets(stages):
    before, after = stages["mixing"]
    words = lambda r: len(regex.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
    size, got, longest = Counter(), Counter(), Counter()
    for r in before:
        size[r.source] += words(r)
        longest[r.source] = max(longest[r.source], words(r))
    for r in after:
        got[r.source] += words(r)
    for source, _, target in source_targets(list(size.items()), MixConfig()):
        assert abs(got[source] - target) <= longest[source] / 2 + 1
    rows = {r.doc_id: r for r in before}
    assert all(rows[r.doc_id] == r for r in after) and max(Counter(r.doc_id for r in after).values()) <= 2


def test_every_row_gets_a_place(stages):
    before, after = stages["sharding"]
    assert Counter((r.doc_id, r.text) for r in before) == Counter((r.doc_id, r.text) for r in after)
    load, places = Counter(), defaultdict(list)
    for r in after:
        assert r["size"] == len((r.text or "").encode()) + 1
        load[r.shard] += r["size"]
        places[r.shard].append(r.slot)
    assert all(sorted(p) == list(range(len(p))) for p in places.values()) and max(load.values()) <= sum(load.values()) / 16 + max(r["size"] for r in after)


def test_run_leaves_only_its_result(spark):
    mark = len(Scratch.made)
    out = corpus_pipeline.run(spark, SF)
    assert out.count() > 50 and len(Scratch.made) == mark + 1 and {f.split("/")[-2] for f in out.inputFiles()} == {"05-sharding"}


def test_kept_maps_outlive_the_run_and_are_edited(spark, tmp_path):
    spark.conf.set(MAP_SETTING, str(tmp_path))
    try:
        first, second = (corpus_pipeline.run(spark, SF) for _ in range(2))
        a, b = ({r.virtual_slot: (r.shard, r.map_version) for r in out.select("virtual_slot", "shard", "map_version").distinct().collect()} for out in (first, second))
    finally:
        spark.conf.unset(MAP_SETTING)
    old, new = (SlotMap.load(spark, f"{tmp_path}/pipeline", k) for k in (1, 2))
    assert {v for _, v in a.values()} == {1} and {v for _, v in b.values()} == {2} and SlotMap.versions(spark, f"{tmp_path}/pipeline") == [1, 2]
    assert all(old.shard_of[k] == s for k, (s, _) in a.items()) and all(new.shard_of[k] == s for k, (s, _) in b.items())
    assert a.keys() == b.keys() and sum(x != y for x, y in zip(old.shard_of, new.shard_of)) < len(a) / 10  # edited, not made anew


def test_batch_limit_with_a_unit(spark):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    for value, want in (("64m", str(8 << 20)), ("4m", "4m"), ("100", "100"), ("1g", str(8 << 20))):
        spark.conf.set(key, value)
        small_batches(spark)
        assert spark.conf.get(key) == want
    spark.conf.set(key, before)


def test_every_operator_has_one_query():
    names = [n for n in queries.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
    assert corpus_pipeline.ORACLE_SQL is None and [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "decontamination", "mixing", "sharding"]

"""URL filters: host and path rules, and for all other URLs gradient-boosted trees on lexical features, as plain column expressions.

The URLs that a rule decides are the labelled ones. Beside lengths and counts the trees see how often a url's suffixes, first host label and first
folder are blocked, counted without the url's own fold. The trees are grown on the driver from a bounded sample of binned feature rows and come back as
CASE expressions, so scoring is one projection without any Python on the executors.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch

# The rules of the query, verdict and host/path.
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))

FEATURES = ("url_length", "host_length", "path_length", "path_depth", "host_labels", "digit_ratio", "hyphens", "entropy", "parameters", "query_length", "fragment", "extension", "secure", "tld_rate", "domain_rate", "label_rate", "folder_rate")


@dataclass(frozen=True)
class TreeConfig:
    max_fit_rows: int = 20_000  # labelled URLs that the fit may see, the first by hash
    trees: int = 30
    depth: int = 3
    rate: float = 0.2
    bins: int = 32
    ridge: float = 1.0
    least_rows: float = 5.0
    smoothing: float = 3.0  # rows' worth of the overall rate in a suffix's rate
    folds: int = 5  # a labelled url's rates come from the other folds
    threshold: float = 0.5


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null and for a url without `://`."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def matching_rule(host: Column, path: Column, rules: tuple[tuple[str, str], ...]) -> tuple[Column, Column]:
    """The longest rule that fits (its host equals the url's or is a domain above it; its path starts the url's) and its verdict, else nulls."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for decision, text in sorted(rules, key=lambda r: len(r[1])):  # the longest is asked first
        top, _, rest = text.partition("/")
        fits = ((host == top) | host.endswith("." + top)) & path.startswith("/" + rest)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(decision)).otherwise(verdict)
    return rule, verdict


def _entropy(text: Column) -> Column:
    """Bits a character, rounded: from the lengths that are left when each distinct character goes."""
    size = F.length(text)
    chars = F.array_distinct(F.split(text, ""))
    bits = F.aggregate(chars, F.lit(0.0), lambda a, c: a - _plogp((size - F.length(F.replace(text, c, F.lit("")))) / size))
    return F.when(size > 0, F.round(bits, 6)).otherwise(0.0)


def _plogp(p: Column) -> Column:
    return F.when(p > 0, p * F.log2(p)).otherwise(0.0)


def lexical(pages: DataFrame, rules: tuple[tuple[str, str], ...] = RULES) -> DataFrame:
    """page_id, host, path, rule, ruled (its verdict) and the lexical features of each url; null urls count as empty."""
    host, path = parts(F.col("url"))
    rule, verdict = matching_rule(F.col("host"), F.col("path"), rules)
    url, query = F.coalesce("url", F.lit("")), F.regexp_extract(F.coalesce("url", F.lit("")), r"\?([^#]*)", 1)
    return (
        pages.select("page_id", "url", host.alias("host"), path.alias("path"))
        .select("*", rule.alias("rule"), verdict.alias("ruled"), F.substring_index("host", ".", -1).alias("tld"), F.substring_index("host", ".", -2).alias("domain"), F.substring_index("host", ".", 1).alias("label_1"), F.regexp_extract("path", "^/([^/]*)/", 1).alias("folder"))
        .select(
            "page_id", "host", "path", "rule", "ruled", "tld", "domain", "label_1", "folder", F.xxhash64("page_id", "url").alias("key"),
            F.length(url).cast("double").alias("url_length"),
            F.length("host").cast("double").alias("host_length"),
            F.length("path").cast("double").alias("path_length"),
            F.regexp_count("path", F.lit("/[^/]")).cast("double").alias("path_depth"),
            F.regexp_count("host", F.lit(r"[^.]+")).cast("double").alias("host_labels"),
            F.round(F.regexp_count(url, F.lit("[0-9]")) / F.greatest(F.length(url), F.lit(1)), 6).alias("digit_ratio"),
            F.regexp_count("host", F.lit("-")).cast("double").alias("hyphens"),
            _entropy(url).alias("entropy"),
            F.regexp_count(query, F.lit("[^&]+")).cast("double").alias("parameters"),
            F.length(query).cast("double").alias("query_length"),
            F.when(url.contains("#"), 1.0).otherwise(0.0).alias("fragment"),
            F.when(F.col("path").rlike(r"\.[A-Za-z0-9]{1,5}$"), 1.0).otherwise(0.0).alias("extension"),
            F.when(url.startswith("https://"), 1.0).otherwise(0.0).alias("secure"),
        )
    )


def with_rates(table: DataFrame, cfg: TreeConfig) -> DataFrame:
    """The share of block verdicts (column label) under each url's last label, last two labels, first label and first folder, smoothed towards the
    overall share. A labelled url's rates come from the rows of other folds, so its own label is not in them; all others see all labelled rows.
    """
    total = table.agg(F.avg("label")).first()[0]
    total = 0.5 if total is None else round(total, 6)
    table = table.withColumn("__fold", F.pmod("key", F.lit(cfg.folds)).cast("int"))
    for name, rate in (("tld", "tld_rate"), ("domain", "domain_rate"), ("label_1", "label_rate"), ("folder", "folder_rate")):
        each = [F.struct(F.sum(F.when(F.col("__fold") == k, F.col("label"))).alias("y"), F.count(F.when(F.col("__fold") == k, 1)).alias("n")) for k in range(cfg.folds)]
        sums = table.filter("label is not null").groupBy(name).agg(F.sum("label").alias("__y"), F.count("label").alias("__n"), F.array(*each).alias("__each"))
        own = F.when(F.col("label").isNotNull(), F.get("__each", F.col("__fold")))
        y = F.coalesce("__y", F.lit(0.0)) - F.coalesce(own["y"], F.lit(0.0))
        n = F.coalesce("__n", F.lit(0)) - F.coalesce(own["n"], F.lit(0))
        table = table.join(sums, name, "left").withColumn(rate, F.round((y + cfg.smoothing * total) / (n + cfg.smoothing), 6)).drop("__y", "__n", "__each")
    return table.drop("__fold")


@dataclass(frozen=True)
class Trees:
    """Boosted trees: for each, nested (feature, cut, left, right) with numbers as leaves; left is taken below the cut."""

    start: float
    trees: tuple

    def column(self) -> Column:
        def build(node) -> Column:
            if isinstance(node, float):
                return F.lit(node)
            feature, cut, left, right = node
            return F.when(F.col(feature) < F.lit(cut), build(left)).otherwise(build(right))

        total = F.lit(self.start)
        for tree in self.trees:
            total = total + build(tree)
        return 1 / (1 + F.exp(-total))

    def predict(self, x: np.ndarray) -> np.ndarray:
        def walk(node, rows: np.ndarray) -> np.ndarray:
            if isinstance(node, float):
                return np.full(len(rows), node)
            feature, cut, left, right = node
            low = rows[:, FEATURES.index(feature)] < cut
            out = np.empty(len(rows))
            out[low], out[~low] = walk(left, rows[low]), walk(right, rows[~low])
            return out

        return 1 / (1 + np.exp(-(self.start + sum((walk(t, x) for t in self.trees), start=np.zeros(len(x))))))


def grow(x: np.ndarray, y: np.ndarray, cfg: TreeConfig = TreeConfig()) -> Trees:
    """Second-order boosting of logistic loss by histograms over quantile bins. Without rows the odds are even; with one class they are its smoothed share."""
    if not len(y):
        return Trees(0.0, ())
    share = (y.sum() + 0.5) / (len(y) + 1)
    start = float(np.log(share / (1 - share)))
    if y.min() == y.max():
        return Trees(start, ())
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, cfg.bins + 1)[1:-1], method="higher")) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, f], "right") for f, c in enumerate(cuts)], 1)  # bin b: cuts[b-1] <= value < cuts[b]
    score, trees = np.full(len(y), start), []

    def split(rows: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int):
        gs, hs = g[rows].sum(), h[rows].sum()
        best = (1e-6, None)
        if depth:
            for f, c in enumerate(cuts):
                if not len(c):
                    continue
                gb = np.bincount(binned[rows, f], g[rows], len(c) + 1).cumsum()[:-1]
                hb = np.bincount(binned[rows, f], h[rows], len(c) + 1).cumsum()[:-1]
                nb = np.bincount(binned[rows, f], minlength=len(c) + 1).cumsum()[:-1]
                gain = gb**2 / (hb + cfg.ridge) + (gs - gb) ** 2 / (hs - hb + cfg.ridge) - gs**2 / (hs + cfg.ridge)
                gain[(nb < cfg.least_rows) | (len(rows) - nb < cfg.least_rows)] = -1
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (gain[k], (f, k))
        if best[1] is None:
            leaf = float(-cfg.rate * gs / (hs + cfg.ridge))
            score[rows] += leaf
            return leaf
        f, k = best[1]
        low = binned[rows, f] <= k
        return (FEATURES[f], float(cuts[f][k]), split(rows[low], g, h, depth - 1), split(rows[~low], g, h, depth - 1))

    for _ in range(cfg.trees):
        p = 1 / (1 + np.exp(-score))
        trees.append(split(np.arange(len(y)), p - y, p * (1 - p), cfg.depth))
    return Trees(start, tuple(trees))


def fit_trees(table: DataFrame, cfg: TreeConfig) -> Trees:
    """Trees grown from the labelled rows (label 1: block), at most max_fit_rows of them, the first by hash."""
    rows = table.filter("label is not null").orderBy("key").limit(cfg.max_fit_rows).select("label", *FEATURES).collect()
    x = np.array([r[1:] for r in rows], float).reshape(len(rows), len(FEATURES))
    return grow(x, np.array([r[0] for r in rows], float), cfg)


def judge_urls(pages: DataFrame, rules: tuple[tuple[str, str], ...] = RULES, cfg: TreeConfig = TreeConfig()) -> DataFrame:
    """page_id, host, path, rule, verdict and score (chance of block by the trees) for every row of pages.

    A rule decides where one fits; else the trees do, from the threshold on. Null urls and those without `://` have empty host and path and
    are judged by the trees. Without labelled urls the trees say even odds, that is block. Repeated rows are judged alike, urls of any length whole;
    an empty table gives no rows.

    Scale: one pass makes the features, stored once; four joins with a row for each suffix, label or folder; at most max_fit_rows rows of numbers for the driver.
    """
    scratch = Scratch(pages.sparkSession, "urls")
    table = scratch.table(lexical(pages, rules).withColumn("label", F.when(F.col("ruled") == "block", 1.0).when(F.col("ruled") == "allow", 0.0)), "features")
    table = with_rates(table, cfg)
    trees = fit_trees(table, cfg)
    out = table.select("page_id", "host", "path", "rule", "ruled", F.round(trees.column(), 6).alias("score"))
    return out.select("page_id", "host", "path", "rule", F.coalesce("ruled", F.when(F.col("score") >= cfg.threshold, "block").otherwise("allow")).alias("verdict"), "score")


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"))

"""Quality by regularised quadratic discriminant analysis over transformed document statistics.

Each class has a mean and a covariance, shrunk towards the pooled one and towards a multiple of the identity; a document's score
comes from the difference of its two Gaussian log-densities, by Mahalanobis distances through cached Cholesky factors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, add_up, held_out, spare
from .textkernel import as_strings, buffers, gram_hashes, lowered, mix, word_hashes, word_spans

FEATURES = ("bytes", "words", "word_length", "upper", "digits", "stops", "symbols", "bangs", "pipes", "spaces", "line_length", "repeat_words", "repeat_trigrams", "adjacent", "repeat_lines", "wide_words")

_KINDS = {"upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digits": b"0123456789", "stops": b".,;:?", "symbols": b"#$%&*@~^<>=+\\/{}[]_`", "bangs": b"!", "pipes": b"|", "spaces": b" \t\r\n", "lines": b"\n"}


def _distinct(keys: np.ndarray, text: np.ndarray, n: int) -> np.ndarray:
    """Distinct keys of each text."""
    both = mix(keys + mix(text.astype(np.uint64) + np.uint64(1)))
    _, at = np.unique(both, return_index=True)
    return np.bincount(text[at], minlength=n)



def statistics(col: pa.Array, most: int = 2_000_000) -> np.ndarray:
    """One row of transformed statistics for each text (nulls as empty): shares as log odds per 100 units, sizes as logs."""
    raw = as_strings(col)
    data, off = buffers(raw)
    out = np.zeros((len(raw), len(FEATURES)))
    for i, j, lpart, lo in lowered(raw, most):
        n, part, o = j - i, data[off[i] : off[j]], off[i : j + 1] - off[i]
        size = np.diff(o).astype(float)
        sums = {}
        for name, chars in _KINDS.items():
            flag = np.zeros(256, np.int32)
            flag[list(chars)] = 1
            sums[name] = np.diff(np.concatenate(([0], np.cumsum(flag[part], dtype=np.int64)))[o]).astype(float)
        starts, lens, first = word_spans(lpart, lo)
        words = word_hashes(lpart, starts, lens)
        count = np.diff(first)
        text = np.repeat(np.arange(n), count)
        letters = np.bincount(text, lens, minlength=n)
        same = np.zeros(len(words), bool)
        same[1:] = (words[1:] == words[:-1]) & (text[1:] == text[:-1])
        tri, tri_off = gram_hashes(words, first, 3)
        tri_count = np.diff(tri_off)
        tri_text = np.repeat(np.arange(n), tri_count)
        share = lambda x, whole: np.log((x + 0.02 * whole + 0.2) / (whole + 10.0))
        repeated = count - _distinct(words, text, n)
        tri_repeated = tri_count - _distinct(tri, tri_text, n)
        # a line's key is the sum of its words' hashes
        line_at = np.cumsum(np.concatenate(([0], lpart == 10)))[starts] if len(starts) else np.zeros(0, np.int64)
        if len(words):
            cut = np.flatnonzero(np.concatenate(([True], (line_at[1:] != line_at[:-1]) | (text[1:] != text[:-1]))))
            lines, line_text = np.add.reduceat(words, cut), text[cut]
        else:
            lines, line_text = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        n_lines = np.bincount(line_text, minlength=n)
        line_repeated = n_lines - _distinct(lines, line_text, n)
        wide = np.bincount(text[lens > 18], minlength=n)
        out[i:j] = np.stack(
            [
                np.log1p(size),
                np.log1p(count),
                np.log((letters + 5.0) / (count + 1.0)),
                *(share(sums[k], size) for k in ("upper", "digits", "stops", "symbols", "bangs", "pipes", "spaces")),
                np.log((size + 40.0) / (n_lines + 1.0)),
                share(repeated, count) - 0.25 * np.log1p(count),  # longer texts repeat more words
                share(tri_repeated, tri_count),
                share(np.bincount(text[same], minlength=n), count),
                share(line_repeated, n_lines),
                share(wide, count),
            ],
            axis=1,
        )
    return out


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = statistics(batch.column(1))
        flat = pa.array(x.ravel())
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * len(FEATURES), pa.int32()), flat)
        yield pa.RecordBatch.from_arrays([batch.column(0), lists], ["doc_id", "x"])


def document_statistics(docs: DataFrame) -> DataFrame:
    """doc_id and the statistics of every whole text."""
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_features, "doc_id long, x array<double>")


@dataclass(frozen=True)
class Discriminant:
    """Two Gaussian classes with their inverse Cholesky factors, and the line that turns log-density differences into odds."""

    centre: np.ndarray
    scale: np.ndarray
    means: tuple[np.ndarray, np.ndarray]
    inverse_factors: tuple[np.ndarray, np.ndarray]
    log_dets: tuple[float, float]
    slope: float = 1.0
    offset: float = 0.0
    constant: float | None = None

    def difference(self, x: np.ndarray) -> np.ndarray:
        """log p(x | good) - log p(x | bad)."""
        z = np.clip((x - self.centre) / self.scale, -12, 12)
        d = [((z - m) @ f.T) ** 2 @ np.ones(z.shape[1]) + ld for m, f, ld in zip(self.means, self.inverse_factors, self.log_dets, strict=True)]
        return 0.5 * (d[0] - d[1])

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        d = self.difference(x)
        squashed = np.sign(d) * np.log1p(np.abs(d))  # far tails are no stronger evidence than their order
        return 1 / (1 + np.exp(-np.clip(self.slope * squashed + self.offset, -35, 35)))


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    p = len(FEATURES)
    total = np.zeros((2, 1 + p + p * p))
    for batch in batches:
        y = batch.column(0).to_numpy(zero_copy_only=False).astype(int)
        x = np.asarray(batch.column(1).flatten()).reshape(len(y), p)
        for k in (0, 1):
            own = x[y == k]
            total[k] += np.concatenate(([len(own)], own.sum(0), (own.T @ own).ravel()))
    yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["part"])


def fit(labelled: DataFrame, to_pooled: float = 0.3, to_identity: float = 0.05) -> Discriminant:
    """Fit on all rows (label 0 or 1, x); only class moments leave the executors. With one class or none: a constant score.

    to_pooled and to_identity are the two shrinkage weights. The line from log-density differences to odds is fitted on the same rows, from a
    histogram of 400 cells.
    """
    p = len(FEATURES)
    sums = add_up(labelled.select(F.col("label").cast("int"), "x").mapInArrow(_moments, "part binary"))
    sums = np.zeros((2, 1 + p + p * p)) if sums is None or len(sums) == 1 else sums.reshape(2, -1)
    n = sums[:, 0]
    zero = np.zeros(p)
    if n.min() < 2:
        return Discriminant(zero, zero + 1, (zero, zero), (np.eye(p), np.eye(p)), (0.0, 0.0), constant=float((n[1] + 0.5) / (n.sum() + 1)))
    mean = sums[:, 1 : 1 + p] / n[:, None]
    centre = sums[:, 1 : 1 + p].sum(0) / n.sum()
    second = sums[:, 1 + p :].reshape(2, p, p)
    scale = np.sqrt(np.maximum(np.diag(second.sum(0)) / n.sum() - centre**2, 1e-6))
    cov = [(second[k] / n[k] - np.outer(mean[k], mean[k])) / np.outer(scale, scale) for k in (0, 1)]
    pooled = (n[0] * cov[0] + n[1] * cov[1]) / n.sum()
    factors, dets = [], []
    for k in (0, 1):
        s = (1 - to_pooled) * cov[k] + to_pooled * pooled
        s = (1 - to_identity) * s + to_identity * np.trace(s) / p * np.eye(p)
        low = np.linalg.cholesky(s + 1e-9 * np.eye(p))
        factors.append(np.linalg.inv(low))
        dets.append(2 * float(np.log(np.diag(low)).sum()))
    model = Discriminant(centre, scale, tuple((mean[k] - centre) / scale for k in (0, 1)), tuple(factors), tuple(dets))
    return calibrated(model, labelled)


def calibrated(model: Discriminant, labelled: DataFrame) -> Discriminant:
    cells = 400

    def histogram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, cells))
        for batch in batches:
            y = batch.column(0).to_numpy(zero_copy_only=False).astype(int)
            d = model.difference(np.asarray(batch.column(1).flatten()).reshape(len(y), len(FEATURES)))
            at = np.clip((np.sign(d) * np.log1p(np.abs(d)) + 10) / 20 * cells, 0, cells - 1).astype(int)
            for k in (0, 1):
                total[k] += np.bincount(at[y == k], minlength=cells)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["part"])

    h = add_up(labelled.select(F.col("label").cast("int"), "x").mapInArrow(histogram, "part binary")).reshape(2, cells)
    at = (np.arange(cells) + 0.5) / cells * 20 - 10
    w, y = h.sum(0), (h[1] + 1e-3) / (h.sum(0) + 2e-3)
    beta = np.array([0.0, 1.0])
    design = np.stack([np.ones(cells), at], 1)
    for _ in range(50):
        q = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        hess = design.T @ (design * (w * q * (1 - q))[:, None]) + np.diag([1e-3, 1.0])
        beta = beta + np.linalg.solve(hess, design.T @ (w * (y - q)) - np.array([1e-3, 1.0]) * (beta - [0.0, 1.0]))
    return Discriminant(model.centre, model.scale, model.means, model.inverse_factors, model.log_dets, float(max(beta[1], 0.05)), float(beta[0]))


def score_table(table: DataFrame, model: Discriminant) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.asarray(batch.column(1).flatten()).reshape(batch.num_rows, len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(x))], ["doc_id", "score"])

    return table.select("doc_id", "x").mapInArrow(run, "doc_id long, score double")


def fitted_statistics(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, Discriminant]:
    """The table of statistics of all documents, and the model fitted on the labelled ones outside the held-out fold."""
    scratch = Scratch(docs.sparkSession, "quality")
    table = scratch.table(document_statistics(docs), "statistics")
    return table, fit_on(table, labels)


def fit_on(table: DataFrame, labels: DataFrame) -> Discriminant:
    """The model of the rows of table (doc_id, x) that have a label outside the held-out fold."""
    marks = labels.select("doc_id", F.col("quality").alias("label")).filter(F.col("label").isin(0, 1) & ~held_out())
    return fit(table.join(marks, "doc_id").select("label", "x"))


def score_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score (0 to 1), predicted (1 from `threshold` on) for every row of docs.

    Only the text enters a score; null texts count as empty and get the score of an empty text. Labels of held-out ids, other
    values and nulls are ignored; an id labelled or present twice counts as often as it pairs. With fewer than two rows of
    a class the score is the smoothed share of label 1. An empty table gives no rows.

    Scale: one pass over the texts, into 16 numbers a document; the fit moves class moments only.
    """
    table, model = fitted_statistics(docs, labels)
    return score_table(table, model).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """Rows of docs whose score, as score_quality gives it, reaches the threshold; null and empty texts have the score of an empty text.

    Labels count as in score_quality; repeated rows stay or go together; an empty table gives no rows. Extra columns come back as they are.

    Scale: the statistics are computed once, into a table beside the rows; the fit reads only them, the last pass scores and filters.
    """
    scratch, x = Scratch(docs.sparkSession, "quality"), spare(docs, "__statistics")
    at, names = docs.columns.index("text"), [*docs.columns, x]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = statistics(batch.column(at))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(flat) + 1) * len(FEATURES), pa.int32()), pa.array(flat.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], names)

    schema = T.StructType([*docs.schema.fields, T.StructField(x, T.ArrayType(T.DoubleType()))])
    table = scratch.table(docs.mapInArrow(measure, schema), "statistics")
    model = fit_on(table.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(x).alias("x")), labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = model.score(np.asarray(batch.column(len(names) - 1).flatten()).reshape(batch.num_rows, len(FEATURES)))
            yield pa.RecordBatch.from_arrays(batch.columns[:-1], names[:-1]).filter(pa.array(score >= threshold))

    return table.mapInArrow(run, docs.schema)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))

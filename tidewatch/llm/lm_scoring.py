"""Documents scored by masked pseudo-likelihood: a bidirectional window network, trained in numpy, predicts every token from both sides.

A token is a frequent word, or a class of rarer words with the same ending; the vocabulary of frequent words grows with the corpus. A rarer word's probability is its
class's, from the network, times its share of the counts of its class, so every word has its own. Tokens get two-digit codes: those that stand
beside the same very frequent tokens share the high digit. The network adds the embeddings of two tokens to the left and two to the right, bends
the sum, and predicts the high and the low digit by two short softmaxes; it starts from the counts, that is as a unigram model. A document's
score is the sum of the log-probabilities of all its tokens, each given its neighbours.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, add_up
from .textkernel import iter_endings


@dataclass(frozen=True)
class LmConfig:
    digits: tuple[int, int] = (64, 64)  # a token is one of 64 x 64 numbers, or of more: see grown; the first is a power of 2
    most_tokens: int = 1 << 18  # as many numbers at most: with them go 50 MB of network and codes to a task, and 134 MB of neighbour counts to the driver
    classes: int = 1023  # the last numbers: classes of words beyond the vocabulary, by ending
    reach: int = 2
    hidden: int = 24
    marks: int = 64  # the most frequent tokens, beside which all tokens are counted
    rounds: int = 4  # parts of the corpus, each trained from the mean of the part before
    group_tokens: int = 1_000_000  # about as many tokens does one walk of a part see
    batch: int = 4096
    rate: float = 8.0
    embed_rate: float = 0.1
    seed: int = 3

    @property
    def size(self) -> int:
        return self.digits[0] * self.digits[1]

    @property
    def words(self) -> int:
        return self.size - self.classes

    @property
    def edge(self) -> int:
        """Stands before the first and after the last token; never predicted."""
        return self.size

    @property
    def token(self) -> type:
        return np.uint16 if self.size < 1 << 16 else np.uint32


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n, ending): hash, number and ending of every word in all texts; each task adds up before anything moves, and passes on what exceeds its room."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        room, held = 1_000_000, []
        size = 0

        def flush() -> pa.RecordBatch:
            words, first, at = np.unique(np.concatenate([w for w, _, _ in held]), return_index=True, return_inverse=True)
            n = np.bincount(at, np.concatenate([c for _, c, _ in held])).astype(np.int64)
            endings = np.concatenate([e for _, _, e in held])[first]
            held[:] = [(words, n, endings)]
            return pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(n), pa.array(endings)], ["word", "n", "ending"])

        for batch in batches:
            for _, _, words, endings, _ in iter_endings(batch.column(0)):
                words, first, n = np.unique(words, return_index=True, return_counts=True)
                held.append((words, n, endings[first]))
                size += len(words)
                if size > 2 * room:
                    out = flush()
                    size = out.num_rows
                    if size > room:
                        yield out
                        held.clear()
                        size = 0
        if held:
            yield flush()

    return docs.select(F.col("text").cast("string")).mapInArrow(run, "word long, n long, ending long").groupBy("word").agg(F.sum("n").alias("n"), F.min("ending").alias("ending"))


@dataclass(frozen=True)
class Vocabulary:
    """Sorted hashes of the frequent words and their numbers (0 is the most frequent)."""

    hashes: np.ndarray
    numbers: np.ndarray
    first_class: int
    classes: int

    def known(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.hashes) or not len(words):
            return np.zeros(len(words), bool), np.zeros(len(words), np.int64)
        at = np.minimum(np.searchsorted(self.hashes, words), len(self.hashes) - 1)
        return self.hashes[at] == words, at

    def encode(self, words: np.ndarray, endings: np.ndarray) -> np.ndarray:
        out = self.first_class + endings % self.classes
        known, at = self.known(words)
        out[known] = self.numbers[at[known]]
        return out


def grown(cfg: LmConfig, counts: DataFrame) -> LmConfig:
    """cfg with room for every word that makes up half the root of all tokens or more: at most twice that root of words, and most_tokens numbers in all.

    Words beyond that room are not lost: they are rarer words, each with its own share of the counts of its class.
    """
    total = counts.agg(F.sum("n")).first()[0] or 0
    need = min(counts.filter(F.col("n") >= total**0.5 / 2).count() + cfg.classes, cfg.most_tokens)
    if need <= cfg.size:
        return cfg
    high = 1 << round(math.log2(need) / 2)
    return replace(cfg, digits=(high, min(-(-need // high), cfg.most_tokens // high)))


def vocabulary(counts: DataFrame, cfg: LmConfig) -> Vocabulary:
    rows = counts.orderBy(F.desc("n"), "word").limit(cfg.words).select("word").collect()
    hashes = np.array([r.word for r in rows], np.int64).view(np.uint64)
    order = np.argsort(hashes)
    return Vocabulary(hashes[order], np.arange(len(rows))[order], cfg.words, cfg.classes)


def tokenise(docs: DataFrame, vocab: Vocabulary, cfg: LmConfig) -> DataFrame:
    """doc_id, key (a hash of the row), n_tokens and tokens of every whole text, and its place k in a slice of texts.

    One more row a slice, with a null key, has the words beyond the vocabulary: how many different ones (n_tokens), their hashes (words, sorted), the place in it of each such token (at) and each text's first of these (first).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slice_id = TaskContext.get().partitionId() << 32
        for batch in batches:
            for i, j, words, endings, first in iter_endings(batch.column(2)):
                tokens = vocab.encode(words, endings)
                rare = tokens >= vocab.first_class
                own, at = np.unique(words[rare], return_inverse=True)
                start = np.concatenate(([0], np.cumsum(rare)))[first]
                size = np.dtype(cfg.token).itemsize
                cells = pa.Array.from_buffers(pa.binary(), j - i, [None, pa.py_buffer((first * size).astype(np.int32)), pa.py_buffer(tokens.astype(cfg.token).tobytes())])
                none = pa.nulls(j - i, pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), pa.array(np.diff(first), pa.int64()), cells, pa.array(np.full(j - i, slice_id)), pa.array(np.arange(j - i)), none, none, none], names)
                packed = [own.tobytes(), at.astype(np.uint32).tobytes(), start.astype(np.int64).tobytes()]
                yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.array([len(own)], pa.int64()), pa.nulls(1, pa.binary()), pa.array([slice_id]), pa.nulls(1, pa.int64()), *(pa.array([x], pa.binary()) for x in packed)], names)
                slice_id += 1

    schema = "doc_id long, key long, n_tokens long, tokens binary, slice long, k long, words binary, at binary, first binary"
    names = [c.split()[0] for c in schema.split(", ")]
    return docs.select(F.col("doc_id").cast("long"), F.xxhash64("doc_id", "text").alias("key"), F.col("text").cast("string")).mapInArrow(run, schema)


RANGE_WORDS = 4_000_000  # 32 MB


def within_classes(rare: DataFrame, counts: DataFrame, vocab: Vocabulary) -> DataFrame:
    """slice, k and within: the sum of log(count of the word / count of its class) over a text's words beyond the vocabulary.

    Words and counts meet in ranges of the hash. What moves is the distinct words of a slice and their answers, packed, not a row a word.
    """

    def class_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(vocab.classes)
        for batch in batches:
            outside = ~vocab.known(batch.column(0).to_numpy().view(np.uint64))[0]
            total += np.bincount(batch.column(2).to_numpy()[outside] % vocab.classes, batch.column(1).to_numpy()[outside], minlength=vocab.classes)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["part"])

    totals = add_up(counts.select("word", "n", "ending").mapInArrow(class_sums, "part binary"))
    # a range's share of what slices ask, and of the counts, stays about RANGE_WORDS words
    asked_words = rare.agg(F.sum("n_tokens")).first()[0] or 0
    ranges = min(1 << 22, max(256, -(-asked_words // RANGE_WORDS)))
    width = 2**64 // ranges + 1

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for sid, cell in zip(batch.column(0).to_pylist(), batch.column(1)):
                words = np.frombuffer(cell.as_buffer(), np.uint64)
                at, cut = np.unique(words // np.uint64(width), return_index=True)
                pieces = [w.tobytes() for w in np.split(words, cut[1:])] if len(cut) else []
                yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(np.full(len(at), sid)), pa.array(pieces, pa.binary())], ["range", "slice", "words"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column(0).to_numpy().view(np.uint64)
            batch = batch.filter(pa.array(~vocab.known(words)[0]))
            words = batch.column(0).to_numpy().view(np.uint64)
            share = np.log(batch.column(1).to_numpy() / totals[batch.column(2).to_numpy() % vocab.classes])
            yield pa.RecordBatch.from_arrays([pa.array((words // np.uint64(width)).astype(np.int32)), batch.column(0), pa.array(share)], ["range", "word", "share"])

    def answer(asked: pa.Table, counted: pa.Table) -> pa.Table:
        words = counted["word"].to_numpy().view(np.uint64)
        order = np.argsort(words)
        words, share = words[order], counted["share"].to_numpy()[order]
        logs = [share[np.searchsorted(words, np.frombuffer(w.as_buffer(), np.uint64))].tobytes() for w in asked["words"]]
        return pa.table({"slice": asked["slice"], "range": asked["range"], "logs": pa.array(logs, pa.binary())})

    def total(texts: pa.Table, answers: pa.Table) -> pa.Table:
        out = []
        order = np.argsort(answers["range"].to_numpy())
        logs = np.concatenate([np.zeros(0), *(np.frombuffer(answers["logs"][int(i)].as_buffer(), np.float64) for i in order)])
        for row in texts.to_pylist():
            each, first = logs[np.frombuffer(row["at"], np.uint32)], np.frombuffer(row["first"], np.int64)
            sums = sums_of(each, first)
            out.append(pa.table({"slice": np.full(len(sums), row["slice"]), "k": np.arange(len(sums)), "within": sums}))
        return pa.concat_tables(out)

    asked = rare.select("slice", "words").mapInArrow(ask, "range int, slice long, words binary").groupBy("range")
    counted = counts.select("word", "n", "ending").mapInArrow(count, "range int, word long, share double").groupBy("range")
    answers = asked.cogroup(counted).applyInArrow(answer, "slice long, range int, logs binary").groupBy("slice")
    return rare.select("slice", "at", "first").groupBy("slice").cogroup(answers).applyInArrow(total, "slice long, k long, within double")


def sums_of(each: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of the runs between offsets, each by itself, so that a text's sum doesn't hang on the texts before it."""
    out = np.zeros(len(first) - 1)
    full = np.flatnonzero(np.diff(first))
    if len(full):
        out[full] = np.add.reduceat(each, first[full])
    return out


def padded(tokens: np.ndarray, first: np.ndarray, cfg: LmConfig) -> tuple[np.ndarray, np.ndarray]:
    """Texts with `reach` edges before, between and after them, and the place of each token among these."""
    texts = len(first) - 1
    place = np.arange(len(tokens)) + cfg.reach * (np.repeat(np.arange(texts), np.diff(first)) + 1)
    out = np.full(len(tokens) + cfg.reach * (texts + 1), cfg.edge)
    out[place] = tokens
    return out, place


def _log_softmax(x: np.ndarray) -> np.ndarray:
    x -= x.max(1, keepdims=True)
    return x - np.log(np.exp(x).sum(1, keepdims=True))


class Network:
    """Weights as one float32 vector: embeddings for the left and the right side, output rows of both digits, and the bias of low digits by high ones."""

    def __init__(self, cfg: LmConfig, flat: np.ndarray | None = None):
        self.cfg = cfg
        a, b = cfg.digits
        shapes = {"embed": (2, cfg.size + 1, cfg.hidden), "offset": (cfg.hidden,), "high": (cfg.hidden, a), "high_bias": (a,), "low": (cfg.hidden, b), "low_bias": (a, b)}
        self.flat = np.zeros(sum(int(np.prod(s)) for s in shapes.values()), np.float32) if flat is None else np.asarray(flat, np.float32).copy()
        at = 0
        for k, s in shapes.items():
            n = int(np.prod(s))
            setattr(self, k, self.flat[at : at + n].reshape(s))
            at += n

    @classmethod
    def started(cls, cfg: LmConfig, codes: Codes) -> Network:
        """Embeddings are what a token stands beside, biases its counts: before any step the network is a unigram model."""
        net = cls(cfg)
        net.embed[:, : cfg.size] = codes.vectors
        n = codes.counts.reshape(cfg.digits) + 0.1
        net.high_bias[:] = np.log(n.sum(1) / n.sum())
        net.low_bias[:] = np.log(n / n.sum(1, keepdims=True))
        return net

    def forward(self, row: np.ndarray, place: np.ndarray) -> np.ndarray:
        left, right = self.embed[0][row], self.embed[1][row]
        total = self.offset + left[place - 1] + right[place + 1]
        for d in range(2, self.cfg.reach + 1):
            total += left[place - d] + right[place + d]
        return np.tanh(total)

    def log_probability(self, token: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Of each token of a run of texts, given its neighbours."""
        h, rows = self.forward(*padded(token, first, self.cfg)), np.arange(len(token))
        hi, lo = token // self.cfg.digits[1], token % self.cfg.digits[1]
        high, low = self._heads(h, hi)
        return high[rows, hi] + low[rows, lo]

    def _heads(self, h: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return _log_softmax(h @ self.high + self.high_bias), _log_softmax(h @ self.low + self.low_bias[hi])

    def step(self, token: np.ndarray, first: np.ndarray, rate: float, embed_rate: float) -> None:
        """One gradient step on the mean log-probability of a run of texts."""
        row, place = padded(token, first, self.cfg)
        h, rows, n = self.forward(row, place), np.arange(len(token)), len(token)
        hi, lo = token // self.cfg.digits[1], token % self.cfg.digits[1]
        e_hi, e_lo = (np.exp(x) for x in self._heads(h, hi))
        e_hi[rows, hi] -= 1
        e_lo[rows, lo] -= 1
        back = (e_hi @ self.high.T + e_lo @ self.low.T) * (1 - h * h)
        self.high -= rate / n * (h.T @ e_hi)
        self.low -= rate / n * (h.T @ e_lo)
        self.high_bias -= rate / n * e_hi.sum(0)
        self.offset -= embed_rate / n * back.sum(0)
        # a row of the embeddings moves by the sum of its tokens' gradients over the root of their number
        order = np.argsort(row, kind="stable")
        cut = np.flatnonzero(np.concatenate(([True], row[order][1:] != row[order][:-1])))
        own, scale = row[order][cut], embed_rate / np.sqrt(np.diff(np.append(cut, len(row))).astype(np.float32) * 8)[:, None]
        for side, sign in ((0, -1), (1, 1)):
            moved = np.zeros((len(row), back.shape[1]), np.float32)
            for d in range(1, self.cfg.reach + 1):
                moved[place + sign * d] += back
            self.embed[side][own] -= scale * np.add.reduceat(moved[order], cut)


def _runs(batch: pa.RecordBatch, col: int, kind: type, most: int = 8192) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first text, last + 1, tokens, offsets) over slices of a column of token bytes; a longer text stands alone."""
    cells = batch.column(col)
    off = np.frombuffer(cells.buffers()[1], np.int32)[cells.offset : cells.offset + len(cells) + 1].astype(np.int64) // np.dtype(kind).itemsize
    data = np.frombuffer(cells.buffers()[2], kind) if cells.buffers()[2] is not None else np.zeros(0, kind)
    i = 0
    while i < len(cells):
        j = min(len(cells), max(i + 1, int(np.searchsorted(off, off[i] + most, "right")) - 1))
        yield i, j, data[off[i] : off[j]].astype(np.int64), off[i : j + 1] - off[i]
        i = j


@dataclass(frozen=True)
class Codes:
    """The two-digit number of each token (one more entry: the edge), and by this number the counts and what the token stands beside."""

    number: np.ndarray
    counts: np.ndarray
    vectors: np.ndarray


def neighbours(tokens: DataFrame, cfg: LmConfig) -> tuple[np.ndarray, np.ndarray]:
    """Counts of all tokens, and how often each stands within reach of each of the most frequent ones (tokens by marks), over the whole corpus."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(cfg.size)
        for batch in batches:
            for _, _, token, _ in _runs(batch, 0, cfg.token, 400_000):
                total += np.bincount(token, minlength=cfg.size)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["part"])

    counts = add_up(tokens.select("tokens").mapInArrow(count, "part binary"))
    counts = np.zeros(cfg.size) if counts is None or len(counts) == 1 else counts
    rank = np.full(cfg.size + 1, -1)
    rank[np.argsort(-counts, kind="stable")[: cfg.marks]] = np.arange(min(cfg.marks, cfg.size))

    def beside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(cfg.size * cfg.marks)
        for batch in batches:
            for _, _, token, first in _runs(batch, 0, cfg.token, 400_000):
                row, place = padded(token, first, cfg)
                for d in range(1, cfg.reach + 1):
                    for near in (place - d, place + d):
                        mark = rank[row[near]]
                        seen = mark >= 0
                        total += np.bincount(token[seen] * cfg.marks + mark[seen], minlength=len(total))
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["part"])

    both = add_up(tokens.select("tokens").mapInArrow(beside, "part binary"))
    return counts, (np.zeros(cfg.size * cfg.marks) if both is None or len(both) == 1 else both).reshape(cfg.size, cfg.marks)


def token_codes(counts: np.ndarray, both: np.ndarray, cfg: LmConfig) -> Codes:
    """High digits by halving the tokens along the main direction of what they stand beside, again and again; low digits by falling count."""
    a, b = cfg.digits
    all_ = both.sum(0) + 1e-9
    share = (both + 20 * all_ / all_.sum()) / (both.sum(1, keepdims=True) + 20)
    x, weight = np.sqrt(share) - np.sqrt(all_ / all_.sum()), counts + 0.1

    def leaves(ids: np.ndarray, n: int) -> list[np.ndarray]:
        if n == 1:
            return [ids[np.argsort(-counts[ids], kind="stable")]]
        w = np.sqrt(weight[ids])[:, None]
        y = x[ids] - (x[ids] * w).sum(0) / w.sum()
        main = np.linalg.eigh((y * w).T @ y)[1][:, -1]
        main *= np.sign(main[np.argmax(np.abs(main))])
        ids, half = ids[np.argsort(y @ main, kind="stable")], (len(ids) + 1) // 2
        return leaves(ids[:half], n // 2) + leaves(ids[half:], n // 2)

    number = np.empty(cfg.size + 1, np.int64)
    for k, ids in enumerate(leaves(np.arange(cfg.size), a)):
        number[ids] = k * b + np.arange(len(ids))
    number[cfg.size] = cfg.edge
    place = np.argsort(number[:-1])
    x, weight = x[place], weight[place][:, None]
    parts = x @ np.linalg.eigh((x * weight).T @ x)[1][:, ::-1][:, : cfg.hidden]
    parts /= np.sqrt((parts**2 * weight).sum(0) / weight.sum()) + 1e-9
    vectors = np.zeros((cfg.size, cfg.hidden), np.float32)
    vectors[:, : parts.shape[1]] = 0.25 * np.clip(parts, -3, 3)
    return Codes(number, counts[place], vectors)


FINE = float(1 << 24)  # weights are added up as whole numbers of this part of 1, so that their mean doesn't hang on the order


def train(tokens: DataFrame, codes: Codes, cfg: LmConfig) -> Network:
    """Local steps over every token of a part of the corpus, a group of texts at a time, then the mean of the groups' weights; part after part.

    Parts, groups, the order within a group and the batches follow hashes of the rows, not the partitions, so the network doesn't hang on them.
    """
    net, number = Network.started(cfg, codes), codes.number
    groups = max(1, round(float(codes.counts.sum()) / cfg.rounds / cfg.group_tokens))
    dealt = tokens.select("tokens", "key", F.pmod("key", F.lit(cfg.rounds)).cast("int").alias("part"), F.pmod(F.xxhash64("key", F.lit(cfg.seed)), F.lit(groups)).cast("int").alias("grp"))
    for part in range(cfg.rounds):
        sent = tokens.sparkSession.sparkContext.broadcast(net.flat)  # as many numbers as the network has

        def run(batches: Iterator[pa.RecordBatch], sent=sent, part=part) -> Iterator[pa.RecordBatch]:
            total, own, held = np.zeros(len(sent.value) + 1), None, None
            waiting: list[np.ndarray] = []
            size = 0

            def learn() -> None:
                nonlocal size
                if size:
                    first = np.concatenate(([0], np.cumsum([len(t) for t in waiting])))
                    own.step(number[np.concatenate(waiting)], first, cfg.rate / (1 + part), cfg.embed_rate / (1 + part))
                waiting.clear()
                size = 0

            def close() -> None:
                nonlocal total
                learn()
                if own is not None:
                    total += np.concatenate(([1], np.rint(own.flat.astype(np.float64) * FINE)))

            for batch in batches:
                for group, cell in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    if group != held:
                        close()
                        own, held = Network(cfg, sent.value), group
                    text = np.frombuffer(cell.as_buffer(), cfg.token).astype(np.int64)
                    for lo in range(0, len(text), cfg.batch):  # a long text is learned in pieces
                        waiting.append(text[lo : lo + cfg.batch])
                        size += len(waiting[-1])
                        if size >= cfg.batch:
                            learn()
            close()
            if total[0]:
                yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["part"])

        rows = dealt.filter((F.col("part") == part) & (F.length("tokens") > 0)).repartition(groups, "grp").sortWithinPartitions("grp", "key").select("grp", "tokens")
        total = add_up(rows.mapInArrow(run, "part binary"))
        if total is not None and len(total) > 1:
            net = Network(cfg, total[1:] / total[0] / FINE)
    return net


def score_documents(docs: DataFrame, cfg: LmConfig = LmConfig()) -> DataFrame:
    """doc_id, n_tokens, log_likelihood (sum over all tokens, each given its neighbours) and per_token (its mean) for every row of docs.

    Null and empty texts, and those without words, have 0 tokens, a sum of 0 and a null mean. Repeated rows score alike; an empty table gives no rows.
    Scores don't hang on how docs is partitioned.

    Scale: words of all texts are counted (a task passes on its distinct words only) and all tokens are trained on, in `rounds` parts of groups of
    `group_tokens`; what comes together for each part is one sum of networks for each task, over three levels. The vocabulary grows with the root of the
    corpus up to most_tokens, which bounds the network, what is sent with tasks and what the driver holds. The token table is two bytes a token and four more
    for a word beyond the vocabulary; a slice of texts asks for the counts of its distinct such words.
    """
    scratch = Scratch(docs.sparkSession, "lm")
    counts = scratch.table(word_counts(docs), "counts")
    cfg = grown(cfg, counts)
    vocab = vocabulary(counts, cfg)
    both = scratch.table(tokenise(docs, vocab, cfg), "tokens")
    tokens, rare = both.filter("key is not null"), both.filter("key is null")
    codes = token_codes(*neighbours(tokens, cfg), cfg)
    sent = docs.sparkSession.sparkContext.broadcast((codes.number, train(tokens, codes, cfg).flat))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, flat = sent.value
        net = Network(cfg, flat)
        for batch in batches:
            for i, j, token, first in _runs(batch, 2, cfg.token):
                total = sums_of(scored(net, number[token], first), first)
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(i, j - i) for c in (0, 1, 3, 4)), pa.array(total)], ["doc_id", "n_tokens", "slice", "k", "classes"])

    scores = tokens.select("doc_id", "n_tokens", "tokens", "slice", "k").mapInArrow(run, "doc_id long, n_tokens long, slice long, k long, classes double")
    out = scores.join(within_classes(rare, counts, vocab), ["slice", "k"]).select("doc_id", "n_tokens", (F.col("classes") + F.col("within")).alias("log_likelihood"))
    return out.withColumn("per_token", F.when(F.col("n_tokens") > 0, F.col("log_likelihood") / F.col("n_tokens")))


def scored(net: Network, token: np.ndarray, first: np.ndarray, most: int = 65_536) -> np.ndarray:
    """Log-probabilities of all tokens; a text longer than `most` is cut, with its neighbours beyond the cut, to bound memory."""
    if len(token) <= most:
        return net.log_probability(token, first).astype(np.float64) if len(token) else np.zeros(0)
    reach, out = net.cfg.reach, []
    for lo in range(0, len(token), most):  # only a text that stands alone is as long
        a, b = max(0, lo - reach), min(len(token), lo + most + reach)
        out.append(net.log_probability(token[a:b], np.array([0, b - a]))[lo - a : lo - a + most].astype(np.float64))
    return np.concatenate(out)


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))

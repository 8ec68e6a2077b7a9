"""Toxicity by weak supervision.

Many voters (lexicon stems, found in labelled rows or given, and patterns of disguised spelling) look at each text. A generative
label model, fitted by expectation-maximisation over the votes of all documents, estimates how often each voter fires
on toxic and on other texts; voters that repeat one another hang on one another in both classes, along the branches of trees, so that what a
repeated vote adds is what it says beyond the first. The model's posteriors, of all documents, train a linear classifier.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, add_up, held_out

# Insults that need no labels to be known.
SEED = {
    "seed_en": ("idiot", "stupid", "moron", "loser", "pathetic", "scum", "worthless", "trash", "disgusting", "imbecile", "bastard", "dumbass", "vermin"),
    "seed_de": ("dummkopf", "abschaum", "vollidiot", "arschloch", "trottel", "widerlich"),
    "seed_fr": ("connard", "salaud", "crétin", "ordure", "imbécile", "abruti"),
    "seed_es": ("imbécil", "estúpido", "basura", "cabrón", "gilipollas", "asqueroso"),
}
PATTERNS = ("leet", "spaced", "stretched", "aimed", "shouted")
LEET = str.maketrans("013457@$!", "oieastasi")
SPACED = re.compile(r"(?<![^\W_])(?:[^\W\d_][.\-_* ]){3,}[^\W\d_](?![^\W_])")
MIXED = re.compile(r"(?<![^\W\d_])[^\W\d_]+[0-9@$!]+[^\W\d_][\w@$!]*|(?<![0-9@$])[0-9@$]+[^\W\d_][\w@$!]*")
TRIPLE = re.compile(r"([^\W\d_])\1\1")
REST = re.compile(r"[^\W_]*")
AIMED = re.compile(r"(?:you|your|du|ihr|tu|toi|vous|eres|tú)\W+(?:\w+\W+){0,2}$")


@dataclass(frozen=True)
class ToxicConfig:
    max_fit_rows: int = 40_000  # labelled rows that lexicon search and calibration may see, the first by hash
    stem_lengths: tuple[int, ...] = (4, 5, 6)
    least_toxic: int = 5  # documents of label 1 that a stem must occur in
    least_odds: float = 30.0
    em_rounds: int = 8
    threshold: float = 0.5


def stretched(text: str) -> Iterator[str]:
    """Words with a letter three times in a row, each once; found from the letters, so a word of any length is read once."""
    done = 0
    for m in TRIPLE.finditer(text):
        if m.start() < done:
            continue
        lo = m.start()
        while lo > done and text[lo - 1].isalpha():
            lo -= 1
        done = REST.match(text, m.end()).end()
        yield text[lo:done]


def _words(text: str) -> list[str]:
    return re.findall(r"[^\W\d_]+", text.lower())


def find_stems(sample: DataFrame, cfg: ToxicConfig) -> list[str]:
    """Word starts that mark label 1 in the sample (label, text), strongest first, none a longer form of another."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: tuple[Counter, Counter] = (Counter(), Counter())
            for y, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = set(_words(text or ""))
                seen[y].update({w[:k] for w in own for k in cfg.stem_lengths if len(w) >= k})
                seen[y].update({w + "$" for w in own})
            # a stem that label 1 never shows can't be chosen
            keys = list(seen[1]) if batch.num_rows else []
            extra = [k for k in seen[0] if k not in seen[1]]
            yield pa.RecordBatch.from_arrays([pa.array(keys + extra, pa.string()), pa.array([seen[0][k] for k in keys + extra], pa.int64()), pa.array([seen[1][k] for k in keys + extra], pa.int64())], ["stem", "n0", "n1"])

    size = sample.groupBy("label").count().collect()
    n = {r["label"]: r["count"] for r in size}
    if not n.get(1):
        return []
    table = sample.select("label", "text").mapInArrow(count, "stem string, n0 long, n1 long").groupBy("stem").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    odds = (F.col("n1") + 0.1) / n[1] / ((F.col("n0") + 0.1) / max(1, n.get(0, 0)))
    rows = table.filter(F.col("n1") >= cfg.least_toxic).withColumn("odds", odds).filter(F.col("odds") >= cfg.least_odds)
    rows = rows.orderBy(F.desc("n1"), F.length("stem"), "stem").select("stem").collect()  # words of at most max_fit_rows texts
    chosen: dict[str, None] = {}
    for r in rows:
        if r.stem not in chosen and not any(r.stem[:k] in chosen for k in range(1, len(r.stem.rstrip("$")) + 1)):
            chosen[r.stem] = None
    return list(chosen)


def voter_names(stems: list[str]) -> list[str]:
    return [f"stem:{s}" for s in stems] + list(SEED) + list(PATTERNS)


class Voters:
    """All voters over one text: hits of each."""

    def __init__(self, stems: list[str]):
        self.names = voter_names(stems)
        self.at = {n: k for k, n in enumerate(self.names)}
        self.machine = ahocorasick.Automaton()
        entries: dict[str, list[tuple[int, bool]]] = {}
        for k, s in enumerate(stems):
            entries.setdefault(s.rstrip("$"), []).append((k, s.endswith("$")))
        for name, words in SEED.items():
            for w in words:
                entries.setdefault(w, []).append((self.at[name], True))
        for word, owners in entries.items():
            self.machine.add_word(word, (len(word), owners))
        self.machine.make_automaton()

    def hits(self, text: str) -> list[int]:
        """The voter of each hit, at the start of a word (and to its end, for whole words)."""
        out = []
        for end, (size, owners) in self.machine.iter(text):
            start = end - size + 1
            if start and (text[start - 1].isalpha()):
                continue
            whole = end + 1 == len(text) or not text[end + 1].isalpha()
            found = [k for k, word in owners if whole or not word]
            out += found
            if found and AIMED.search(text[max(0, start - 40) : start]):
                out.append(self.at["aimed"])
        return out

    def __call__(self, text: str) -> Counter:
        low = text.lower()
        out = Counter(self.hits(low))
        for name, found in (("leet", MIXED.finditer), ("spaced", SPACED.finditer), ("stretched", stretched)):
            if name == "leet" and not any(c in low for c in "013457@$"):
                continue
            for m in found(low):
                word = m if name == "stretched" else m.group(0)
                plain = word.translate(LEET) if name == "leet" else re.sub(r"[.\-_* ]", "", word) if name == "spaced" else re.sub(r"(.)\1\1+", r"\1", word)
                if plain != word and self.hits(plain):
                    out[self.at[name]] += 1
        if out and sum(map(str.isupper, text)) > 0.5 * len(text):
            out[self.at["shouted"]] += 1
        return out


def vote_table(docs: DataFrame, stems: list[str]) -> DataFrame:
    """doc_id, words and, for each voter that fired, its number (at) and hits (n), over every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voters = Voters(stems)
        for batch in batches:
            at, n, size = [], [], []
            for value in batch.column(1):
                text = value.as_py() or ""
                found = voters(text)
                at.append(sorted(found))
                n.append([found[k] for k in sorted(found)])
                size.append(text.count(" ") + text.count("\n") + 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size, pa.int64()), pa.array(at, pa.list_(pa.int32())), pa.array(n, pa.list_(pa.int32()))], ["doc_id", "words", "at", "n"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, words long, at array<int>, n array<int>")


class Votes:
    """A batch's votes: for each hit the text (row), the voter (at) and the number of hits (n), by text and then voter; what is computed from them grows with the hits."""

    def __init__(self, batch: pa.RecordBatch, col: int, v: int):
        at, n = batch.column(col), batch.column(col + 1)
        self.texts, self.v = batch.num_rows, v
        self.row = np.repeat(np.arange(self.texts), np.diff(np.asarray(at.offsets)))
        self.at, self.n = np.asarray(at.flatten()).astype(np.int64), np.asarray(n.flatten()).astype(np.float64)

    def sums(self, each: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, each, self.texts)

    def with_parent(self, parent: np.ndarray) -> np.ndarray:
        """Whether the parent of each hit's voter fired on the same text."""
        keys, wanted = self.row * self.v + self.at, self.row * self.v + parent[self.at]
        place = np.minimum(np.searchsorted(keys, wanted), max(0, len(keys) - 1))
        return (parent[self.at] >= 0) & (keys[place] == wanted) if len(keys) else np.zeros(0, bool)


@dataclass(frozen=True)
class LabelModel:
    """The share of toxic texts and, for each voter, P(fires | class, whether its parent fired), by whether it did (a voter without a parent: 0); pooled is the prior mean of the latter where it did."""

    prior: float
    toxic: np.ndarray
    other: np.ndarray
    parent: np.ndarray
    pooled: np.ndarray

    @classmethod
    def started(cls, v: int, prior: float = 0.05) -> LabelModel:
        some = min(0.2, 3 / v)  # about three voters fire on a toxic text
        return cls(prior, np.full((v, 2), some), np.full((v, 2), some / 100), np.full(v, -1), np.full(v, 0.5))

    def joint(self, votes: Votes) -> tuple[np.ndarray, np.ndarray]:
        """log P(votes, toxic) and log P(votes, other) of each text."""
        u, out = votes.with_parent(self.parent).astype(np.int64), []
        child = np.flatnonzero(self.parent >= 0)
        for p, share in ((self.toxic, self.prior), (self.other, 1 - self.prior)):
            off = np.log1p(-p)
            # a voter that fires changes what its silent children say
            silent = np.bincount(self.parent[child], off[child, 1] - off[child, 0], len(p))
            fires = np.log(p) - off
            # a hit's own term; where its parent fired, `silent` has already moved it to the other column
            out.append(np.log(share) + off[:, 0].sum() + votes.sums(silent[votes.at] + fires[votes.at, u]))
        return out[0], out[1]

    def posterior(self, votes: Votes) -> np.ndarray:
        yes, no = self.joint(votes)
        return 1 / (1 + np.exp(-np.clip(yes - no, -35, 35)))

    @property
    def quiet(self) -> tuple[float, float]:
        """The two joint log-probabilities of a text without a vote."""
        return tuple(float(np.log(share) + np.log1p(-p[:, 0]).sum()) for p, share in ((self.toxic, self.prior), (self.other, 1 - self.prior)))

    def log_prior(self) -> float:
        """Log-density of the parameters, up to a constant: what the pseudo-counts add to the log-likelihood."""
        child, total = self.parent >= 0, 0.0
        for p, (a, b) in ((self.toxic, PSEUDO[0]), (self.other, PSEUDO[1])):
            total += (a * np.log(p[:, 0]) + b * np.log1p(-p[:, 0])).sum()
            q = self.pooled[child]
            total += (q * np.log(p[child, 1]) + (1 - q) * np.log1p(-p[child, 1])).sum()
        return float(total)


PSEUDO = ((0.02, 0.08), (0.001, 0.999))  # hits and misses that each voter starts with, on toxic and on other texts
LEAST_RATIO = 3.0  # a voter fires so much more often on toxic texts
REPEATS = 0.6  # correlation in the toxic class from which a voter may hang on another: lower ones come from texts of one language


def most_likely(hits: tuple[np.ndarray, np.ndarray], texts: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """P(fires) on toxic and on other texts that make the votes and the pseudo-counts likeliest, given the least ratio between them.

    Where the free solution breaks the ratio, the best one has exactly it: the root of a quadratic.
    """
    (a1, b1), (a0, b0) = ((h + a, np.maximum(n - h, 0) + b) for h, n, (a, b) in zip(hits, texts, PSEUDO, strict=True))
    p1, p0 = a1 / (a1 + b1), a0 / (a0 + b0)
    c, a = LEAST_RATIO, a1 + a0
    x, y = c * (a + b1 + b0), (c + 1) * a + c * b1 + b0
    tied = (y - np.sqrt(np.maximum(y * y - 4 * x * a, 0))) / (2 * x)
    broken = p1 < c * p0
    return np.clip(np.where(broken, c * tied, p1), 1e-5, 0.95), np.clip(np.where(broken, tied, p0), 1e-7, 0.3)


def em_round(votes: DataFrame, model: LabelModel) -> tuple[LabelModel, float] | None:
    """The next model along the same trees, and the objective (log-likelihood of all votes plus log_prior) of this one; None without texts. Sums of four numbers a voter move."""
    v = len(model.parent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(3 + 6 * v)
        yes, no = model.quiet
        alone = 1 / (1 + np.exp(no - yes))
        for batch in batches:
            some = np.diff(np.asarray(batch.column(0).offsets)) > 0  # texts without a vote are alike
            quiet = int((~some).sum())
            total[:3] += [quiet, quiet * alone, quiet * np.logaddexp(yes, no)]
            batch = batch.filter(pa.array(some))
            for lo in range(0, batch.num_rows, 8192):
                own = Votes(batch.slice(lo, 8192), 0, v)
                l1, l0 = model.joint(own)
                r, u = 1 / (1 + np.exp(-np.clip(l1 - l0, -35, 35))), own.with_parent(model.parent)
                count = lambda at, w=None: np.bincount(at, w, v)
                total[:3] += [own.texts, r.sum(), np.logaddexp(l1, l0).sum()]
                weight = r[own.row]
                total[3:] += np.concatenate([count(own.at, weight), count(own.at), count(own.at[u], weight[u]), count(own.at[u]), np.zeros(2 * v)])
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["part"])

    sums = add_up(votes.select("at", "n").mapInArrow(run, "part binary"))
    if sums is None or len(sums) < 3 or not sums[0]:
        return None
    n, n1, likelihood = sums[:3]
    yes, all_, yes_both, all_both = (sums[3 + k * v : 3 + (k + 1) * v] for k in range(4))
    child = model.parent >= 0
    # texts whose voter's parent fired
    up1, up = np.where(child, yes[model.parent], 0.0), np.where(child, all_[model.parent], 0.0)
    alone1, alone0 = most_likely((yes - yes_both, all_ - yes - (all_both - yes_both)), (n1 - up1, n - n1 - (up - up1)))
    beside = [np.clip((h + model.pooled) / (m + 1), 1e-4, 1 - 1e-4) for h, m in ((yes_both, up1), (all_both - yes_both, up - up1))]
    toxic, other = (np.column_stack([p, np.where(child, b, p)]) for p, b in ((alone1, beside[0]), (alone0, beside[1])))
    prior = float(np.clip(n1 / n, 1e-4, 0.5))
    return LabelModel(prior, toxic, other, model.parent, model.pooled), float(likelihood + model.log_prior())


def voter_trees(votes: DataFrame, model: LabelModel) -> LabelModel:
    """The model with each voter hung on the one that it repeats most, in trees, where they correlate by REPEATS or more within the toxic class.

    Only pairs that do fire on one text are counted; those that correlate enough come to the driver, for a spanning forest of the strongest.
    """
    v, unit = len(model.parent), float(1 << 20)

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                own = Votes(batch.slice(lo, 1024), 0, v)
                r = np.rint(model.posterior(own) * unit).astype(np.int64)
                size = np.bincount(own.row, minlength=own.texts)
                # every hit with every hit of its text, itself too
                many = size[own.row]
                left = np.repeat(np.arange(len(own.at)), many)
                start = (np.cumsum(size) - size)[own.row]
                right = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many) + np.repeat(start, many)
                upper = own.at[left] <= own.at[right]
                left, right = left[upper], right[upper]
                key, at = np.unique(own.at[left] * v + own.at[right], return_inverse=True)
                yes = np.bincount(at, r[own.row[left]], len(key)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(key // v), pa.array(key % v), pa.array(yes), pa.array(np.bincount(at, minlength=len(key)).astype(np.int64))], ["a", "b", "yes", "n"])

    counted = votes.filter(F.size("at") > 0).select("at", "n").mapInArrow(pairs, "a long, b long, yes long, n long").groupBy("a", "b").agg(F.sum("yes").alias("yes"), F.sum("n").alias("n"))
    own = counted.filter("a = b").select(F.col("a").alias("x"), "yes", "n")
    sized = counted.filter("a < b").join(own.select(F.col("x").alias("a"), F.col("yes").alias("yes_a"), F.col("n").alias("n_a")), "a").join(own.select(F.col("x").alias("b"), F.col("yes").alias("yes_b"), F.col("n").alias("n_b")), "b")
    # a correlation is no higher than the cosine, which needs no number of texts
    near = sized.filter(F.col("yes") >= REPEATS * F.sqrt(F.col("yes_a").cast("double") * F.col("yes_b"))).collect()
    n1 = max(model.prior * votes.count(), 1e-9)
    found = []
    for r in near:
        p, q, both = r["yes_a"] / unit / n1, r["yes_b"] / unit / n1, r["yes"] / unit / n1
        corr = (both - p * q) / max((p * (1 - p) * q * (1 - q)) ** 0.5, 1e-12) if 0 < p < 1 and 0 < q < 1 else 0.0
        if corr > REPEATS:
            found.append((-round(corr, 9), r["a"], r["b"], r["n"], r["n_a"], r["n_b"]))
    group = list(range(v))

    def top(x: int) -> int:
        while group[x] != x:
            group[x] = group[group[x]]
            x = group[x]
        return x

    beside: dict[int, list[tuple[int, float]]] = {}
    often: dict[int, int] = {}
    for _, a, b, n, n_a, n_b in sorted(found):
        if top(a) != top(b):
            group[top(a)] = top(b)
            beside.setdefault(a, []).append((b, (n + 0.5) / (n_a + 1)))
            beside.setdefault(b, []).append((a, (n + 0.5) / (n_b + 1)))
            often |= {a: n_a, b: n_b}
    parent, pooled = np.full(v, -1), np.full(v, 0.5)
    for root in sorted(often, key=lambda x: (-often[x], x)):  # the voter that fires most is the root of its tree
        todo = [root] if parent[root] < 0 else []
        while todo:
            x = todo.pop()
            for c, share in beside[x]:
                if c != parent[x] and parent[c] < 0 and c != root:
                    parent[c], pooled[c] = x, min(share, 0.99)
                    todo.append(c)
    spread = lambda p: np.column_stack([p[:, 0], np.where(parent >= 0, np.clip(pooled, 1e-4, 1 - 1e-4), p[:, 0])])
    return LabelModel(model.prior, spread(model.toxic), spread(model.other), parent, pooled)


def fit_label_model(votes: DataFrame, n_voters: int, rounds: int = 8, start_prior: float = 0.05) -> tuple[LabelModel, list[float]]:
    """Expectation-maximisation over the votes of all documents, and the objective before each round along the last trees: it doesn't fall.

    The first round takes voters as independent; then trees are chosen, and again after the third.
    """
    model, told = LabelModel.started(n_voters, start_prior), []
    for k in range(rounds):
        if k in (1, 3):
            model, told = voter_trees(votes, model), []
        if (step := em_round(votes, model)) is None:
            return model, told
        model = step[0]
        told.append(step[1])
    return model, told


@dataclass(frozen=True)
class Linear:
    beta: np.ndarray
    scale: np.ndarray


def log_odds(beta: np.ndarray, votes: Votes, words: np.ndarray) -> np.ndarray:
    """Of the linear classifier: a weight for each voter's log hits, for the log of all hits, for that of their number per 100 words and for how many voters fired."""
    total = votes.sums(votes.n)
    return beta[0] + votes.sums(np.log1p(votes.n) * beta[1:-3][votes.at]) + np.column_stack(extras(votes, words, total)) @ beta[-3:]


def extras(votes: Votes, words: np.ndarray, total: np.ndarray) -> list[np.ndarray]:
    return [np.log1p(total), np.log1p(100 * total / np.maximum(words, 1)), np.bincount(votes.row, minlength=votes.texts).astype(float)]


def fit_linear(x: np.ndarray, y: np.ndarray, w: np.ndarray, ridge: float = 1.0) -> Linear:
    """Logistic regression on soft labels by Newton steps."""
    scale = np.maximum(np.sqrt((x**2).mean(0)), 1e-3) if len(x) else np.ones(x.shape[1])
    z = np.column_stack([np.ones(len(x)), x / scale])
    beta = np.zeros(z.shape[1])
    penalty = np.full(z.shape[1], ridge)
    penalty[0] = 1e-3
    for _ in range(25):
        q = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
        step = np.linalg.solve(z.T @ (z * (w * q * (1 - q))[:, None]) + np.diag(penalty), z.T @ (w * (y - q)) - penalty * beta)
        beta += step
        if np.abs(step).max() < 1e-6:
            break
    return Linear(beta, scale)


def fit_posteriors(votes: DataFrame, model: LabelModel, scratch: Scratch, ridge: float = 1.0, most_steps: int = 40) -> np.ndarray | None:
    """Logistic regression on the posteriors of all documents by limited-memory quasi-Newton steps: each moves one vector of as many numbers as there are inputs, for a few step lengths at once; None without a vote.

    Texts without a vote are one row with their number as its weight.
    """
    v = len(model.parent)
    k = v + 4  # the constant, voters, and three more
    some = F.size("at") > 0
    quiet = votes.filter(~some).count()
    yes, no = model.quiet
    still = 1 / (1 + np.exp(no - yes))

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(model.posterior(Votes(batch, 1, v)))], ["words", "at", "n", "y"])

    table = scratch.table(votes.filter(some).select("words", "at", "n").mapInArrow(judged, "words long, at array<int>, n array<int>, y double"), "judged")

    def summed(inner) -> np.ndarray | None:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = 0.0
            for batch in batches:
                for lo in range(0, batch.num_rows, 8192):
                    part = batch.slice(lo, 8192)
                    total = total + inner(Votes(part, 1, v), part.column(0).to_numpy().astype(float), part.column(3).to_numpy())
            if not isinstance(total, float):
                yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["part"])

        return add_up(table.mapInArrow(run, "part binary"))

    def squares(own: Votes, words: np.ndarray, y: np.ndarray) -> np.ndarray:
        more = extras(own, words, own.sums(own.n))
        return np.concatenate([[own.texts], np.bincount(own.at, np.log1p(own.n) ** 2, v), [(x**2).sum() for x in more]])

    first = summed(squares)
    if first is None or len(first) < 2 or not first[0]:
        return None
    scale = np.concatenate([[1.0], np.maximum(np.sqrt(first[1:] / (first[0] + quiet)), 1e-3)])
    penalty = np.full(k, ridge)
    penalty[0] = 1e-3

    def losses(points: list[np.ndarray]) -> list[tuple[float, np.ndarray]]:
        """Loss and gradient at each point, in scaled inputs."""

        def inner(own: Votes, words: np.ndarray, y: np.ndarray) -> np.ndarray:
            more, out = extras(own, words, own.sums(own.n)), []
            for beta in points:
                z = np.clip(log_odds(beta / scale, own, words), -30, 30)
                error = 1 / (1 + np.exp(-z)) - y
                out += [[(np.logaddexp(0, z) - y * z).sum(), error.sum()], np.bincount(own.at, error[own.row] * np.log1p(own.n), v), [(error * x).sum() for x in more]]
            return np.concatenate(out)

        total, found = summed(inner).reshape(len(points), k + 1), []
        for beta, row in zip(points, total, strict=True):
            z = beta[0]
            grad = row[1:] / scale + penalty * beta
            grad[0] += quiet * (1 / (1 + np.exp(-z)) - still)
            found.append((row[0] + quiet * (np.logaddexp(0, z) - still * z) + 0.5 * (penalty * beta**2).sum(), grad))
        return found

    beta = np.zeros(k)
    loss, grad = losses([beta])[0]
    steps: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(most_steps):
        q, alphas = grad.copy(), []
        for s, y in reversed(steps):
            alphas.append(s @ q / (s @ y))
            q -= alphas[-1] * y
        q *= steps[-1][0] @ steps[-1][1] / (steps[-1][1] @ steps[-1][1]) if steps else 1 / max(np.abs(grad).max(), 1e-12)
        for (s, y), a in zip(steps, reversed(alphas), strict=True):
            q += (a - y @ q / (s @ y)) * s
        tried = losses(points := [beta - q * 0.25**j for j in range(4)])
        best = min(range(4), key=lambda j: tried[j][0])
        if not tried[best][0] < loss:
            break
        gained = loss - tried[best][0]
        s, y = points[best] - beta, tried[best][1] - grad
        if s @ y > 1e-12:
            steps = [*steps, (s, y)][-8:]
        beta, (loss, grad) = points[best], tried[best]
        if gained < 1e-6 * abs(loss):
            break
    return beta / scale


def score_toxicity(docs: DataFrame, labels: DataFrame, cfg: ToxicConfig = ToxicConfig()) -> DataFrame:
    """doc_id, held_out, score (0 to 1), predicted (1 from the threshold on) for every row of docs.

    Only the text enters a score; null texts count as empty and score as a text without any hit. Labels of held-out ids, other
    values and nulls are ignored. Without labels of class 1 only the seed lexicons and patterns vote; an empty table gives no
    rows. Repeated rows stay rows and score alike.

    Scale: the lexicon search and the line from odds to labels see at most max_fit_rows labels; voting is one pass over all whole texts, the
    label model and the classifier sum over the votes of all documents, and no text is exchanged.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "toxicity")
    marks = labels.select(F.col("doc_id").alias("label_id"), F.col("toxic").cast("int").alias("label")).filter(F.col("label").isin(0, 1) & F.col("label_id").isNotNull() & ~held_out("label_id"))
    first = F.broadcast(marks.orderBy(F.xxhash64("label_id"), "label_id", "label").limit(cfg.max_fit_rows))  # at most max_fit_rows rows of two numbers
    sample = docs.select("doc_id", "text").join(first, F.col("doc_id") == F.col("label_id")).select("label", "text")
    stems = find_stems(sample, cfg)
    votes = scratch.table(vote_table(docs, stems), "votes")
    v = len(voter_names(stems))
    model, _ = fit_label_model(votes, v, cfg.em_rounds)
    beta = fit_posteriors(votes, model, scratch)
    if beta is None:
        beta = np.concatenate(([-3.0], np.zeros(v), [1.0, 1.0, 0.5]))

    def odds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.clip(log_odds(beta, Votes(batch, 2, v), batch.column(1).to_numpy().astype(float)), -20.7, 20.7))], ["label", "odds"])

    # the line from the classifier's odds to those of the labels
    marked = votes.join(first, F.col("doc_id") == F.col("label_id")).select(F.col("label").cast("int"), "words", "at", "n")
    marked = marked.orderBy(F.xxhash64("words", "at", "n")).limit(cfg.max_fit_rows).mapInArrow(odds, "label int, odds double").collect()
    y, x = np.array([r["label"] for r in marked], float), np.array([r["odds"] for r in marked])
    if len(y) and 0 < y.sum() < len(y):
        line = fit_linear(x[:, None], y, np.ones(len(y)), 0.01)
        a, b = line.beta[1] / line.scale[0], line.beta[0]
        if a > 0:
            beta = a * beta
            beta[0] += b

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = 1 / (1 + np.exp(-np.clip(log_odds(beta, Votes(batch, 2, v), batch.column(1).to_numpy().astype(float)), -35, 35)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s)], ["doc_id", "score"])

    scored = votes.select("doc_id", "words", "at", "n").mapInArrow(score, "doc_id long, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= cfg.threshold).cast("int").alias("predicted"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))

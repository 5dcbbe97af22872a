"""Quality classifier by positive-unlabelled learning.

Trusted positives and unlabelled web text train an additive logistic model under the non-negative unbiased risk: the
negative class's risk is what the unlabelled texts have beyond the positives' share, and it is never pushed below zero. The
class prior is estimated first, from positives and unlabelled texts alone. A text is described by its shape (binned) and by
all the words it holds (hashed).
"""

from __future__ import annotations

import math
import operator
import zlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlog.llm.common import held_out, map_rows, table

#: About so many positives and unlabelled texts are learned from: those whose id's hash lies below a cutoff (see sample).
POSITIVES, UNLABELLED = 8_000, 16_000
BINS = 24
#: Hashed words: weights, the most that a text can have (all of them), the least texts of the sample a word is in.
WORDS = DISTINCT = 1 << 13
LEAST_TEXTS = 20
#: Hashed words of texts that are spread out together (memory only, never results).
TOGETHER = 1 << 20
EPOCHS, BATCH, RATE, DECAY, WORD_DECAY = 40, 2_048, 0.03, 1e-3, 1e-3
CUT = 0.7

_UPPER, _DIGIT = bytes(range(65, 91)), bytes(range(48, 58))
_MARKS = bytes(c for c in range(33, 127) if not chr(c).isalnum())
_SPACE = bytes([*range(9, 14), 32])
FEATURES = ("log_words", "distinct", "adjacent", "word_length", "upper", "digit", "marks", "exclaim", "bar", "lines", "line_repeat", "commas", "stops", "spaces", "long_words", "capital_words")


def features(text: str | None) -> list[float]:
    """Shape statistics of a whole text; all zero for a null or empty one."""
    if not text:
        return [0.0] * len(FEATURES)
    raw, words, lines = text.encode(), text.split(), text.split("\n")
    size, n = len(raw), max(1, len(words))
    without = lambda chars: (size - len(raw.translate(None, chars))) / size
    return [
        math.log1p(len(words)),
        len(set(words)) / n**0.8,
        sum(map(operator.eq, words, words[1:])) / n,
        len(text) / n,
        without(_UPPER),
        without(_DIGIT),
        without(_MARKS),
        raw.count(b"!") / n,
        raw.count(b"|") / n,
        math.log1p(len(lines)) / math.log(2 + len(words)),
        1 - len(set(lines)) / len(lines),
        raw.count(b",") / n,
        raw.count(b".") / n,
        without(_SPACE),
        max(map(len, words), default=0) ** 0.5,
        sum(map(str.istitle, words)) / n,
    ]


def content(text: str | None) -> np.ndarray:
    """Distinct hashed words of a whole text, ascending."""
    found = np.array([zlib.crc32(w) for w in set((text or "").lower().encode().split())], np.int64)
    return np.unique(found % WORDS).astype(np.uint16)


def packed(words: np.ndarray) -> bytes:
    """Hashed words as a list or, where that is shorter, as one bit for each of DISTINCT."""
    if len(words) < DISTINCT // 16:
        return words.astype("<u2").tobytes()
    bits = np.zeros(DISTINCT, np.uint8)
    bits[words] = 1
    return np.packbits(bits).tobytes()


def unpacked(data: bytes) -> np.ndarray:
    if len(data) < DISTINCT // 8:
        return np.frombuffer(data, "<u2")
    return np.flatnonzero(np.unpackbits(np.frombuffer(data, np.uint8))).astype(np.uint16)


@dataclass(frozen=True)
class Sample:
    """Texts as the model sees them: shape features, and the hashed words of each, laid end to end."""

    x: np.ndarray
    words: np.ndarray
    sizes: np.ndarray

    @classmethod
    def of(cls, x, words: list[np.ndarray]) -> Sample:
        joined = np.concatenate([np.zeros(0, np.uint16), *words], dtype=np.uint16, casting="unsafe")
        return cls(np.array(x, float).reshape(-1, len(FEATURES)), joined, np.array([len(w) for w in words], np.int64))

    def __len__(self) -> int:
        return len(self.x)

    def take(self, at: np.ndarray) -> Sample:
        ends = np.cumsum(self.sizes)
        begin, size = (ends - self.sizes)[at], self.sizes[at]
        place = np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(size.sum())
        return Sample(self.x[at], self.words[place], size)

    def parts(self, at: np.ndarray) -> list[np.ndarray]:
        """The rows `at` in order, cut wherever their words pass a multiple of TOGETHER."""
        return np.split(at, np.flatnonzero(np.diff(np.cumsum(self.sizes[at]) // TOGETHER)) + 1)

    def shape(self) -> Sample:
        """The texts without their words."""
        return Sample(self.x, np.zeros(0, np.uint16), np.zeros(len(self), np.int64))


@dataclass(frozen=True)
class Model:
    """Weights of all bins, then of the hashed words, then the bias."""

    edges: np.ndarray
    weights: np.ndarray
    prior: float

    def columns(self, some: Sample) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(weight, row, value) of every feature that a text has. A text's words share one unit of length."""
        bins = np.stack([np.searchsorted(e, some.x[:, j], side="right") + j * (BINS + 1) for j, e in enumerate(self.edges)], axis=1)
        rows, value = np.arange(len(some)), 1 / np.sqrt(np.maximum(some.sizes, 1))
        first = len(self.edges) * (BINS + 1)
        return (
            np.concatenate([bins.ravel(), some.words.astype(np.int64) + first, np.full(len(some), len(self.weights) - 1)]),
            np.concatenate([np.repeat(rows, len(self.edges)), np.repeat(rows, some.sizes), rows]),
            np.concatenate([np.ones(bins.size), np.repeat(value, some.sizes), np.ones(len(some))]),
        )

    def spread(self, some: Sample, at: np.ndarray):
        """A function that gives the columns of the rows `at` part by part; one part is kept, more are made again on each call."""
        parts = some.parts(at)
        if len(parts) > 1:
            return lambda: (self.columns(some.take(a)) for a in parts)
        one = [self.columns(some.take(at))]
        return lambda: one

    def logit(self, some: Sample) -> np.ndarray:
        return logits(self.weights, self.spread(some, np.arange(len(some)))())

    def score(self, some: Sample) -> np.ndarray:
        return 1 / (1 + np.exp(-self.logit(some)))


def logits(weights: np.ndarray, columns) -> np.ndarray:
    """Of all rows, from the columns of each part; the bias gives every row a column."""
    return np.concatenate([np.clip(np.bincount(r, weights[c] * x), -30, 30) for c, r, x in columns])


def blank(x: np.ndarray, prior: float) -> Model:
    """The model before training: bins by the quantiles of the sample's shape features, every score equal to the prior."""
    x = x if len(x) else np.zeros((1, len(FEATURES)))
    edges = np.quantile(x, np.linspace(0, 1, BINS + 1)[1:], axis=0).T + 0.0
    weights = np.zeros(edges.shape[0] * (BINS + 1) + WORDS + 1)
    weights[-1] = math.log(prior / (1 - prior))
    return Model(edges, weights, prior)


def risk(positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> tuple[float, np.ndarray, np.ndarray]:
    """The non-negative risk prior * R_p(+) + max(0, R_u(-) - prior * R_p(-)) of logits under logistic loss, and the step's
    direction for each logit: the risk's gradient, or, where the negative part is below zero, that part's reversed."""
    p, u = 1 / (1 + np.exp(-positive)), 1 / (1 + np.exp(-unlabelled))
    negative = np.logaddexp(0, unlabelled).mean() - prior * np.logaddexp(0, positive).mean()
    value = prior * np.logaddexp(0, -positive).mean() + max(0.0, negative)
    if negative >= 0:
        return value, prior * (p - 1 - p) / len(p), u / len(u)
    return value, prior * p / len(p), -u / len(u)


def train(positive: Sample, unlabelled: Sample, prior: float, epochs: int = EPOCHS, seed: int = 7) -> Model:
    """Minimises the non-negative risk by Adam over batches that hold positives and unlabelled texts in their proportion."""
    sides = (positive, unlabelled)
    model = blank(np.concatenate([s.x for s in sides]), prior)
    if not len(positive) or not len(unlabelled):
        return model
    rng, w = np.random.default_rng(seed), model.weights
    common = sum(np.bincount(s.words[i : i + TOGETHER], minlength=WORDS) for s in sides for i in range(0, max(1, len(s.words)), TOGETHER)) >= LEAST_TEXTS
    free = np.concatenate([np.ones(len(w) - WORDS - 1, bool), common, [True]])  # rare words keep weight zero
    decay = np.concatenate([np.full(len(w) - WORDS - 1, DECAY), np.full(WORDS, WORD_DECAY), [0.0]])
    m, v, step = np.zeros_like(w), np.zeros_like(w), 0
    batches = max(1, -(-(len(positive) + len(unlabelled)) // BATCH))
    for _ in range(epochs):
        parts = [np.array_split(rng.permutation(len(s)), min(batches, len(s))) for s in sides]
        for k in range(batches):
            columns = [model.spread(s, p[k % len(p)]) for s, p in zip(sides, parts, strict=True)]
            _, *slopes = risk(*(logits(w, c()) for c in columns), prior)
            g = sum(_slope(slope, c(), len(w)) for slope, c in zip(slopes, columns, strict=True))
            g = (g + decay * w) * free
            step += 1
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            w = w - RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return Model(model.edges, w, prior)


def _slope(of: np.ndarray, columns, size: int) -> np.ndarray:
    """The step's direction for each weight, from that for each row's logit."""
    out, at = np.zeros(size), 0
    for c, r, x in columns:
        out += np.bincount(c, of[r + at] * x, size)
        at += r[-1] + 1
    return out


def estimate_prior(positive: Sample, unlabelled: Sample) -> float:
    """The share of positives among the unlabelled texts, from these two samples alone.

    A classifier of positives against unlabelled texts, trained on one half, scores the other. Of the unlabelled texts above
    a cutoff at least the share prior * P(positive above it) is positive, so the quotient of the two shares bounds the prior
    from above; it comes closest where nearly only positives lie. The cutoff is the one with the least quotient
    after a margin for the samples' sizes, so a few texts at the top don't decide. Half where a sample is empty.
    """
    if len(positive) < 4 or len(unlabelled) < 4:
        return 0.5
    positive, unlabelled = positive.shape(), unlabelled.shape()
    halves = [[np.arange(len(s))[k::2] for k in (0, 1)] for s in (positive, unlabelled)]
    # logistic regression of positives against unlabelled texts: the same learner where no unlabelled text counts as positive
    learned = _separate(positive.take(halves[0][0]), unlabelled.take(halves[1][0]))
    p, u = np.sort(learned.logit(positive.take(halves[0][1]))), np.sort(learned.logit(unlabelled.take(halves[1][1])))
    cuts = np.unique(p)
    above_p, above_u = 1 - np.searchsorted(p, cuts) / len(p), 1 - np.searchsorted(u, cuts) / len(u)
    margin = math.sqrt(math.log(40) / (2 * len(u))) + math.sqrt(math.log(40) / (2 * len(p)))
    best = np.argmin((above_u + margin) / above_p)
    return float(np.clip(above_u[best] / above_p[best], 0.02, 0.98))


def _separate(positive: Sample, unlabelled: Sample, rounds: int = 150) -> Model:
    """Plain logistic regression on shape features, both sides with equal weight."""
    model = blank(np.concatenate([positive.x, unlabelled.x]), 0.5)
    sides = [model.columns(s.shape()) for s in (positive, unlabelled)]
    w = model.weights
    m, v = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, rounds + 1):
        g = DECAY * w
        for (c, r, x), n, target in zip(sides, (len(positive), len(unlabelled)), (1, 0), strict=True):
            p = 1 / (1 + np.exp(-np.clip(np.bincount(r, w[c] * x, n), -30, 30)))
            g = g + np.bincount(c, (p - target)[r] * x, len(w)) / (2 * n)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w = w - 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return Model(model.edges, w, 0.5)


def sample(ids: DataFrame, wanted: int) -> DataFrame:
    """The rows of about `wanted` different ids (all, if there are fewer): those whose hash lies below a cutoff, which is set from
    an approximate count. Nothing is sorted or gathered, and an id's rows all stay or all go."""
    count = ids.agg(F.approx_count_distinct("doc_id", 0.02)).first()[0]
    if count <= wanted:
        return ids
    return ids.where(F.shiftrightunsigned(F.xxhash64("doc_id"), 1) < F.lit(int(wanted / count * (1 << 63))))


def _collect(rows: DataFrame) -> Sample:
    """Described rows of a bounded sample, one for each id (repeated ids: the smallest description), in the order of ids."""

    def make():
        return lambda cols: {"doc_id": cols["doc_id"], "x": [features(t) for t in cols["text"]], "words": [packed(content(t)) for t in cols["text"]]}

    described = map_rows(rows.select("doc_id", "text"), make, "doc_id long, x array<double>, words binary")
    one = described.groupBy("doc_id").agg(F.min(F.struct("x", "words")).alias("d")).select("doc_id", "d.x", "d.words")
    got = sorted(one.collect(), key=lambda r: r["doc_id"])
    return Sample.of([r["x"] for r in got], [unpacked(r["words"]) for r in got])


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Trains on bounded samples of the learnable rows of docs (doc_id, text): about POSITIVES rows with quality 1 and UNLABELLED
    rows of any kind. Labels other than 1 are not used."""
    usable = docs.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = labels.where((F.col("quality") == 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select(F.col("doc_id").cast("long").alias("doc_id"))
    trusted = F.broadcast(sample(known, POSITIVES).distinct())  # bounded by the sample
    positive, unlabelled = _collect(usable.join(trusted, "doc_id", "left_semi")), _collect(sample(usable, UNLABELLED))
    return train(positive, unlabelled, estimate_prior(positive, unlabelled))


def score(docs: DataFrame, model: Model, threshold: float = CUT) -> DataFrame:
    """doc_id, score and predicted of docs (doc_id, text), in one narrow pass over whole texts."""
    kept = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        def step(cols):
            s = kept.value.score(Sample.of([features(t) for t in cols["text"]], [content(t) for t in cols["text"]]))
            return {"doc_id": cols["doc_id"], "score": s, "predicted": (s >= threshold).astype(np.int32)}

        return step

    return map_rows(docs, make, "doc_id long, score double, predicted int")


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted of each row.

    Reads the texts of the sample, trains on the driver, then scores all texts in one narrow pass; the model is broadcast (its
    size depends on BINS and WORDS only). Null and empty texts have all features zero and no words and are scored like any other.
    Repeated rows and null ids each give a row (a null id is never held out nor learned from); an empty table gives none.
    Without a positive label every score is one half. Other columns are not looked at.
    """
    read = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    scored = score(read, fit(read, labels))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))

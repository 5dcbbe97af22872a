"""Language identification by a linear-chain conditional random field over words.

A word's emission scores are sums of learned weights of its affixes, character n-grams and lexicon entries; learned
transitions tie neighbouring words. Training sequences are spliced from pieces of labelled texts, so switches of language
within a text are seen and learned. Forward-backward gives each word's label marginals; a text's language is the label
with the most expected words.
"""

from __future__ import annotations

import random
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlog.llm.common import append, free_name, held_out, map_rows, table

#: Bounds of the training sample: about so many texts of a label, and in all; the least of a label, whatever the number of labels; and
#: characters of a text: of a longer one a stretch at a place set by its hash is learned from.
PER_LANG, TEXTS, LEAST, CHARS = 300, 9_600, 20, 20_000
#: Spliced training sequences of each label and in all, their pieces and words in a piece.
SEQUENCES, MOST_SEQUENCES, PIECES, PIECE = 700, 22_400, (1, 3), (2, 24)
EPOCHS, BATCH, RATE = 4, 128, 0.3
#: Words of a text run that are processed side by side, and memoised words of a worker (speed only).
STEP, MEMO = 96, 200_000
#: Characters of texts labelled together, and words of a longer text held at a time.
TOGETHER, BLOCK = 500_000, 250_000
UNDETERMINED = "und"
_EDGE = re.compile(r"^[\W\d_]+|[\W\d_]+$")
#: Rows of the hashed weight table; the first ones are kept for word length and lexicon labels.
TABLE, KEPT = 1 << 18, 64
_BORDER = 2
_MIX = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5))


def word_features(words: list[str], lexicon: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """(feature, position of its word) of lower-case words, as two arrays.

    2- and 3-grams of letters with the word's borders (so they hold its short affixes), affixes of three letters,
    capped length, and the word's lexicon label. N-grams are hashed into the weight table.
    """
    codes = np.frombuffer(f"\x02{'\x02'.join(words)}\x02".encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    border = codes == _BORDER
    word = np.cumsum(border) - 1

    def grams(n: int, good) -> tuple[np.ndarray, np.ndarray]:
        size = len(codes) - n + 1
        at = np.flatnonzero(good) if size > 0 else np.zeros(0, int)
        h = np.full(len(at), n, np.uint64)
        for j in range(n):
            h = (h ^ codes[at + j]) * _MIX[j]
            h ^= h >> np.uint64(31)
        return (h % np.uint64(TABLE - KEPT)).astype(np.int64) + KEPT, word[at]

    inner = ~border
    parts = [grams(2, inner[:-1] | inner[1:])]
    if len(codes) > 2:
        parts.append(grams(3, inner[1:-1]))
    if len(codes) > 3:
        whole = inner[1:-2] & inner[2:-1]
        parts.append(grams(4, whole & (border[:-3] ^ border[3:])))
    lengths = np.minimum(np.diff(np.flatnonzero(border)) - 1, 15)
    parts.append((lengths, np.arange(len(words))))
    labels = np.array([lexicon.get(w, -1) for w in words], np.int64)
    some = np.flatnonzero(labels >= 0)
    parts.append((labels[some] + 16, some))
    return np.concatenate([f for f, _ in parts]), np.concatenate([w for _, w in parts])


def tokens(text: str) -> list[str]:
    """The text's lower-case tokens, for learning and for labelling alike."""
    return text.lower().replace(".", " ").replace(",", " ").replace("!", " ").replace("\x02", " ").split()


def clean(token: str) -> str:
    """The token without what isn't a letter at its ends; empty if it has no letter."""
    if token.isalpha():
        return token
    word = _EDGE.sub("", token)
    return word if any(map(str.isalpha, word)) else ""  # the pattern leaves numerals such as a raised two


@dataclass(frozen=True)
class Crf:
    langs: tuple[str, ...]
    weights: np.ndarray
    transitions: np.ndarray
    starts: np.ndarray
    lexicon: dict[str, int]

    def emissions(self, words: list[str]) -> np.ndarray:
        feature, word = word_features(words, self.lexicon)
        return np.stack([np.bincount(word, self.weights[feature, j], len(words)) for j in range(len(self.langs))], axis=1)


def marginals(emissions: np.ndarray, first: np.ndarray, transitions: np.ndarray, starts: np.ndarray, step: int = STEP) -> np.ndarray:
    """Label marginals of words laid end to end; `first` marks the words that begin a text."""
    return _pass(emissions, first, transitions, starts, step)[0]


def _pass(emissions, first, transitions, starts, step, before=None, behind=None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Marginals, the message after the last word and the one before the first, given those from outside (None: none).

    Exact forward-backward. The words are cut into runs of `step`; the runs' transfer matrices are multiplied side by side, a short
    scan over the runs gives the messages at their borders, and these are carried through all runs at once. A text's
    first word has a transfer matrix that forgets what stands before it.
    """
    total, k = emissions.shape
    none = np.full(k, 1 / k)
    if not total:
        return np.zeros((0, k)), none, none
    runs = -(-total // step)
    pad = runs * step - total
    local = np.exp(emissions - emissions.max(axis=1, keepdims=True))
    real = np.concatenate([np.ones(total, bool), np.zeros(pad, bool)]).reshape(runs, step).T
    local = np.concatenate([local, np.ones((pad, k))]).reshape(runs, step, k).transpose(1, 0, 2)
    begins = np.concatenate([first, np.zeros(pad, bool)]).reshape(runs, step).T
    move, start = np.exp(transitions - transitions.max()), np.exp(starts - starts.max())

    def unit(x: np.ndarray, axes) -> np.ndarray:
        return x / x.sum(axis=axes, keepdims=True)

    product = np.broadcast_to(np.eye(k), (runs, k, k))
    for t in range(step):
        moved = np.where(begins[t][:, None, None], product.sum(axis=2, keepdims=True) * start, product @ move)
        product = np.where(real[t][:, None, None], unit(moved * local[t][:, None, :], (1, 2)), product)
    ahead, back = np.empty((runs, k)), np.empty((runs, k))
    alpha, beta = none if before is None else before, none if behind is None else behind
    for r in range(runs):
        ahead[r] = alpha
        alpha = unit(alpha @ product[r], 0)
        back[runs - 1 - r] = beta
        beta = unit(product[runs - 1 - r] @ beta, 0)
    forward = np.empty((step, runs, k))
    for t in range(step):
        moved = np.where(begins[t][:, None], start, ahead @ move)
        ahead = forward[t] = np.where(real[t][:, None], unit(moved * local[t], 1), ahead)
    out = np.empty((step, runs, k))
    for t in range(step - 1, -1, -1):
        out[t] = unit(forward[t] * back, 1)
        sent = local[t] * back
        sent = unit(np.where(begins[t][:, None], (sent * start).sum(axis=1, keepdims=True), sent @ move.T), 1)
        back = np.where(real[t][:, None], sent, back)
    return out.transpose(1, 0, 2).reshape(-1, k)[:total], alpha, beta


def train(texts: list[tuple[str, str]], seed: int = 7) -> Crf:
    """Fits weights and transitions by AdaGrad on the conditional likelihood of spliced sequences. texts: (text, lang)."""
    by_lang: dict[str, list[list[str]]] = {}
    counts: dict[str, Counter] = {}
    for text, lang in texts:
        words = [w for w in map(clean, tokens(text)) if w]
        if words:
            by_lang.setdefault(lang, []).append(words)
            counts.setdefault(lang, Counter()).update(words)
    langs = tuple(sorted(by_lang))
    k = len(langs)
    if k == 0:
        return Crf((), np.zeros((TABLE, 0)), np.zeros((0, 0)), np.zeros(0), {})
    totals: Counter = sum(counts.values(), Counter())
    lexicon = {}
    for number, lang in enumerate(langs):
        lexicon |= {w: number for w, n in counts[lang].items() if n >= 4 and n >= 0.8 * totals[w]}
    rng, sequences = random.Random(seed), []
    for own in range(k):
        for _ in range(max(50, min(SEQUENCES, MOST_SEQUENCES // k))):
            words, labels = [], []
            for piece in range(rng.randint(*PIECES)):
                label = own if piece == 0 else rng.randrange(k)
                text = rng.choice(by_lang[langs[label]])
                size = rng.randint(*PIECE)
                at = rng.randrange(max(1, len(text) - size + 1))
                part = text[at : at + size]
                words += part
                labels += [label] * len(part)
            sequences.append((words, labels))
    weights, move, start = np.zeros((TABLE, k)), np.zeros((k, k)), np.zeros(k)
    sums = [np.full_like(weights, 1e-2), np.full_like(move, 1e-2), np.full_like(start, 1e-2)]
    for _ in range(EPOCHS):
        rng.shuffle(sequences)
        for b in range(0, len(sequences), BATCH):
            words = [w for s in sequences[b : b + BATCH] for w in s[0]]
            labels = np.array([x for s in sequences[b : b + BATCH] for x in s[1]])
            sizes = np.array([len(s[1]) for s in sequences[b : b + BATCH]])
            first = np.zeros(len(labels), bool)
            first[np.concatenate([[0], np.cumsum(sizes)[:-1]])] = True
            flat, of = word_features(words, lexicon)
            scores = np.stack([np.bincount(of, weights[flat, j], len(words)) for j in range(k)], axis=1)
            each, both = _expectations(scores, first, move, start)
            truth = np.eye(k)[labels]
            inner = np.flatnonzero(~first)
            seen = np.zeros((k, k))
            np.add.at(seen, (labels[inner - 1], labels[inner]), 1)
            diff = each - truth
            used, flat = np.unique(flat, return_inverse=True)
            slope = np.stack([np.bincount(flat, diff[of, j], len(used)) for j in range(k)], axis=1) / len(sizes)
            sums[0][used] += slope * slope
            weights[used] -= RATE * slope / np.sqrt(sums[0][used])
            for x, g, s in ((move, (both - seen) / len(sizes), sums[1]), (start, diff[first].sum(axis=0) / len(sizes), sums[2])):
                s += g * g
                x -= RATE * g / np.sqrt(s)
    return Crf(langs, weights.astype(np.float32), move, start, lexicon)


def _expectations(scores, first, move, start):
    """Word marginals and the expected number of each transition."""
    each = marginals(scores, first, move, start, 16)
    k = len(start)
    # pair marginals from word messages: forward of the left word, what the right word sends back
    local = np.exp(scores - scores.max(axis=1, keepdims=True))
    forward = _forward(local, first, np.exp(move - move.max()), np.exp(start - start.max()))
    inner = np.flatnonzero(~first)
    if not len(inner):
        return each, np.zeros((k, k))
    with np.errstate(divide="ignore", invalid="ignore"):
        sent = np.where(forward > 0, each / forward, 0)  # backward messages up to a factor
    pair = forward[inner - 1][:, :, None] * np.exp(move - move.max()) * (local * sent)[inner][:, None, :]
    return each, (pair / pair.sum(axis=(1, 2), keepdims=True)).sum(axis=0)


def _forward(local, first, move, start):
    """Normalised forward messages, all texts side by side."""
    begin = np.flatnonzero(first)
    sizes = np.diff(np.append(begin, len(local)))
    out = np.empty_like(local)
    now = start * local[begin]
    now = now / now.sum(axis=1, keepdims=True)
    out[begin] = now
    for t in range(1, int(sizes.max(initial=1))):
        live = sizes > t
        at = begin[live] + t
        step = (out[at - 1] @ move) * local[at]
        out[at] = step / step.sum(axis=1, keepdims=True)
    return out


class Labeller:
    """Applies a model; memoises emission rows by token."""

    def __init__(self, model: Crf):
        self.model = model
        self.rows: dict[str, int] = {}
        self.table = np.zeros((0, len(model.langs)))

    def learn(self, tokens: set[str]) -> None:
        """Adds the rows of new tokens; -1 for those without a letter."""
        rows = self.rows
        if len(rows) > MEMO:
            rows.clear()
            self.table = self.table[:0]
        new = [t for t in tokens if t not in rows]
        words = [(t, w) for t, w in zip(new, map(clean, new), strict=True) if w]
        rows.update(dict.fromkeys(new, -1))
        rows.update(zip((t for t, _ in words), range(len(self.table), len(self.table) + len(words)), strict=True))
        if words:
            self.table = np.concatenate([self.table, self.model.emissions([w for _, w in words])])

    def words(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Rows of all words with a letter, and how many each text has."""
        split = [tokens(t) if t else [] for t in texts]
        every = [t for words in split for t in words]
        self.learn(set(every))
        at = np.fromiter(map(self.rows.__getitem__, every), np.int64, len(every))
        ends = np.cumsum([len(words) for words in split])
        word = at >= 0
        before = np.concatenate([[0], np.cumsum(word)])
        return at[word], np.diff(before[np.concatenate([[0], ends])])

    def label(self, texts: list[str | None]) -> list[tuple[str, float, list[float]]]:
        """(language, score, expected share of each language) of each text, some texts at a time."""
        langs, out, a = self.model.langs, [], 0
        if not langs:
            return [(UNDETERMINED, 0.0, [])] * len(texts)
        while a < len(texts):
            size, b = 0, a
            while b < len(texts) and (b == a or size + len(texts[b] or "") <= TOGETHER):
                size += len(texts[b] or "")
                b += 1
            out += self._label(texts[a:b])
            a = b
        return out

    def _label(self, texts: list[str | None]) -> list[tuple[str, float, list[float]]]:
        langs = self.model.langs
        rows, sizes = self.words(texts)
        begin = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(int)
        some = sizes > 0
        shares = np.zeros((len(texts), len(langs)))
        if len(texts) == 1 and len(rows) > BLOCK:
            shares[0] = self._long(rows) / len(rows)
        elif len(rows):
            first = np.zeros(len(rows), bool)
            first[begin[some]] = True
            each = marginals(self.table[rows], first, self.model.transitions, self.model.starts)
            shares[some] = np.add.reduceat(each, begin[some], axis=0) / sizes[some][:, None]
        best = shares.argmax(axis=1)
        return [(langs[b], min(1.0, float(s[b])), s.tolist()) if ok else (UNDETERMINED, 0.0, []) for b, s, ok in zip(best, shares, some, strict=True)]

    def _long(self, rows: np.ndarray) -> np.ndarray:
        """Expected words of each label in one text, exactly, block by block: forward for the messages between blocks, then back."""
        blocks = [rows[i : i + BLOCK] for i in range(0, len(rows), BLOCK)]
        first = [np.arange(len(b)) == (0 if i == 0 else -1) for i, b in enumerate(blocks)]
        ahead, behind, total = [None], None, np.zeros(len(self.model.langs))
        model = (self.model.transitions, self.model.starts, STEP)
        for b, f in zip(blocks[:-1], first, strict=False):
            ahead.append(_pass(self.table[b], f, *model, ahead[-1])[1])
        for b, f, message in zip(blocks[::-1], first[::-1], ahead[::-1], strict=True):
            each, _, behind = _pass(self.table[b], f, *model, message, behind)
            total += each.sum(axis=0)
        return total


def sample(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> list[tuple[str, str]]:
    """(text, lang) of a bounded sample of learnable rows (see held_out) with an id, a lang and a text that isn't empty, in a fixed order.

    Each label gives the rows whose hash of id and text lies below a cutoff, set from an approximate count, so nothing is sorted
    or ranked and a label's rows don't meet in a task. Equal rows count once. What is sent grows with the labels, as the model does.
    """
    text, lang = docs[text_col].cast("string"), docs[lang_col].cast("string")
    known = docs.where(docs[id_col].isNotNull() & lang.isNotNull() & (F.length(text) > 0) & ~held_out(docs[id_col]))
    rows = known.select(F.shiftrightunsigned(F.xxhash64(docs[id_col], text), 1).alias("h"), lang.alias("lang"), text.alias("text"))
    counts = [tuple(r) for r in rows.groupBy("lang").agg(F.approx_count_distinct("h", 0.02)).collect()]
    if not counts:
        return []
    quota = max(LEAST, min(PER_LANG, TEXTS // len(counts)))
    cutoffs = [(x, (1 << 63) - 1 if n <= quota else int(quota / n * (1 << 63))) for x, n in counts]
    least = docs.sparkSession.createDataFrame(cutoffs, "lang string, cutoff long")
    size = F.length("text")
    place = F.when(size > CHARS, F.pmod(F.col("h"), size - CHARS + 1) + 1).otherwise(1)
    picked = rows.join(F.broadcast(least), "lang").where(F.col("h") <= F.col("cutoff")).select("lang", "h", F.substr("text", place.cast("int"), F.lit(CHARS)).alias("text"))
    found = picked.groupBy("lang", "h").agg(F.min("text").alias("text")).collect()
    return sorted((r["text"], r["lang"]) for r in found)


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Crf:
    """Trains on the bounded sample; every label of a learnable row can be predicted."""
    return train(sample(docs, id_col, text_col, lang_col))


def identify(docs: DataFrame, model: Crf, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score (the expected share of words in that language), shares of each row.

    One narrow pass over whole texts; the model (bounded by the training sample) is broadcast. `und` with score 0 where the
    text is null or has no letter. Repeated rows and null ids each give a row; an empty table gives none; other columns
    are not looked at. Without any learnable row all texts are `und`.
    """
    kept = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        labeller = Labeller(kept.value)

        def step(cols):
            got = labeller.label(cols["text"])
            return {"doc_id": cols["doc_id"]} | {n: [g[i] for g in got] for i, n in enumerate(("lang_pred", "score", "shares"))}

        return step

    read = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    return map_rows(read, make, "doc_id long, lang_pred string, score double, shares array<double>")


#: A text is rejected below this share of its best language.
MIN_SCORE = 0.3


def keep_known(docs: DataFrame, model: Crf, least: float = MIN_SCORE, text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns as they are, whose language is determined with a score of `least` or more.

    Rejects texts without a letter (null and empty ones too) and mixtures without a leading language.
    """
    kept, keep = docs.sparkSession.sparkContext.broadcast(model), free_name(docs, "_known")

    def make():
        labeller = Labeller(kept.value)
        return lambda cols: {keep: [lang != UNDETERMINED and score >= least for lang, score, _ in labeller.label(cols["text"])]}

    return append(docs, make, {"text": text_col}, {keep: "boolean"}).where(F.col(keep)).drop(keep)


def op1_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, fit(docs)).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")

"""The pipeline's rows against a plain version of every stage, on documents with planted cases."""

import base64
import hashlib
import random
import re

import numpy as np
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F

from strandlog.llm import byte_bpe, common, langid, pii

WORDS = {
    "aa": "alpha arbor amber adage along abide again award azure actor annex apron aisle alert album arrow",
    "zz": "zebra zonal zesty zilch zippy zones zoned zincs zooms zeros zings zonks zippo zests zaxes zills",
}


def corpus(seed):
    """(docs, items): two invented languages, exact and near copies, benchmark passages in short and long texts, personal data, junk."""
    rng = random.Random(seed)
    text = lambda lang, n: " ".join(rng.choice(WORDS[lang].split()) + rng.choice(["", "", "s", "ed"]) for _ in range(n))
    items = [(f"i{k}", text("aa", 30)) for k in range(5)] + [("none", None), ("short", "quite unlike words")]
    rows = []
    for k in range(90):
        lang = "aa" if k % 3 else "zz"
        body = text(lang, rng.choice([30, 80, 400, 6000 if k % 30 == 1 else 120]))
        if k % 9 == 1:
            item, at = rng.choice(items[:5])[1].split(), rng.randrange(5)
            body = f"{body} {' '.join(item[at : at + 13 + k % 7])} {text(lang, 40)}"
        elif k % 9 == 2:
            body += f" mail me{k}@example.org or +1 (988) 555-24{k:02} from 10.0.0.{k}"
        elif k % 9 == 4:
            body += " It is Quite unlike WORDS."
        elif k % 9 == 5 and k > 30:
            body = rows[k // 2][1]  # an exact copy, perhaps of a copy
        elif k % 9 == 7 and k > 30 and rows[k // 2][1]:
            body = rows[k // 2][1].replace("arbor", "harbour", 1)
        rows.append((k, body, lang if k % 4 else None))
    rows += [(200, None, None), (201, "", None), (202, "12 34 -- 56", "aa"), (None, text("aa", 50), "aa"), (203, "é ½ \x85 " + text("zz", 60), "zz")]
    rows += [(204, f"{text('aa', 60)} {text('zz', 60)}", None), rows[3]]
    rng.shuffle(rows)
    return rows, items


def test_worker_memory():
    """A worker that goes from one operator to another drops what only the first one uses, and keeps it between tasks of one."""
    path, pattern = byte_bpe.default_vocabulary()
    with common.task(byte_bpe.__name__):
        first = byte_bpe.load(path, pattern)
    with common.task(byte_bpe.__name__):
        assert byte_bpe.load(path, pattern) is first
    with common.task(langid.__name__):
        assert byte_bpe.load.cache_info().currsize == 0


def plain_language(rows, model, least):
    """Each text by itself, forward and backward word by word."""
    kept, k = [], len(model.langs)
    for row in rows:
        words = [w for w in map(langid.clean, langid.tokens(row[1] or "")) if w]
        if not words:
            continue
        e, move = model.emissions(words), np.exp(model.transitions)
        local = np.exp(e - e.max(axis=1, keepdims=True))
        ahead, back = np.zeros((len(words), k)), np.ones((len(words), k))
        for t in range(len(words)):
            ahead[t] = local[t] * (np.exp(model.starts) if t == 0 else ahead[t - 1] @ move)
            ahead[t] /= ahead[t].sum()
        for t in range(len(words) - 2, -1, -1):
            back[t] = move @ (local[t + 1] * back[t + 1])
            back[t] /= back[t].sum()
        each = ahead * back
        if (each / each.sum(axis=1, keepdims=True)).mean(axis=0).max() >= least:
            kept.append(row)
    return kept


def plain_features(text):
    """The words' sequence, the fingerprints of the distinct words and the set of five-word shingles, bit by bit."""
    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    prints = []
    for seed in (42, 43):
        hashes = [xxhash.xxh64(w, seed=seed).intdigest() for w in set(words)]
        prints.append(sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)))
    return words, prints, {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def plain_near(rows):
    """All pairs, then the smallest id of each group; rows without an id all stay if some group has none, else all go."""
    made = [plain_features(r[1]) for r in rows]
    group, pairs = list(range(len(rows))), []
    halves = lambda x: ((x >> 32).bit_count(), (x & 0xFFFFFFFF).bit_count())
    for i, (words, prints, shingles) in enumerate(made):
        for j, (others, theirs, set_) in enumerate(made[:i]):
            close = any(min(halves(p ^ q)) <= 1 for p, q in zip(prints, theirs, strict=True))
            if words == others or close and shingles & set_ and 5 * len(shingles & set_) >= 4 * len(shingles | set_):
                pairs.append((i, j))
    was = None
    while was != group:
        was = list(group)
        for i, j in pairs:
            group[i] = group[j] = min(group[i], group[j])
    first = {}
    for row, g in zip(rows, group, strict=True):
        if row[0] is not None:
            first[g] = min(first.get(g, row[0]), row[0])
    kept = {r[0] for r, g in zip(rows, group, strict=True) if r[0] == first.get(g)}
    return [r for r in rows if r[0] in kept]


def plain_clean(rows, items):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = set()
    for _, text in items:
        w = split(text)
        windows |= {tuple(w[i : i + 13]) for i in range(max(1, len(w) - 12) if w else 0)}

    def hit(text):
        w = split(text)
        return any(tuple(w[i : i + n]) in windows for n in {len(x) for x in windows} for i in range(len(w) - n + 1))

    return [r for r in rows if not hit(r[1])]


def plain_masked(text, spans):
    out, done = "", 0
    for s in sorted(spans, key=lambda s: (s["start"], -s["end"], s["kind"])):
        if s["start"] >= done:
            out += text[done : s["start"]] + f"[{s['kind'].upper()}]"
        done = max(done, s["end"])
    return out + text[done:]


@pytest.mark.parametrize("seed", [1, 2])
def test_against_plain_stages(spark, monkeypatch, tmp_path, seed):
    pipeline = pytest.importorskip("corpus_pipeline")
    rows, items = corpus(seed)
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame([(d, t, lang, "s", None if t is None else len(t)) for d, t, lang in rows], schema)
    sf = str(tmp_path)
    docs.repartition(3).write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame(items, "item_id string, text string").write.parquet(f"{sf}/benchmark.parquet")
    now = plain_language(rows, langid.fit(docs), langid.MIN_SCORE)
    assert len(now) < len(rows)
    sizes = [len(now)]
    now = plain_near(now)
    sizes.append(len(now))
    now = plain_clean(now, items)
    sizes.append(len(now))
    assert sizes[0] > sizes[1] > sizes[2] > 20
    # the spans are tested against a plain version of their own; here the masked text is built from them
    texts = spark.createDataFrame([(i, r[1]) for i, r in enumerate(now)], "doc_id long, text string")
    spans = {r["doc_id"]: r["found"] for r in pii.detect(texts, out_col="found").collect()}
    assert sum(map(bool, spans.values())) > 3
    path, pattern = byte_bpe.default_vocabulary()
    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in open(path, "rb"))}
    library = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    want = []
    for i, (doc, text, _) in enumerate(now):
        text = plain_masked(text, spans[i])
        ids = np.array(library.encode_ordinary(text), "<u4").tobytes()
        want.append((str(doc), len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    got = pipeline.run(spark, sf).select(F.col("doc_id").cast("string"), "n_tokens", "ids_sha256", "decoded_sha256").collect()
    assert sorted((str(r[0]), *r[1:]) for r in got) == sorted(want)

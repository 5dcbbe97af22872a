"""SimHash against brute force."""

import random

import pytest
import xxhash

from strandlog.llm import simhash
from strandlog.llm.graph import components


def brute_components(pairs):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in parent}


def plain_fingerprint(text):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("text", [None, "", " \n", "One", "one TWO", "a b c", "a b c d É\x85x \x1cy", "x " * 70000, "the a the a the a the b"])
def test_fingerprint(text):
    assert simhash.fingerprint(text) % (1 << 64) == plain_fingerprint(text)


def signed(x):
    return x - (1 << 64) if x >> 63 else x


@pytest.mark.parametrize("paired", [2, 128])
def test_links(spark, paired):
    rng = random.Random(3)
    fps = {0, (1 << 64) - 1}
    for _ in range(6):
        centre = rng.getrandbits(64)
        for _ in range(40):
            x = centre
            for _ in range(rng.randint(0, 5)):
                x ^= 1 << rng.randrange(64)
            fps.add(x)
    fps = [signed(x) for x in fps]
    want = {(min(a, b), max(a, b)) for i, a in enumerate(fps) for b in fps[:i] if ((a ^ b) % (1 << 64)).bit_count() <= 3}
    got = simhash.links(spark.createDataFrame([(x,) for x in fps], "fp long"), paired).collect()
    assert {tuple(r) for r in got} == want
    if paired == 128:
        assert len(got) == len(want)


def test_components(spark):
    rng = random.Random(1)
    pairs = [(i, i + 1) for i in range(100, 160)] + [(rng.randrange(1000, 1400), rng.randrange(1000, 1400)) for _ in range(150)] + [(5000, i) for i in range(5001, 5100)] + [(7, 7)]
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == brute_components([p for p in pairs if p[0] != p[1]])
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_whole(spark):
    rng = random.Random(2)
    words = ["w%d" % i for i in range(50)]
    texts = [None, "", "  ", "one", "One"]
    for _ in range(20):
        base = [rng.choice(words) for _ in range(60)]
        texts += [" ".join(base)] * 2
        for _ in range(4):
            other = list(base)
            other[rng.randrange(60)] = "x"
            texts.append(" ".join(other))
    rows = [(i if i != 7 else None, t, 1) for i, t in enumerate(texts)]
    got = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, fp int")).collect()
    fps = [plain_fingerprint(t) for t in texts]
    near = brute_components([(i, j) for i in range(len(fps)) for j in range(i + 1) if (fps[i] ^ fps[j]).bit_count() <= 3])
    ids = {}
    for i, (doc, *_) in enumerate(rows):
        if doc is not None:
            ids[near[i]] = min(ids.get(near[i], doc), doc)
    want = {(doc, f"{fps[i]:016x}", ids.get(near[i])) for i, (doc, *_) in enumerate(rows)}
    assert {tuple(r) for r in got} == want and len(got) == len(rows)
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(empty).count() == 0


@pytest.mark.parametrize("star", [2, 64])
def test_keep_first(spark, monkeypatch, star):
    """Near copies go, texts below the similarity and reordered words stay; null ids, repeated rows, no rows, clashing names."""
    from tests.llm.test_pipeline import plain_near

    monkeypatch.setattr(simhash._similar_texts, "__defaults__", (star,))
    rng = random.Random(5)
    words = ["w%d" % i for i in range(400)]
    texts = [None, "", " \t", "one", "One", "one two", "two one", "a b c d e", "a b c d e " * 30000]
    for k in range(25):
        base = [rng.choice(words) for _ in range(rng.choice([8, 60, 200, 900]))]
        texts += [" ".join(base), " ".join(base).upper(), " ".join(rng.sample(base, len(base)))]
        for share in (0.004, 0.01, 0.02, 0.05) * (5 if k % 6 == 0 else 1):
            texts.append(" ".join("x%d" % k if rng.random() < share else w for w in base))
    rng.shuffle(texts)
    rows = [(i if i % 19 != 7 else None, t, i, i) for i, t in enumerate(texts)]
    rows += rows[:3]
    docs = spark.createDataFrame(rows, "doc_id long, text string, key long, first long")
    got = simhash.keep_first(docs)
    assert got.columns == docs.columns
    got = [tuple(r) for r in got.collect()]
    assert sorted(got, key=str) == sorted(plain_near(rows), key=str) and len(texts) / 4 < len(got) < len(texts) - 40
    assert simhash.keep_first(docs.limit(0)).count() == 0

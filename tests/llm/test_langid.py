"""Language identification: exact inference, held-out accuracy and odd inputs."""

import itertools
import random
import zlib

import numpy as np
import pytest

from strandlog.llm import langid
from strandlog.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def brute(emissions, transitions, starts):
    n, k = emissions.shape
    total = np.zeros((n, k))
    for path in itertools.product(range(k), repeat=n):
        score = starts[path[0]] + sum(emissions[t, s] for t, s in enumerate(path)) + sum(transitions[a, b] for a, b in itertools.pairwise(path))
        total[range(n), path] += np.exp(score)
    return total / total[0].sum()


@pytest.mark.parametrize("step", [1, 3, 7, 50])
def test_marginals(step):
    rng = np.random.default_rng(step)
    move, start = rng.normal(size=(3, 3)) * 2, rng.normal(size=3)
    parts = [rng.normal(size=(n, 3)) * 2 for n in (1, 5, 1, 6, 4)]
    first = np.concatenate([[True] + [False] * (len(p) - 1) for p in parts])
    got = langid.marginals(np.concatenate(parts), first, move, start, step)
    assert np.allclose(got, np.concatenate([brute(p, move, start) for p in parts]))
    assert langid.marginals(np.zeros((0, 3)), np.zeros(0, bool), move, start).shape == (0, 3)


def test_long_text_in_blocks(monkeypatch):
    rng = np.random.default_rng(3)
    model = langid.Crf(("a", "b"), np.zeros((langid.TABLE, 2), np.float32), rng.normal(size=(2, 2)), rng.normal(size=2), {})
    labeller = langid.Labeller(model)
    labeller.table = rng.normal(size=(50, 2))
    rows = rng.integers(0, 50, 1001)
    want = langid.marginals(labeller.table[rows], np.arange(1001) == 0, model.transitions, model.starts).sum(axis=0)
    for size in (100, 250, 1000, 7):
        monkeypatch.setattr(langid, "BLOCK", size)
        assert np.allclose(labeller._long(rows), want)


def test_expectations():
    rng = np.random.default_rng(1)
    move, start, e = rng.normal(size=(2, 2)), rng.normal(size=2), rng.normal(size=(4, 2))
    _, pairs = langid._expectations(e, np.array([True, False, False, False]), move, start)
    want, total = np.zeros((2, 2)), 0
    for path in itertools.product(range(2), repeat=4):
        p = np.exp(start[path[0]] + sum(e[t, s] for t, s in enumerate(path)) + sum(move[a, b] for a, b in itertools.pairwise(path)))
        total += p
        for a, b in itertools.pairwise(path):
            want[a, b] += p
    assert np.allclose(pairs, want / total)


def test_code_switching():
    rng = random.Random(1)
    word = lambda letters: "".join(rng.choice(letters) for _ in range(rng.randint(2, 7)))
    texts = [(" ".join(word("abcdef") for _ in range(40)), "x") for _ in range(30)] + [(" ".join(word("uvwxyz") for _ in range(40)), "y") for _ in range(30)]
    labeller = langid.Labeller(langid.train(texts))
    got = labeller.label(["abba dead face", "ABBA, Dead! wyvux wuzzy zyx vux", None, "", "12 -- 3!", "\x02 abba", "\u00b2 \u2167 _\u00bd_"])
    assert [g[0] for g in got] == ["x", "y", "und", "und", "und", "x", "und"]
    assert got[0][1] > 0.9 and 0.5 < got[1][1] < 0.8 and got[2][1] == 0.0
    assert langid.Labeller(langid.train([])).label(["a"])[0][:2] == ("und", 0.0)


def test_held_out(spark):
    got = QUERIES["op1_langid"](spark, SF).collect()
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert len(got) == len(docs)
    for r in got:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1
    held = [r["lang_pred"] == docs[r["doc_id"]]["lang"] for r in got if r["held_out"]]
    assert np.mean(held) > 0.95


def test_odd_rows(spark):
    rows = [(1, "the cat", "en", 1), (1, "the cat", "en", 1), (None, "x", None, 2), (3, None, "en", 3), (4, "é" * 200_000, None, 4), (5, "a " * 50_000, None, 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score int")
    model = langid.fit(df)
    got = langid.identify(df, model).collect()
    assert len(got) == 6 and [r["lang_pred"] for r in got if r["doc_id"] == 3] == ["und"]
    kept = langid.keep_known(df, model)
    assert kept.columns == df.columns and kept.count() == 5
    empty = df.limit(0)
    assert langid.identify(empty, langid.fit(empty)).count() == 0


def test_many_labels_and_long_texts(spark, monkeypatch):
    """No cap on labels; a label whose texts are all long is learned too; the sample is the same however the rows lie."""
    monkeypatch.setattr(langid, "MOST_SEQUENCES", 2_000)
    rng = random.Random(4)
    spell = lambda k: ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz"[k % 20 : k % 20 + 6]) + str.lower(chr(97 + k % 26)) for _ in range(rng.randint(1, 4))) for _ in range(40)]
    lexicons = [spell(k) for k in range(36)]
    rows = [(k * 100 + i, " ".join(rng.choice(lexicons[k]) for _ in range(40)), f"l{k:02}") for k in range(36) for i in range(12)]
    rows += [(9_000 + i, " ".join(rng.choice(["zebra", "zulu", "zinc"]) for _ in range(6_000)), "long") for i in range(8)]
    docs = spark.createDataFrame(rows * 2, "doc_id long, text string, lang string")
    found = langid.sample(docs.repartition(5))
    assert found == langid.sample(docs.repartition(2))
    assert {lang for _, lang in found} == {r[2] for r in rows} and max(len(t) for t, _ in found) == langid.CHARS
    model = langid.fit(docs)
    assert len(model.langs) == 37
    got = langid.Labeller(model).label(["zulu zinc zebra", " ".join(lexicons[35][:20])])
    assert [g[0] for g in got] == ["long", "l35"]


def test_one_tokeniser():
    texts = [("alpha,beta.gamma!delta", "x"), ("one two", "y")]
    model = langid.train(texts * 5)
    assert {w for w, k in model.lexicon.items() if model.langs[k] == "x"} == {"alpha", "beta", "gamma", "delta"}
    assert langid.Labeller(model).words(["alpha,beta.gamma!delta"])[1].tolist() == [4]


def test_sample_is_bounded(spark, monkeypatch):
    monkeypatch.setattr(langid, "PER_LANG", 50)
    docs = spark.range(0, 30_000).selectExpr("id % 10000 as doc_id", "concat('word ', id % 10000) as text", "if(id % 10 < 9, 'en', 'de') as lang")
    found = langid.sample(docs)
    assert all(25 < sum(lang == x for _, lang in found) < 80 for x in ("en", "de")) and len(set(found)) == len(found)

"""URL filter, exact top-k and the quality classifier."""

import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandlog.llm import quality, topk, url_filter
from strandlog.llm.queries import QUERIES


def test_urls(spark):
    cases = {
        None: ("", "", None, "allow"),
        "": ("", "", None, "allow"),
        "no-scheme.com/en/1": ("", "", None, "allow"),
        "http://A.Example.COM/en/1?x#y": ("a.example.com", "/en/1", "com/en/", "block"),
        "http://example.com/en/77": ("example.com", "/en/77", "example.com/en/7", "allow"),
        "http://notexample.com/en/77": ("notexample.com", "/en/77", "com/en/", "block"),
        "https://example.net/de/8": ("example.net", "/de/8", "example.net/de/8", "block"),
        "https://x.org?/es/": ("x.org", "", None, "allow"),
        "x://y://z/es/": ("y:", "//z/es/", None, "allow"),
        "http://m.org/es/": ("m.org", "/es/", "org/es/", "block"),
        "http://h.org/xxx": ("h.org", "/xxx", None, "block"),
        "http://h.org/xxxl": ("h.org", "/xxxl", None, "allow"),
        "http://h.org/casino": ("h.org", "/casino", None, "allow"),
        "http://h.org/casino/casino": ("h.org", "/casino/casino", None, "allow"),
        "http://h.org/Casino/POKER": ("h.org", "/Casino/POKER", None, "block"),
        "http://sussex.org/essex": ("sussex.org", "/essex", None, "allow"),
    }
    rows = [(i, u, "h") for i, u in enumerate(cases)] + [(None, "http://" + "a." * 50_000 + "org/es/", "h")]
    got = {r["page_id"]: r for r in url_filter.judge_urls(spark.createDataFrame(rows, "page_id long, url string, host string")).collect()}
    for i, (url, want) in enumerate(cases.items()):
        assert tuple(got[i][c] for c in ("host", "path", "rule", "verdict")) == want, url
    assert got[None]["verdict"] == "block"
    some = [r for r in rows if r[0] in (3, 10)] * 3
    again = url_filter.judge_urls(spark.createDataFrame(some, "page_id long, url string, host string"))
    assert sorted(r["page_id"] for r in again.collect()) == [3] * 3 + [10] * 3 and again.distinct().count() == 2
    assert url_filter.judge_urls(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_url_rules_of_the_contract(spark):
    """The contract's list, written out here: each rule alone, where rules meet, and all pages by a plain version of the rule."""
    listed = {("com", "/en/"): "block", ("example.com", "/en/7"): "allow", ("net", "/de/"): "allow", ("example.net", "/de/8"): "block", ("org", "/es/"): "block"}
    assert {(r.host, r.path): r.action for r in url_filter.RULES} == listed
    sf = "/root/testdata/sf0.01"
    extra = ["http://net/de/", "http://M.NET/de/1", "http://example.net/de/7", "http://a.example.net/de/81", "http://m.net/de/xxx", "http://m.net/de", "http://mnet/de/"]
    urls = {r["page_id"]: r["url"] for r in spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url").collect()}
    got = {r["page_id"]: r for r in QUERIES["op8_url_filter"](spark, sf).collect()}
    assert got.keys() == urls.keys()
    frame = spark.createDataFrame(list(enumerate(extra, -len(extra))), "page_id long, url string")
    got |= {r["page_id"]: r for r in url_filter.judge_urls(frame).collect()}
    urls |= dict(enumerate(extra, -len(extra)))
    seen = set()
    for i, url in urls.items():
        host, path = re.search(r"://([^/?#]*)([^?#]*)", url).groups()
        fits = [r for r in listed if f".{host.lower()}".endswith(f".{r[0]}") and path.startswith(r[1])]
        rule = max(fits, key=lambda r: len("".join(r)), default=None)
        want = (rule and "".join(rule), listed[rule] if rule else "block" if got[i]["weight"] >= 100 else "allow")
        assert (got[i]["rule"], got[i]["verdict"]) == want, url
        seen.add(rule)
    assert seen == {*listed, None}
    assert [got[i]["verdict"] for i in range(-len(extra), 0)] == ["allow", "allow", "allow", "block", "allow", "allow", "allow"]


def test_url_vocabulary(spark):
    """Random urls full of terms, joined with and without boundaries, against a regular expression for each term; and the SQL."""
    import duckdb

    rng = random.Random(12)
    terms = url_filter.TERMS
    assert {w >= url_filter.LIMIT for w in terms.values()} == {True, False} and all(0 < w <= 100 for w in terms.values())
    words = [*terms, "garden", "essex", "x", "9", "Ünder"]
    urls = ["".join(rng.choice(["http://h.io/", "HTTPS://Casino.io/", ""])) + "".join(rng.choice(words).title() + rng.choice("-/_.?=&#% a7é") for _ in range(rng.randint(0, 5))) for _ in range(3000)]
    frame = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string")
    got = {r["page_id"]: r for r in url_filter.judge_urls(frame, rules=()).collect()}
    verdicts = set()
    for i, url in enumerate(urls):
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in url)
        hits = [w for t, w in terms.items() if re.search(f"(?<![a-z0-9]){re.escape(t)}(?![a-z0-9])", low)]
        want = (sum(w >= 100 for w in hits), sum(w < 100 for w in hits), sum(hits), "block" if sum(hits) >= 100 else "allow")
        assert tuple(got[i][c] for c in ("n_strict", "n_soft", "weight", "verdict")) == want, url
        verdicts.add((want[0] > 0, want[1] > 1, want[3]))
    assert {(True, False, "block"), (False, True, "block"), (False, True, "allow"), (False, False, "allow")} <= verdicts
    pages = frame.toPandas()  # noqa: F841
    sql = duckdb.sql(url_filter.ORACLE).fetchall()
    ours = url_filter.judge_urls(frame).collect()
    assert sorted(sql, key=lambda r: r[0]) == sorted((tuple(r) for r in ours), key=lambda r: r[0])


def test_url_terms_file(tmp_path):
    (tmp_path / "t").write_text("# c\n100 Bad\n 40 two words # x\n\n", encoding="utf-8")
    assert url_filter.read_terms(tmp_path / "t") == {"bad": 100, "two words": 40}
    judge = url_filter.UrlJudge((), {"a": 60, "b": 39, "c": 1}, 100)
    assert [judge.judge(f"x://h/{p}")[3] for p in ("a-b", "a-b-c", "a-a-a", "b-c")] == ["allow", "block", "allow", "allow"]


def plain_top(rows, k):
    ok = [(i, [math.floor(64 * float(np.float32(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, a in {i: v for i, v in ok if i % 20 == 0}.items():
        scores = sorted((-sum(x * y for x, y in zip(a, v, strict=True)), i) for i, v in ok if i != q and len(v) == len(a))
        out += [(q, r, i, -s) for r, (s, i) in enumerate(scores[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("k, n", [(5, 300), (20, 12), (3, 2500)])
def test_topk(spark, k, n):
    rng = random.Random(k)
    rows = [(i, [round(rng.gauss(0, 1), 1) for _ in range(6)]) for i in range(n)]
    rows += [(n + 1, None), (n + 2, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (n + 3, [float("nan")] * 6), (n + 4, [float("inf")] * 6), (n + 5, [1.0] * 4), (None, [1.0] * 6)]
    rows += [(n + 6, rows[0][1]), (n + 7, rows[0][1])]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, score int").repartition(4)
    got = topk.top_k(df, F.col("id") % 20 == 0, k)
    assert sorted(tuple(r) for r in got.collect()) == plain_top(rows, k)


def test_topk_large_values_and_empty(spark):
    """Beyond the exact range of doubles the scores are integers all the same."""
    df = spark.createDataFrame([(0, [float(2**22), 1.0]), (1, [float(2**22), 2.0]), (2, [float(2**22), 3.0])], "vec_id long, embedding array<double>")
    big = 2**28 * 2**28
    assert sorted(tuple(r) for r in topk.top_k(df, F.col("id") == 0, 2).collect()) == [(0, 1, 2, big + 64 * 192), (0, 2, 1, big + 64 * 128)]
    assert topk.top_k(df.limit(0), F.col("id") % 20 == 0).count() == 0
    small = spark.createDataFrame([(0, [1.0]), (20, [2.0])], "vec_id long, embedding array<float>")
    assert sorted(tuple(r) for r in topk.top_k(small, F.col("id") % 20 == 0).collect()) == [(0, 1, 20, 8192), (20, 1, 0, 8192)]


def test_quality_held_out(spark):
    sf = "/root/testdata/sf0.1"
    got = {r["doc_id"]: r for r in QUERIES["op6_quality"](spark, sf).collect()}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    held = [(got[d]["score"], y, got[d]["predicted"]) for d, y in labels.items() if got[d]["held_out"]]
    assert all(got[d]["held_out"] == (zlib.crc32(str(d).encode()) % 4 == 2) for d in got)
    assert np.mean([p == y for _, y, p in held]) > 0.95
    scores, y = np.array([s for s, *_ in held]), np.array([y for _, y, _ in held])
    assert np.mean(scores[y == 1][:, None] > scores[y == 0][None, :]) > 0.97
    assert all(r["predicted"] == (r["score"] >= 0.7) and 0 <= r["score"] <= 1 for r in got.values())


def test_quality_odd(spark):
    docs = spark.createDataFrame([(1, None, 1), (1, "", 1), (None, "word", 2), (4, "x" * 200_000, 3), (5, "a b " * 60_000, 3)], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(1, 1, None), (1, 0, 0), (None, 1, 1), (9, None, 0)], "doc_id long, quality int, toxic int")
    assert quality.classify(docs, labels).count() == 5
    assert quality.classify(docs, labels.limit(0)).where("score between 0 and 1").count() == 5
    assert quality.classify(docs.limit(0), labels).count() == 0


def plain_risk(p, u, prior):
    """The risk from its definition, value by value."""
    loss = lambda z, y: math.log1p(math.exp(-z if y else z))
    mean = lambda v: sum(v) / len(v)
    negative = mean([loss(z, 0) for z in u]) - prior * mean([loss(z, 0) for z in p])
    return prior * mean([loss(z, 1) for z in p]) + max(0.0, negative), negative


@pytest.mark.parametrize("shift", [-1.0, 2.5])
def test_quality_risk(shift):
    """The value, and the gradient by differences: of the whole risk, or of the negative part, reversed, where that is below zero."""
    rng = np.random.default_rng(3)
    p, u, prior = rng.normal(shift, 1, 7), rng.normal(-abs(shift), 1, 9), 0.7
    value, gp, gu = quality.risk(p, u, prior)
    want, negative = plain_risk(p, u, prior)
    assert math.isclose(value, want)
    assert (negative < 0) == (shift > 0)
    target = (lambda a, b: plain_risk(a, b, prior)[0]) if negative >= 0 else (lambda a, b: -plain_risk(a, b, prior)[1])
    for z, g, other in ((p, gp, lambda x: target(x, u)), (u, gu, lambda x: target(p, x))):
        for i in range(len(z)):
            up, down = z.copy(), z.copy()
            up[i] += 1e-5
            down[i] -= 1e-5
            assert math.isclose((other(up) - other(down)) / 2e-5, g[i], rel_tol=1e-5, abs_tol=1e-9)


@pytest.mark.parametrize("share", [0.3, 0.6, 0.85])
def test_quality_prior(share):
    """The share of positives is found without a negative label."""
    rng = np.random.default_rng(int(share * 100))

    def made(n, good):
        x = rng.normal(0, 1, (n, len(quality.FEATURES)))
        x[:, :3] += np.where(good[:, None], 1.6, -1.6)
        return quality.Sample(x, np.zeros(0, np.int64), np.zeros(n, np.int64))

    found = quality.estimate_prior(made(3000, np.ones(3000, bool)), made(8000, rng.random(8000) < share))
    assert abs(found - share) < 0.08


def test_quality_sample(spark):
    """A cutoff on the id's hash: about as many ids as wanted, all rows of each, and the same ones however the rows lie."""
    rows = spark.range(0, 60_000).selectExpr("id % 20000 as doc_id", "cast(id as string) as text")
    got = quality.sample(rows, 1000)
    ids = {r[0] for r in got.select("doc_id").collect()}
    assert 850 < len(ids) < 1150 and got.count() == 3 * len(ids)
    assert {r[0] for r in quality.sample(rows.repartition(7), 1000).select("doc_id").collect()} == ids
    assert quality.sample(rows, 30_000).count() == 60_000
    one = quality._collect(spark.createDataFrame([(1, "b"), (1, "a"), (1, None), (2, "")], "doc_id long, text string"))
    assert len(one) == 2 and one.x[0].tolist() == quality.features(None)


def test_quality_words():
    text = " ".join(f"w{i}" for i in range(3000))
    words = quality.content(text)
    assert 200 < len(words) <= quality.DISTINCT and (words == quality.content(text + " W5 w9 ")).all()
    assert len(quality.content(None)) == 0 and quality.content("a A a b").tolist() == sorted(set(quality.content("b a").tolist()))
    some = quality.Sample.of([[0.0] * len(quality.FEATURES)] * 3, [np.arange(3), np.arange(0), np.arange(5, 7)])
    assert some.take(np.array([2, 0])).words.tolist() == [5, 6, 0, 1, 2]


def test_quality_all_words(spark, monkeypatch):
    """Every word of a long text has its weight in the score and in learning, however the memory is cut."""
    words = [f"w{i}" for i in range(3000)]
    assert quality.content(" ".join(words)).tolist() == sorted({zlib.crc32(w.encode()) % quality.WORDS for w in words})
    texts = [" ".join(words[:n]) for n in (0, 1, 511, 512, 560, 3000)]
    seen = quality._collect(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert seen.words.tolist() == [w for t in texts for w in quality.content(t)]
    model = quality.blank(seen.x, 0.5)
    for w in (words[7], words[1500], words[-1]):
        model.weights[:] = 0
        model.weights[len(model.edges) * (quality.BINS + 1) + zlib.crc32(w.encode()) % quality.WORDS] = 9
        assert quality.score(spark.createDataFrame([(1, texts[-1])], "doc_id long, text string"), model).first()["score"] > 0.51
    monkeypatch.setattr(quality, "LEAST_TEXTS", 1)
    whole = quality.train(seen, seen.take(np.array([3, 5])), 0.6, epochs=3)
    scores = whole.score(seen)
    monkeypatch.setattr(quality, "TOGETHER", 600)
    assert len(seen.parts(np.arange(6))) > 2
    assert np.allclose(quality.train(seen, seen.take(np.array([3, 5])), 0.6, epochs=3).weights, whole.weights) and np.allclose(whole.score(seen), scores)


def test_topk_prunes():
    """Full scores only for entries that a slice has handed in, and no product for entries whose norm can't reach the share."""
    rng = np.random.default_rng(9)
    queries = rng.integers(-50, 50, (8, 16))
    many = rng.integers(-3, 4, (4000, 16))
    many[::100] = rng.integers(-90, 90, (40, 16))
    qids, ids = np.arange(8) + 10_000, np.arange(4000)
    exact = queries @ many.T
    k = 5
    pair = topk.BlockPair(qids, queries, ids, many)
    cutoffs = np.array([s[k - 1] for s in pair.gather(k)], float)
    assert pair.scored <= 8 * 2 * k and (cutoffs <= np.sort(exact, axis=1)[:, -k]).all()
    before = pair.multiplied
    q, v, score = pair.resolve(cutoffs, k)
    assert pair.scored < 0.02 * exact.size and pair.multiplied - before < 0.1 * 2 * exact.size
    want = [(i, c, exact[i, c]) for i in range(8) for c in sorted(range(4000), key=lambda c: (-exact[i, c], c))[:k]]
    assert list(zip(q.tolist(), v.tolist(), score.tolist(), strict=True)) == want


def test_topk_repeated_rows(spark):
    """A candidate id that repeats counts each time; of vectors under one query id the smallest asks, and none is its own candidate."""
    rows = [(0, [1.0, 0.0]), (0, [2.0, 0.0]), (3, [1.0, 1.0]), (3, [1.0, 1.0]), (3, [4.0, 0.0]), (5, [-1.0, 0.0])]
    df = spark.createDataFrame(rows * 2, "vec_id long, embedding array<float>").repartition(3)
    got = sorted(tuple(r) for r in topk.top_k(df, F.col("id") % 20 == 0, 20).collect())
    assert got == [(0, r, i, s * 4096) for r, (i, s) in enumerate([(3, 4)] * 2 + [(3, 1)] * 4 + [(5, -1)] * 2, 1)]

"""Token store, personal data, byte-level BPE, decontamination and the pipeline against plain versions."""

import base64
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from strandlog.llm import byte_bpe, decontaminate, pii, token_store

SF = "/root/testdata/sf0.001"
ODD = [
    (1, "The cat's hat", "a", 1),
    (1, "The cat's hat", "a", 1),
    (None, "no id", "a", None),
    (3, None, None, 3),
    (4, "", "a", 3),
    (7, " \n\t", "a", 3),
    (6, "日本語 ½ Ⅷ \x85\x1c\u00a0x İstanbul ΑΣ <|endoftext|>", "a", 3),
    (5, "long text é " * 20_000, "a", 3),
]
COLUMNS = "doc_id long, text string, ids string, n_tokens int"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, COLUMNS).repartition(3)


# byte-level BPE


@pytest.fixture(scope="module")
def bpe():
    path, pattern = byte_bpe.default_vocabulary()
    ours = byte_bpe.load(path, pattern)
    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in open(path, "rb"))}
    return ours, tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def test_bpe_random(bpe):
    ours, library = bpe
    rng = random.Random(1)
    letters = "aaab bcé\x85\x1c\xa0 \n\t123²½'s'llñ日本語🙂 ́Ⅷ__--!!abcABCthereon"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(8000)]
    texts += ["a" * 3000, "ab" * 1500, "thth" * 900, " " * 3000 + "x", "日本" * 700, "ereren" * 700]
    for t in texts:
        ids = ours.encode(t)
        assert ids == np.array(library.encode_ordinary(t), "<u4").tobytes()
        assert ours.decode(ids) == t.encode()


def test_bpe_long(bpe):
    ours, _ = bpe
    for t in ("a" * 300_000, "ab" * 100_000):
        assert ours.decode(ours.encode(t)) == t.encode()


def test_bpe_rows(spark, odd, bpe):
    got = byte_bpe.encode(odd, *byte_bpe.default_vocabulary()).collect()
    assert len(got) == len(ODD)
    for r in got:
        texts = [t or "" for d, t, *_ in ODD if d == r["doc_id"]]
        assert bytes(r["decoded"]) == texts[0].encode() and r["n_tokens"] * 4 == len(r["ids"])
        assert len(texts[0]) > 1000 or bytes(r["ids"]) == np.array(bpe[1].encode_ordinary(texts[0]), "<u4").tobytes()
    assert byte_bpe.encode(odd.limit(0), *byte_bpe.default_vocabulary()).count() == 0


# token store


WORDS = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def words():
    return token_store.WordTokenizer(WORDS)


@pytest.fixture(scope="module")
def fresh():
    """The library as it is."""
    return Tokenizer.from_file(WORDS)


def test_words(words, fresh):
    rng = random.Random(2)
    letters = [*"aaab bcÀéß\x85\x1c\xa0\x00\x7f\xad \n\t123²½'s'llñ\"#µª·×÷__--!!abcABCΣ", "<|startoftext|>", "<|endoftext|>", "<|endof", "<|STARTOFTEXT|>"]
    for _ in range(4000):
        t = "".join(rng.choice(letters) for _ in range(rng.randint(0, 40)))
        assert np.frombuffer(words.encode(t), "<u4").tolist() == fresh.encode(t, add_special_tokens=False).ids
    assert words.words is not None
    assert np.frombuffer(words.encode("a <|startoftext|> b"), "<u4").tolist() == [320, 49406, 321]


def test_other_tokenizer_files(tmp_path, fresh):
    """A file that asks for something else than the known steps is left to the library."""
    import json

    config = json.loads(open(WORDS, encoding="utf-8").read())
    text = "It's a Cat-1 né"
    for change in ({"normalizer": {"type": "Lowercase"}}, {"pre_tokenizer": {"type": "Whitespace"}}):
        path = tmp_path / "other.json"
        path.write_text(json.dumps(config | change), encoding="utf-8")
        other = token_store.WordTokenizer(str(path))
        assert other.words is None
        assert np.frombuffer(other.encode(text), "<u4").tolist() == other.library.encode(text, add_special_tokens=False).ids
    config["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"] = "\\S+"
    (tmp_path / "split.json").write_text(json.dumps(config), encoding="utf-8")
    assert token_store.WordTokenizer(str(tmp_path / "split.json")).words is None


@pytest.mark.parametrize("high", [1, 200, 300, 70_000, 2**32 - 1])
def test_codes(high):
    ids = np.random.default_rng(high).integers(0, high, 5000).astype(np.uint32)
    codes = token_store.DacReader(token_store.DacWriter.pack(ids))
    assert len(codes) == 5000 and all(codes[i] == ids[i] for i in range(0, 5000, 37))
    for a, b in ((0, 5000), (777, 3333), (511, 513), (5, 5), (4999, 5000)):
        assert (codes.range(a, b) == ids[a:b]).all()
    docs, ends, read = token_store.open_block(token_store.pack_block([3, None, 9], [ids[:5], ids[5:5], ids[5:90]]))
    assert docs == [3, None, 9] and ends.tolist() == [0, 5, 5, 90] and (read.range(0, 90) == ids[:90]).all()
    with pytest.raises(ValueError):
        token_store.open_block(b"none")


def test_store(spark, odd, fresh, tmp_path):
    path = WORDS
    token_store.write(token_store.tokenize(odd, path), str(tmp_path / "t"))
    got = token_store.read(spark, str(tmp_path / "t")).orderBy("start").collect()
    want, start = [], 0
    coded = [(d, fresh.encode(t or "", add_special_tokens=False).ids + [1]) for d, t, *_ in ODD]
    for doc, ids in sorted(coded, key=lambda x: (x[0] is not None, x[0], x[1])):
        want.append((doc, start, len(ids), np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert [(r["doc_id"], r["start"], r["n_tokens"], bytes(r["ids"])) for r in got] == want
    crc = token_store.read(spark, str(tmp_path / "t"), crc=F.crc32("ids")).orderBy("start").collect()
    assert [r["crc"] for r in crc] == [zlib.crc32(w[3]) for w in want]
    token_store.write(token_store.tokenize(odd.limit(0), path), str(tmp_path / "e"))
    assert token_store.read(spark, str(tmp_path / "e")).count() == 0


def test_hot_ids(spark, fresh, tmp_path):
    """A null id and a repeated one with most of the rows are dealt over several ranges, and the file stays in order."""
    rows = [(None, f"none {i}") for i in range(300)] + [(7, f"seven {i}") for i in range(300)] + [(i, f"id {i}") for i in range(200)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    coded = token_store.tokenize(frame, WORDS).select("doc_id", "bucket").distinct().collect()
    assert len({r["bucket"] for r in coded if r["doc_id"] is None}) > 4 and len({r["bucket"] for r in coded if r["doc_id"] == 7}) > 4
    token_store.write(token_store.tokenize(frame, WORDS), str(tmp_path / "h"))
    got, at = token_store.read(spark, str(tmp_path / "h")).orderBy("start").collect(), 0
    assert [r["doc_id"] for r in got] == sorted((d for d, _ in rows), key=lambda d: (d is not None, d))
    for r in got:
        assert r["start"] == at
        at += r["n_tokens"]
    ids = lambda t: np.array([*fresh.encode(t, add_special_tokens=False).ids, 1], "<u4").tobytes()
    assert sorted(bytes(r["ids"]) for r in got) == sorted(ids(t) for _, t in rows)


# personal data


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def plain_spans(text):
    out = []
    patterns = (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
        ("card", r"[0-9]([\x20-]?[0-9])+"),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
    )
    for kind, pattern in patterns:
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "card" and not (13 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append((kind, m.start(), m.end()))
    return out


def test_pii(spark):
    rng = random.Random(5)
    some = ["@", ".", "a", "b", "1", "4", "7", "+", "-", " ", "(", ")", "_", "é", "0", "5", "255", "4111111111111111", "@a.b", "\n", "+1 "]
    texts = [None, "", "a@b.c_d@e.f", "1.2.3.4.5.6.7.8 999.1.2.3.4", "é4111-1111-1111-1111é +1 (988) 555-2485 x"]
    texts += ["".join(rng.choice(some) for _ in range(rng.randint(0, 60))) for _ in range(1500)]
    texts += ["".join(rng.choice("0123456789 -") for _ in range(rng.randint(0, 60))) for _ in range(1500)]
    texts += ["a" * 50_000, "1 " * 20_000, "a." * 20_000, "a@" + "b." * 20_000 + "c", "1." * 20_000, "+1" * 9_000, "1.2.3.4 " * 2_000]
    texts += ["pay DE89 3704 0044 0532 0130 00 now", "not DE89 3704 0044 0532 0130 01", "call 555-123-4567", "item 555-123-4567", "+1 555-123-4567"]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, pii string").repartition(8)
    found = pii.detect(df, out_col="found")
    rows = {r["doc_id"]: r for r in pii.digest(found, "found").join(found.select("doc_id", "text", "found", pii.mask(F.col("text"), F.col("found")).alias("masked")), "doc_id").collect()}
    base = ("email", "ip", "card", "phone")
    for i, text in enumerate(texts):
        r, want = rows[i], plain_spans(text or "")
        assert [(s["kind"], s["start"], s["end"]) for s in r["found"] if s["kind"] in base] == want
        assert [r[f"n_{k}"] for k in base] == [sum(w[0] == k for w in want) for k in base]
        assert r["base_sha256"] == hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in want).encode()).hexdigest()
        out, done = "", 0
        for kind, start, end in sorted(((s["kind"], s["start"], s["end"]) for s in r["found"]), key=lambda x: (x[1], -x[2], x[0])):
            if start >= done:
                out += text[done:start] + f"[{kind.upper()}]"
            done = max(done, end)
        assert r["masked"] == (None if text is None else out + text[done:])
    last = [rows[i]["spans"] for i in range(len(texts) - 5, len(texts))]
    assert last == ["iban:4:31", "", "localphone:5:17", "", "phone:0:15"]


def test_masked_rows(spark, odd):
    docs = spark.createDataFrame([(1, "me@x.org!", 9), (2, None, None), (3, "plain", 5)], "doc_id long, text string, n_chars long")
    assert [tuple(r) for r in pii.masked(docs).orderBy("doc_id").collect()] == [(1, "[EMAIL]!", 8), (2, None, None), (3, "plain", 5)]
    assert pii.masked(docs.limit(0)).count() == 0 and pii.masked(odd).columns == odd.columns


# decontamination


def plain_hits(docs, items, window=13):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    wins = {}
    for item, text in items:
        w = split(text)
        for i in range(max(1, len(w) - window + 1) if w else 0):
            wins.setdefault(tuple(w[i : i + window]), set()).add(str(item))
    out = []
    for doc, text in docs:
        w, hit, found = split(text), set(), set()
        for size in {len(k) for k in wins}:
            for i in range(len(w) - size + 1):
                got = wins.get(tuple(w[i : i + size]))
                if got:
                    hit.update(range(i, i + size))
                    found |= got
        out.append((doc, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return out


@pytest.mark.parametrize("block", [1 << 19, 200])
def test_decontaminate(spark, monkeypatch, block):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", block)
    rng = random.Random(3)
    vocabulary = ["a", "be", "the", "ÉTÉ", "x1", "of", "Thing", "日本"]
    text = lambda n: rng.choice([" ", "-", "\n", ". "]).join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, text(rng.choice([1, 3, 13, 14, 20, 30]))) for i in range(25)] + [(3, text(15)), (90, None), (91, ""), (92, "--"), (None, "the of")]
    docs = []
    for i in range(60):
        parts = [text(rng.randint(0, 30)) for _ in range(3)] + [t for _, t in rng.sample(items[:25], 2) if len(t) > 40]
        rng.shuffle(parts)
        docs.append((i if i % 9 else None, " ".join(parts)))
    docs += [(100, None), (101, ""), (5, docs[5][1]), (102, "the of " * 30_000)]
    frame = spark.createDataFrame([(d, t, "x", [1]) for d, t in docs], "doc_id long, text string, hits string, items array<int>").repartition(4)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = [tuple(r) for r in decontaminate.find_contamination(frame, bench).drop("items").collect()]
    key = lambda r: (r[0] is not None, *r)
    want = plain_hits(docs, [x for x in items if x[0] is not None])
    assert sorted(got, key=lambda r: str(key(r))) == sorted(want, key=lambda r: str(key(r)))
    kept = decontaminate.keep_clean(frame, bench)
    assert kept.columns == frame.columns and kept.count() == sum(not w[2] for w in want)
    assert decontaminate.find_contamination(frame.limit(0), bench).count() == 0
    assert decontaminate.keep_clean(frame, bench.limit(0)).count() == len(docs)


@pytest.mark.parametrize("block", [1 << 19, 600])
def test_clean_keeps_and_drops(spark, block):
    """One planted passage drops a document however long it is; texts that share less than a window stay."""
    rng = random.Random(11)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(500)]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(f"i{i}", text(40)) for i in range(12)]
    docs, planted = [], set()
    for i in range(90):
        body = text(rng.choice([5, 100, 3000, 20_000 if i % 30 == 0 else 900])).split()
        at, item = rng.randrange(len(body)), rng.choice(items)[1].split()
        if i % 3 == 0:  # a whole window
            planted.add(i)
            body[at:at] = item[4 : 4 + rng.randint(13, 30)]
        elif i % 3 == 1:  # one word short of a window
            body[at:at] = [*item[10:22], "zzz"]
        docs.append((i, " ".join(body), 7))
    frame = spark.createDataFrame(docs, "doc_id long, text string, _hit int").repartition(3)
    kept = decontaminate.keep_clean(frame, spark.createDataFrame(items, "item_id string, text string"), block_bytes=block)
    assert {r["doc_id"] for r in kept.collect()} == set(range(90)) - planted


def test_long_item_in_pieces():
    text = " ".join(f"w{i}" for i in range(400))
    whole, cut = decontaminate.item_windows([(1, text)]), decontaminate.item_windows([(1, p) for p in decontaminate._pieces(text, 300)])
    assert cut == whole and len(list(decontaminate._pieces(text, 300))) > 5


# pipeline


def test_pipeline(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "decontamination", "pii", "byte_bpe"]
    now = docs
    for name, stage in corpus_pipeline.STAGES:
        before, now = now, stage(spark, now, SF).cache()
        if name != "byte_bpe":
            assert now.columns == docs.columns
        else:
            assert now.count() == before.count()
    whole = corpus_pipeline.run(spark, SF)
    assert sorted(r["ids_sha256"] for r in whole.collect()) == sorted(r["ids_sha256"] for r in now.collect())
    assert 0.5 * docs.count() < whole.count() < docs.count()
    assert corpus_pipeline.language(spark, docs.limit(0), SF).count() == 0

"""Repeated-string removal against brute force."""

import hashlib
import random

import numpy as np
import pytest

from strandlog.llm import suffix_dedup


def brute(rows, length=100):
    """rows: (doc, text); unique docs. (n_bytes, n_removed, n_spans, kept) by doc."""
    seen, out = set(), {}
    for doc, text in sorted(rows, key=lambda r: (r[0] is not None, r[0])):
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - length + 1):
            s = raw[i : i + length]
            if s in seen:
                gone[i : i + length] = b"\1" * length
            seen.add(s)
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        runs = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out[doc] = (len(raw), sum(gone), runs, kept)
    return out


def corpus(seed, n=120):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefghié") for _ in range(rng.randint(1, 9))) for _ in range(60)]
    text = lambda k: " ".join(rng.choice(words) for _ in range(k))
    shared = [text(rng.randint(15, 80)) for _ in range(6)]
    rows = []
    for i in range(n):
        parts = []
        for _ in range(rng.randint(0, 4)):
            p = rng.choice(shared) if rng.random() < 0.5 else text(rng.randint(1, 60))
            if rng.random() < 0.3:
                at = rng.randrange(len(p))
                p = p[:at] + "X" + p[at + 1 :]
            parts.append(p)
        rows.append((i * 7 % n, " ".join(parts)))
    rows += [(n + 1, None), (n + 2, ""), (n + 3, "a" * 5000), (n + 4, "ab" * 800), (n + 5, "a" * 99), (n + 6, "a" * 100), (n + 7, "of " * 900), (None, shared[0])]
    return rows


@pytest.mark.parametrize("seed, frequent", [(1, 16), (2, 2), (3, 1)])
def test_against_brute_force(spark, monkeypatch, seed, frequent):
    monkeypatch.setattr(suffix_dedup, "FREQUENT", frequent)
    rows = corpus(seed)
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, kept string, key int").repartition(5)
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in suffix_dedup.remove_repeats(df).collect()}
    assert got == brute(rows)


def test_shared_ids_and_empty(spark):
    long = " ".join(hashlib.md5(str(i).encode()).hexdigest() for i in range(40))
    rows = [(5, long), (5, long), (5, "Y" + long), (9, long)]
    got = sorted((r["doc_id"], r["n_bytes"], r["n_removed"]) for r in suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    whole = len(long)
    assert got[3] == (9, whole, whole)
    assert [g for g in got if g[0] == 5 and g[1] == whole] in ([(5, whole, 0)] * 2, [(5, whole, whole)] * 2)
    assert suffix_dedup.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_target(spark):
    ids = [0, 1, -1, 5, 10**12, -(1 << 63), (1 << 63) - 1]
    want = [r[0] for r in spark.createDataFrame([(i, i // 3 - 1) for i in ids], "a long, b long").selectExpr("pmod(xxhash64(a, b), 13)").collect()]
    assert suffix_dedup.target(np.array(ids), np.array([i // 3 - 1 for i in ids]), 13).tolist() == want


def test_small_batches(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SORTED", 50)
    rng = np.random.default_rng(8)
    data, wanted = [], {n: [] for n, _ in suffix_dedup.WANTED}
    for i in range(60):
        text = bytes(rng.integers(97, 99, 3).astype(np.uint8)) * 40
        data.append(text[:119])
        for n, v in zip(wanted, (i % 4, i, 0, 0, 20, 0), strict=True):
            wanted[n].append(v)
    cols = {n: np.array(wanted[n]).astype(t) for n, t in suffix_dedup.WANTED}
    whole = suffix_dedup.resolve(cols, np.frombuffer(b"".join(data), np.uint8))
    row = [0, suffix_dedup.pack(cols, suffix_dedup.WANTED), b"".join(data)]
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([0]), *(pa.array([x]) for x in row)], ["bucket", "kind", "payload", "text"])
    out = list(suffix_dedup._resolve(1)([batch]))
    got = suffix_dedup.unpack(out[0].column("payload").to_pylist(), suffix_dedup.REPEAT)
    assert all((got[n] == whole[n]).all() for n, _ in suffix_dedup.REPEAT) and len(got["doc"])


def test_sorter():
    rng = np.random.default_rng(4)
    data = rng.integers(97, 99, 6000).astype(np.uint8)
    data[1000:1400] = data[3000:3400]
    suffix = rng.integers(0, 5800, 700)
    group = np.sort(rng.integers(0, 9, 700))
    order = suffix_dedup.SuffixSorter(data).sort(suffix, group)
    raw = data.tobytes()
    want = sorted(range(700), key=lambda i: (group[i], raw[suffix[i] : suffix[i] + 100]))
    assert order.tolist() == want


def test_long_text_in_pieces(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "CHUNK", 1 << 12)
    rng = random.Random(5)
    raw = bytes(rng.choice(b"abcd") for _ in range(30000))
    got = suffix_dedup.entries([(1, 0, raw)], None)
    assert got["n"].astype(int).sum() == len(raw) - 99


def test_many_texts_of_no_id(spark):
    """More texts under one id than 16 bits number; a null id comes before the smallest id there is."""
    long = " ".join(hashlib.md5(str(i).encode()).hexdigest() for i in range(8))
    rows = [(None, f"text {i}") for i in range(70_000)] + [(None, long), (-(1 << 63), long), (-(1 << 63), "x"), (3, long)]
    got = suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(6)).collect()
    assert len(got) == len(rows)
    texts = sorted((r["doc_id"] is not None, r["doc_id"], bytes(r["kept"])) for r in got if r["n_bytes"] != len(long))
    assert texts == sorted((d is not None, d, t.encode()) for d, t in rows if t != long)
    assert {r["doc_id"]: r["n_removed"] for r in got if r["n_bytes"] == len(long)} == {None: 0, -(1 << 63): len(long), 3: len(long)}


def test_frequent_over_all_documents(spark, monkeypatch):
    """A k-gram with many different spans is marked from the count over all tasks, however few one task sees."""
    monkeypatch.setattr(suffix_dedup, "FREQUENT", 150)
    rng = random.Random(6)
    noise = lambda n: "".join(rng.choice("abcdefghijklmnop") for _ in range(n))
    line = noise(60)
    frame = spark.createDataFrame([(i, noise(150) + (line if i % 2 else "") + noise(150)) for i in range(400)], "doc_id long, text string")
    marks = suffix_dedup._frequent(frame.repartition(40))
    key = suffix_dedup.entries([(0, 0, (noise(80) + line + noise(80)).encode())], None)["k"]
    assert marks is not None and marks[suffix_dedup.cell(key)].any() and marks.sum() < 40
    rows = [(r["doc_id"], r["text"]) for r in frame.collect()]
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in suffix_dedup.remove_repeats(frame.repartition(9)).collect()}
    assert got == brute(rows)


def test_equal_hashes_of_different_bytes():
    rng = np.random.default_rng(2)
    raw = rng.integers(97, 110, 2000).astype(np.uint8).tobytes()
    cols = suffix_dedup.entries([(1, 0, raw), (2, 0, raw)], None)
    half = len(cols["k"]) // 2
    both = np.frombuffer(raw + raw, np.uint8).copy()
    assert len(suffix_dedup.settle(suffix_dedup.tell_apart(dict(cols), both))[0]["k"]) == half
    both[3000] += 1  # now the bytes differ, as if hashes had met
    first, repeats = suffix_dedup.settle(suffix_dedup.tell_apart({n: v.copy() for n, v in cols.items()}, both))
    assert half < len(first["k"]) < half + 20
    starts, counts = repeats["start"].astype(int), repeats["n"].astype(int)
    assert not any(s <= 1000 < s + n + 99 for a, c in zip(starts, counts, strict=True) for s, n in ((a + i, 1) for i in range(c)))

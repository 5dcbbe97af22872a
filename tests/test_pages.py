"""Pages over ten fixed events, and against a plain walk of random ones."""

import random

import pytest

from strandlog.functions import scalars
from strandlog.operators.cursor import ASC, DESC, EVENTS, Args, CursorSpec, pages, paginate, walk
from strandlog.schema import EVENT, EVENT_COLUMNS

# fixed values: id, version, timestamp
GOLDEN = [
    ("01K14CFBVQ9DA4240RZ0V89PQS", 23, 1753567658),
    ("01K14CFR387QQCNT4GGGVBSAJV", 8, 1753567482),
    ("01K14C49SHZGXFVAKJJTJYQS70", 2, 1753567361),
    ("01K14C428V3TNC2K7DCFEJ4HV4", 1, 1753567001),
    ("01K14CFZJ0T1KJHBK5084C30BK", 52, 1753567690),
    ("01K14CAERY65HK16EWV7B0X9V6", 5, 1753567482),
    ("01K14CFJR0GZ18SD2F4J5DXEDD", 19, 1753567670),
    ("01K14CA43DENK9KM08REE27EE7", 3, 1753567361),
    ("01K14CFW3GNN366VM32YEGBT13", 88, 1753567680),
    ("01K14CAPNNDMVZH4RCDCW3WWPS", 5, 1753567482),
]


def event(id_, version, timestamp, subsec=0, kind="Message", name="MessageSent", key=None, agg="a"):
    row = {"id": id_, "aggregator_type": kind, "aggregator_id": agg, "version": version, "name": name, "routing_key": key, "data": "{}", "metadata": None, "timestamp": timestamp, "timestamp_subsec": subsec}
    return [row[c] for c in EVENT_COLUMNS]


@pytest.fixture(scope="module")
def golden(spark):
    return spark.createDataFrame([event(*g) for g in GOLDEN], EVENT).cache()


def at(i):
    return scalars.cursor_encode([GOLDEN[i][2], 0, GOLDEN[i][1], GOLDEN[i][0]])


CASES = [
    (ASC, Args.forward(10), [3, 2, 7, 5, 9, 1, 0, 6, 8, 4], False),
    (ASC, Args.forward(3), [3, 2, 7], True),
    (ASC, Args.forward(2, at(3)), [2, 7], True),
    (ASC, Args.forward(2, at(9)), [1, 0], True),
    (ASC, Args.forward(3, at(8)), [4], False),
    (DESC, Args.forward(3), [4, 8, 6], True),
    (DESC, Args.forward(2, at(3)), [], False),
    (DESC, Args.forward(2, at(9)), [5, 7], True),
    (ASC, Args.backward(3), [6, 8, 4], True),
    (ASC, Args.backward(2, at(4)), [6, 8], True),
    (ASC, Args.backward(2, at(2)), [3], False),
    (ASC, Args.backward(3, at(8)), [1, 0, 6], True),
    (DESC, Args.backward(3), [7, 2, 3], True),
    (DESC, Args.backward(2, at(4)), [], False),
    (DESC, Args.backward(2, at(2)), [5, 7], True),
    (DESC, Args.backward(3, at(8)), [4], False),
    (ASC, Args.forward(9), [3, 2, 7, 5, 9, 1, 0, 6, 8], True),  # exactly one row more than the page
]


@pytest.mark.parametrize("order, args, want, more", CASES)
def test_golden(golden, order, args, want, more):
    page = paginate(golden, args, order)
    assert [r["id"] for r in page.rows] == [GOLDEN[i][0] for i in want]
    info = page.info
    assert (info.has_previous_page if args.is_backward else info.has_next_page) == more
    assert not (info.has_next_page if args.is_backward else info.has_previous_page)
    edge = info.start_cursor if args.is_backward else info.end_cursor
    assert edge == (at(want[0 if args.is_backward else -1]) if want else None)
    assert [r["cursor"] for r in page.rows] == [at(i) for i in want]


def test_seconds_before_milliseconds(spark):
    """The canonical order compares seconds first."""
    df = spark.createDataFrame([event("a", 1, 10, 900), event("b", 2, 11, 100)], EVENT)
    assert [r["id"] for r in paginate(df).rows] == ["a", "b"]


def test_args():
    assert Args().size == 40 and not Args().is_backward
    assert Args(first=1, last=2).is_backward is False
    assert Args.forward(10).limit(5) == Args.forward(5) and Args().limit(7) == Args.forward(7)
    assert Args.backward(3, "x").limit(5) == Args.backward(3, "x")
    for bad in (-1, 65_535):
        with pytest.raises(ValueError):
            Args.forward(bad)
    for bad in ("%%%", "e30=", scalars.cursor_encode([1])):
        with pytest.raises(scalars.CursorError):
            scalars.cursor_decode(bad, 4)


@pytest.mark.parametrize("seed", range(3))
def test_random(spark, seed):
    rng = random.Random(seed)
    shared = [rng.randrange(60000) for _ in range(3)]
    rows = [event(f"{i:026d}", rng.randrange(9), rng.choice(shared) if rng.random() < 0.5 else rng.randrange(60000), rng.randrange(3)) for i in range(40)]
    df = spark.createDataFrame(rows, EVENT).cache()
    key = lambda r: (r["timestamp"], r["timestamp_subsec"], r["version"], r["id"])
    want = [r["id"] for r in sorted(df.collect(), key=key)]
    for order, ids in ((ASC, want), (DESC, want[::-1])):
        got = list(walk(df, 7, order))
        assert [r["id"] for p in got for r in p.rows] == ids and len(got) == 6
        placed = {r["id"]: r["page_no"] for r in pages(df, 7, order).collect()}
        assert placed == {i: n // 7 for n, i in enumerate(ids)}


def test_pushdown(golden, spark, tmp_path):
    golden.write.parquet(str(tmp_path / "e"))
    df = spark.read.parquet(str(tmp_path / "e"))
    spark.conf.set("spark.sql.maxMetadataStringLength", "4000")
    plan = df.where(EVENTS.beyond(at(9), False)).select("id")._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(timestamp" in plan and "Or(GreaterThan(timestamp" in plan
    top = paginate(df, Args.forward(3)).frame
    assert "TakeOrderedAndProject" in top._jdf.queryExecution().toString()


def test_mixed_directions(spark):
    df = spark.createDataFrame([(i % 3, i) for i in range(12)], "a int, b int")
    spec = CursorSpec(("-a", "b"))
    got = [(r["a"], r["b"]) for p in walk(df, 5, ASC, spec) for r in p.rows]
    assert got == sorted(((i % 3, i) for i in range(12)), key=lambda r: (-r[0], r[1]))


def test_pages_of_any_key(spark):
    """Ranges are of the full key: one value of the first part, and text, are dealt over many tasks all the same."""
    df = spark.range(5000).selectExpr("'same' as a", "lpad(cast(id * 7919 % 5000 as string), 6, '0') as b").repartition(3)
    spec = CursorSpec(("a", "-b"))
    got = pages(df, 300, ASC, spec)
    want = {b: n // 300 for n, b in enumerate(sorted((r["b"] for r in df.collect()), reverse=True))}
    assert {r["b"]: r["page_no"] for r in got.collect()} == want
    assert pages(df.limit(0), 3, ASC, spec).count() == 0


def test_cursor_values(spark):
    df = spark.createDataFrame([event(*g) for g in GOLDEN], EVENT).select("id", scalars.cursor_column().alias("cursor"))
    assert all(r["v"]["id"] == r["id"] and list(r["v"]) == scalars.cursor_decode(r["cursor"]) for r in df.select("id", "cursor", scalars.cursor_values(df["cursor"]).alias("v")).collect())
    odd = spark.createDataFrame([(None,), (scalars.cursor_encode([1]),), ("",)], "c string")
    assert [r["v"] for r in odd.select(scalars.cursor_values(odd["c"]).alias("v")).collect()] == [None] * 3

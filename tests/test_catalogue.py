"""Every catalogue query against its SQL, and what SQL can't say."""

import hashlib
import os

import duckdb
import pandas as pd
import pytest

from strandlog.operators import fold, relations
from strandlog.plans import catalogue, stored
from strandlog.schema import EVENT

SF = "/root/testdata/sf0.001"



@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL | stored.ORACLE_SQL))
def test_query(spark, duck, name):
    got = (catalogue.QUERIES | stored.QUERIES)[name](spark, SF).toPandas()
    want = duck.execute((catalogue.ORACLE_SQL | stored.ORACLE_SQL)[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    key = lambda r: tuple((v is None, str(type(v)) if v is None else "", v if v is not None else 0) for v in r)
    rows = [sorted((tuple(None if pd.isna(v) else v.item() if hasattr(v, "item") else v for v in r) for r in d[sorted(d.columns)].itertuples(index=False)), key=key) for d in (got, want)]
    assert rows[0] == rows[1]


def test_hash_ids(spark):
    for r in catalogue.hash_ids(spark, SF).join(catalogue._log(spark, SF), "id").head(20):
        assert r["hash"] == hashlib.sha3_256((r["aggregator_type"] + r["aggregator_id"]).encode()).hexdigest()


def test_folds_agree(spark):
    """The three strategies on one log; null values count as values, and an empty log folds to nothing."""
    from pyspark.sql import functions as F

    rows = [("a", "1"), ("b", None)]
    df = spark.createDataFrame([[f"e{i}", "t", "x", i + 1, n, None, v, None, 10 + i, 0] for i, (n, v) in enumerate(rows)], EVENT)
    assert fold.algebraic(df, v=fold.last(F.col("data"))).first()["v"] is None
    assert fold.algebraic(df, v=fold.first(F.col("data"))).first()["v"] == "1"
    empty = df.limit(0)
    assert fold.algebraic(empty, v=fold.last(F.col("data"))).count() == 0
    assert fold.ordered(empty, {"n": F.lit(0)}, lambda s, e: {"n": s["n"] + 1}, ()).count() == 0
    assert fold.ordered(df, {"n": F.lit(0)}, lambda s, e: {"n": s["n"] + 1}, ()).first()["n"] == 2
    assert relations.last_routing_key(df).first()[0] is None
    with pytest.raises(ValueError):
        relations.union()


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0


@pytest.mark.parametrize("cut", [0, 1704100000, 1705276800, 1706000000, 4000000000])
def test_snapshot_and_tail(spark, cut):
    """A fold resumed from snapshots at any cut is the full fold."""
    from pyspark.sql import functions as F

    events = catalogue._amounts(spark, SF)
    at = fold.algebraic(events.where(F.col("timestamp") < cut), fold.BY, at=fold.last(F.struct(*fold.EVENT_KEY)), held=F.sum("amount"))
    snapshots = at.select(*fold.BY, "held", *[F.col(f"at.{k}").alias(f"at_{k}") for k in fold.EVENT_KEY])
    tail = relations.after_cursor(events, snapshots).groupBy(*fold.BY).agg(F.sum("amount").alias("more"))
    both = snapshots.join(tail, list(fold.BY), "full").select("aggregator_id", (F.coalesce("held", F.lit(0)) + F.coalesce("more", F.lit(0))).alias("total"))
    want = events.groupBy("aggregator_id").agg(F.sum("amount").alias("total"))
    assert sorted(map(tuple, both.collect())) == sorted(map(tuple, want.collect()))


@pytest.mark.parametrize("name, pushed", [("scan_id", "EqualTo(aggregator_id,42)"), ("scan_event", "EqualTo(name,purchase)"), ("scan_id_event", "EqualTo(aggregator_id,7)"), ("scan_multi", "Or(")])
def test_scans_are_pushed_down(spark, name, pushed):
    """The registered scans prune partitions and push their filters into the scan of the stored log; nothing is shuffled."""
    was = spark.conf.get("spark.sql.maxMetadataStringLength")
    spark.conf.set("spark.sql.maxMetadataStringLength", "4000")
    try:
        plan = stored.QUERIES[name](spark, SF)._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
    finally:
        spark.conf.set("spark.sql.maxMetadataStringLength", was)
    assert "PartitionFilters: [" in plan and "aggregator_type" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert pushed in plan.split("PushedFilters: [")[1] and "Exchange" not in plan
    typed = stored.QUERIES["scan_type"](spark, SF)._jdf.queryExecution().toString()
    assert "app/User" in typed.split("PartitionFilters: [")[1]


def test_folds_keep_types_apart(spark):
    """Aggregates of two types with one id are two states."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame([[f"e{i}", t, "x", 1, "n", None, None, None, 10 + i, 0] for i, t in enumerate(("a", "b"))], EVENT)
    assert sorted(tuple(r) for r in fold.algebraic(df, n=F.count("*")).collect()) == [("a", "x", 1), ("b", "x", 1)]
    assert fold.custom(df, lambda s, e: s.update(n=1), "n long").count() == 2

"""Commits, conflicts, snapshots and composed stores."""

import json
import threading
import time

import pytest
from pyspark.sql import functions as F

from strandlog.functions import scalars
from strandlog.operators.cursor import Args
from strandlog.operators.filters import Read, RoutingKey
from strandlog.schema import EVENT_COLUMNS, Aggregate
from strandlog.sources import files
from strandlog.sources.store import EventStore, FrameStore, GroupStore, InvalidOriginalVersion, MissingData, ReadWriteStore, WriteError

THING = Aggregate("t/Thing", Made="n long", Changed="n long")


@pytest.fixture
def store(spark, tmp_path):
    return EventStore(spark, str(tmp_path / "store"))


def test_commit(store):
    assert store.version() == -1 and store.log().count() == 0
    a = store.create().routing_key("eu").routing_key("us").requested_by("me").metadata("k", "v").event(THING.Made, n=1).event(THING.Changed, n=2).commit()
    store.aggregate(a).original_version(2).routing_key("other").event(THING.Changed, n=3).commit()
    rows = store.read([Read("t/Thing", a)]).rows
    assert [(r["version"], r["name"], json.loads(r["data"]), r["routing_key"]) for r in rows] == [(1, "Made", {"n": 1}, "eu"), (2, "Changed", {"n": 2}, "eu"), (3, "Changed", {"n": 3}, "eu")]
    assert rows[0]["metadata"]["meta"] == {"requested_by": "me", "k": "v"} and rows[0]["timestamp"] == rows[1]["timestamp"]
    assert scalars.metadata_value(rows[0]["metadata"], "k") == "v"
    with pytest.raises(scalars.MetadataError):
        scalars.metadata_value(rows[0]["metadata"], "none")
    assert store.has_event(THING.Changed, a) and not store.has_event(THING.Changed, "x")
    assert store.scan(None, RoutingKey.value("eu")).count() == 3 and store.scan(None, RoutingKey.value(None)).count() == 0
    with pytest.raises(ValueError):
        store.scan([])


def test_rejected(store):
    a = store.create().event(THING.Made, n=1).commit()
    for bad in (0, ):
        with pytest.raises(InvalidOriginalVersion):
            store.aggregate(a).original_version(bad).event(THING.Changed, n=2).commit()
    with pytest.raises(MissingData):
        store.create().commit()
    with pytest.raises(MissingData):
        store.write([])
    row = store.read().rows[0].asDict()
    twice = [row | {"id": str(i), "version": 2} for i in range(2)]
    with pytest.raises(InvalidOriginalVersion):
        store.write(twice)
    with pytest.raises(WriteError):
        store.write([row | {"version": 70000}])
    with pytest.raises(InvalidOriginalVersion):
        store.write([row | {"version": 5}], strict=True)
    store.write([row | {"id": "2", "version": 2}, row | {"id": "3", "version": 3}], strict=True)
    store.write([row | {"id": "9", "version": 9}])  # gaps are fine unless strict
    assert store.log().count() == 4 and store.version() == 2
    assert store.conflicts(store.log().limit(2)).count() == 2
    with pytest.raises(WriteError):
        store.create().event(THING.Made, wrong=1)


def test_race(store, monkeypatch):
    """A writer that loses its number checks against the winner and tries again."""
    a = store.create().event(THING.Made, n=1).commit()
    publish, once = store._publish, []

    def slow(number, *rest):
        if not once:
            once.append(1)
            EventStore(store.spark, store.root).create().event(THING.Made, n=2).commit()
        return publish(number, *rest)

    monkeypatch.setattr(store, "_publish", slow)
    store.aggregate(a).original_version(1).event(THING.Changed, n=3).commit()
    assert store.version() == 2 and store.log().count() == 3
    once.clear()

    def stolen(number, *rest):
        if not once:
            once.append(1)
            EventStore(store.spark, store.root).aggregate(a).original_version(2).event(THING.Changed, n=5).commit()
        return publish(number, *rest)

    monkeypatch.setattr(store, "_publish", stolen)
    with pytest.raises(InvalidOriginalVersion):
        store.aggregate(a).original_version(2).event(THING.Changed, n=4).commit()


def test_concurrent(store):
    store.create().event(THING.Made, n=0).commit()
    errors = []

    def work(i):
        try:
            store.create().event(THING.Made, n=i).commit()
        except Exception as e:
            errors.append(e)

    threads = [threading.Thread(target=work, args=(i,)) for i in range(4)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert not errors and store.version() == 4 and store.log().count() == 5


def test_crash_and_compact(store):
    store.create().event(THING.Made, n=1).commit()
    store._save(store.log())  # data without a manifest
    assert store.log().count() == 1
    store.create().event(THING.Made, n=2).commit()
    before = sorted(r["id"] for r in store.log().collect())
    store.compact()
    assert sorted(r["id"] for r in store.log().collect()) == before
    store.create().event(THING.Made, n=3).commit()
    assert store.log().count() == 3


def test_partition_pruning(store):
    store.create().event(THING.Made, n=1).commit()
    plan = store.scan([Read("t/Thing", "x", "Made")])._jdf.queryExecution().toString()
    assert "PartitionFilters" in plan and "EqualTo(aggregator_id,x)" in plan


def test_snapshots(store):
    assert store.get_snapshot("t", "1", "a") is None
    schema = "aggregator_type string, aggregator_id string, revision string, cursor string, data string"
    store.save_snapshots(store.spark.createDataFrame([("t", "a", "1", "c", "d"), ("t", "b", "1", "c", "d")], schema))
    store.save_snapshots(store.spark.createDataFrame([("t", "a", "1", "c2", "d2"), ("t", "a", "2", "c3", "d3")], schema))
    assert store.get_snapshot("t", "1", "a") == ("d2", "c2") and store.get_snapshot("t", "2", "a") == ("d3", "c3")
    assert store.get_snapshot("t", "1", "b") == ("d", "c") and store.snapshots().count() == 3
    changed = {r["aggregator_id"] + r["revision"]: r["updated_at"] for r in store.snapshots().collect()}
    assert changed["a1"] is not None and changed["b1"] is None


def test_subscribers(store):
    assert store.get_cursor("k") is None and not store.is_running("k", "w")
    store.acknowledge("k", "c", 1)
    store.upsert_subscriber("k", "w")
    store.acknowledge("k", "c", 3)
    assert store.is_running("k", "w") and store.get_cursor("k") == "c"
    store.upsert_subscriber("k", "v")
    assert not store.is_running("k", "w") and store.is_running("k", "v") and store.get_cursor("k") == "c"
    store.enable("k", False)
    assert not store.is_running("k", "v")


def test_composed(spark, tmp_path):
    one, two = EventStore(spark, f"file://{tmp_path}/one"), EventStore(spark, str(tmp_path / "two"))
    group = GroupStore(one, two)
    ids = [group.create().event(THING.Made, n=1).commit(), two.create().event(THING.Made, n=2).commit()]
    assert one.log().count() == 1 and sorted(r["aggregator_id"] for r in group.read().rows) == sorted(ids)
    assert group.read(args=Args.forward(1)).info.has_next_page
    assert GroupStore(one, one).log().count() == 2
    with pytest.raises(ValueError):
        GroupStore()
    rw = ReadWriteStore(FrameStore(one.log()), two)
    rw.create().event(THING.Made, n=3).commit()
    assert rw.log().count() == 1 and two.log().count() == 2
    with pytest.raises(WriteError):
        FrameStore(one.log()).write([])


def test_ids():
    assert scalars.hash_ids(["ab", "c"]) == scalars.hash_ids(["a", "bc"]) and len(scalars.hash_ids(["x"])) == 64
    many = [scalars.ulid() for _ in range(2000)]
    assert many == sorted(many) and len(set(many)) == 2000 and {len(i) for i in many} == {26}


def test_hadoop_paths(spark, tmp_path, monkeypatch):
    """The same protocol through Hadoop's file system interface."""
    from strandlog.streaming.subscription import Subscription

    monkeypatch.setattr(files, "LOCAL", ("none",))
    store = EventStore(spark, f"file:{tmp_path}/h")
    assert store.files.local is None and store.version() == -1
    a = store.create().event(THING.Made, n=1).commit()
    store.aggregate(a).original_version(1).event(THING.Changed, n=2).commit()
    with pytest.raises(FileExistsError):
        store.files.create("log/" + "1".rjust(20, "0") + ".json", "{}")
    with pytest.raises(InvalidOriginalVersion):
        store.aggregate(a).original_version(1).event(THING.Changed, n=3).commit()
    store.upsert_subscriber("k", "w")
    store.acknowledge("k", "c", 1)
    store.upsert_subscriber("k", "v")
    assert store.get_cursor("k") == "c" and store.is_running("k", "v")
    seen = []
    Subscription(store, "s").on_all("t/Thing", lambda e: seen.append(e["version"]), each=True).execute()
    assert seen == [1, 2] and store.get_cursor("s")


def test_jdbc(spark, tmp_path):
    """Events in a relational database, here the embedded one that Spark brings along."""
    from pyspark.sql import functions as F

    from strandlog.sources.store import jdbc_store

    store = EventStore(spark, str(tmp_path / "s"))
    a = store.create().routing_key("eu").requested_by("me").event(THING.Made, n=1).event(THING.Changed, n=2).commit()
    url, driver = "jdbc:derby:memory:strandlog;create=true", "org.apache.derby.iapi.jdbc.AutoloadedDriver"
    flat = store.log().withColumn("metadata", F.to_json("metadata"))
    kinds = ", ".join(f"{c} VARCHAR(200)" for c in ("id", "aggregator_type", "aggregator_id", "name", "routing_key", "data", "metadata"))
    flat.write.format("jdbc").options(url=url, dbtable="event", driver=driver, createTableColumnTypes=kinds).save()
    other = jdbc_store(spark, url, driver=driver)
    rows = other.read([Read("t/Thing", a, "Changed")]).rows
    assert [(r["version"], r["metadata"]["meta"]) for r in rows] == [(2, {"requested_by": "me"})]
    assert other.read(args=Args.forward(1)).info.has_next_page
    assert other.scan(None, RoutingKey.value("eu")).count() == 2 and other.scan(None, RoutingKey.value(None)).count() == 0


def test_database(spark):
    """Writes, races for a version, snapshots and control rows in a relational database."""
    from strandlog.sources.database import JdbcStore

    store = JdbcStore(spark, "jdbc:derby:memory:writable;create=true", "org.apache.derby.iapi.jdbc.AutoloadedDriver", prefix="s_")
    store.create_tables()
    store.create_tables()
    a = store.create().routing_key("eu").requested_by("me").event(THING.Made, n=1).event(THING.Changed, n=2).commit()
    store.aggregate(a).original_version(2).routing_key("us").event(THING.Changed, n=3).commit(strict=True)
    rows = store.read([Read("t/Thing", a)]).rows
    assert [(r["version"], r["routing_key"], json.loads(r["data"])["n"]) for r in rows] == [(1, "eu", 1), (2, "eu", 2), (3, "eu", 3)]
    assert rows[0]["metadata"]["meta"] == {"requested_by": "me"} and store.has_event(THING.Made, a)
    for base, strict in ((0, False), (2, False), (1, True), (7, True)):
        with pytest.raises(InvalidOriginalVersion):
            store.aggregate(a).original_version(base).event(THING.Changed, n=9).event(THING.Changed, n=9).commit(strict)
    with pytest.raises(MissingData):
        store.write([])
    # many events at once, through a table of their own; a batch that conflicts leaves nothing behind
    many = store.log().where("version = 1").crossJoin(spark.range(50).withColumnRenamed("id", "k")).select(
        *[F.concat("id", F.lit("-"), "k").alias(c) if c in ("id", "aggregator_id") else F.col(c) for c in EVENT_COLUMNS]
    )
    assert store.write(many) == 50 and store.log().count() == 53
    again = many.withColumn("id", F.concat("id", F.lit("+"))).withColumn("version", F.when(F.col("aggregator_id").endswith("-7"), 1).otherwise(5))
    assert store.conflicts(again).count() == 1
    with pytest.raises(InvalidOriginalVersion):
        store.write(again)
    with pytest.raises(InvalidOriginalVersion):
        store.write(again.withColumn("version", F.lit(5)), strict=True)
    with pytest.raises(MissingData):
        store.write(many.limit(0))
    assert store.log().count() == 53
    with store._transaction() as connection:
        tables = connection.getMetaData().getTables(None, None, "%STAGE%", None)
        assert not tables.next()
    kind = "aggregator_type string, aggregator_id string, revision string, cursor string, data string"
    store.save_snapshots(spark.createDataFrame([("t", "x", "r", "c1", "d1"), ("t", "y", "r", "c1", "d1")], kind))
    store.save_snapshots(spark.createDataFrame([("t", "x", "r", "c2", "d" * 50_000), ("t", "x", "q", "c3", "d3")], kind))
    assert store.get_snapshot("t", "r", "x") == ("d" * 50_000, "c2") and store.get_snapshot("t", "r", "y") == ("d1", "c1")
    times = {(r["aggregator_id"], r["revision"]): r["updated_at"] is not None and r["updated_at"] >= r["created_at"] for r in store.snapshots().collect()}
    assert times == {("x", "r"): True, ("y", "r"): False, ("x", "q"): False} and store.get_snapshot("t", "r", "z") is None
    store.acknowledge("s", "nowhere", 1)
    assert store.get_cursor("s") is None and not store.is_running("s", "w1")
    store.upsert_subscriber("s", "w1")
    store.acknowledge("s", "here", 3, 20)
    store.acknowledge("s", "there", 2, 10)
    store.upsert_subscriber("s", "w2")
    assert store.subscriber("s") == {"key": "s", "worker_id": "w2", "cursor": "there", "lag_seconds": 2, "newest": 20, "enabled": True}
    assert store.is_running("s", "w2") and not store.is_running("s", "w1")
    store.enable("s", False)
    assert not store.is_running("s", "w2")


def test_written_state(store, monkeypatch):
    """A reader takes the last written state and reads only the manifests after it."""
    from strandlog.sources import store as module

    monkeypatch.setattr(module, "CHECKPOINT", 3)
    ids = [store.create().event(THING.Made, n=n).commit() for n in range(8)]
    assert store.files.names("state") == ["2".zfill(20) + ".json", "5".zfill(20) + ".json"]
    read, other = [], EventStore(store.spark, store.root)
    monkeypatch.setattr(other.files, "read", lambda name, whole=other.files.read: read.append(name) or whole(name))
    assert sorted(r["aggregator_id"] for r in other.log().collect()) == sorted(ids)
    assert read == ["state/" + "5".zfill(20) + ".json", *(f"log/{str(n).zfill(20)}.json" for n in (6, 7))]


@pytest.mark.parametrize("scheme", ["", "file:"])
def test_values(spark, tmp_path, scheme):
    """No change of a small value is lost, and a reader always finds one; on local paths and through Hadoop."""
    from strandlog.sources.files import Files

    files, root = Files(spark, f"{scheme}{tmp_path}/v"), f"{scheme}{tmp_path}/v"
    assert files.value("n") == (-1, None) and files.update("n", lambda old: None) is None
    missing, done = [], []

    def add():
        own = Files(spark, root)
        for _ in range(10):
            own.update("n", lambda old: str(int(old or 0) + 1))

    def look():
        own = Files(spark, root)
        while not done:
            if own.value("n")[1] is None and files.value("n")[0] > 0:
                missing.append(1)

    files.update("n", lambda old: "0")
    threads, reader = [threading.Thread(target=add) for _ in range(3)], threading.Thread(target=look)
    [t.start() for t in (*threads, reader)]
    [t.join() for t in threads]
    done.append(1)
    reader.join()
    assert files.value("n")[1] == "30" and not missing


@pytest.mark.parametrize("local", [True, False])
def test_old_versions(spark, tmp_path, monkeypatch, local):
    """A writer that read a version long since replaced doesn't get the next number; old versions go after a while; on local paths
    and through Hadoop."""
    if not local:
        monkeypatch.setattr(files, "LOCAL", ("none",))
    own = files.Files(spark, f"file:{tmp_path}/v")
    assert (own.local is not None) is local

    def slow(old):
        if old == "0":  # others change the value four times meanwhile
            for n in range(1, 5):
                own.update("n", lambda old, n=n: str(n))
        return old + "+"

    own.update("n", lambda old: "0")
    assert own.update("n", slow) == "4+" and own.value("n")[1] == "4+"
    with pytest.raises(FileExistsError):
        own.create(f"n/{own.names('n')[-1]}", "x")
    monkeypatch.setattr(files, "KEPT", 0.5)
    time.sleep(2)
    own.update("n", lambda old: "new")
    assert len(own.names("n")) == 2 and own.value("n")[1] == "new"


def test_concurrent_snapshots(store, monkeypatch):
    """Saves at one time are all kept, also while the folders are merged; one save writes its own rows only."""
    from strandlog.sources import store as module

    monkeypatch.setattr(module, "SNAPSHOT_FOLDERS", 3)
    schema = "aggregator_type string, aggregator_id string, revision string, cursor string, data string"
    save = lambda i: EventStore(store.spark, store.root).save_snapshots(store.spark.createDataFrame([("t", f"a{i % 5}", "1", f"c{i}", f"d{i}")], schema))
    threads = [threading.Thread(target=save, args=(i,)) for i in range(8)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    save(9)
    assert sorted(r["aggregator_id"] for r in store.snapshots().collect()) == [f"a{i}" for i in range(5)]
    assert store.get_snapshot("t", "1", "a4") == ("d9", "c9")
    store.merge_snapshots()
    assert store.get_snapshot("t", "1", "a4") == ("d9", "c9") and len(store._snapshot_folders()[1]) == 1
    row = next(r for r in store.snapshots().collect() if r["aggregator_id"] == "a4")
    assert row["updated_at"] >= row["created_at"]


def test_vacuum_and_replay(store):
    """Folders that are merged or were never published go; a subscription from the start still gets each commit."""
    from strandlog.streaming.subscription import Subscription

    a = store.create().event(THING.Made, n=1).commit()
    store.aggregate(a).original_version(1).event(THING.Changed, n=2).commit()
    orphan = store._save(store.log())
    store.compact()
    store.aggregate(a).original_version(2).event(THING.Changed, n=3).commit()
    assert store.vacuum() == []  # too young
    gone = store.vacuum(grace=0)
    assert len(gone) == 3 and f"data/{orphan}" in gone and len(store.files.names("data")) == 2
    store.compact()
    store.vacuum(grace=0)
    assert store.log().count() == 3 and len(store.files.names("data")) == 1
    seen = []
    Subscription(store, "s").chunk_size(1).on_all("t/Thing", lambda df: seen.append([r["version"] for r in df.collect()])).execute()
    assert seen == [[1], [2], [3]]


def test_schema_steps(store):
    """Folders of an earlier schema version are brought up to date on reading; those of an unknown one are refused."""
    from strandlog import schema

    store.create().event(THING.Made, n=1).commit()
    old = schema.upgrade(store.log(), schema.SCHEMA_VERSION, 1)
    assert old.first()["timestamp_subsec"] is None
    assert schema.upgrade(old, 1).first()["timestamp_subsec"] == 0
    folder = "commit=old"
    old.withColumn("aggregator_id", F.lit("old")).withColumn("origin", F.lit(folder)).write.partitionBy("aggregator_type").parquet(f"{store.root}/data/{folder}")
    store.files.create("log/" + "1".zfill(20) + ".json", json.dumps({"number": 1, "schema_version": 1, "adds": [folder], "replaces": [], "rewrite": False}))
    assert sorted((r["aggregator_id"] == "old", r["timestamp_subsec"] is not None) for r in store.log().collect()) == [(False, True), (True, True)]
    store.compact()
    assert store.log().count() == 2 and set(store._state()["folders"].values()) == {schema.SCHEMA_VERSION}
    with pytest.raises(schema.SchemaVersionError):
        schema.upgrade(old, 99)


def test_strict_commit(store):
    a = store.create().event(THING.Made, n=1).commit(strict=True)
    with pytest.raises(InvalidOriginalVersion):
        store.aggregate(a).original_version(5).event(THING.Changed, n=2).commit(strict=True)
    store.aggregate(a).original_version(5).event(THING.Changed, n=2).commit()
    assert sorted(r["version"] for r in store.log().collect()) == [1, 6]


def test_no_temporary_folder_on_a_cluster(spark, monkeypatch):
    from strandlog.sources import shared

    class Cluster:
        class sparkContext:
            master = "spark://host:7077"
            getCheckpointDir = staticmethod(lambda: None)

        class conf:
            get = staticmethod(lambda name, other=None: other)

    with pytest.raises(RuntimeError):
        shared.shared_dir(Cluster)
    path = shared.scratch(spark, "x")
    assert spark.sparkContext.applicationId in path and path != shared.scratch(spark, "x")

"""An append-only event store on Parquet with optimistic concurrency, and stores built from stores.

A commit writes its events as Parquet, then publishes a numbered manifest that names them. Numbers are taken exclusively, so
of two writers one publishes and the other looks at what was published and tries again. Readers see
published files only; a crash between the two steps leaves an unnamed folder, which `vacuum` removes.

Every CHECKPOINT commits the state of the manifests (which folders hold the log) is written down, so a reader takes that and the
few manifests after it. Each event keeps the folder of its commit as `origin`, so that commits can be followed one by one
after their folders have been merged into larger ones.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterable, Sequence
from contextlib import suppress
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandlog.functions.scalars import hash_ids, ulid
from strandlog.operators.cursor import ASC, Args, Page, paginate
from strandlog.operators.filters import Read, RoutingKey, scan
from strandlog.operators.relations import conflicts, union
from strandlog.schema import EVENT, EVENT_COLUMNS, IDENTITY, MAX_VERSION, SCHEMA_VERSION, SNAPSHOT, EventSpec, upgrade
from strandlog.sources.files import Files


#: Commits to so many aggregates at most are checked against these aggregates' rows only.
FEW = 500
#: Commits from one written state to the next, and snapshot folders that are merged into one.
CHECKPOINT, SNAPSHOT_FOLDERS = 64, 32
#: Folders that no reader can be using any more, in seconds.
GRACE = 86_400.0
#: Events as they are stored, with the folder of their commit.
STORED = T.StructType([*EVENT.fields, T.StructField("origin", T.StringType())])


class WriteError(Exception):
    """A commit that was not made."""


class InvalidOriginalVersion(WriteError):
    """The log, or the batch itself, has an event of that aggregate and version."""


class MissingData(WriteError):
    """A commit without events."""


class Store:
    """What every store can do. Reads are lazy DataFrames; writes and control rows go to `primary`."""

    spark: SparkSession

    def log(self) -> DataFrame:
        raise NotImplementedError

    @property
    def primary(self) -> EventStore:
        raise NotImplementedError

    def scan(self, reads: Sequence[Read] | None = None, routing: RoutingKey = RoutingKey.ALL) -> DataFrame:
        return scan(self.log(), reads, routing)

    def read(self, reads: Sequence[Read] | None = None, routing: RoutingKey = RoutingKey.ALL, args: Args = Args(), order: str = ASC) -> Page:
        return paginate(self.scan(reads, routing), args, order)

    def has_event(self, spec: EventSpec, aggregator_id: str) -> bool:
        return bool(self.scan([Read.event(spec, aggregator_id)]).select(F.lit(1)).head(1))

    def write(self, events: Sequence[dict] | DataFrame, strict: bool = False) -> int:
        return self.primary.write(events, strict)

    def snapshots(self) -> DataFrame:
        return self.primary.snapshots()

    def get_snapshot(self, aggregator_type: str, revision: str, aggregator_id: str) -> tuple[str, str] | None:
        """(data, cursor) of the aggregate's snapshot of that revision."""
        where = (F.col("aggregator_type") == aggregator_type) & (F.col("revision") == revision) & (F.col("aggregator_id") == aggregator_id)
        row = self.snapshots().where(where).select("data", "cursor").head(1)
        return tuple(row[0]) if row else None

    def save_snapshots(self, rows: DataFrame) -> None:
        self.primary.save_snapshots(rows)

    def get_cursor(self, key: str) -> str | None:
        row = self.primary.subscriber(key)
        return row and row["cursor"]

    def is_running(self, key: str, worker: str) -> bool:
        row = self.primary.subscriber(key)
        return bool(row and row["enabled"] and row["worker_id"] == worker)

    def upsert_subscriber(self, key: str, worker: str) -> None:
        self.primary.upsert_subscriber(key, worker)

    def acknowledge(self, key: str, cursor: str, lag_seconds: int, newest: int | None = None) -> None:
        self.primary.acknowledge(key, cursor, lag_seconds, newest)

    def create(self) -> Commit:
        """A commit for a new aggregate under a fresh id."""
        return Commit(self, ulid())

    def aggregate(self, *ids: str) -> Commit:
        """A commit for the aggregate of that id, or of the hash of several."""
        return Commit(self, ids[0] if len(ids) == 1 else hash_ids(ids))


class EventStore(Store):
    """The Parquet store. Data is partitioned by aggregator_type and sorted by aggregate and version within a file."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.files = spark, root.rstrip("/"), Files(spark, root)

    @property
    def primary(self) -> EventStore:
        return self

    # commits

    def _manifests(self, after: int = -1) -> list[dict]:
        return [json.loads(self.files.read(f"log/{n}")) for n in self.files.names("log") if int(n.removesuffix(".json")) > after]

    def _state(self) -> dict:
        """What the manifests add up to: number (the last one's), folders of the log with their schema versions, and merged (folder
        to the one that replaced it). Reads the last written state and the manifests after it."""
        names = self.files.names("state")
        state = json.loads(self.files.read(f"state/{names[-1]}")) if names else {"number": -1, "folders": {}, "merged": {}}
        for m in self._manifests(state["number"]):
            _apply(state, m)
        return state

    def _folders(self, manifests: Iterable[dict]) -> dict[str, int]:
        state = {"number": -1, "folders": {}, "merged": {}}
        for m in manifests:
            _apply(state, m)
        return state["folders"]

    def version(self) -> int:
        """The number of the last commit, -1 if there is none."""
        names = self.files.names("log")
        return int(names[-1].removesuffix(".json")) if names else -1

    def folders(self, names: dict[str, int] | Sequence[str]) -> DataFrame:
        """The events of data folders, brought to the schema version of today."""
        return self._read(names).select(*EVENT_COLUMNS)

    def _read(self, names: dict[str, int] | Sequence[str]) -> DataFrame:
        versions = names if isinstance(names, dict) else dict.fromkeys(names, SCHEMA_VERSION)
        out = None
        for version in sorted(set(versions.values())):
            at = f"{self.root}/data"
            paths = [f"{at}/{n}" for n, v in versions.items() if v == version]
            some = upgrade(self.spark.read.schema(STORED).option("basePath", at).parquet(*paths), version).select(*STORED.fieldNames())
            out = some if out is None else out.unionByName(some)
        return self.spark.createDataFrame([], STORED) if out is None else out

    def manifests(self, after: int) -> list[dict]:
        """The commits with a number above `after`, in order."""
        return self._manifests(after)

    def commits(self, names: Sequence[str], *extra: str) -> DataFrame:
        """The events of single commits, by their folders, wherever merging has put them. `origin` as an extra column is the folder."""
        columns = [*EVENT_COLUMNS, *extra]
        state, wanted = self._state(), {}
        for n in names:
            now = n
            while now in state["merged"]:
                now = state["merged"][now]
            wanted.setdefault(now, []).append(n)
        whole = [n for n, some in wanted.items() if some == [n]]
        out = self._read({n: state["folders"].get(n, SCHEMA_VERSION) for n in whole}).select(*columns)
        for now, some in wanted.items():
            if now not in whole:
                out = out.unionByName(self._read({now: state["folders"].get(now, SCHEMA_VERSION)}).where(F.col("origin").isin(some)).select(*columns))
        return out

    def log(self) -> DataFrame:
        return self.folders(self._state()["folders"])

    def _publish(self, number: int, adds: list[str], replaces: list[str], rewrite: bool) -> None:
        self.files.create(f"log/{number:020d}.json", json.dumps({"number": number, "schema_version": SCHEMA_VERSION, "adds": adds, "replaces": replaces, "rewrite": rewrite}))
        if number % CHECKPOINT == CHECKPOINT - 1:
            state = self._state()
            with suppress(FileExistsError):  # another writer has written the same
                self.files.create(f"state/{state['number']:020d}.json", json.dumps(state))
            for old in self.files.names("state")[:-2]:
                self.files.delete(f"state/{old}")

    def _save(self, events: DataFrame) -> str:
        folder = f"commit={uuid.uuid4().hex}"
        origin = F.col("origin") if "origin" in events.columns else F.lit(folder)
        stored = events.select(*EVENT_COLUMNS, origin.alias("origin")).sortWithinPartitions("aggregator_type", "aggregator_id", "version")
        stored.write.partitionBy("aggregator_type").parquet(f"{self.root}/data/{folder}")
        return folder

    def write(self, events: Sequence[dict] | DataFrame, strict: bool = False) -> int:
        """Appends events as one commit and returns its number.

        The identities (type, id, version) must be new to the log and differ within the batch; `strict` also wants versions
        to follow the aggregate's last one without gaps. Losing the race for a number leads to a check against the
        commits made since, and another try.
        """
        if not isinstance(events, DataFrame):
            if not events:
                raise MissingData("no events")
            events = self.spark.createDataFrame([[e.get(c) for c in EVENT_COLUMNS] for e in events], EVENT)
        folder = self._save(events)
        saved = self.folders([folder])
        if not saved.head(1):
            raise MissingData("no events")
        if saved.where(~F.col("version").between(0, MAX_VERSION)).head(1):
            raise WriteError(f"a version is not within 0 to {MAX_VERSION}")
        if saved.groupBy(*IDENTITY).count().where(F.col("count") > 1).head(1):
            raise InvalidOriginalVersion("the batch has an aggregate's version twice")
        state = self._state()
        new = state["folders"]
        while True:
            # every check but the first only looks at the commits since
            check_versions(saved, self.folders(state["folders"] if strict else new), strict)
            try:
                self._publish(state["number"] + 1, [folder], [], False)
                return state["number"] + 1
            except FileExistsError:
                since = self._manifests(state["number"])
                new = self._folders(since)
                for m in since:
                    _apply(state, m)

    def conflicts(self, batch: DataFrame) -> DataFrame:
        return conflicts(batch, self.log())

    def compact(self) -> int:
        """Rewrites all published files as one commit, in a few large files of today's schema version; subscriptions skip it."""
        state = self._state()
        number, folders = state["number"], state["folders"]
        if not folders:
            return number
        merged = self._save(self._read(folders).repartitionByRange("aggregator_type", "aggregator_id"))
        while True:
            try:
                self._publish(number + 1, [merged], list(folders), True)
                return number + 1
            except FileExistsError:
                number = self.version()

    def vacuum(self, grace: float = GRACE) -> list[str]:
        """Removes data and snapshot folders that no manifest names any more, or never did, once they are `grace` seconds old.

        Writers and readers must be done with a folder within that time.
        """
        gone = []
        for place, live in (("data", self._state()["folders"]), ("snapshots", self._snapshot_folders()[1])):
            for name in self.files.names(place):
                if name not in live and self.files.age(f"{place}/{name}") >= grace:
                    self.files.delete(f"{place}/{name}")
                    gone.append(f"{place}/{name}")
        return gone

    # snapshots: each save adds a folder; the latest row of a key counts, and now and then the folders are merged

    def _snapshot_folders(self) -> tuple[int, list[str]]:
        number, text = self.files.value("snapshot_state")
        return number, json.loads(text) if text else []

    def snapshots(self) -> DataFrame:
        out = self.spark.createDataFrame([], SNAPSHOT).withColumn("seq", F.lit(0))
        folders = self._snapshot_folders()[1]
        for seq, folder in enumerate(folders):
            some = self.spark.read.schema(SNAPSHOT).parquet(f"{self.root}/snapshots/{folder}").withColumn("seq", F.lit(seq))
            out = out.unionByName(some) if seq else some
        if len(folders) < 2:
            return out.drop("seq")
        key = ["aggregator_type", "aggregator_id", "revision"]
        latest = F.max_by(F.struct("cursor", "data"), "seq").alias("latest")
        again = (F.count("*") > 1) | (F.count("updated_at") > 0)
        rows = out.groupBy(*key).agg(latest, F.min("created_at").alias("created_at"), F.when(again, F.max(F.coalesce("updated_at", "created_at"))).alias("updated_at"))
        return rows.select(*key, "latest.cursor", "latest.data", "created_at", "updated_at")

    def save_snapshots(self, rows: DataFrame) -> None:
        """Inserts or replaces by (type, id, revision). rows: the snapshot columns but the times. Writes the rows given, no others."""
        key = ["aggregator_type", "aggregator_id", "revision"]
        folder = uuid.uuid4().hex
        made = rows.select(*key, "cursor", "data", F.current_timestamp().alias("created_at"), F.lit(None).cast("timestamp").alias("updated_at"))
        made.write.parquet(f"{self.root}/snapshots/{folder}")
        count = len(json.loads(self.files.update("snapshot_state", lambda old: json.dumps([*json.loads(old or "[]"), folder]))))
        if count > SNAPSHOT_FOLDERS:
            self.merge_snapshots()

    def merge_snapshots(self) -> None:
        """Rewrites the snapshots as one folder; folders saved meanwhile stay after it."""
        folders = self._snapshot_folders()[1]
        merged = uuid.uuid4().hex
        self.snapshots().write.parquet(f"{self.root}/snapshots/{merged}")

        def change(old: str | None) -> str | None:
            now = json.loads(old or "[]")
            return json.dumps([merged, *now[len(folders) :]]) if now[: len(folders)] == folders else None  # merged by another

        self.files.update("snapshot_state", change)

    # subscribers: a small value each

    def _subscriber_file(self, key: str) -> str:
        return f"subscribers/{hash_ids([key])}"

    def subscriber(self, key: str) -> dict | None:
        text = self.files.value(self._subscriber_file(key))[1]
        return json.loads(text) if text else None

    def _change(self, key: str, create: bool = False, **fields) -> None:
        def change(old: str | None) -> str | None:
            if old is None and not create:
                return None
            row = json.loads(old) if old else {"key": key, "cursor": None, "lag_seconds": 0, "enabled": True, "created_at": time.time()}
            if fields.get("newest") is None or fields["newest"] < (row.get("newest") or 0):
                fields.pop("newest", None)
            return json.dumps(row | fields | {"updated_at": time.time()})

        self.files.update(self._subscriber_file(key), change)

    def upsert_subscriber(self, key: str, worker: str) -> None:
        """Makes the worker the only active one; cursor and lag stay."""
        self._change(key, create=True, worker_id=worker)

    def acknowledge(self, key: str, cursor: str, lag_seconds: int, newest: int | None = None) -> None:
        """Does nothing where there is no such subscriber. `newest` is a time that events have reached; the latest one is kept."""
        self._change(key, cursor=cursor, lag_seconds=lag_seconds, newest=newest)

    def enable(self, key: str, enabled: bool = True) -> None:
        self._change(key, enabled=enabled)


def _apply(state: dict, manifest: dict) -> None:
    """Brings a state of the log one manifest further."""
    for gone in manifest["replaces"]:
        state["folders"].pop(gone, None)
        state["merged"][gone] = manifest["adds"][0]
    state["folders"] |= dict.fromkeys(manifest["adds"], manifest["schema_version"])
    state["number"] = manifest["number"]


def check_versions(batch: DataFrame, log: DataFrame, strict: bool) -> None:
    """Raises InvalidOriginalVersion if the log has an identity of the batch or, with `strict`, if versions don't follow its last ones."""
    types = [r[0] for r in batch.select("aggregator_type").distinct().collect()]
    log = log.where(F.col("aggregator_type").isin(types))  # reads those partitions only
    ids = [r[0] for r in batch.select("aggregator_id").distinct().limit(FEW + 1).collect()]
    if len(ids) <= FEW:  # row groups are sorted by aggregate, so a small commit reads few of them
        log = log.where(F.col("aggregator_id").isin(ids))
    if batch.join(log.select(*IDENTITY), list(IDENTITY), "left_semi").head(1):
        raise InvalidOriginalVersion("the log has an aggregate's version")
    if strict:
        last = log.groupBy(*IDENTITY[:2]).agg(F.max("version").alias("last"))
        sums = batch.groupBy(*IDENTITY[:2]).agg(F.min("version").alias("low"), F.max("version").alias("high"), F.count("*").alias("n"))
        follows = (F.col("low") == F.coalesce("last", F.lit(0)) + 1) & (F.col("high") == F.col("low") + F.col("n") - 1)
        if sums.join(last, list(IDENTITY[:2]), "left").where(~follows).head(1):
            raise InvalidOriginalVersion("versions don't follow the last one")


class GroupStore(Store):
    """Several stores read as one; duplicates stay, and pages are cut from the whole. Writes go to the first."""

    def __init__(self, *stores: Store):
        if not stores:
            raise ValueError("an empty group")
        self.stores, self.spark = stores, stores[0].spark

    @property
    def primary(self) -> EventStore:
        return self.stores[0].primary

    def log(self) -> DataFrame:
        return union(*(s.log() for s in self.stores))


class ReadWriteStore(Store):
    """Events, cursors and snapshots are read from a replica, which may be behind; writes go to the primary."""

    def __init__(self, reader: Store, writer: Store):
        self.reader, self.writer, self.spark = reader, writer, writer.spark

    @property
    def primary(self) -> EventStore:
        return self.writer.primary

    def log(self) -> DataFrame:
        return self.reader.log()

    def snapshots(self) -> DataFrame:
        return self.reader.snapshots()

    def get_cursor(self, key: str) -> str | None:
        return self.reader.get_cursor(key)

    def is_running(self, key: str, worker: str) -> bool:
        return self.reader.is_running(key, worker)


class FrameStore(Store):
    """Any DataFrame with the event columns as a read-only store: a table of a database read over JDBC, a temporary view, rows in memory."""

    def __init__(self, frame: DataFrame):
        self.frame, self.spark = frame.select(*EVENT_COLUMNS), frame.sparkSession

    @property
    def primary(self) -> EventStore:
        raise WriteError("a read-only store")

    def log(self) -> DataFrame:
        return self.frame


def jdbc_store(spark: SparkSession, url: str, table: str = "event", **options: str) -> FrameStore:
    """Events in a relational database (its driver must be on Spark's class path); filters are pushed into the database.

    Payload and metadata must be JSON text there.
    """
    rows = spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()
    meta = F.from_json(F.col("metadata").cast("string"), EVENT["metadata"].dataType)
    return FrameStore(rows.withColumn("metadata", meta).select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in EVENT]))


@dataclass(frozen=True)
class Commit:
    """Builds one atomic append to an aggregate. Every method returns a changed copy."""

    store: Store
    aggregator_id: str
    base: int = 0
    key: tuple[str | None] | None = None
    meta: dict[str, str] = field(default_factory=dict)
    aggregator_type: str | None = None
    events: tuple[tuple[str, str], ...] = ()

    def original_version(self, version: int) -> Commit:
        """The version the aggregate is expected to have; 0, the default, expects a new one."""
        return replace(self, base=version)

    def routing_key(self, key: str | None) -> Commit:
        """The first call counts; an aggregate that has events keeps the key of its first one."""
        return self if self.key is not None else replace(self, key=(key,))

    def metadata(self, key: str, value: str) -> Commit:
        return replace(self, meta=self.meta | {key: value})

    def metadata_from(self, meta: dict[str, str]) -> Commit:
        return replace(self, meta=dict(meta))

    def requested_by(self, who: str) -> Commit:
        return self.metadata("requested_by", who)

    def requested_as(self, who: str) -> Commit:
        return self.metadata("requested_as", who)

    def event(self, spec: EventSpec, **payload) -> Commit:
        if self.aggregator_type not in (None, spec.aggregator_type):
            raise WriteError("events of different aggregates in one commit")
        unknown = set(payload) - set(spec.schema.fieldNames())
        if unknown:
            raise WriteError(f"{spec.name} has no {', '.join(sorted(unknown))}")
        return replace(self, aggregator_type=spec.aggregator_type, events=(*self.events, (spec.name, json.dumps(payload))))

    def commit(self, strict: bool = False) -> str:
        """Writes the events, with versions from the base on and one time, and returns the aggregate's id. `strict` wants the base to be
        the aggregate's last version, not just free."""
        if not self.events:
            raise MissingData("no events")
        first = self.store.read([Read(self.aggregator_type, self.aggregator_id)], args=Args.forward(1)).rows
        routing = first[0]["routing_key"] if first else (self.key[0] if self.key else None)
        now = time.time_ns() // 1_000_000
        common = {"aggregator_type": self.aggregator_type, "aggregator_id": self.aggregator_id, "routing_key": routing, "timestamp": now // 1000, "timestamp_subsec": now % 1000}
        rows = []
        for n, (name, data) in enumerate(self.events, 1):
            rows.append(common | {"id": ulid(), "version": self.base + n, "name": name, "data": data, "metadata": (ulid(), self.meta)})
        self.store.write(rows, strict)
        return self.aggregator_id

"""An event store in a relational database, over JDBC (its driver must be on Spark's class path).

Reads are DataFrames whose filters the database takes; large writes go through Spark into a table of their own first, whose
rows one transaction then moves, so a commit is seen as a whole or not at all. The database's keys keep versions unique.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable, Sequence
from contextlib import contextmanager, suppress

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlog.operators.relations import conflicts
from strandlog.schema import EVENT, EVENT_COLUMNS, IDENTITY, MAX_VERSION, SNAPSHOT
from strandlog.sources.store import InvalidOriginalVersion, MissingData, Store, WriteError, check_versions

#: The type of long texts by the kind of database; CLOB elsewhere.
TEXT = {"postgresql": "TEXT", "mysql": "LONGTEXT", "mariadb": "LONGTEXT", "sqlite": "TEXT"}
NAME = "VARCHAR(190)"
SNAPSHOT_KEY = ("aggregator_type", "aggregator_id", "revision")


class JdbcStore(Store):
    """Events, snapshots and control rows in three tables. Subscriptions need a log of commits and can't follow this store."""

    def __init__(self, spark: SparkSession, url: str, driver: str, prefix: str = "", read: dict[str, str] | None = None, **options: str):
        """`options`: user, password and what else the connection takes; `read`: more options for reading the events, like
        partitionColumn, lowerBound, upperBound and numPartitions."""
        self.spark, self.url, self.driver, self.prefix = spark, url, driver, prefix
        self.options, self.reading = options, read or {}

    @property
    def primary(self) -> JdbcStore:
        return self

    # connections

    @contextmanager
    def _transaction(self):
        """A connection whose changes are committed at the end, or rolled back on an error."""
        jvm = self.spark._jvm
        properties = jvm.java.util.Properties()
        for name, value in self.options.items():
            properties.setProperty(name, value)
        loader = jvm.java.lang.Thread.currentThread().getContextClassLoader()
        connection = loader.loadClass(self.driver).newInstance().connect(self.url, properties)
        if connection is None:
            raise ValueError(f"{self.driver} doesn't take {self.url.split(':', 2)[1]} addresses")
        try:
            connection.setAutoCommit(False)
            yield connection
            connection.commit()
        except BaseException:
            connection.rollback()
            raise
        finally:
            connection.close()

    def _named(self, connection, names: Iterable[str], of: str = "") -> list[str]:
        mark = connection.getMetaData().getIdentifierQuoteString().strip()
        return [f"{of}{mark}{n}{mark}" for n in names]

    def _change(self, connection, sql: str, *rows: Sequence) -> int:
        """Runs the statement once for each row of values; returns how many rows of the table it changed."""
        statement = connection.prepareStatement(sql)
        try:
            for row in rows or [()]:
                for at, value in enumerate(row, 1):
                    if isinstance(value, bool):
                        statement.setBoolean(at, value)
                    elif isinstance(value, int):
                        statement.setLong(at, value)
                    else:
                        statement.setString(at, value)
                statement.addBatch()
            return sum(statement.executeBatch())
        finally:
            statement.close()

    def create_tables(self) -> None:
        """Makes the tables; those that there are stay as they are."""
        text = TEXT.get(self.url.split(":")[1], "CLOB")
        kinds = {"string": NAME, "int": "INTEGER", "bigint": "BIGINT", "timestamp": "TIMESTAMP", "boolean": "BOOLEAN"}
        tables: dict[str, tuple[dict[str, str], list[Sequence[str]]]] = {
            "event": ({f.name: kinds.get(f.dataType.simpleString(), text) for f in EVENT} | {"data": text}, [("id",), IDENTITY]),
            "snapshot": ({f.name: kinds[f.dataType.simpleString()] for f in SNAPSHOT} | {"cursor": text, "data": text}, [SNAPSHOT_KEY]),
            "subscriber": ({"key": NAME, "worker_id": NAME, "cursor": text, "lag_seconds": "BIGINT", "newest": "BIGINT", "enabled": "BOOLEAN", "created_at": "TIMESTAMP", "updated_at": "TIMESTAMP"}, [("key",)]),
        }
        for table, (columns, keys) in tables.items():
            with self._transaction() as connection:
                if self._has(connection, self.prefix + table):
                    continue
                needed = {c for key in keys for c in key}
                parts = [f"{quoted} {kind}{' NOT NULL' if c in needed else ''}" for (c, kind), quoted in zip(columns.items(), self._named(connection, columns), strict=True)]
                parts += [f"{'UNIQUE' if n else 'PRIMARY KEY'} ({', '.join(self._named(connection, key))})" for n, key in enumerate(keys)]
                self._change(connection, f"CREATE TABLE {self.prefix}{table} ({', '.join(parts)})")

    def _has(self, connection, table: str) -> bool:
        data = connection.getMetaData()
        return any(data.getTables(None, None, name, None).next() for name in {table, table.upper(), table.lower()})

    def _frame(self, table: str, **options: str) -> DataFrame:
        return self.spark.read.format("jdbc").options(url=self.url, driver=self.driver, dbtable=self.prefix + table, **self.options, **options).load()

    @contextmanager
    def _staged(self, rows: DataFrame, names: Sequence[str]):
        """The rows in a table of their own, which is dropped at the end. `names`: columns that are names, not long texts."""
        table = f"{self.prefix}stage_{uuid.uuid4().hex}"
        kinds = ", ".join(f"{n} {NAME}" for n in names)
        try:
            rows.write.format("jdbc").options(url=self.url, driver=self.driver, dbtable=table, createTableColumnTypes=kinds, **self.options).save()
            yield table
        finally:
            with suppress(Py4JJavaError), self._transaction() as connection:
                self._change(connection, f"DROP TABLE {table}")

    # events

    def log(self) -> DataFrame:
        meta = F.from_json(F.col("metadata").cast("string"), EVENT["metadata"].dataType)
        rows = self._frame("event", **self.reading).withColumn("metadata", meta)
        return rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in EVENT])

    def conflicts(self, batch: DataFrame) -> DataFrame:
        return conflicts(batch, self.log())

    def write(self, events: Sequence[dict] | DataFrame, strict: bool = False) -> int:
        """Appends events in one transaction and returns how many. Errors and `strict` as in `EventStore.write`; but of two writers at
        once, one that isn't strict may leave a gap that the other's check didn't see."""
        listed = not isinstance(events, DataFrame)
        if listed:
            if not events:
                raise MissingData("no events")
            if not all(0 <= e["version"] <= MAX_VERSION for e in events):
                raise WriteError(f"a version is not within 0 to {MAX_VERSION}")
            if strict:
                check_versions(self.spark.createDataFrame([[e.get(c) for c in EVENT_COLUMNS] for e in events], EVENT), self.log(), True)
            rows = [[_text(e.get(c)) if c == "metadata" else e.get(c) for c in EVENT_COLUMNS] for e in events]
            return self._insert(lambda c, columns: self._change(c, f"INSERT INTO {self.prefix}event ({columns}) VALUES ({', '.join('?' * len(EVENT_COLUMNS))})", *rows), len(rows))
        names = [f.name for f in EVENT if f.dataType.simpleString() == "string" and f.name != "data"]
        with self._staged(events.select(*[F.to_json(c).alias(c) if c == "metadata" else F.col(c) for c in EVENT_COLUMNS]), names) as table:
            # what was staged is checked, as the frame itself might give other rows when it is computed again
            staged = self._frame(table.removeprefix(self.prefix))
            n, low, high = staged.agg(F.count("*"), F.min("version"), F.max("version")).first()
            if not n:
                raise MissingData("no events")
            if low < 0 or high > MAX_VERSION:
                raise WriteError(f"a version is not within 0 to {MAX_VERSION}")
            if strict:
                check_versions(staged, self.log(), True)
            return self._insert(lambda c, columns: self._change(c, f"INSERT INTO {self.prefix}event ({columns}) SELECT {columns} FROM {table}"), n)

    def _insert(self, run: Callable, n: int) -> int:
        try:
            with self._transaction() as connection:
                run(connection, ", ".join(self._named(connection, EVENT_COLUMNS)))
        except Py4JJavaError as error:
            if _taken(error):
                raise InvalidOriginalVersion("the log, or the batch itself, has an aggregate's version") from error
            raise
        return n

    # snapshots

    def snapshots(self) -> DataFrame:
        return self._frame("snapshot").select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in SNAPSHOT])

    def save_snapshots(self, rows: DataFrame) -> None:
        """Inserts or replaces by (type, id, revision), all in one transaction. rows: the snapshot columns but the times."""
        with self._staged(rows.select(*SNAPSHOT_KEY, "cursor", "data"), SNAPSHOT_KEY) as stage, self._transaction() as connection:
            table, (cursor, data, made, changed) = f"{self.prefix}snapshot", self._named(connection, ("cursor", "data", "created_at", "updated_at"))
            keys, here, there = (self._named(connection, SNAPSHOT_KEY, of) for of in ("", f"{table}.", "s."))
            given = f"FROM {stage} s WHERE {' AND '.join(f'{a} = {b}' for a, b in zip(here, there, strict=True))}"
            self._change(connection, f"UPDATE {table} SET {cursor} = (SELECT s.{cursor} {given}), {data} = (SELECT s.{data} {given}), {changed} = CURRENT_TIMESTAMP WHERE EXISTS (SELECT 1 {given})")
            held = f"SELECT 1 FROM {table} WHERE {' AND '.join(f'{a} = {b}' for a, b in zip(here, there, strict=True))}"
            self._change(connection, f"INSERT INTO {table} ({', '.join(keys)}, {cursor}, {data}, {made}) SELECT {', '.join(there)}, s.{cursor}, s.{data}, CURRENT_TIMESTAMP FROM {stage} s WHERE NOT EXISTS ({held})")

    # control rows

    def subscriber(self, key: str) -> dict | None:
        columns = ("worker_id", "cursor", "lag_seconds", "newest", "enabled")
        row = self._frame("subscriber").where(F.col("key") == key).select(*columns).head(1)
        return {"key": key, **row[0].asDict()} if row else None

    def _update(self, key: str, fields: dict) -> int:
        with self._transaction() as connection:
            sets = [f"{c} = ?" for c in self._named(connection, fields)] + [f"{c} = CURRENT_TIMESTAMP" for c in self._named(connection, ["updated_at"])]
            return self._change(connection, f"UPDATE {self.prefix}subscriber SET {', '.join(sets)} WHERE {self._named(connection, ['key'])[0]} = ?", [*fields.values(), key])

    def upsert_subscriber(self, key: str, worker: str) -> None:
        """Makes the worker the only active one; cursor and lag stay."""
        if self._update(key, {"worker_id": worker}):
            return
        try:
            with self._transaction() as connection:
                columns = self._named(connection, ("key", "worker_id", "lag_seconds", "enabled", "created_at"))
                self._change(connection, f"INSERT INTO {self.prefix}subscriber ({', '.join(columns)}) VALUES (?, ?, 0, ?, CURRENT_TIMESTAMP)", [key, worker, True])
        except Py4JJavaError as error:
            if not _taken(error):
                raise
            self._update(key, {"worker_id": worker})  # another worker made the row meanwhile

    def acknowledge(self, key: str, cursor: str, lag_seconds: int, newest: int | None = None) -> None:
        """Does nothing where there is no such subscriber. `newest` is a time that events have reached; the latest one is kept."""
        self._update(key, {"cursor": cursor, "lag_seconds": lag_seconds})
        if newest is not None:
            with self._transaction() as connection:
                at, named = self._named(connection, ("newest", "key"))
                self._change(connection, f"UPDATE {self.prefix}subscriber SET {at} = ? WHERE {named} = ? AND ({at} IS NULL OR {at} < ?)", [newest, key, newest])

    def enable(self, key: str, enabled: bool = True) -> None:
        self._update(key, {"enabled": enabled})


def _text(metadata: tuple | dict | None) -> str | None:
    """Metadata, a pair of id and values, as JSON."""
    if metadata is None:
        return None
    made = metadata if isinstance(metadata, dict) else dict(zip(("id", "meta"), metadata, strict=True))
    return json.dumps({k: v for k, v in made.items() if v is not None})


def _taken(error: Py4JJavaError) -> bool:
    """Whether a unique key was violated: SQL states of class 23, of the error or of those linked to it."""
    now = error.java_exception
    while now is not None and hasattr(now, "getSQLState"):
        with suppress(Exception):
            if (now.getSQLState() or "").startswith("23"):
                return True
        now = now.getNextException()
    return False

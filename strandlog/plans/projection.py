"""Projections: handlers that build a state from events, for one aggregate, some, or all.

A projection is written either as Python handlers, called event by event, or as columns: aggregates over an aggregate's events,
which stay in the JVM for any number of aggregates.
"""

from __future__ import annotations

import copy
import json
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandlog.functions.scalars import cursor_column
from strandlog.operators import fold, relations
from strandlog.operators.cursor import EVENTS
from strandlog.operators.filters import Read
from strandlog.plans.context import Context
from strandlog.schema import EVENT_KEY, EventSpec
from strandlog.sources.store import Commit, Store

Handler = Callable[..., None]
#: (state, version, cursor) of a snapshot.
Held = tuple[dict, int, str]


class NoHandler(Exception):
    """A strict projection or subscription met an event that nothing handles."""


class Snapshots:
    """Where a projection's snapshots are kept. Subclasses decide how; this one keeps none."""

    def restore(self, projection: Projection, store: Store, aggregator_id: str) -> Held | None:
        return None

    def take(self, projection: Projection, store: Store, aggregator_id: str, held: Held) -> None:
        pass


class StoreSnapshots(Snapshots):
    """Kept by the store, as JSON, under the projection's revision."""

    def restore(self, projection: Projection, store: Store, aggregator_id: str) -> Held | None:
        saved = store.get_snapshot(projection.aggregator_type, projection.revision, aggregator_id)
        if saved is None:
            return None
        held = json.loads(saved[0])
        return held["state"], held["version"], saved[1]

    def take(self, projection: Projection, store: Store, aggregator_id: str, held: Held) -> None:
        row = (projection.aggregator_type, aggregator_id, projection.revision, held[2], json.dumps({"state": held[0], "version": held[1]}))
        store.save_snapshots(store.spark.createDataFrame([row], "aggregator_type string, aggregator_id string, revision string, cursor string, data string"))


class MemorySnapshots(Snapshots):
    """Kept in this process, by revision too; a revision of none is one as well."""

    def __init__(self):
        self.held: dict[tuple, Held] = {}

    def restore(self, projection: Projection, store: Store, aggregator_id: str) -> Held | None:
        return copy.deepcopy(self.held.get((projection.aggregator_type, projection.revision, aggregator_id)))

    def take(self, projection: Projection, store: Store, aggregator_id: str, held: Held) -> None:
        self.held[projection.aggregator_type, projection.revision, aggregator_id] = copy.deepcopy(held)


@dataclass
class Loaded:
    """A state with where it stands. `version` is that of the root aggregate's last event."""

    id: str
    aggregator_type: str
    state: dict[str, Any]
    version: int
    cursor: str
    store: Store = field(repr=False)

    def __getattr__(self, name: str) -> Any:
        try:
            return self.__dict__["state"][name]
        except KeyError:
            raise AttributeError(name) from None

    def append(self) -> Commit:
        """A commit that expects the aggregate to be as it was loaded."""
        return self.store.aggregate(self.id).original_version(self.version)


class Projection:
    """Handlers by (type, name); a handler changes the state, a dict, given the event, a dict with `data` decoded.

    `state` is the schema of the fields, each null at first unless `defaults` has it. `revision` marks snapshots: a new one starts over.
    Without a revision and without `snapshots` none are kept. Given columns (see `columns`), there are no handlers to call.
    """

    def __init__(self, aggregator_type: str, state: str | T.StructType, defaults: dict[str, Any] | None = None, revision: str | None = None, snapshots: Snapshots | None = None):
        self.aggregator_type, self.revision, self.defaults = aggregator_type, revision, dict(defaults or {})
        self.schema = T.StructType.fromDDL(state) if isinstance(state, str) else state
        self.handlers: dict[tuple[str, str], Handler | None] = {}
        self.snapshots = snapshots or (StoreSnapshots() if revision is not None else Snapshots())
        self.strict = False
        self.fields: dict[str, Column] = {}
        self.ids: dict[str, str] = {}
        self.context = Context()

    def data(self, value: object) -> Projection:
        """Shares a value with the handlers, which then take the context as a third argument."""
        self.context = self.context.having(value)
        return self

    def aggregator(self, aggregator_type: str, aggregator_id: str) -> Projection:
        """A related aggregate that `load` reads too, by the name of its type."""
        self.ids[aggregator_type] = aggregator_id
        return self

    def columns(self, *specs: EventSpec, **fields: Column) -> Projection:
        """State fields as aggregates over the events of these specs, as `fold.last`, `fold.total` and the like make them.

        The events have the log's columns. Fields without a column keep their default.
        """
        unknown = set(fields) - set(self.schema.fieldNames())
        if unknown:
            raise ValueError(f"no field {', '.join(sorted(unknown))}")
        if any(self.handlers.values()):
            raise ValueError("a projection has handlers or columns, not both")
        for spec in specs:
            self._add(spec, None)
        self.fields |= fields
        return self

    def handler(self, spec: EventSpec, fn: Handler) -> Projection:
        return self._add(spec, fn)

    def skip(self, spec: EventSpec) -> Projection:
        """Takes an event and does nothing, which satisfies a strict projection."""
        return self._add(spec, None)

    def _add(self, spec: EventSpec, fn: Handler | None) -> Projection:
        key = (spec.aggregator_type, spec.name)
        if key in self.handlers:
            raise ValueError(f"{key} has a handler")
        if fn is not None and self.fields:
            raise ValueError("a projection has handlers or columns, not both")
        self.handlers[key] = fn
        return self

    def safety_check(self) -> Projection:
        """Reads all events of the aggregates; one without a handler is an error."""
        self.strict = True
        return self

    @property
    def types(self) -> list[str]:
        return sorted({t for t, _ in self.handlers} | {self.aggregator_type})

    def reads(self, ids: dict[str, str] | None = None) -> list[Read]:
        ids = ids or {}
        if self.strict:
            return [Read(t, ids.get(t)) for t in self.types]
        return [Read(t, ids.get(t), n) for t, n in sorted(self.handlers)]

    def initial(self) -> dict[str, Any]:
        return dict.fromkeys(self.schema.fieldNames()) | self.defaults

    def apply(self, state: dict, event: dict) -> None:
        key = (event["aggregator_type"], event["name"])
        if key not in self.handlers:
            if self.strict:
                raise NoHandler(f"{key[0]} {key[1]}")
            return
        fn = self.handlers[key]
        if fn is not None:
            data = event["data"]
            given = (self.context,) if len(self.context) else ()
            fn(state, event | {"data": json.loads(data) if isinstance(data, str) else data or {}}, *given)

    def load(self, store: Store, aggregator_id: str, others: dict[str, str] | None = None) -> Loaded | None:
        """The state of one aggregate, folded here (its events are bounded by the version's range); None without events.

        `others` gives the ids of related aggregates by type. With a revision, the fold starts at the snapshot and leaves a new one.
        """
        ids = self.ids | (others or {}) | {self.aggregator_type: aggregator_id}
        missing = [t for t in self.types if t not in ids]
        if missing:
            raise ValueError(f"no id for {', '.join(missing)}")
        if self.fields:
            links = {t: store.spark.createDataFrame([(aggregator_id, ids[t])], "root_id string, linked_id string") for t in self.types if t != self.aggregator_type}
            row = self.execute(store, [aggregator_id], links).first()
            return row and Loaded(aggregator_id, self.aggregator_type, {n: row[n] for n in self.schema.fieldNames()}, row["version"], row["cursor"], store)
        state, version, cursor = self.initial(), 0, None
        saved = self.snapshots.restore(self, store, aggregator_id)
        if saved:
            state, version, cursor = state | saved[0], saved[1], saved[2]
        events = store.scan(self.reads(ids))
        if cursor is not None:
            events = events.where(EVENTS.beyond(cursor, False))
        rows = sorted((r.asDict(recursive=True) for r in events.collect()), key=lambda e: [e[k] for k in EVENT_KEY])
        if not rows and cursor is None:
            return None
        for event in rows:
            self.apply(state, event)
            if event["aggregator_type"] == self.aggregator_type and event["aggregator_id"] == aggregator_id:
                version = event["version"]
        if rows:
            cursor = EVENTS.encode(rows[-1])
            self.snapshots.take(self, store, aggregator_id, (state, version, cursor))
        return Loaded(aggregator_id, self.aggregator_type, state, version, cursor, store)

    def execute(self, store: Store, ids: DataFrame | Sequence[str] | None = None, links: dict[str, DataFrame] | None = None) -> DataFrame:
        """aggregator_id, the state's fields, version and cursor for all aggregates, or those in `ids`, as a plan.

        `links` gives, for each related type, its (root_id, linked_id) pairs; events of a linked aggregate reach all its roots.
        """
        missing = [t for t in self.types if t != self.aggregator_type and t not in (links or {})]
        if missing:
            raise ValueError(f"no links for {', '.join(missing)}")
        log = store.scan(self.reads())
        events = log.where(F.col("aggregator_type") == self.aggregator_type).withColumn("root_id", F.col("aggregator_id"))
        for kind, link in (links or {}).items():
            theirs = relations.linked(log.limit(0), log.where(F.col("aggregator_type") == kind), link)
            events = events.unionByName(theirs)
        if ids is not None:
            wanted = ids if isinstance(ids, DataFrame) else store.spark.createDataFrame([(i,) for i in ids], "root_id string")
            events = events.join(wanted.select(F.col(wanted.columns[0]).alias("root_id")).distinct(), "root_id", "left_semi")
        if self.fields:
            return self._reduced(events)
        out = T.StructType([*self.schema.fields, T.StructField("version", T.IntegerType()), T.StructField("cursor", T.StringType())])
        root, apply, initial = self.aggregator_type, self.apply, self.initial()

        def step(state: dict, event: dict) -> None:
            if not state.get("_begun"):
                state |= initial | {"_begun": True}
            apply(state, event)
            if event["aggregator_type"] == root:
                state["version"] = event["version"]
            state["cursor"] = event["cursor"]

        folded = fold.custom(events.drop("metadata").withColumn("cursor", cursor_column()), step, out, ("root_id",))
        return folded.withColumnRenamed("root_id", "aggregator_id")

    def _reduced(self, events: DataFrame) -> DataFrame:
        """The state by columns: one partial aggregation, without Python."""
        if self.strict:
            known = F.concat_ws("\x01", "aggregator_type", "name").isin(*["\x01".join(k) for k in self.handlers])
            events = events.where(F.when(known, True).otherwise(F.raise_error(F.concat(F.lit("no handler for "), "aggregator_type", F.lit(" "), "name")).cast("boolean")))
        own = F.col("aggregator_type") == self.aggregator_type
        cursor = F.max_by(cursor_column(), fold.key())
        folded = fold.algebraic(events, ("root_id",), **{f"_{n}": c for n, c in self.fields.items()}, _version=fold.last(F.col("version"), own), _cursor=cursor)
        fields = [(F.col(f"_{f.name}") if f.name in self.fields else F.lit(self.defaults.get(f.name))).cast(f.dataType).alias(f.name) for f in self.schema.fields]
        return folded.select(F.col("root_id").alias("aggregator_id"), *fields, F.coalesce("_version", F.lit(0)).alias("version"), F.col("_cursor").alias("cursor"))

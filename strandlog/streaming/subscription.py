"""Subscriptions: handlers that follow a store's commits, at least once, with a cursor that survives restarts.

The stream's source is the folder of manifests, so a batch is a set of published commits and its checkpoint is the position.
"""

from __future__ import annotations

import threading
import time
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from strandlog.functions.scalars import hash_ids, subscriber_key, ulid
from strandlog.operators.cursor import EVENTS
from strandlog.operators.filters import Read, RoutingKey, scan
from strandlog.plans.context import Context
from strandlog.plans.projection import NoHandler
from strandlog.schema import EventSpec
from strandlog.sources.store import EventStore

#: Commits in a micro-batch; within it events are handled in chunks.
COMMITS = 300
#: Seconds between looks at a query that may have to be started again.
WATCH = 1.0
_MANIFEST = "number long, adds array<string>, replaces array<string>, rewrite boolean"


class Fenced(Exception):
    """Another worker has taken the subscription over."""


@dataclass(frozen=True)
class Rule:
    aggregator_type: str
    name: str | None
    fn: Callable | None
    #: Called with each event (a dict) in order instead of once with a DataFrame.
    each: bool


@dataclass(frozen=True)
class Subscription:
    """Built step by step; every method returns a changed copy. By default only events without a routing key are followed."""

    store: EventStore
    key: str
    rules: tuple[Rule, ...] = ()
    routing: RoutingKey = field(default_factory=lambda: RoutingKey.value(None))
    #: Events handled at a time at most; a commit with more is handled whole.
    chunk: int = 300
    retries: int = 30
    strict: bool = False
    failures_accepted: bool = False
    start_delay: float = 0.0
    ids: tuple[tuple[str, str], ...] = ()
    #: Drops late events: those not beyond the acknowledged cursor.
    strict_cursor: bool = False
    context: Context = field(default_factory=Context)

    def data(self, value: object) -> Subscription:
        """Shares a value with the handlers, which then take the context as their last argument."""
        return replace(self, context=self.context.having(value))

    def on(self, spec: EventSpec, fn: Callable, each: bool = False) -> Subscription:
        return self._with(Rule(spec.aggregator_type, spec.name, fn, each))

    def on_all(self, aggregator_type: str, fn: Callable, each: bool = False) -> Subscription:
        """All events of a type, undecoded."""
        return self._with(Rule(aggregator_type, None, fn, each))

    def skip(self, spec: EventSpec) -> Subscription:
        return self._with(Rule(spec.aggregator_type, spec.name, None, False))

    def _with(self, rule: Rule) -> Subscription:
        if any((r.aggregator_type, r.name) == (rule.aggregator_type, rule.name) for r in self.rules):
            raise ValueError(f"{rule.aggregator_type} {rule.name} has a handler")
        return replace(self, rules=(*self.rules, rule))

    def routing_key(self, key: str | None) -> Subscription:
        return replace(self, routing=RoutingKey.value(key))

    def all(self) -> Subscription:
        return replace(self, routing=RoutingKey.ALL)

    def aggregator(self, aggregator_type: str, aggregator_id: str) -> Subscription:
        return replace(self, ids=(*self.ids, (aggregator_type, aggregator_id)))

    def safety_check(self) -> Subscription:
        """Reads all events of the types; one without a handler is an error."""
        return replace(self, strict=True)

    def chunk_size(self, n: int) -> Subscription:
        return replace(self, chunk=n)

    def retry(self, n: int) -> Subscription:
        return replace(self, retries=n)

    def without_retry(self) -> Subscription:
        return self.retry(0)

    def delay(self, seconds: float) -> Subscription:
        return replace(self, start_delay=seconds)

    def accept_failure(self) -> Subscription:
        """A batch that keeps failing doesn't end the subscription: it is tried again and again, and blocks those after it."""
        return replace(self, failures_accepted=True)

    @property
    def full_key(self) -> str:
        """Name of the control row; all events, unrouted ones and each routing key have positions of their own."""
        return subscriber_key(self.key, "*" if self.routing.every else self.routing.key)

    def reads(self) -> list[Read]:
        ids, found = dict(self.ids), {}
        for r in self.rules:
            wide = self.strict or r.name is None
            found[Read(r.aggregator_type, ids.get(r.aggregator_type), None if wide else r.name)] = None
        return list(found)

    # running

    def _batch(self, worker: str) -> Callable[[DataFrame, int], None]:
        ahead: dict = {"number": -1, "newest": None}

        def run(manifests: DataFrame, batch_id: int) -> None:
            rows = sorted(manifests.where(~F.col("rewrite")).collect(), key=lambda m: m["number"])
            for part in self._parts(rows):
                for attempt in range(self.retries + 1):
                    if not self.store.is_running(self.full_key, worker):
                        raise Fenced(self.full_key)
                    try:
                        self._process([a for m in part for a in m["adds"]], part[-1]["number"], ahead)
                        break
                    except Exception:
                        if attempt == self.retries:
                            raise
                        time.sleep(min(0.1 * 2**attempt, 60))

        return run

    def _parts(self, rows: list) -> list[list]:
        """Runs of commits with at most `chunk` events each, or one commit: a commit is never cut, so its events are seen together."""
        sizes = dict(self._matching([a for m in rows for a in m["adds"]], "origin").groupBy("origin").count().collect()) if len(rows) > 1 else {}
        parts, held = [], 0
        for m in rows:
            size = sum(sizes.get(a, 0) for a in m["adds"])
            if not parts or held + size > self.chunk:
                parts.append([])
                held = 0
            parts[-1].append(m)
            held += size
        return parts

    def _matching(self, folders: list[str], *extra: str) -> DataFrame:
        return scan(self.store.commits(folders, *extra), self.reads(), self.routing)

    def _lag(self, number: int, own: int, last: int, ahead: dict) -> int:
        """Seconds from the batch's last event to the newest one that this subscription follows. Each commit is looked at once:
        `ahead` remembers how far that has come."""
        known = [t for t in ((self.store.subscriber(self.full_key) or {}).get("newest"), ahead["newest"], own) if t is not None]
        pending = [m for m in self.store.manifests(max(number, ahead["number"])) if not m["rewrite"]]
        if pending:
            ahead["number"] = pending[-1]["number"]
            newest = self._matching([a for m in pending for a in m["adds"]]).agg(F.max("timestamp")).first()[0]
            known += [newest] if newest is not None else []
        ahead["newest"] = max(known)
        return max(0, ahead["newest"] - last)

    def _process(self, folders: list[str], number: int, ahead: dict) -> None:
        events = self._matching(folders)
        if self.strict_cursor and (cursor := self.store.get_cursor(self.full_key)):
            events = events.where(EVENTS.beyond(cursor, False))
        events = events.persist()
        try:
            last = events.orderBy(*EVENTS.order(True)).head(1)
            if not last:
                return
            wide = {r.aggregator_type: r for r in self.rules if r.name is None}
            named = {(r.aggregator_type, r.name): r for r in self.rules if r.name is not None}
            kinds = events.select("aggregator_type", "name").distinct().collect()
            if self.strict:
                for k in kinds:
                    if k["aggregator_type"] not in wide and tuple(k) not in named:
                        raise NoHandler(f"{k[0]} {k[1]}")
            chosen = {tuple(k): wide.get(k["aggregator_type"]) or named.get(tuple(k)) for k in kinds}
            if any(r is not None and r.each and r.fn for r in chosen.values()):
                for row in events.orderBy(*EVENTS.order(False)).toLocalIterator():
                    rule = chosen[row["aggregator_type"], row["name"]]
                    if rule is not None and rule.each and rule.fn:
                        rule.fn(row.asDict(recursive=True), *self._given)
            for rule in {id(r): r for r in chosen.values() if r is not None and not r.each and r.fn}.values():
                own = F.col("aggregator_type") == rule.aggregator_type
                rule.fn(events.where(own if rule.name is None else own & (F.col("name") == rule.name)).orderBy(*EVENTS.order(False)), *self._given)
            lag = self._lag(number, last[0]["timestamp"], last[0]["timestamp"], ahead)
            self.store.acknowledge(self.full_key, EVENTS.encode(last[0]), lag, newest=last[0]["timestamp"])
        finally:
            events.unpersist()

    @property
    def _given(self) -> tuple:
        return (self.context,) if len(self.context) else ()

    def _query(self, worker: str, **trigger) -> StreamingQuery:
        if not self.rules:
            raise ValueError("a subscription without handlers")
        self.store.files.ensure("log")
        source = self.store.spark.readStream.schema(_MANIFEST).option("maxFilesPerTrigger", COMMITS).json(f"{self.store.root}/log")
        place = f"{self.store.root}/checkpoints/{hash_ids([self.full_key])}"
        return source.writeStream.foreachBatch(self._batch(worker)).option("checkpointLocation", place).trigger(**trigger).start()

    def _take(self) -> str:
        worker = ulid()
        self.store.upsert_subscriber(self.full_key, worker)
        return worker

    def execute(self) -> None:
        """Handles all that is pending, then returns. An error of a handler is raised, unless failures are accepted."""
        time.sleep(self.start_delay)
        query = self._query(self._take(), availableNow=True)
        try:
            query.awaitTermination()
        except StreamingQueryException as e:
            if "Fenced" in str(e):
                return
            if not self.failures_accepted:
                raise

    def start(self, interval: str = "1 second") -> Running:
        """Follows the store until shut down or taken over by another worker."""
        time.sleep(self.start_delay)
        worker = self._take()
        running = Running(self, worker, self._query(worker, processingTime=interval), interval)
        if self.failures_accepted:
            threading.Thread(target=running._watch, daemon=True).start()
        return running


@dataclass
class Running:
    subscription: Subscription
    worker: str
    query: StreamingQuery
    interval: str
    #: Set by shutdown; a query that ends without it has failed or was taken over.
    ended: threading.Event = field(default_factory=threading.Event)
    lock: threading.Lock = field(default_factory=threading.Lock)

    @property
    def is_active(self) -> bool:
        return self.query.isActive

    def supervise(self) -> bool:
        """Restarts a query that an accepted failure has ended; true if it runs."""
        with self.lock:
            mine = self.subscription.failures_accepted and not self.ended.is_set()
            if mine and not self.query.isActive and self.subscription.store.is_running(self.subscription.full_key, self.worker):
                self.query = self.subscription._query(self.worker, processingTime=self.interval)
            return self.query.isActive

    def _watch(self) -> None:
        """Supervises until shut down or taken over."""
        while not self.ended.wait(WATCH):
            if not self.supervise():
                return

    def shutdown(self) -> None:
        """Ends after the batch at hand."""
        self.ended.set()
        while self.query.isActive and self.query.status["isTriggerActive"] and self.query.status["isDataAvailable"]:
            time.sleep(0.05)
        self.query.stop()

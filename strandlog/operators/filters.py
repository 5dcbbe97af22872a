"""Which events to read: aggregates, names and routing, as one pushed-down predicate."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlog.schema import EVENT_COLUMNS, EventSpec


@dataclass(frozen=True)
class Read:
    """A type of aggregate, optionally one instance, optionally one event name."""

    aggregator_type: str
    aggregator_id: str | None = None
    name: str | None = None

    @classmethod
    def event(cls, spec: EventSpec, aggregator_id: str | None = None) -> Read:
        return cls(spec.aggregator_type, aggregator_id, spec.name)

    def column(self) -> Column:
        wanted = {"aggregator_type": self.aggregator_type, "aggregator_id": self.aggregator_id, "name": self.name}
        return reduce(and_, (F.col(c) == v for c, v in wanted.items() if v is not None))


class RoutingKey:
    """ALL: no filter. value(None): events without a key. value(k): events with that key."""

    def __init__(self, every: bool, key: str | None = None):
        self.every, self.key = every, key

    @classmethod
    def value(cls, key: str | None) -> RoutingKey:
        return cls(False, key)

    def column(self) -> Column | None:
        if self.every:
            return None
        return F.col("routing_key").isNull() if self.key is None else F.col("routing_key") == self.key

    def __eq__(self, other: object) -> bool:
        return isinstance(other, RoutingKey) and (self.every, self.key) == (other.every, other.key)

    def __hash__(self) -> int:
        return hash((self.every, self.key))


RoutingKey.ALL = RoutingKey(True)


def scan(log: DataFrame, reads: Sequence[Read] | None = None, routing: RoutingKey = RoutingKey.ALL) -> DataFrame:
    """The log's events that match any of `reads` (None: all) and the routing. Overlapping reads give a row once.

    An empty list of reads is an error: it has no agreed meaning.
    """
    if reads is not None:
        if not reads:
            raise ValueError("an empty list of reads: pass None for all events")
        log = log.where(reduce(or_, (r.column() for r in reads)))
    where = routing.column()
    return log if where is None else log.where(where)


def project(log: DataFrame) -> DataFrame:
    """The ten event columns in their order."""
    return log.select(*EVENT_COLUMNS)

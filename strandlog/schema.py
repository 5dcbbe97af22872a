"""The event log's data model."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The total order of events, over all aggregates: most significant first.
EVENT_KEY = ("timestamp", "timestamp_subsec", "version", "id")
MAX_VERSION = 65_535
#: The identity that appends must keep unique.
IDENTITY = ("aggregator_type", "aggregator_id", "version")
SCHEMA_VERSION = 3

METADATA = T.StructType([T.StructField("id", T.StringType()), T.StructField("meta", T.MapType(T.StringType(), T.StringType()))])
EVENT = T.StructType(
    [
        T.StructField("id", T.StringType(), False),
        T.StructField("aggregator_type", T.StringType(), False),
        T.StructField("aggregator_id", T.StringType(), False),
        T.StructField("version", T.IntegerType(), False),
        T.StructField("name", T.StringType(), False),
        T.StructField("routing_key", T.StringType()),
        T.StructField("data", T.StringType()),
        T.StructField("metadata", METADATA),
        T.StructField("timestamp", T.LongType(), False),
        T.StructField("timestamp_subsec", T.IntegerType(), False),
    ]
)
EVENT_COLUMNS = tuple(EVENT.fieldNames())
CURSOR = T.StructType([EVENT[c] for c in EVENT_KEY])
SNAPSHOT = T.StructType(
    [
        T.StructField("aggregator_type", T.StringType(), False),
        T.StructField("aggregator_id", T.StringType(), False),
        T.StructField("revision", T.StringType(), False),
        T.StructField("cursor", T.StringType(), False),
        T.StructField("data", T.StringType(), False),
        T.StructField("created_at", T.TimestampType()),
        T.StructField("updated_at", T.TimestampType()),
    ]
)


class SchemaVersionError(Exception):
    """Events of a schema version that this code doesn't know."""


@dataclass(frozen=True)
class Migration:
    """The step to a schema version and back, as changes of a frame of events."""

    version: int
    up: Callable[[DataFrame], DataFrame]
    down: Callable[[DataFrame], DataFrame]


#: Steps in the order of versions: 2 brought milliseconds; 3 allowed longer names, which changes no row.
MIGRATIONS = (
    Migration(2, lambda df: df.withColumn("timestamp_subsec", F.coalesce("timestamp_subsec", F.lit(0))), lambda df: df.withColumn("timestamp_subsec", F.lit(None).cast("int"))),
    Migration(3, lambda df: df, lambda df: df),
)


def upgrade(events: DataFrame, version: int, target: int = SCHEMA_VERSION) -> DataFrame:
    """Events written under a schema version, as the target version (by default today's) has them: steps up or down, one by one.

    Columns that a version lacks are read as null before its step.
    """
    known = {1, *(m.version for m in MIGRATIONS)}
    if version not in known or target not in known:
        raise SchemaVersionError(f"from {version} to {target}: known are {sorted(known)}")
    for m in MIGRATIONS:
        if version < m.version <= target:
            events = m.up(events)
    for m in reversed(MIGRATIONS):
        if target < m.version <= version:
            events = m.down(events)
    return events


def type_name(package: str, name: str) -> str:
    """The aggregator type of an aggregate: package and name."""
    return f"{package}/{name}"


@dataclass(frozen=True)
class EventSpec:
    """A typed event: which aggregate it belongs to, its name and its payload."""

    aggregator_type: str
    name: str
    payload: str | T.StructType

    @property
    def schema(self) -> T.StructType:
        """The payload's type; DDL text is parsed here, which needs a session."""
        if isinstance(self.payload, T.StructType):
            return self.payload
        return T.StructType.fromDDL(self.payload) if self.payload else T.StructType()


class Aggregate:
    """A registry of an aggregate's events: Aggregate("bank/Account", Opened="owner string, balance long")."""

    def __init__(self, aggregator_type: str, **events: str | T.StructType):
        self.aggregator_type = aggregator_type
        self.events = {n: EventSpec(aggregator_type, n, p) for n, p in events.items()}

    def __getattr__(self, name: str) -> EventSpec:
        try:
            return self.__dict__["events"][name]
        except KeyError:
            raise AttributeError(name) from None

"""Questions about whole logs: versions, routing, gaps, conflicts, lag, and links between aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandlog.operators import fold
from strandlog.operators.fold import BY
from strandlog.schema import EVENT_KEY, IDENTITY


def has_event(log: DataFrame, name: str, by: Sequence[str] = BY) -> DataFrame:
    """For each aggregate whether it has an event of that name."""
    return log.groupBy(*by).agg(F.bool_or(F.col("name") == name).alias("has_event"))


def last_version(log: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    return log.groupBy(*by).agg(F.max("version").alias("last_version"))


def state_version(log: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """The version of the event that comes last in the total order."""
    return fold.algebraic(log, by, state_version=fold.last(F.col("version")))


def assign_version(batch: DataFrame, order: Sequence[str | Column], base: Column | int = 0, by: Sequence[str] = BY) -> DataFrame:
    """Numbers a batch's events base + 1, base + 2, ... within each aggregate."""
    start = base if isinstance(base, Column) else F.lit(base)
    return batch.withColumn("version", (start + F.row_number().over(Window.partitionBy(*by).orderBy(*order))).cast("int"))


def sticky_routing(log: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """The routing key of each aggregate's first event, null if that one has none."""
    return fold.algebraic(log, by, routing_key=fold.first(F.col("routing_key")))


def last_routing_key(log: DataFrame) -> DataFrame:
    """One row: the newest event's routing key."""
    return log.agg(fold.last(F.col("routing_key")).alias("routing_key"))


def event_lag(log: DataFrame) -> DataFrame:
    """Each event with the seconds between it and the newest one, at least 0. The newest time is a scalar subquery."""
    newest = log.agg(F.max("timestamp")).scalar()
    return log.withColumn("lag_seconds", F.greatest(newest - F.col("timestamp"), F.lit(0)))


def gap_check(log: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """Events whose version isn't the one after their aggregate's version before, which is given as previous_version."""
    before = F.coalesce(F.lag("version").over(Window.partitionBy(*by).orderBy("version")), F.lit(0))
    return log.withColumn("previous_version", before).where(F.col("version") != F.col("previous_version") + 1)


def conflicts(batch: DataFrame, log: DataFrame) -> DataFrame:
    """Batch rows whose identity the log has already, or that another row of the batch has."""
    keys = list(IDENTITY)
    taken = batch.join(log.select(*keys), keys, "left_semi").select(*keys)
    twice = batch.groupBy(*keys).count().where(F.col("count") > 1).select(*keys)
    return batch.join(taken.unionByName(twice), keys, "left_semi")


def unhandled(log: DataFrame, handled: Sequence[str]) -> DataFrame:
    """Names (with counts) of events that no handler takes."""
    return log.where(~F.col("name").isin(*handled)).groupBy("name").agg(F.count("*").alias("n_events"))


def union(*logs: DataFrame) -> DataFrame:
    """Several logs read as one; duplicates stay. Filters and limits are pushed into each."""
    if not logs:
        raise ValueError("an empty group")
    out = logs[0]
    for log in logs[1:]:
        out = out.unionByName(log)
    return out


def fan_out(rows: DataFrame, link: str, changes: DataFrame, by: str = "aggregator_id", **fields: Column) -> DataFrame:
    """Rows of a read model with fields replaced by the latest change of the aggregate they link to."""
    latest = fold.algebraic(changes, (by,), **{f"_new_{n}": fold.last(F.struct(c.alias("v"))) for n, c in fields.items()})
    joined = rows.join(latest.withColumnRenamed(by, "_link"), F.col(link) == F.col("_link"), "left")
    new = {n: F.when(F.col("_link").isNotNull(), F.col(f"_new_{n}")["v"]).otherwise(F.col(n)) for n in fields}
    return joined.withColumns(new).select(*rows.columns)


def linked(roots: DataFrame, others: DataFrame, link: DataFrame) -> DataFrame:
    """Events of both logs with the `root_id` they belong to; link: (root_id, linked_id). An event of a linked aggregate
    goes to each of its roots."""
    own = roots.withColumn("root_id", F.col("aggregator_id"))
    theirs = others.join(link.distinct(), others["aggregator_id"] == link["linked_id"]).drop("linked_id")
    return own.unionByName(theirs)


def after_cursor(log: DataFrame, snapshots: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """Events beyond their aggregate's snapshot cursor (all, where there is none). snapshots: by, and the four key columns as `at_*`."""
    joined = log.join(snapshots.select(*by, *[f"at_{k}" for k in EVENT_KEY]), list(by), "left")
    later = None
    for k in reversed(EVENT_KEY):
        more = F.col(k) > F.col(f"at_{k}")
        later = more if later is None else more | ((F.col(k) == F.col(f"at_{k}")) & later)
    return joined.where(F.col("at_id").isNull() | later).select(*log.columns)


def no_events(ids: DataFrame, log: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """Wanted aggregates that have no event."""
    return ids.join(log.select(*by), list(by), "left_anti")

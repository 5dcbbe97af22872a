"""Ordered folds of events into one state for each aggregate.

Three strategies. `algebraic`: every field is a sum, a last or a first value and the like: plain partial aggregation,
nothing is buffered. `ordered`: an expression over state and event, for handlers that don't commute: one aggregate's
events are sorted and folded in the JVM. `custom`: any Python handler, one group of rows at a time. The last two hold the
events of one aggregate (MAX_VERSION at most), never more.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandlog.schema import EVENT_KEY

BY = ("aggregator_type", "aggregator_id")


def key(columns: Sequence[str] = EVENT_KEY) -> Column:
    """The total order as a comparable struct."""
    return F.struct(*columns)


def total(amount: Column, when: Column | None = None) -> Column:
    return F.coalesce(F.sum(amount if when is None else F.when(when, amount)), F.lit(0))


def _pick(best: Callable, value: Column, when: Column | None) -> Column:
    # the value is wrapped: a null value counts, only rows that don't match are left out
    place = key() if when is None else F.when(when, key())
    return best(F.struct(value.alias("v")), place)["v"]


def last(value: Column, when: Column | None = None) -> Column:
    """The value of the latest matching event, null values included."""
    return _pick(F.max_by, value, when)


def first(value: Column, when: Column | None = None) -> Column:
    return _pick(F.min_by, value, when)


def algebraic(events: DataFrame, by: Sequence[str] = BY, **fields: Column) -> DataFrame:
    return events.groupBy(*by).agg(*[c.alias(n) for n, c in fields.items()])


def ordered(events: DataFrame, initial: dict[str, Column], step: Callable[[Column, Column], dict[str, Column]], uses: Sequence[str], by: Sequence[str] = BY) -> DataFrame:
    """State fields after `step(state, event)` for each event in order. `initial` fixes the fields' types, `uses` names the event columns read."""
    kept = [*EVENT_KEY, *[u for u in uses if u not in EVENT_KEY]]
    lists = events.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(*kept))).alias("_events"))
    start = F.struct(*[c.alias(n) for n, c in initial.items()])
    types = {n: f.dataType for n, f in zip(initial, events.limit(0).select(*[c.alias(n) for n, c in initial.items()]).schema, strict=True)}

    def merge(state: Column, event: Column) -> Column:
        changed = step(state, event)
        return F.struct(*[changed.get(n, state[n]).cast(types[n]).alias(n) for n in initial])

    return lists.select(*by, F.aggregate("_events", start, merge).alias("_state")).select(*by, "_state.*")


def custom(events: DataFrame, handle: Callable[[dict, dict], None], state: T.StructType | str, by: Sequence[str] = BY) -> DataFrame:
    """State fields after the Python `handle(state, event)` changed the state in place for each event in order."""
    schema = T.StructType.fromDDL(state) if isinstance(state, str) else state
    names = list(by)
    out = T.StructType([*[events.schema[n] for n in names], *schema.fields])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        now = dict.fromkeys(schema.fieldNames())
        for event in pdf.sort_values(list(EVENT_KEY)).to_dict("records"):
            handle(now, event)
        return pd.DataFrame([{n: pdf[n].iloc[0] for n in names} | now], columns=out.fieldNames())

    return events.groupBy(*names).applyInPandas(run, out)


def running(events: DataFrame, by: Sequence[str] = BY, **fields: Column) -> DataFrame:
    """All events with fields aggregated over their aggregate's events up to each one."""
    window = Window.partitionBy(*by).orderBy(*EVENT_KEY).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return events.withColumns({n: c.over(window) for n, c in fields.items()})

"""Incremental folds: state kept by Structured Streaming, one value for each aggregate."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from strandlog.operators.fold import BY
from strandlog.schema import EVENT_KEY


class FoldProcessor(StatefulProcessor):
    """Folds the new events of a key, sorted, into its state; the engine gives no order within a key."""

    def __init__(self, handle: Callable[[dict, dict], None], state: T.StructType):
        self.handle, self.schema = handle, state

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", self.schema)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        names = self.schema.fieldNames()
        now = dict(zip(names, self.state.get(), strict=True)) if self.state.exists() else dict.fromkeys(names)
        for event in pd.concat(list(rows)).sort_values(list(EVENT_KEY)).to_dict("records"):
            self.handle(now, event)
        self.state.update(tuple(now[n] for n in names))
        yield pd.DataFrame([dict(zip(BY, key, strict=True)) | now])

    def close(self) -> None:
        pass


def incremental_fold(events: DataFrame, handle: Callable[[dict, dict], None], state: str | T.StructType) -> DataFrame:
    """The changed states after each micro-batch of a stream of events (update mode). Needs the RocksDB state store.

    Equal to the batch fold if each aggregate's events arrive in their order over the batches.
    """
    schema = T.StructType.fromDDL(state) if isinstance(state, str) else state
    out = T.StructType([*[T.StructField(n, T.StringType()) for n in BY], *schema.fields])
    return events.groupBy(*BY).transformWithStateInPandas(FoldProcessor(handle, schema), out, "Update", "None")

"""What running subscriptions are doing, for logs and dashboards."""

from __future__ import annotations

import json
import logging
import threading

from pyspark.sql import SparkSession
from pyspark.sql.streaming.listener import StreamingQueryListener

_log = logging.getLogger("strandlog.subscription")


class ProgressLog(StreamingQueryListener):
    """Logs each batch and keeps the last progress of each query by its id."""

    def __init__(self):
        self.last: dict[str, dict] = {}
        self.ended: dict[str, str | None] = {}
        self._lock = threading.Lock()

    def attach(self, spark: SparkSession) -> ProgressLog:
        spark.streams.addListener(self)
        return self

    def detach(self, spark: SparkSession) -> None:
        spark.streams.removeListener(self)

    def onQueryStarted(self, event) -> None:
        _log.info("started %s", event.id)

    def onQueryProgress(self, event) -> None:
        p = event.progress
        row = {"batch": p.batchId, "commits": p.numInputRows, "millis": p.batchDuration}
        _log.info("progress %s %s", p.id, json.dumps(row))
        with self._lock:
            self.last[str(p.id)] = row

    def onQueryIdle(self, event) -> None:
        _log.debug("idle %s", event.id)

    def onQueryTerminated(self, event) -> None:
        _log.info("ended %s %s", event.id, event.exception or "")
        with self._lock:
            self.ended[str(event.id)] = event.exception

"""Scalar functions: ids, cursors, time, names, payloads and metadata."""

from __future__ import annotations

import base64
import hashlib
import json
import os
import threading
import time
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandlog.schema import CURSOR, EVENT_KEY

_CROCKFORD = "0123456789ABCDEFGHJKMNPQRSTVWXYZ"
_last = [0, 0]
_lock = threading.Lock()


class CursorError(ValueError):
    """A cursor that isn't base64 or doesn't hold the expected values."""


class MetadataError(KeyError):
    """A metadata key that is missing."""


def hash_ids(ids: Iterable[str]) -> str:
    """SHA3-256 in hex of the concatenated ids. There is no separator: ["ab", "c"] and ["a", "bc"] agree."""
    return hashlib.sha3_256("".join(ids).encode()).hexdigest()


def hash_id_column(joined: Column) -> Column:
    """hash_ids for a column of already concatenated ids; Spark has no SHA-3, so this is an Arrow-batched function."""

    def run(ids: pd.Series) -> pd.Series:
        return ids.map(lambda s: None if s is None else hashlib.sha3_256(s.encode()).hexdigest())

    return F.pandas_udf(run, T.StringType())(joined)


def ulid(now: float | None = None) -> str:
    """A 26-character id whose text order follows time; within a process ids of one millisecond increase."""
    millis = int((time.time() if now is None else now) * 1000)
    with _lock:
        low = _last[1] + 1 if millis <= _last[0] and now is None else int.from_bytes(os.urandom(10), "big") >> 1
        if now is None:
            millis = max(millis, _last[0])
            _last[:] = [millis, low]
    value = millis << 80 | low
    return "".join(_CROCKFORD[value >> 5 * i & 31] for i in range(25, -1, -1))


def cursor_encode(values: Iterable) -> str:
    """Key values as URL-safe base64 of their JSON list."""
    return base64.urlsafe_b64encode(json.dumps(list(values), separators=(",", ":")).encode()).decode()


def cursor_decode(cursor: str, size: int | None = None) -> list:
    try:
        values = json.loads(base64.b64decode(cursor.encode(), altchars=b"-_", validate=True))
    except Exception as e:
        raise CursorError(f"not a cursor: {cursor!r}") from e
    if not isinstance(values, list) or (size is not None and len(values) != size):
        raise CursorError(f"not a cursor of {size} values: {cursor!r}")
    return values


def cursor_column(*keys: str) -> Column:
    """cursor_encode of each row, in the JVM."""
    each = [F.regexp_extract(F.to_json(F.struct(F.col(k).alias("v"))), r'(?s)^\{"v":(.*)\}$', 1) for k in keys or EVENT_KEY]
    listed = F.concat(F.lit("["), F.concat_ws(",", *each), F.lit("]"))
    return F.translate(F.base64(listed.cast("binary")), "+/\r\n", "-_")


def cursor_values(cursor: Column) -> Column:
    """The event key in a cursor, as a struct, in the JVM; null where there is no cursor or it holds something else."""
    text = F.unbase64(F.translate(cursor, "-_", "+/")).cast("string")
    fields = F.from_json(F.regexp_replace(text, r'^\[(\d+),(\d+),(\d+),("[^"]*")\]$', r'{"timestamp":$1,"timestamp_subsec":$2,"version":$3,"id":$4}'), CURSOR)
    return F.when(fields["timestamp"].isNotNull(), fields)


def split_time(ts: Column) -> tuple[Column, Column]:
    """Unix seconds and truncated milliseconds within the second of a zoneless timestamp, whatever the session's zone."""
    days = F.datediff(ts.cast("date"), F.lit("1970-01-01").cast("date")).cast("long")
    seconds = days * 86400 + F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)
    return seconds, F.floor((F.extract(F.lit("SECOND"), ts) * 1000) % 1000).cast("int")


def handler_key(aggregator_type: Column | str, name: Column | str) -> Column:
    return F.concat_ws("_", aggregator_type, name)


def subscriber_key(key: str, routing: str | None = None) -> str:
    """The name of a subscription's control row: routed ones have the routing key in front."""
    return f"{routing}.{key}" if routing else key


def subscriber_key_column(key: str, routing: Column | str) -> Column:
    """subscriber_key for a column of routing keys."""
    column = F.col(routing) if isinstance(routing, str) else routing
    return F.when(F.length(column) > 0, F.concat(column, F.lit(f".{key}"))).otherwise(F.lit(key))


def encode_payload(*columns: str | Column) -> Column:
    return F.to_json(F.struct(*columns))


def decode_payload(data: Column | str, schema: T.StructType | str) -> Column:
    """Typed payload; a payload that doesn't fit fails the query."""
    return F.from_json(data, schema, {"mode": "FAILFAST"})


def metadata_get(key: str, metadata: Column | str = "metadata") -> Column:
    """The value under a key, null if missing."""
    column = F.col(metadata) if isinstance(metadata, str) else metadata
    return F.try_element_at(column["meta"], F.lit(key))


def metadata_value(metadata: dict, key: str) -> str:
    """The value under a key of a collected metadata row; MetadataError if missing."""
    try:
        return (metadata["meta"] or {})[key]
    except KeyError as e:
        raise MetadataError(key) from e


def requested_by(metadata: Column | str = "metadata") -> Column:
    return metadata_get("requested_by", metadata)


def requested_as(metadata: Column | str = "metadata") -> Column:
    return metadata_get("requested_as", metadata)

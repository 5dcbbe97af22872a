"""Shared helpers of the training-data operators."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlog.deploy import ship
from strandlog.sources.shared import cut, scratch


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: Column) -> Column:
    """True for the rows that no model may learn from: crc32(doc_id as text) mod 4 is 2. A null id counts as learnable."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


#: What this Python worker keeps from task to task: functions that drop it, by the module whose tasks use it.
_kept: dict[str, Callable[[], None]] = {}


def keeps(module: str, drop: Callable[[], None]) -> None:
    """The module's tasks leave something for later ones in their worker; drop() is called before other modules' tasks."""
    _kept[module] = drop


@contextmanager
def task(module: str) -> Iterator[None]:
    """A task of the module in a Python worker, which lives on and takes other tasks: before it, what other modules keep is
    dropped; afterwards freed memory goes back to the system."""
    for name, drop in _kept.items():
        if name != module:
            drop()
    _give_back()
    try:
        yield
    finally:
        _give_back()


def _give_back() -> None:
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError, TypeError):  # not glibc
        pass


def map_rows(df: DataFrame, make: Callable[[], Callable[[dict], dict]], schema: str) -> DataFrame:
    """Runs make() once in each Python worker task, then the function it returns on each Arrow batch.

    The function takes and returns a dict of column name to list (or array). Batches are streamed: no partition
    is held as a whole.
    """
    ship(df.sparkSession)
    out = _arrow_schema(df.sparkSession, schema)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in batches:
            for part in slices(batch):
                got = step({n: part.column(i).to_pylist() for i, n in enumerate(part.schema.names)})
                if got is not None:
                    yield pa.RecordBatch.from_arrays([pa.array(got[f.name], f.type) for f in out], schema=out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with task(make.__module__):
            yield from rows(batches)

    return df.mapInArrow(run, schema)


#: A Python worker holds about so many bytes of rows at a time, or one row.
SLICE_BYTES = 8 << 20


def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Halves a batch until each part is small or a single row, so long texts don't pile up in a worker."""
    if batch.num_rows > 1 and batch.nbytes > SLICE_BYTES:
        half = batch.num_rows // 2
        yield from slices(batch.slice(0, half))
        yield from slices(batch.slice(half))
    elif batch.num_rows:
        yield batch


def _arrow_schema(spark: SparkSession, ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


def free_name(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have, in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def append(df: DataFrame, make: Callable[[], Callable[[dict], dict]], inputs: dict[str, str], outputs: dict[str, str]) -> DataFrame:
    """All rows and columns of df, with new columns computed from some of them in one narrow pass.

    make() runs once in each worker task; the function it returns gets a dict of lists for the keys of `inputs` (key to column name)
    and returns one for `outputs` (column name, which df must not have, to type).
    """
    from pyspark.sql.types import StructType

    ship(df.sparkSession)
    extra = StructType.fromDDL(", ".join(f"`{n}` {t}" for n, t in outputs.items()))
    fields = list(_arrow_schema(df.sparkSession, ", ".join(f"`{n}` {t}" for n, t in outputs.items())))
    at = {key: df.columns.index(name) for key, name in inputs.items()}

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in batches:
            for part in slices(batch):
                got = step({key: part.column(i).to_pylist() for key, i in at.items()})
                new = [pa.array(got[f.name], f.type) for f in fields]
                yield pa.RecordBatch.from_arrays([*part.columns, *new], names=[*part.schema.names, *outputs])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with task(make.__module__):
            yield from rows(batches)

    return df.mapInArrow(run, StructType([*df.schema.fields, *extra.fields]))


__all__ = ["append", "cut", "free_name", "held_out", "keeps", "map_rows", "scratch", "slices", "table", "task"]

"""Keyset pagination of any DataFrame, forward and backward."""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import cached_property

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandlog.functions.scalars import cursor_column, cursor_decode, cursor_encode
from strandlog.schema import EVENT_KEY
from strandlog.sources.shared import cut

DEFAULT_SIZE, MAX_SIZE = 40, 65_534
ASC, DESC = "asc", "desc"


@dataclass(frozen=True)
class Args:
    """first/after ask for a page forward, last/before for one backward; forward wins if both are given."""

    first: int | None = None
    after: str | None = None
    last: int | None = None
    before: str | None = None

    def __post_init__(self):
        for n in (self.first, self.last):
            if n is not None and not 0 <= n <= MAX_SIZE:
                raise ValueError(f"page size {n} is not within 0 to {MAX_SIZE}")

    @classmethod
    def forward(cls, first: int, after: str | None = None) -> Args:
        return cls(first=first, after=after)

    @classmethod
    def backward(cls, last: int, before: str | None = None) -> Args:
        return cls(last=last, before=before)

    @property
    def is_backward(self) -> bool:
        return (self.last is not None or self.before is not None) and self.first is None and self.after is None

    @property
    def size(self) -> int:
        n = self.last if self.is_backward else self.first
        return DEFAULT_SIZE if n is None else n

    @property
    def cursor(self) -> str | None:
        return self.before if self.is_backward else self.after

    def limit(self, cap: int) -> Args:
        """At most `cap` rows; `cap` is also the size where none is set. Drops the arguments of the other direction."""
        if self.is_backward:
            return Args.backward(cap if self.last is None else min(self.last, cap), self.before)
        return Args.forward(cap if self.first is None else min(self.first, cap), self.after)


@dataclass(frozen=True)
class CursorSpec:
    """Key columns, most significant first, that order the rows and tell them apart. They must not be null.

    A column may be pinned to a direction opposite to the page's order by a leading "-".
    """

    keys: tuple[str, ...] = EVENT_KEY

    @property
    def names(self) -> tuple[str, ...]:
        return tuple(k.lstrip("-") for k in self.keys)

    def directions(self, descending: bool) -> list[tuple[str, bool]]:
        return [(k.lstrip("-"), descending ^ k.startswith("-")) for k in self.keys]

    def encode(self, row) -> str:
        return cursor_encode(row[n] for n in self.names)

    def order(self, descending: bool) -> list[Column]:
        return [F.desc(n) if d else F.asc(n) for n, d in self.directions(descending)]

    def beyond(self, cursor: str | list, descending: bool) -> Column:
        """Rows after the cursor: nested comparisons, which reach the scan, and a plain bound on the first key."""
        values = cursor_decode(cursor, len(self.keys)) if isinstance(cursor, str) else list(cursor)
        out = None
        for (name, down), value in reversed(list(zip(self.directions(descending), values, strict=True))):
            more = F.col(name) < value if down else F.col(name) > value
            out = more if out is None else more | ((F.col(name) == value) & out)
        (name, down), value = self.directions(descending)[0], values[0]
        return out & (F.col(name) <= value if down else F.col(name) >= value)


EVENTS = CursorSpec()


@dataclass(frozen=True)
class PageInfo:
    has_next_page: bool = False
    end_cursor: str | None = None
    has_previous_page: bool = False
    start_cursor: str | None = None


@dataclass(frozen=True)
class Page:
    """A page as a lazy plan (`frame`, ordered, with its `cursor` and `has_more`) and, on first use, as rows and page info."""

    frame: DataFrame
    backward: bool

    @cached_property
    def rows(self) -> list:
        return self.frame.collect()

    @property
    def info(self) -> PageInfo:
        rows = self.rows
        more = bool(rows) and rows[0]["has_more"]
        if self.backward:
            return PageInfo(has_previous_page=more, start_cursor=rows[0]["cursor"] if rows else None)
        return PageInfo(has_next_page=more, end_cursor=rows[-1]["cursor"] if rows else None)

    def map(self, fn) -> Page:
        return replace(self, frame=fn(self.frame))


def paginate(df: DataFrame, args: Args = Args(), order: str = ASC, spec: CursorSpec = EVENTS) -> Page:
    """One page in the asked order; a row beyond it is read to learn whether there are more, and dropped.

    A backward page is read in the opposite order from its end, then turned. The plan is a filter and a top-k: no
    full sort, and no more than size + 1 rows leave a task.
    """
    if order not in (ASC, DESC):
        raise ValueError(f"order {order!r}")
    descending = (order == DESC) ^ args.is_backward
    if args.cursor is not None:
        df = df.where(spec.beyond(args.cursor, descending))
    probe = df.orderBy(*spec.order(descending)).limit(args.size + 1)
    rank = F.row_number().over(Window.orderBy(*spec.order(descending)))
    probe = probe.select("*", rank.alias("_rank"), F.count("*").over(Window.partitionBy()).alias("_count"))
    page = probe.where(F.col("_rank") <= args.size).withColumn("has_more", F.col("_count") > args.size).withColumn("cursor", cursor_column(*spec.names))
    ranked = page.orderBy(F.desc("_rank") if args.is_backward else F.asc("_rank"))
    return Page(ranked.drop("_rank", "_count"), args.is_backward)


def pages(df: DataFrame, size: int, order: str = ASC, spec: CursorSpec = EVENTS) -> DataFrame:
    """All rows with the number (from 0) of the page that a walk of `size` rows a page would give them in.

    Rows are dealt into ranges of the full key, whatever its types and however often its first part repeats, sorted and numbered
    within each range, and checkpointed, so that ranges and numbers stay what they were. One count for each range moves the numbers.
    """
    if size < 1:
        raise ValueError("page size")
    keys, count = spec.order(order == DESC), int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(count, *keys).sortWithinPartitions(*keys)
    # the lower 33 bits of this id count the rows of a partition
    numbered = cut(ranged.select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("_n")))
    # one row for each range, so their running sum and the broadcast are small
    sums = numbered.groupBy("_part").agg(F.count("*").alias("_size")).select("_part", F.coalesce(F.sum("_size").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    placed = numbered.join(F.broadcast(sums), "_part")
    return placed.withColumn("page_no", F.floor((F.col("_before") + F.col("_n")) / size).cast("long")).drop("_part", "_n", "_before")


def walk(df: DataFrame, size: int, order: str = ASC, spec: CursorSpec = EVENTS):
    """Yields pages one by one, each from the cursor of the one before."""
    args = Args.forward(size)
    while True:
        page = paginate(df, args, order, spec)
        if not page.rows:
            return
        yield page
        if not page.info.has_next_page:
            return
        args = Args.forward(size, page.info.end_cursor)

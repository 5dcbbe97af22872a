"""Registered queries that go through a store: commits, snapshots and subscriptions, with the SQL of their results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlog.functions.scalars import cursor_column, cursor_decode, decode_payload, requested_as, requested_by
from strandlog.operators import fold
from strandlog.operators.cursor import Args, pages
from strandlog.operators.filters import Read, RoutingKey
from strandlog.plans.catalogue import _FLAT, _KEY, _KEY_DESC, _LOG, _RESET, FLAT, _amounts, _log, _reset_handler
from strandlog.plans.projection import Projection
from strandlog.schema import EVENT_COLUMNS, EVENT_KEY, Aggregate
from strandlog.sources.adapters import USER
from strandlog.sources.shared import scratch
from strandlog.sources.store import EventStore, GroupStore, ReadWriteStore
from strandlog.streaming.incremental import incremental_fold
from strandlog.streaming.subscription import Subscription

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
_MIDDLE = "500".rjust(26, "0")
EVENTS = Aggregate(USER, **{n: "amount long" for n in ("click", "error", "purchase", "signup", "view")})


def query(sql: str):
    def register(fn):
        QUERIES[fn.__name__], ORACLE_SQL[fn.__name__] = fn, sql
        return fn

    return register


def _store(spark: SparkSession, *logs: DataFrame) -> EventStore:
    store = EventStore(spark, scratch(spark, "store"))
    for log in logs:
        store.write(log.select(*EVENT_COLUMNS))
    return store


_written: dict[tuple[str, str], EventStore] = {}


def _stored(spark: SparkSession, sf_dir: str) -> EventStore:
    """The log in a store that queries only read; written once by an application."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _written:
        _written[key] = _store(spark, _log(spark, sf_dir))
    return _written[key]


def _halves(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    log = _log(spark, sf_dir)
    return log.where(F.col("id") < _MIDDLE), log.where(F.col("id") >= _MIDDLE)


# scans, pages and projections of a stored log


@query(f"{_LOG} select {_FLAT} from log where aggregator_type = 'app/User'")
def scan_type(spark, sf_dir):
    return _stored(spark, sf_dir).scan([Read(USER)]).select(*FLAT)


@query(f"{_LOG} select {_FLAT} from log where aggregator_id = '42'")
def scan_id(spark, sf_dir):
    return _stored(spark, sf_dir).scan([Read(USER, "42")]).select(*FLAT)


@query(f"{_LOG} select {_FLAT} from log where name = 'purchase'")
def scan_event(spark, sf_dir):
    return _stored(spark, sf_dir).scan([Read(USER, name="purchase")]).select(*FLAT)


@query(f"{_LOG} select {_FLAT} from log where aggregator_id = '7' and name = 'click'")
def scan_id_event(spark, sf_dir):
    return _stored(spark, sf_dir).scan([Read(USER, "7", "click")]).select(*FLAT)


@query(f"{_LOG} select {_FLAT} from log where (aggregator_id = '7' and name = 'click') or name = 'signup' or aggregator_id = '9'")
def scan_multi(spark, sf_dir):
    """pred_and, pred_or, filter_union, distinct_ids: overlapping reads give a row once"""
    return _stored(spark, sf_dir).scan([Read(USER, "7", "click"), Read(USER, name="signup"), Read(USER, "9"), Read(USER, "9", "signup")]).select(*FLAT)


@query(f"{_LOG} select id, ((row_number() over (order by {_KEY}) - 1) // 250)::bigint as page_no from log")
def page_walk(spark, sf_dir):
    return pages(_stored(spark, sf_dir).log(), 250).select("id", "page_no")


_TOTALS = """select aggregator_id, coalesce(sum(amount) filter (name = 'purchase'), 0)::bigint as spent, count(*)::int as n_events, max(version) as version,
  arg_max(name, (timestamp, timestamp_subsec, version, id)) as last_name from log where name in ('purchase', 'error', 'signup') group by 1"""


@query(_LOG + _TOTALS)
def projection_execute(spark, sf_dir):
    """Projection builder, handler, execute: Python handlers over all aggregates"""

    def purchase(state: dict, event: dict) -> None:
        state["spent"] += event["data"]["amount"]
        count(state, event)

    def count(state: dict, event: dict) -> None:
        state["n_events"] += 1
        state["last_name"] = event["name"]

    view = Projection(USER, "spent long, n_events int, last_name string", {"spent": 0, "n_events": 0})
    view = view.handler(EVENTS.purchase, purchase).handler(EVENTS.error, count).handler(EVENTS.signup, count)
    return view.execute(_stored(spark, sf_dir)).select("aggregator_id", "spent", "n_events", "version", "last_name")


@query(_LOG + _TOTALS)
def projection_columns(spark, sf_dir):
    """The same projection written as columns, which stays in the JVM"""
    amount = decode_payload("data", "amount long")["amount"]
    view = Projection(USER, "spent long, n_events int, last_name string").columns(
        *(EVENTS.events[n] for n in ("purchase", "error", "signup")), spent=fold.total(amount, F.col("name") == "purchase"), n_events=F.count("*"), last_name=fold.last(F.col("name"))
    )
    return view.execute(_stored(spark, sf_dir)).select("aggregator_id", "spent", "n_events", "version", "last_name")


@query(f"{_LOG} select aggregator_id, sum(amount)::bigint as total, max(version) as version, true as found, false as other_revision from log where aggregator_id = (select min(aggregator_id) from log) group by 1")
def snapshot_get(spark, sf_dir):
    """get_snapshot: what loading one aggregate has left, by type, id and revision"""
    log = _log(spark, sf_dir)
    one = log.agg(F.min("aggregator_id")).first()[0]
    store = _store(spark, log.where(F.col("aggregator_id") == one))

    def add(state: dict, event: dict) -> None:
        state["total"] += event["data"]["amount"]

    view = Projection(USER, "total long", {"total": 0}, revision="1")
    for spec in EVENTS.events.values():
        view = view.handler(spec, add)
    view.load(store, one)
    data, cursor = store.get_snapshot(USER, "1", one)
    rows = spark.createDataFrame([(one, data, cursor, store.get_snapshot(USER, "2", one) is not None)], "aggregator_id string, data string, cursor string, other_revision boolean")
    held = F.from_json("data", "state struct<total: bigint>, version int")
    return rows.select("aggregator_id", held["state"]["total"].alias("total"), held["version"].alias("version"), F.col("cursor").isNotNull().alias("found"), "other_revision")


@query("select * from (values (1, 'signup', 5::bigint, 'eu', 'me', 'ops'), (2, 'click', 7::bigint, 'eu', 'me', 'ops'), (3, 'view', 9::bigint, 'eu', null, null)) v(version, name, amount, routing_key, requested_by, requested_as)")
def commit(spark, sf_dir):
    """commit, create, aggregator, original_version, routing_key, metadata, requested_by, requested_as, event: what two commits write"""
    store = EventStore(spark, scratch(spark, "store"))
    made = store.create().routing_key("eu").requested_by("me").requested_as("ops").event(EVENTS.signup, amount=5).event(EVENTS.click, amount=7)
    new = made.commit()
    store.aggregate(new).original_version(2).routing_key("us").event(EVENTS.view, amount=9).commit(strict=True)
    amount = decode_payload("data", "amount long")["amount"]
    return store.scan([Read(USER, new)]).select("version", "name", amount.alias("amount"), "routing_key", requested_by().alias("requested_by"), requested_as().alias("requested_as"))


@query(_RESET)
def fold_incremental(spark, sf_dir):
    """incremental_fold: the log as a stream in two parts; the last state of each aggregate is the batch fold's"""
    events = _amounts(spark, sf_dir).select(*fold.BY, *EVENT_KEY, "name", "amount")
    path = scratch(spark, "stream")
    for k, part in enumerate((events.where(F.col("id") < _MIDDLE), events.where(F.col("id") >= _MIDDLE))):
        part.write.parquet(f"{path}/in/part={k}")
    provider = "spark.sql.streaming.stateStore.providerClass"
    was = spark.conf.get(provider)
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for k in (0, 1):  # one run for each part, so an aggregate's events come in their order
            stream = spark.readStream.schema(events.schema).parquet(f"{path}/in/part={{{','.join(map(str, range(k + 1)))}}}")
            folded = incremental_fold(stream, _reset_handler, "balance long, available long")
            keep = lambda df, batch, k=k: df.withColumn("run", F.lit(k)).withColumn("batch", F.lit(batch)).write.mode("append").parquet(f"{path}/out")
            folded.writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(provider, was)
    latest = F.max_by(F.struct("balance", "available"), F.struct("run", "batch")).alias("state")
    return spark.read.parquet(f"{path}/out").groupBy("aggregator_id").agg(latest).select("aggregator_id", "state.balance", "state.available")


# stores


@query(f"{_LOG} select {_FLAT} from log")
def store_append(spark, sf_dir):
    """write, occ_check: two commits, read back as one log"""
    return _store(spark, *_halves(spark, sf_dir)).scan([Read(USER)]).select(*FLAT)


@query(f"{_LOG} select {_FLAT} from log where name = 'signup' and routing_key is null")
def store_compact(spark, sf_dir):
    """persist, compaction: the rewritten log answers as before"""
    store = _store(spark, *_halves(spark, sf_dir))
    store.compact()
    return store.scan([Read(USER, name="signup")], RoutingKey.value(None)).select(*FLAT)


@query(f"{_LOG} select {_FLAT} from log order by {_KEY_DESC} limit 20")
def store_read_write(spark, sf_dir):
    """src_rw, src_group: pages over a pair of stores behind one handle"""
    one, two = (_store(spark, half) for half in _halves(spark, sf_dir))
    both = ReadWriteStore(GroupStore(one, two), one)
    return both.read([Read(USER)], args=Args.forward(20), order="desc").frame.select(*FLAT)


@query(f"{_LOG} select aggregator_id, sum(amount)::bigint as total from log group by 1")
def store_snapshots(spark, sf_dir):
    """save_snapshot, get_snapshot: saved twice by (type, id, revision), the later state stays"""
    store, events = _store(spark, _log(spark, sf_dir)), _amounts(spark, sf_dir)
    for some in (events.where(F.col("version") < 5), events):
        state = fold.algebraic(some.withColumn("cursor", cursor_column()), fold.BY, data=F.to_json(F.struct(F.sum("amount").alias("total"))), cursor=fold.last(F.col("cursor")))
        store.save_snapshots(state.withColumn("revision", F.lit("1")))
    return store.snapshots().select("aggregator_id", F.from_json("data", "total long")["total"].alias("total"))


def _read_model(subscription: Subscription, *runs) -> DataFrame:
    """Follows the store in one or more runs; the handler keeps (id, key, name) of what it gets."""
    store = subscription.store
    path = f"{store.root}/read_model"

    def keep(df: DataFrame) -> None:
        df.select("aggregator_id", *fold.EVENT_KEY, "name").write.mode("append").parquet(path)

    for spec in EVENTS.events.values():
        if spec.name != "view":
            subscription = subscription.on(spec, keep)
    for run in runs or (lambda: None,):
        run()
        subscription.execute()
    return store.spark.read.parquet(path)


_STATUS = "select aggregator_id, name as status from (select *, row_number() over (partition by aggregator_id order by {order}) as r from log where name <> 'view' {where}) where r = 1"


@query(_LOG + _STATUS.format(order=_KEY_DESC, where="and routing_key = 'us-east-1'"))
def subscription_filtered(spark, sf_dir):
    """sub_execute, routing_key, ack: a read model of one routing key"""
    rows = _read_model(Subscription(_store(spark, _log(spark, sf_dir)), "status").routing_key("us-east-1"))
    return fold.algebraic(rows, ("aggregator_id",), status=fold.last(F.col("name")))


@query(_LOG + _STATUS.format(order=_KEY_DESC, where=""))
def subscription_incremental(spark, sf_dir):
    """Two runs, with commits in between, give what one run gives"""
    first, second = _halves(spark, sf_dir)
    store = _store(spark)
    rows = _read_model(Subscription(store, "status").all(), lambda: store.write(first.select(*EVENT_COLUMNS)), lambda: store.write(second.select(*EVENT_COLUMNS)))
    return fold.algebraic(rows, ("aggregator_id",), status=fold.last(F.col("name")))


@query(f"{_LOG} select name, count(*) as n_events from log group by 1")
def subscription_all_events(spark, sf_dir):
    """subscription_all: every event of a type"""
    store = _store(spark, *_halves(spark, sf_dir))
    path = f"{store.root}/audit"
    Subscription(store, "audit").all().on_all(USER, lambda df: df.select("id", "name").write.mode("append").parquet(path)).execute()
    return spark.read.parquet(path).groupBy("name").agg(F.count("*").alias("n_events"))


@query(f"{_LOG} select 'status' as key, true as running, max(timestamp) as cursor_timestamp, 0::bigint as lag_seconds from log where routing_key is null and name <> 'view'")
def subscriber_state(spark, sf_dir):
    """upsert_subscriber, acknowledge, get_subscriber_cursor, is_subscriber_running: the control row after a run"""
    store = _store(spark, _log(spark, sf_dir))
    subscription = Subscription(store, "status")
    _read_model(subscription)
    row = store.subscriber(subscription.full_key)
    running = store.is_running(subscription.full_key, row["worker_id"])
    return spark.createDataFrame([(row["key"], running, cursor_decode(row["cursor"])[0], row["lag_seconds"])], "key string, running boolean, cursor_timestamp long, lag_seconds long")

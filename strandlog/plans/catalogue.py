"""The registered queries on event logs, each with the SQL that states its meaning."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlog.functions import scalars
from strandlog.operators import fold, relations
from strandlog.operators.cursor import ASC, DESC, Args, CursorSpec, paginate
from strandlog.operators.filters import Read, RoutingKey, project, scan
from strandlog.schema import type_name
from strandlog.sources import adapters
from strandlog.sources.adapters import USER

FLAT = ("id", "aggregator_type", "aggregator_id", "version", "name", "routing_key", "data", "timestamp", "timestamp_subsec")
QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

_LOG = """
with log as (
  select lpad(event_id::varchar, 26, '0') as id, 'app/User' as aggregator_type, user_id::varchar as aggregator_id,
    row_number() over (partition by user_id order by ts, event_id)::int as version, event_type as name,
    case user_id % 3 when 0 then 'us-east-1' when 1 then 'eu-west-3' end as routing_key,
    '{"amount":' || round(value * 100)::bigint || '}' as data, round(value * 100)::bigint as amount,
    epoch_us(ts) // 1000000 as timestamp, ((epoch_us(ts) // 1000) % 1000)::int as timestamp_subsec, ts, event_id, user_id
  from events)
"""
_FLAT = ", ".join(FLAT)
_KEY = "timestamp, timestamp_subsec, version, id"
_KEY_DESC = "timestamp desc, timestamp_subsec desc, version desc, id desc"


def query(sql: str | None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLE_SQL[fn.__name__] = sql
        return fn

    return register


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapters.user_events(spark, sf_dir)


def _amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _log(spark, sf_dir).withColumn("amount", scalars.decode_payload("data", "amount long")["amount"])


def _by_id(folded: DataFrame) -> DataFrame:
    """States of a log of one type."""
    return folded.drop("aggregator_type")


def _rows(df: DataFrame) -> DataFrame:
    return df.select(*FLAT)


# scans and predicates


@query(f"{_LOG} select {_FLAT} from log")
def event_log(spark, sf_dir):
    """project_columns, scan_all"""
    return _rows(project(scan(_log(spark, sf_dir))))


@query(f"{_LOG} select {_FLAT} from log where name = 'view' and timestamp_subsec = 7")
def pred_eq(spark, sf_dir):
    return _rows(_log(spark, sf_dir).where((F.col("name") == "view") & (F.col("timestamp_subsec") == 7)))


@query(f"{_LOG} select {_FLAT} from log where routing_key = 'us-east-1'")
def routing_value(spark, sf_dir):
    """scan_routing, pred_routing_value"""
    return _rows(scan(_log(spark, sf_dir), None, RoutingKey.value("us-east-1")))


@query(f"{_LOG} select {_FLAT} from log where routing_key is null")
def routing_null(spark, sf_dir):
    """pred_routing_null"""
    return _rows(scan(_log(spark, sf_dir), None, RoutingKey.value(None)))


@query(f"{_LOG} select {_FLAT} from log")
def routing_all(spark, sf_dir):
    """pred_routing_all"""
    return _rows(scan(_log(spark, sf_dir), None, RoutingKey.ALL))


@query(f"{_LOG} select id, amount from log")
def decode_payload(spark, sf_dir):
    return _amounts(spark, sf_dir).select("id", "amount")


@query(f"{_LOG} select id, case name when 'purchase' then amount when 'error' then -1 end as handled from log where name in ('purchase', 'error')")
def dispatch(spark, sf_dir):
    """dispatch by (type, name), skip: other names fall through"""
    typed = F.col("aggregator_type") == USER
    value = F.when(typed & (F.col("name") == "purchase"), F.col("amount")).when(typed & (F.col("name") == "error"), F.lit(-1))
    return _amounts(spark, sf_dir).where(typed & F.col("name").isin("purchase", "error")).select("id", value.cast("long").alias("handled"))


# pages

_MIDDLE = [1704844800, 0, 0, ""]
_MIDDLE_SQL = "(1704844800, 0, 0, '')"


def _page_sql(descending: bool, backward: bool, size: int = 25) -> str:
    down = descending ^ backward
    side = f"({_KEY}) {'<' if down else '>'} {_MIDDLE_SQL}"
    order = _KEY_DESC if down else _KEY
    return f"""{_LOG}, probe as (select *, row_number() over (order by {order}) as r from log where {side}),
few as (select * from probe where r <= {size + 1})
select {_FLAT}, (select count(*) from few) > {size} as has_more from few where r <= {size}"""


def _page(spark, sf_dir, order, args):
    return paginate(scan(_log(spark, sf_dir), [Read(USER)]), args, order).frame.select(*FLAT, "has_more")


_AT = scalars.cursor_encode(_MIDDLE)


@query(_page_sql(False, False))
def page_forward_asc(spark, sf_dir):
    """sort_key, keyset_gt, forward"""
    return _page(spark, sf_dir, ASC, Args.forward(25, _AT))


@query(_page_sql(True, False))
def page_forward_desc(spark, sf_dir):
    """order_flip, keyset_lt"""
    return _page(spark, sf_dir, DESC, Args.forward(25, _AT))


@query(_page_sql(False, True))
def page_backward_asc(spark, sf_dir):
    """backward, is_backward, page_info"""
    return _page(spark, sf_dir, ASC, Args.backward(25, _AT))


@query(_page_sql(True, True))
def page_backward_desc(spark, sf_dir):
    return _page(spark, sf_dir, DESC, Args.backward(25, _AT))


@query(
    """with probe as (
  select *, row_number() over (order by o_totalprice desc, o_orderkey) as r from orders
  where o_totalprice < 400000.0 or (o_totalprice = 400000.0 and o_orderkey > 100)),
few as (select * from probe where r <= 31)
select o_orderkey, o_totalprice, (select count(*) from few) > 30 as has_more from few where r <= 30"""
)
def page_custom_key(spark, sf_dir):
    """bind_custom: a keyset over the columns of another table, of mixed direction"""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_totalprice")
    spec = CursorSpec(("-o_totalprice", "o_orderkey"))
    return paginate(orders, Args.forward(30, scalars.cursor_encode([400000.0, 100])), ASC, spec).frame.select("o_orderkey", "o_totalprice", "has_more")


@query(f"{_LOG} select {_FLAT}, true as has_more from log order by {_KEY} limit 5")
def args_limit_cap(spark, sf_dir):
    return _page(spark, sf_dir, ASC, Args.forward(10).limit(5))


@query(f"{_LOG} select {_FLAT}, true as has_more from log order by {_KEY} limit 40")
def page_default(spark, sf_dir):
    """default limit 40"""
    return _page(spark, sf_dir, ASC, Args())


@query(f"{_LOG} select id, to_base64(('[' || timestamp || ',' || timestamp_subsec || ',' || version || ',\"' || id || '\"]')::blob) as cursor from log")
def cursor_encode(spark, sf_dir):
    return _log(spark, sf_dir).select("id", F.translate(scalars.cursor_column(), "-_", "+/").alias("cursor"))


# whole-log questions


@query(f"{_LOG} select id, timestamp, timestamp_subsec, version, id as event_id from log")
def cursor_decode(spark, sf_dir):
    """Cursors back into their key values, in the JVM"""
    decoded = _log(spark, sf_dir).select("id", scalars.cursor_values(scalars.cursor_column()).alias("at"))
    return decoded.select("id", "at.timestamp", "at.timestamp_subsec", "at.version", F.col("at.id").alias("event_id"))


@query(f"{_LOG} select id, aggregator_type || '_' || name as handler, coalesce(routing_key || '.', '') || 'orders' as subscriber from log")
def subscriber_key(spark, sf_dir):
    """subscriber_key, handler_key, agg_type_name as columns"""
    kind = F.lit(type_name("app", "User"))
    return _log(spark, sf_dir).select("id", scalars.handler_key(kind, "name").alias("handler"), scalars.subscriber_key_column("orders", "routing_key").alias("subscriber"))


@query(f"{_LOG} select aggregator_id, bool_or(name = 'purchase') as has_event from log group by 1")
def has_event(spark, sf_dir):
    return relations.has_event(_log(spark, sf_dir), "purchase").select("aggregator_id", "has_event")


@query(f"{_LOG} select aggregator_id, max(version) as last_version from log group by 1")
def last_version(spark, sf_dir):
    return relations.last_version(_log(spark, sf_dir)).select("aggregator_id", "last_version")


@query(f"{_LOG} select aggregator_id, version as state_version from (select *, row_number() over (partition by aggregator_id order by {_KEY_DESC}) as r from log) where r = 1")
def state_version(spark, sf_dir):
    return relations.state_version(_log(spark, sf_dir)).select("aggregator_id", "state_version")


@query(f"{_LOG} select max(timestamp) as newest_timestamp from log where name = 'error'")
def newest_timestamp(spark, sf_dir):
    return scan(_log(spark, sf_dir), [Read(USER, name="error")]).agg(F.max("timestamp").alias("newest_timestamp"))


@query(f"{_LOG} select id, (100 + row_number() over (partition by aggregator_id order by event_id))::int as version from log")
def assign_version(spark, sf_dir):
    return relations.assign_version(_log(spark, sf_dir).drop("version"), ("id",), 100).select("id", "version")


@query(f"{_LOG} select aggregator_id, routing_key from (select *, row_number() over (partition by aggregator_id order by {_KEY}) as r from log) where r = 1")
def sticky_routing(spark, sf_dir):
    return relations.sticky_routing(_log(spark, sf_dir)).select("aggregator_id", "routing_key")


@query(f"{_LOG} select routing_key from log order by {_KEY_DESC} limit 1")
def last_routing_key(spark, sf_dir):
    return relations.last_routing_key(_log(spark, sf_dir))


@query(f"{_LOG} select id, (select max(timestamp) from log) - timestamp as lag_seconds from log")
def event_lag(spark, sf_dir):
    return relations.event_lag(_log(spark, sf_dir)).select("id", "lag_seconds")


@query(
    f"""{_LOG} select id, version, previous_version from (
  select *, coalesce(lag(version) over (partition by aggregator_id order by version), 0) as previous_version from log where name <> 'view')
where version <> previous_version + 1"""
)
def gap_check(spark, sf_dir):
    return relations.gap_check(_log(spark, sf_dir).where(F.col("name") != "view")).select("id", "version", "previous_version")


# folds

_BALANCE = "case name when 'purchase' then amount when 'signup' then amount when 'error' then -amount else 0 end"


def _balance():
    return F.when(F.col("name").isin("purchase", "signup"), F.col("amount")).when(F.col("name") == "error", -F.col("amount")).otherwise(0)


@query(f"{_LOG} select aggregator_id, sum({_BALANCE})::bigint as balance, count(*) as n_events from log group by 1")
def fold_sum(spark, sf_dir):
    return _by_id(fold.algebraic(_amounts(spark, sf_dir), balance=fold.total(_balance()), n_events=F.count("*")))


@query(
    f"""{_LOG} select aggregator_id, name as last_name,
  (select amount from log p where p.aggregator_id = l.aggregator_id and p.name = 'purchase' order by {_KEY_DESC} limit 1) as last_purchase
from (select *, row_number() over (partition by aggregator_id order by {_KEY_DESC}) as r from log) l where r = 1"""
)
def fold_last(spark, sf_dir):
    events = _amounts(spark, sf_dir)
    return _by_id(fold.algebraic(events, last_name=fold.last(F.col("name")), last_purchase=fold.last(F.col("amount"), F.col("name") == "purchase")))


@query(
    f"""{_LOG} select aggregator_id, coalesce((select amount from log p where p.aggregator_id = l.aggregator_id and p.name = 'signup' order by {_KEY} limit 1), 0) as opening,
  1000::bigint as daily_limit from (select distinct aggregator_id from log) l"""
)
def fold_init(spark, sf_dir):
    opening = F.coalesce(fold.first(F.col("amount"), F.col("name") == "signup"), F.lit(0).cast("long"))
    return _by_id(fold.algebraic(_amounts(spark, sf_dir), opening=opening, daily_limit=F.lit(1000).cast("long")))


@query(
    f"""{_LOG} select aggregator_id, case name when 'error' then 'Frozen' when 'signup' then 'Active' else 'Closed' end as status,
  name = 'signup' as is_active, name = 'error' as is_frozen, name = 'purchase' as is_closed
from (select *, row_number() over (partition by aggregator_id order by {_KEY_DESC}) as r from log where name in ('signup', 'error', 'purchase')) where r = 1"""
)
def fold_multi_flag(spark, sf_dir):
    name = F.col("name")
    status = F.when(name == "error", "Frozen").when(name == "signup", "Active").otherwise("Closed")
    flags = F.struct(status.alias("status"), (name == "signup").alias("is_active"), (name == "error").alias("is_frozen"), (name == "purchase").alias("is_closed"))
    some = scan(_log(spark, sf_dir), [Read(USER, name=n) for n in ("signup", "error", "purchase")])
    return fold.algebraic(some, flags=fold.last(flags)).select("aggregator_id", "flags.*")


# signup sets balance and available; error resets available to balance + amount; others add to or take from both
_RESET = f"""{_LOG}, recursive_rows as (select *, row_number() over (partition by aggregator_id order by {_KEY}) as r from log),
lists as (select aggregator_id, list({{'name': name, 'amount': amount}} order by r) as l from recursive_rows group by 1),
folded as (select aggregator_id, list_reduce(list_prepend({{'name': '', 'b': 0::bigint, 'a': 0::bigint}}, list_transform(l, lambda x: {{'name': x.name, 'b': x.amount, 'a': 0::bigint}})),
  lambda s, e: {{'name': '',
    'b': case e.name when 'signup' then e.b when 'purchase' then s.b - e.b when 'click' then s.b + e.b else s.b end,
    'a': case e.name when 'signup' then e.b when 'purchase' then s.a - e.b when 'click' then s.a + e.b when 'error' then s.b + e.b else s.a end}}) as s from lists)
select aggregator_id, s.b as balance, s.a as available from folded"""


def _reset(state, event):
    name, amount = event["name"], event["amount"]
    return {
        "balance": F.when(name == "signup", amount).when(name == "purchase", state["balance"] - amount).when(name == "click", state["balance"] + amount).otherwise(state["balance"]),
        "available": F.when(name == "signup", amount)
        .when(name == "purchase", state["available"] - amount)
        .when(name == "click", state["available"] + amount)
        .when(name == "error", state["balance"] + amount)
        .otherwise(state["available"]),
    }


@query(_RESET)
def fold_reset_then_add(spark, sf_dir):
    zero = F.lit(0).cast("long")
    return _by_id(fold.ordered(_amounts(spark, sf_dir), {"balance": zero, "available": zero}, _reset, ("name", "amount")))


def _reset_handler(state: dict, event: dict) -> None:
    balance, available = state["balance"] or 0, state["available"] or 0
    match event["name"]:
        case "signup":
            balance = available = event["amount"]
        case "purchase":
            balance, available = balance - event["amount"], available - event["amount"]
        case "click":
            balance, available = balance + event["amount"], available + event["amount"]
        case "error":
            available = balance + event["amount"]
    state["balance"], state["available"] = balance, available


@query(_RESET)
def fold_custom(spark, sf_dir):
    """fold by a Python handler"""
    events = _amounts(spark, sf_dir).select(*fold.BY, *fold.EVENT_KEY, "name", "amount")
    return _by_id(fold.custom(events, _reset_handler, "balance long, available long"))


@query(f"{_LOG} select id, (sum({_BALANCE}) over (partition by aggregator_id order by {_KEY} rows between unbounded preceding and current row))::bigint as balance from log")
def running_state(spark, sf_dir):
    return fold.running(_amounts(spark, sf_dir), balance=F.sum(_balance())).select("id", "balance")


@query(f"{_LOG} select name, count(*) as n_events from log where name not in ('click', 'purchase', 'signup') group by 1")
def projection_safety(spark, sf_dir):
    """safety_check"""
    return relations.unhandled(_log(spark, sf_dir), ("click", "purchase", "signup"))


# snapshots

_CUT = 1705276800


@query(f"{_LOG} select aggregator_id, sum({_BALANCE})::bigint as balance, max(version) as version from log group by 1")
def snapshot_resume(spark, sf_dir):
    """snapshot_join, incremental fold: the state at a cut and the tail beyond each snapshot's cursor give the full fold"""
    events = _amounts(spark, sf_dir)
    at = fold.last(F.struct(*fold.EVENT_KEY))
    snap = fold.algebraic(events.where(F.col("timestamp") < _CUT), fold.BY, snap_balance=fold.total(_balance()), at=at, snap_version=F.max("version"))
    snap = snap.select(*fold.BY, "snap_balance", "snap_version", *[F.col(f"at.{k}").alias(f"at_{k}") for k in fold.EVENT_KEY])
    tail = fold.algebraic(relations.after_cursor(events, snap), fold.BY, tail_balance=fold.total(_balance()), tail_version=F.max("version"))
    both = snap.join(tail, list(fold.BY), "full")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    return both.select("aggregator_id", (zero(F.col("snap_balance")) + zero(F.col("tail_balance"))).alias("balance"), F.greatest("snap_version", "tail_version").alias("version"))


@query(f"{_LOG} select aggregator_id, timestamp, timestamp_subsec, version, id from (select *, row_number() over (partition by aggregator_id order by {_KEY_DESC}) as r from log where timestamp < {_CUT}) where r = 1")
def snapshot_cursor(spark, sf_dir):
    events = _log(spark, sf_dir).where(F.col("timestamp") < _CUT)
    return fold.algebraic(events, at=fold.last(F.struct(*fold.EVENT_KEY))).select("aggregator_id", "at.*")


# several aggregates, several stores


@query(
    """select o_orderkey, c_name as owner_name, count(l_orderkey) as n_lines, sum(round(l_extendedprice * 100)::bigint)::bigint as total_cents
from orders join customer on c_custkey = o_custkey left join lineitem on l_orderkey = o_orderkey group by 1, 2"""
)
def multi_aggregate(spark, sf_dir):
    """Order state from its own events and those of its owner, an aggregate that it is linked to"""
    orders, customers, lines = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("orders", "customer", "lineitem"))

    def events(rows: DataFrame, kind: str, name: str, id_: str, version, text, cents) -> DataFrame:
        made = {"aggregator_type": F.lit(kind), "name": F.lit(name), "aggregator_id": F.col(id_).cast("string"), "version": version, "text": text, "cents": cents}
        made |= {"timestamp": F.lit(0).cast("long"), "timestamp_subsec": F.lit(0), "id": F.concat(F.lit(name), F.col(id_).cast("string"))}
        return rows.select(*[c.alias(n) for n, c in made.items()])

    none, no_cents = F.lit(None).cast("string"), F.lit(None).cast("long")
    roots = events(orders, "shop/Order", "Placed", "o_orderkey", F.lit(1), none, no_cents)
    sold = F.round(F.col("l_extendedprice") * 100).cast("long")
    roots = roots.unionByName(events(lines, "shop/Order", "LineAdded", "l_orderkey", (F.col("l_linenumber") + 1).cast("int"), none, sold))
    owners = events(customers, "shop/Customer", "Named", "c_custkey", F.lit(1), F.col("c_name"), no_cents)
    link = orders.select(F.col("o_orderkey").cast("string").alias("root_id"), F.col("o_custkey").cast("string").alias("linked_id"))
    both = relations.linked(roots, owners, link)
    line = F.col("name") == "LineAdded"
    state = fold.algebraic(both, ("root_id",), owner_name=fold.last(F.col("text"), F.col("name") == "Named"), n_lines=F.count(F.when(line, 1)), total_cents=F.sum("cents"))
    return state.select(F.col("root_id").cast("long").alias("o_orderkey"), "owner_name", "n_lines", "total_cents")


@query(
    """with changed as (select c_custkey, arg_max(name, v) as name from (
  select c_custkey, c_name || '!' as name, 1 as v from customer where c_custkey % 3 = 0 union all
  select c_custkey, c_name || '!!', 2 from customer where c_custkey % 6 = 0) group by 1)
select o_orderkey, case when changed.name is not null then changed.name else customer.c_name end as owner_name
from orders join customer on customer.c_custkey = o_custkey left join changed on changed.c_custkey = o_custkey"""
)
def fanout_update(spark, sf_dir):
    """Owners' latest name changes reach every order of theirs"""
    orders, customers = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("orders", "customer"))
    rows = orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", F.col("o_custkey").cast("string").alias("owner_id"), F.col("c_name").alias("owner_name"))

    def renamed(every: int, mark: str, version: int) -> DataFrame:
        key = F.col("c_custkey")
        return customers.where(key % every == 0).select(key.cast("string").alias("aggregator_id"), F.concat("c_name", F.lit(mark)).alias("value"), F.lit(version).alias("version"), F.lit(0).alias("timestamp"), F.lit(0).alias("timestamp_subsec"), F.lit("").alias("id"))

    changes = relations.union(renamed(3, "!", 1), renamed(6, "!!", 2))
    return relations.fan_out(rows, "owner_id", changes, owner_name=F.col("value")).select("o_orderkey", "owner_name")


@query(f"{_LOG} select {_FLAT}, true as has_more from log order by {_KEY} limit 30")
def group_union(spark, sf_dir):
    """src_group: two stores read as one, paged over the union"""
    log, user = _log(spark, sf_dir), F.col("aggregator_id").cast("long")
    both = relations.union(log.where(user % 2 == 0), log.where(user % 2 == 1))
    return paginate(both, Args.forward(30)).frame.select(*FLAT, "has_more")


@query(f"{_LOG} select {_FLAT} from log where aggregator_id = '5' union all select {_FLAT} from log where aggregator_id = '5'")
def group_union_dup(spark, sf_dir):
    log = _log(spark, sf_dir)
    return _rows(scan(relations.union(log, log), [Read(USER, "5")]))


@query(
    f"""{_LOG}, batch as (select aggregator_id, (version + case when user_id % 2 = 0 then 0 else 1000 end)::int as version, id from log where name = 'signup')
select b.id, b.aggregator_id, b.version from batch b where exists (select 1 from log l where l.aggregator_id = b.aggregator_id and l.version = b.version)"""
)
def occ_conflict(spark, sf_dir):
    log = _log(spark, sf_dir)
    shift = F.when(F.col("aggregator_id").cast("long") % 2 == 0, 0).otherwise(1000)
    batch = log.where(F.col("name") == "signup").select("id", "aggregator_type", "aggregator_id", (F.col("version") + shift).alias("version"))
    return relations.conflicts(batch, log).select("id", "aggregator_id", "version")


@query(f"{_LOG} select distinct aggregator_id from log l where not exists (select 1 from log p where p.aggregator_id = l.aggregator_id and p.name = 'purchase')")
def no_events(spark, sf_dir):
    log = _log(spark, sf_dir)
    return relations.no_events(log.select(*fold.BY).distinct(), scan(log, [Read(USER, name="purchase")])).select("aggregator_id")


@query(
    f"""{_LOG}, handlers as (select * from (values ('app/User', 'purchase', 'buy'), ('app/User', 'error', 'fail')) h(t, n, handler))
select id, handler from log join handlers on t = aggregator_type and n = name"""
)
def handler_join(spark, sf_dir):
    registry = spark.createDataFrame([(USER, "purchase", "buy"), (USER, "error", "fail")], "aggregator_type string, name string, handler string")
    return _log(spark, sf_dir).join(F.broadcast(registry), ["aggregator_type", "name"]).select("id", "handler")


@query(
    """select conv_id::varchar as aggregator_id, count(*) as turns, arg_max(role, turn) as last_role,
  (select text from conversations f where f.conv_id = c.conv_id and f.role = 'user' order by turn limit 1) as first_user_text
from conversations c group by conv_id"""
)
def conversation_fold(spark, sf_dir):
    events = adapters.conversation_events(spark, sf_dir)
    text = scalars.decode_payload("data", "text string")["text"]
    return _by_id(fold.algebraic(events, turns=F.count("*"), last_role=fold.last(F.col("name")), first_user_text=fold.first(text, F.col("name") == "user")))


# scalar functions


@query(f"{_LOG} select id, timestamp, timestamp_subsec from log")
def split_time(spark, sf_dir):
    return _log(spark, sf_dir).select("id", "timestamp", "timestamp_subsec")


@query(f"{_LOG} select id, aggregator_type || '_' || name as handler_key from log")
def handler_key(spark, sf_dir):
    return _log(spark, sf_dir).select("id", scalars.handler_key("aggregator_type", "name").alias("handler_key"))


@query(f"{_LOG} select id, case when user_id % 2 = 0 then 'u' || user_id end as requested_by, null::varchar as missing from log")
def metadata_get(spark, sf_dir):
    user = F.col("aggregator_id").cast("long")
    meta = F.when(user % 2 == 0, F.create_map(F.lit("requested_by"), F.concat(F.lit("u"), "aggregator_id"))).otherwise(F.create_map().cast("map<string,string>"))
    log = _log(spark, sf_dir).withColumn("metadata", F.struct(F.col("id").alias("id"), meta.alias("meta")))
    return log.select("id", scalars.requested_by().alias("requested_by"), scalars.metadata_get("none").alias("missing"))


@query(None)
def hash_ids(spark, sf_dir):
    """SHA3-256; DuckDB has none, so it is tested against hashlib"""
    return _log(spark, sf_dir).select("id", scalars.hash_id_column(F.concat("aggregator_type", "aggregator_id")).alias("hash"))

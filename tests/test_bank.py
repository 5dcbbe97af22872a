"""The bank's scenarios from end to end."""

from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from strandlog.examples import bank
from strandlog.examples.bank import ACCOUNT, OWNER, Bank
from strandlog.functions.scalars import ulid
from strandlog.operators.relations import last_routing_key
from strandlog.plans.projection import NoHandler, Projection
from strandlog.sources.store import EventStore, InvalidOriginalVersion
from strandlog.streaming.subscription import Subscription


@pytest.fixture
def store(spark, tmp_path):
    return EventStore(spark, str(tmp_path / "store"))


def test_load(store):
    b = Bank(store)
    john, jane = b.open_account("owner_john", "John Doe", initial_balance=1000), b.open_account("owner_jane", "Jane Smith", "Savings", "EUR", 500)
    assert (b.load(john).balance, b.load(john).version, b.load(jane).balance) == (1000, 1, 500)
    b.deposit(john, 250)
    b.transfer(john, 300, jane)
    b.receive(jane, 300, john)
    assert (b.load(john).balance, b.load(john).version) == (950, 3)
    assert (b.load(jane).balance, b.load(jane).version) == (800, 2)
    assert b.load("none") is None
    frame = {r["aggregator_id"]: (r["balance"], r["version"]) for r in bank.command_state().execute(store).collect()}
    assert frame == {john: (950, 3), jane: (800, 2)}
    one = bank.command_state().execute(store, [jane]).collect()
    assert [(r["aggregator_id"], r["cursor"]) for r in one] == [(jane, b.load(jane).cursor)]


def test_routing_key(store):
    b = Bank(store)
    a = b.open_account("o", "n", initial_balance=10, routing_key="eu")
    assert last_routing_key(store.log()).first()[0] == "eu"
    b.deposit(a, 5, routing_key="us")
    assert last_routing_key(store.log()).first()[0] == "eu"
    c = b.open_account("o", "n", initial_balance=10)
    b.deposit(c, 5, routing_key="us")
    assert last_routing_key(store.log()).first()[0] is None


def test_multiple_aggregates(store):
    b = Bank(store)
    owner = store.create().event(OWNER.Created, name="Ann").commit()
    a = b.open_account(owner, "Ann", initial_balance=100)
    view = bank.details_view()
    assert view.load(store, a, {OWNER.aggregator_type: owner}).owner_name == "Ann"
    store.aggregate(owner).original_version(1).event(OWNER.NameChanged, value="Bea").commit()
    loaded = view.load(store, a, {OWNER.aggregator_type: owner})
    assert loaded.owner_name == "Bea" and loaded.version == 1  # the root's version, not the owner's
    with pytest.raises(ValueError):
        view.load(store, a)
    links = store.spark.createDataFrame([(a, owner)], "root_id string, linked_id string")
    row = view.execute(store, links={OWNER.aggregator_type: links}).first()
    assert (row["owner_name"], row["balance"], row["version"]) == ("Bea", 100, 1)


def test_snapshots(store):
    b = Bank(store, revision="1")
    a = b.open_account("o", "n", initial_balance=100)
    for n in (1, 2, 3):
        b.deposit(a, n)
    assert b.load(a).balance == 106 and b.load(a).version == 4
    data, cursor = store.get_snapshot(ACCOUNT.aggregator_type, "1", a)
    assert '"balance": 106' in data and cursor == b.load(a).cursor
    assert store.get_snapshot(ACCOUNT.aggregator_type, "2", a) is None
    assert Bank(store, revision="2").load(a).balance == 106


def test_version_conflict(store):
    b = Bank(store)
    a = b.open_account("o", "n", initial_balance=100)
    stale = b.load(a)
    b.deposit(a, 1)
    with pytest.raises(InvalidOriginalVersion):
        stale.append().event(ACCOUNT.MoneyDeposited, amount=5, transaction_id="", description="").commit()
    assert b.load(a).balance == 101


def test_all_commands(store):
    b = Bank(store)
    a = b.open_account("o", "n", initial_balance=5000)
    b.deposit(a, 2500)
    b.withdraw(a, 500)
    b.transfer(a, 1000, "x")
    b.receive(a, 10, "x")
    b.change_overdraft(a, 500)
    view = bank.balance_view().load(store, a)
    assert (view.balance, view.available_balance) == (6010, 6510)
    b.change_daily_limit(a, 100)
    b.freeze(a)
    with pytest.raises(bank.AccountFrozen):
        b.withdraw(a, 1)
    b.receive(a, 1, "y")
    status = bank.status_view().load(store, a)
    assert (status.status, status.is_frozen, status.is_active) == ("Frozen", True, False)
    b.unfreeze(a)
    with pytest.raises(bank.InsufficientFunds):
        b.withdraw(a, 6512)
    with pytest.raises(bank.InvalidAmount):
        b.deposit(a, 0)
    b.withdraw(a, 6011)
    b.close(a)
    with pytest.raises(bank.AccountClosed):
        b.deposit(a, 1)
    with pytest.raises(bank.NotFound):
        b.deposit("none", 1)
    done = b.load(a)
    assert (done.balance, done.status, done.version) == (0, "Closed", 12)
    details = bank.details_view().load(store, a, {OWNER.aggregator_type: "o"})
    assert (details.daily_withdrawal_limit, details.overdraft_limit, details.status) == (100, 500, "Closed")


def test_safety(store):
    b = Bank(store)
    a = b.open_account("o", "n", initial_balance=1)
    b.deposit(a, 1)
    loose = Projection(ACCOUNT.aggregator_type, "n long", {"n": 0}).handler(ACCOUNT.AccountOpened, lambda s, e: s.update(n=s["n"] + 1))
    assert loose.load(store, a).n == 1
    with pytest.raises(NoHandler):
        loose.safety_check().load(store, a)
    with pytest.raises(ValueError):
        loose.handler(ACCOUNT.AccountOpened, lambda s, e: None)


def statuses():
    rows = {}

    def handler(status):
        def run(event):
            rows[event["aggregator_id"]] = (status, event["version"])

        return run

    return rows, handler


def subscription(store, key, handler):
    return Subscription(store, key).on(ACCOUNT.AccountOpened, handler("Active"), each=True).on(ACCOUNT.AccountFrozen, handler("Frozen"), each=True)


def test_subscribe(store):
    b = Bank(store)
    a, other = b.open_account("o", "n", initial_balance=1), b.open_account("o", "n", initial_balance=1, routing_key="eu")
    rows, handler = statuses()
    s = subscription(store, "status", handler).all()
    s.execute()
    assert rows == {a: ("Active", 1), other: ("Active", 1)}
    rows.clear()
    s.execute()
    assert rows == {}  # nothing new
    b.freeze(a)
    b.deposit(other, 1)
    s.execute()
    assert rows == {a: ("Frozen", 2)}
    assert store.get_cursor(s.full_key) and store.subscriber(s.full_key)["lag_seconds"] == 0
    replay, handler = statuses()
    subscription(store, "again", handler).all().execute()
    assert replay == {a: ("Frozen", 2), other: ("Active", 1)}


def test_subscribe_routing(store):
    b = Bank(store)
    plain, eu = b.open_account("o", "n", initial_balance=1), b.open_account("o", "n", initial_balance=1, routing_key="eu")
    rows, handler = statuses()
    subscription(store, "k", handler).execute()
    assert set(rows) == {plain}
    rows, handler = statuses()
    subscription(store, "k", handler).routing_key("eu").execute()
    assert set(rows) == {eu}
    rows, handler = statuses()
    subscription(store, "one", handler).all().aggregator(ACCOUNT.aggregator_type, eu).execute()
    assert set(rows) == {eu}


def test_subscribe_all_and_frames(store):
    b = Bank(store)
    a = b.open_account("o", "n", initial_balance=1)
    b.deposit(a, 1)
    store.compact()
    seen, frames = [], []
    Subscription(store, "audit").on_all(ACCOUNT.aggregator_type, lambda e: seen.append(e["name"]), each=True).execute()
    assert seen == ["AccountOpened", "MoneyDeposited"]
    Subscription(store, "frames").on(ACCOUNT.MoneyDeposited, lambda df: frames.append([r["version"] for r in df.collect()])).execute()
    assert frames == [[2]]
    chunks = []
    Subscription(store, "chunks").chunk_size(1).on_all(ACCOUNT.aggregator_type, lambda df: chunks.append(df.count())).execute()
    assert chunks == [1, 1]
    chunks.clear()
    Subscription(store, "large").chunk_size(100).on_all(ACCOUNT.aggregator_type, lambda df: chunks.append(df.count())).execute()
    assert chunks == [2]


def test_failures(store):
    b = Bank(store)
    b.open_account("o", "n", initial_balance=1)
    calls = []

    def fails(event):
        calls.append(event["id"])
        if len(calls) < 3:
            raise RuntimeError("not yet")

    s = Subscription(store, "f").on(ACCOUNT.AccountOpened, fails, each=True)
    with pytest.raises(Exception, match="not yet"):
        s.without_retry().execute()
    s.without_retry().accept_failure().execute()  # fails again, is not raised and not skipped
    s.retry(2).execute()
    assert len(calls) == 3 and store.get_cursor("f")
    strict = Subscription(store, "strict").on(ACCOUNT.AccountFrozen, lambda e: None, each=True).safety_check().without_retry()
    with pytest.raises(Exception, match="AccountOpened"):
        strict.execute()
    with pytest.raises(ValueError):
        strict.skip(ACCOUNT.AccountFrozen)


def test_continuous_and_fencing(store):
    import time

    b = Bank(store)
    rows, handler = statuses()
    s = subscription(store, "live", handler)
    first = s.start("100 milliseconds")
    a = b.open_account("o", "n", initial_balance=1)
    for _ in range(200):
        if a in rows:
            break
        time.sleep(0.1)
    assert rows == {a: ("Active", 1)}
    store.upsert_subscriber(s.full_key, ulid())  # another worker takes over
    b.freeze(a)
    for _ in range(200):
        if not first.is_active:
            break
        time.sleep(0.1)
    assert not first.is_active and rows == {a: ("Active", 1)} and not first.supervise()
    second = s.start("100 milliseconds")
    for _ in range(200):
        if rows[a][0] == "Frozen":
            break
        time.sleep(0.1)
    second.shutdown()
    assert rows == {a: ("Frozen", 2)} and not second.is_active


def test_incremental_fold(spark, tmp_path):
    from strandlog.plans.catalogue import _amounts, _reset_handler
    from strandlog.operators import fold
    from strandlog.streaming.incremental import incremental_fold

    sf = "/root/testdata/sf0.001"
    events = _amounts(spark, sf).select(*fold.BY, *fold.EVENT_KEY, "name", "amount")
    cut = 1705276800
    for i, part in enumerate((events.where(events.timestamp < cut), events.where(events.timestamp >= cut))):
        part.coalesce(1).write.parquet(str(tmp_path / f"in/p{i}"))
    states = {}
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    out = incremental_fold(stream, _reset_handler, "balance long, available long")

    def keep(df, _):
        states.update({r["aggregator_id"]: (r["balance"], r["available"]) for r in df.collect()})

    out.writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    want = {r["aggregator_id"]: (r["balance"], r["available"]) for r in fold.custom(events, _reset_handler, "balance long, available long").collect()}
    assert states == want


def test_progress(store):
    import time

    from strandlog.streaming.progress import ProgressLog

    log = ProgressLog().attach(store.spark)
    try:
        Bank(store).open_account("o", "n", initial_balance=1)
        Subscription(store, "seen").on_all(ACCOUNT.aggregator_type, lambda e: None, each=True).execute()
        for _ in range(100):
            if log.ended:
                break
            time.sleep(0.1)
        assert any(r["commits"] == 1 for r in log.last.values()) and list(log.ended.values()) == [None]
    finally:
        log.detach(store.spark)


def test_supervised(store, monkeypatch):
    """An accepted failure doesn't end a running subscription: it starts again by itself, and stops when it is shut down."""
    import time

    from strandlog.streaming import subscription as module

    monkeypatch.setattr(module, "WATCH", 0.1)
    Bank(store).open_account("o", "n", initial_balance=1)
    calls = []

    def fails(event):
        calls.append(event["id"])
        if len(calls) < 3:
            raise RuntimeError("not yet")

    running = Subscription(store, "f").on(ACCOUNT.AccountOpened, fails, each=True).without_retry().accept_failure().start("100 milliseconds")
    for _ in range(300):
        if store.get_cursor("f"):
            break
        time.sleep(0.1)
    assert len(calls) == 3 and store.get_cursor("f")
    running.shutdown()
    time.sleep(0.5)
    assert not running.is_active and not running.supervise()


def test_lag_without_the_log(store, monkeypatch):
    """The lag comes from the batch and the commits after it; the whole log isn't read."""
    b = Bank(store)
    b.open_account("o", "n", initial_balance=1)
    row = store.log().first().asDict(recursive=True)
    s = Subscription(store, "lag").chunk_size(1).on(ACCOUNT.AccountOpened, lambda e: None, each=True)
    lags = []
    acknowledge = store.acknowledge
    monkeypatch.setattr(store, "acknowledge", lambda *a, **k: lags.append(a[2]) or acknowledge(*a, **k))
    for k, late in ((2, 50), (3, 20), (4, 70)):
        store.write([row | {"id": f"{k}", "aggregator_id": f"x{k}", "timestamp": row["timestamp"] + late}])
    monkeypatch.setattr(store, "log", lambda: pytest.fail("read the log"))
    s.execute()
    assert lags == [70, 20, 50, 0]


def test_late_and_delayed(store):
    """Late events are handled, unless the cursor is strict; a delay comes before all else."""
    import time

    b = Bank(store)
    b.open_account("o", "n", initial_balance=1)
    row = store.log().first().asDict(recursive=True)
    seen = {"loose": [], "strict": []}
    follow = lambda key: Subscription(store, key).on(ACCOUNT.AccountOpened, lambda e: seen[key].append(e["aggregator_id"]), each=True)
    loose, strict = follow("loose"), replace(follow("strict"), strict_cursor=True)
    loose.execute()
    strict.execute()
    store.write([row | {"id": "0", "aggregator_id": "late", "timestamp": row["timestamp"] - 100}])
    begin = time.time()
    loose.delay(0.3).execute()
    assert time.time() - begin >= 0.3
    strict.execute()
    assert seen["loose"][1:] == ["late"] and len(seen["strict"]) == 1


def test_shared_data(store):
    from strandlog.plans.context import Context

    class Fee(int):
        pass

    a = Bank(store).open_account("o", "n", initial_balance=10)
    view = Projection(ACCOUNT.aggregator_type, "n long", {"n": 0}).data(Fee(3)).handler(ACCOUNT.AccountOpened, lambda s, e, context: s.update(n=e["data"]["initial_balance"] - context[Fee]))
    assert view.load(store, a).n == 7 and view.execute(store).first()["n"] == 7
    got = []
    Subscription(store, "d").data(Fee(5)).on(ACCOUNT.AccountOpened, lambda e, context: got.append(context[Fee]), each=True).execute()
    assert got == [5]
    context = Context(1, "a").having(2)
    assert (context.get(int), context[str], context.get(float), int in context, len(context.without(int))) == (2, "a", None, True, 1)
    with pytest.raises(KeyError):
        context[float]


def test_snapshot_kinds(store):
    """In the store, in memory, in a way of one's own, or none."""
    from strandlog.plans.projection import MemorySnapshots, Snapshots

    b, handled = Bank(store), []
    a = b.open_account("o", "n", initial_balance=1)

    def view(**kind):
        def count(state, event):
            handled.append(event["version"])
            state["n"] += 1

        return Projection(ACCOUNT.aggregator_type, "n long", {"n": 0}, **kind).handler(ACCOUNT.AccountOpened, count).handler(ACCOUNT.MoneyDeposited, count)

    class Once(Snapshots):
        def restore(self, projection, store, aggregator_id):
            return {"n": 40}, 1, self.cursor

    once, memory = Once(), view(snapshots=MemorySnapshots())
    once.cursor = memory.load(store, a).cursor
    b.deposit(a, 1)
    handled.clear()
    assert memory.load(store, a).n == 2 and handled == [2] and memory.load(store, a).version == 2 and handled == [2]
    assert view(snapshots=once).load(store, a).n == 41
    handled.clear()
    assert view().load(store, a).n == 2 and view().load(store, a).n == 2 and handled == [1, 2, 1, 2]
    assert store.snapshots().count() == 0


def test_columns_projection(store):
    """A projection by columns gives what the handlers give, without Python in its plan, and takes related aggregates too."""
    from strandlog.functions.scalars import decode_payload
    from strandlog.operators import fold

    b = Bank(store)
    owner = store.create().event(OWNER.Created, name="Ann").commit()
    a = b.open_account(owner, "Ann", initial_balance=100)
    b.deposit(a, 5)
    store.aggregate(owner).original_version(1).event(OWNER.NameChanged, value="Bea").commit()
    data = lambda field, kind: decode_payload("data", f"{field} {kind}")[field]
    opened, paid, renamed = (F.col("name") == s.name for s in (ACCOUNT.AccountOpened, ACCOUNT.MoneyDeposited, OWNER.NameChanged))
    view = Projection(ACCOUNT.aggregator_type, "balance long, owner_name string, note string", {"note": "none"})
    view = view.columns(ACCOUNT.AccountOpened, ACCOUNT.MoneyDeposited, OWNER.NameChanged, balance=fold.total(data("initial_balance", "long"), opened) + fold.total(data("amount", "long"), paid), owner_name=fold.last(data("value", "string"), renamed))
    view = view.aggregator(OWNER.aggregator_type, owner)
    loaded = view.load(store, a)
    assert (loaded.balance, loaded.owner_name, loaded.note, loaded.version) == (105, "Bea", "none", 2)
    assert Projection(ACCOUNT.aggregator_type, "n long").columns(ACCOUNT.AccountOpened, n=F.count("*")).load(store, "none") is None
    links = store.spark.createDataFrame([(a, owner)], "root_id string, linked_id string")
    frame = view.execute(store, links={OWNER.aggregator_type: links})
    assert frame.first()["cursor"] == loaded.cursor and "Python" not in frame._jdf.queryExecution().toString()
    with pytest.raises(ValueError):
        view.handler(ACCOUNT.AccountFrozen, lambda s, e: None)
    with pytest.raises(ValueError):
        view.columns(other=F.lit(1))
    b.freeze(a)
    assert view.load(store, a).version == 2  # events that no column reads don't count, as with handlers
    with pytest.raises(Exception, match="no handler"):
        view.safety_check().load(store, a)

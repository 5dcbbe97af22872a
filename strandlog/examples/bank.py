"""A bank: accounts and owners as aggregates, commands that check a state and append, and views that fold the events."""

from __future__ import annotations

from strandlog.functions.scalars import ulid
from strandlog.plans.projection import Loaded, Projection
from strandlog.schema import Aggregate
from strandlog.sources.store import Store

# fixed values: the domain's events and their fields
ACCOUNT = Aggregate(
    "bank/BankAccount",
    AccountOpened="owner_id string, owner_name string, account_type string, currency string, initial_balance long",
    MoneyDeposited="amount long, transaction_id string, description string",
    MoneyWithdrawn="amount long, transaction_id string, description string",
    MoneyTransferred="amount long, to_account_id string, transaction_id string, description string",
    MoneyReceived="amount long, from_account_id string, transaction_id string, description string",
    AccountFrozen="reason string",
    AccountUnfrozen="reason string",
    DailyWithdrawalLimitChanged="new_limit long",
    OverdraftLimitChanged="new_limit long",
    AccountClosed="reason string, final_balance long",
)
OWNER = Aggregate("bank/Owner", Created="name string", NameChanged="value string")
ACTIVE, FROZEN, CLOSED = "Active", "Frozen", "Closed"


class BankError(Exception):
    pass


class AccountClosed(BankError):
    pass


class AccountFrozen(BankError):
    pass


class InvalidAmount(BankError):
    pass


class InsufficientFunds(BankError):
    pass


class NotFound(BankError):
    pass


def _plus(*fields: str, sign: int = 1):
    def handle(state: dict, event: dict) -> None:
        for f in fields:
            state[f] += sign * event["data"]["amount"]

    return handle


def _sets(**fields):
    """Sets fields to values, or to what a function makes of the payload."""

    def handle(state: dict, event: dict) -> None:
        for name, value in fields.items():
            state[name] = value(event["data"]) if callable(value) else value

    return handle


def _opening(payload: dict) -> int:
    return payload["initial_balance"]


def command_state(revision: str | None = None) -> Projection:
    """What the commands check."""
    p = Projection(ACCOUNT.aggregator_type, "balance long, status string, overdraft_limit long", {"balance": 0, "status": ACTIVE, "overdraft_limit": 0}, revision)
    p.handler(ACCOUNT.AccountOpened, _sets(balance=_opening, status=ACTIVE))
    for spec, sign in ((ACCOUNT.MoneyDeposited, 1), (ACCOUNT.MoneyReceived, 1), (ACCOUNT.MoneyWithdrawn, -1), (ACCOUNT.MoneyTransferred, -1)):
        p.handler(spec, _plus("balance", sign=sign))
    for spec, status in ((ACCOUNT.AccountFrozen, FROZEN), (ACCOUNT.AccountUnfrozen, ACTIVE), (ACCOUNT.AccountClosed, CLOSED)):
        p.handler(spec, _sets(status=status))
    p.handler(ACCOUNT.OverdraftLimitChanged, _sets(overdraft_limit=lambda d: d["new_limit"]))
    return p.skip(ACCOUNT.DailyWithdrawalLimitChanged).safety_check()


def balance_view(revision: str | None = None) -> Projection:
    """An overdraft change resets what is available, so this fold depends on the order."""

    def overdraft(state: dict, event: dict) -> None:
        state["available_balance"] = state["balance"] + event["data"]["new_limit"]

    p = Projection(ACCOUNT.aggregator_type, "balance long, currency string, available_balance long", {"balance": 0, "currency": "", "available_balance": 0}, revision)
    p.handler(ACCOUNT.AccountOpened, _sets(balance=_opening, available_balance=_opening, currency=lambda d: d["currency"]))
    for spec, sign in ((ACCOUNT.MoneyDeposited, 1), (ACCOUNT.MoneyReceived, 1), (ACCOUNT.MoneyWithdrawn, -1), (ACCOUNT.MoneyTransferred, -1)):
        p.handler(spec, _plus("balance", "available_balance", sign=sign))
    return p.handler(ACCOUNT.OverdraftLimitChanged, overdraft)


def status_view() -> Projection:
    def flags(status: str):
        return _sets(status=status, is_active=status == ACTIVE, is_frozen=status == FROZEN, is_closed=status == CLOSED)

    p = Projection(ACCOUNT.aggregator_type, "status string, is_active boolean, is_frozen boolean, is_closed boolean", {"status": ACTIVE, "is_active": False, "is_frozen": False, "is_closed": False})
    for spec, status in ((ACCOUNT.AccountOpened, ACTIVE), (ACCOUNT.AccountFrozen, FROZEN), (ACCOUNT.AccountUnfrozen, ACTIVE), (ACCOUNT.AccountClosed, CLOSED)):
        p.handler(spec, flags(status))
    return p


def details_view(revision: str | None = None) -> Projection:
    """Co-loads an account and its owner."""
    fields = "owner_id string, owner_name string, account_type string, currency string, balance long, available_balance long, status string, daily_withdrawal_limit long, overdraft_limit long"
    p = Projection(ACCOUNT.aggregator_type, fields, {"balance": 0, "available_balance": 0, "status": ACTIVE}, revision)

    def opened(state: dict, event: dict) -> None:
        d = event["data"]
        state |= {k: d[k] for k in ("owner_id", "owner_name", "account_type", "currency")}
        state |= {"balance": d["initial_balance"], "available_balance": d["initial_balance"], "status": ACTIVE, "daily_withdrawal_limit": 1000, "overdraft_limit": 0}

    def overdraft(state: dict, event: dict) -> None:
        state["overdraft_limit"] = event["data"]["new_limit"]
        state["available_balance"] = state["balance"] + state["overdraft_limit"]

    p.handler(ACCOUNT.AccountOpened, opened)
    for spec, sign in ((ACCOUNT.MoneyDeposited, 1), (ACCOUNT.MoneyReceived, 1), (ACCOUNT.MoneyWithdrawn, -1), (ACCOUNT.MoneyTransferred, -1)):
        p.handler(spec, _plus("balance", "available_balance", sign=sign))
    for spec, status in ((ACCOUNT.AccountFrozen, FROZEN), (ACCOUNT.AccountUnfrozen, ACTIVE), (ACCOUNT.AccountClosed, CLOSED)):
        p.handler(spec, _sets(status=status))
    p.handler(ACCOUNT.DailyWithdrawalLimitChanged, _sets(daily_withdrawal_limit=lambda d: d["new_limit"]))
    p.handler(ACCOUNT.OverdraftLimitChanged, overdraft)
    return p.handler(OWNER.NameChanged, _sets(owner_name=lambda d: d["value"]))


class Bank:
    """Commands on a store."""

    def __init__(self, store: Store, revision: str | None = None):
        self.store, self.state = store, command_state(revision)

    def load(self, account: str) -> Loaded | None:
        return self.state.load(self.store, account)

    def _open(self, account: str, frozen_too: bool = True) -> Loaded:
        found = self.load(account)
        if found is None:
            raise NotFound(account)
        if found.status == CLOSED:
            raise AccountClosed(account)
        if frozen_too and found.status == FROZEN:
            raise AccountFrozen(account)
        return found

    def open_account(self, owner_id: str, owner_name: str, account_type: str = "Checking", currency: str = "USD", initial_balance: int = 0, routing_key: str | None = None) -> str:
        if initial_balance < 0:
            raise InvalidAmount(initial_balance)
        return self.store.create().routing_key(routing_key).event(ACCOUNT.AccountOpened, owner_id=owner_id, owner_name=owner_name, account_type=account_type, currency=currency, initial_balance=initial_balance).commit()

    def _move(self, account: str, spec, amount: int, leaving: bool, frozen_too: bool = True, routing_key: str | None = None, **more: str) -> None:
        found = self._open(account, frozen_too)
        if amount <= 0:
            raise InvalidAmount(amount)
        if leaving and amount > found.balance + found.overdraft_limit:
            raise InsufficientFunds(amount)
        found.append().routing_key(routing_key).event(spec, amount=amount, **({"transaction_id": ulid(), "description": ""} | more)).commit()

    def deposit(self, account: str, amount: int, **more: str) -> None:
        self._move(account, ACCOUNT.MoneyDeposited, amount, False, **more)

    def withdraw(self, account: str, amount: int, **more: str) -> None:
        self._move(account, ACCOUNT.MoneyWithdrawn, amount, True, **more)

    def transfer(self, account: str, amount: int, to_account_id: str, **more: str) -> None:
        self._move(account, ACCOUNT.MoneyTransferred, amount, True, to_account_id=to_account_id, **more)

    def receive(self, account: str, amount: int, from_account_id: str, **more: str) -> None:
        """A frozen account still receives."""
        self._move(account, ACCOUNT.MoneyReceived, amount, False, frozen_too=False, from_account_id=from_account_id, **more)

    def freeze(self, account: str, reason: str = "") -> None:
        self._open(account).append().event(ACCOUNT.AccountFrozen, reason=reason).commit()

    def unfreeze(self, account: str, reason: str = "") -> None:
        found = self._open(account, frozen_too=False)
        if found.status != FROZEN:
            raise BankError("not frozen")
        found.append().event(ACCOUNT.AccountUnfrozen, reason=reason).commit()

    def change_daily_limit(self, account: str, new_limit: int) -> None:
        if new_limit < 0:
            raise InvalidAmount(new_limit)
        self._open(account, frozen_too=False).append().event(ACCOUNT.DailyWithdrawalLimitChanged, new_limit=new_limit).commit()

    def change_overdraft(self, account: str, new_limit: int) -> None:
        if new_limit < 0:
            raise InvalidAmount(new_limit)
        self._open(account, frozen_too=False).append().event(ACCOUNT.OverdraftLimitChanged, new_limit=new_limit).commit()

    def close(self, account: str, reason: str = "") -> None:
        found = self._open(account, frozen_too=False)
        if found.balance < 0:
            raise BankError("negative balance")
        found.append().event(ACCOUNT.AccountClosed, reason=reason, final_balance=found.balance).commit()

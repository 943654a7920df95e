"""Idempotent debits: every account's transactions in order, with duplicates told apart.

A transaction whose id was completed before is DUPLICATE; one that the balance covers is COMPLETED and its id remembered;
any other is FAILED and may come again. An id is remembered for a day after it was completed, the last moment included;
later it is new again. Accounts are independent. Each is read in order as one stream, with a state of its balance and the
ids of its last day, so that no account has to fit into memory; amounts are whole cents.

Whether a transaction is covered depends on all that were before it, so an account is a fold, which no window function
expresses. It is done in Python over sorted Arrow batches: ``F.aggregate`` over a collected array would hold a whole
account in a row.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship

OPENING = 1_000_000
#: Fixed value: the message of a transaction that the balance doesn't cover.
REFUSED = "Insufficient funds: needed {}, available {}"
#: Fixed value: ids are remembered for a day.
RETENTION_US = 24 * 3600 * 1_000_000


class Account:
    """The state of one account."""

    __slots__ = ("balance", "done", "order", "version")

    def __init__(self, balance: int = OPENING) -> None:
        self.balance, self.version, self.done = balance, 0, {}
        self.order: deque[tuple[int, object]] = deque()  # ids by the time of their completion, oldest first

    def debit(self, cents: int) -> bool:
        if self.balance < cents:
            return False
        self.balance -= cents
        self.version += 1
        return True

    def credit(self, cents: int) -> None:
        self.balance += cents
        self.version += 1

    def apply(self, txn: object, cents: int, at: int) -> tuple[str, int | None, str | None]:
        """Status, new balance in cents and error message. at is in microseconds."""
        self.evict(at - RETENTION_US)
        if txn in self.done:
            return "DUPLICATE", None, None
        if not self.debit(cents):
            return "FAILED", None, REFUSED.format(money(cents), money(self.balance))
        self.done[txn] = at
        self.order.append((at, txn))
        return "COMPLETED", self.balance, None

    def evict(self, cutoff: int) -> None:
        """Forgets ids completed before the cutoff, and none at it. Each id is looked at once."""
        while self.order and self.order[0][0] < cutoff:
            del self.done[self.order.popleft()[1]]


def money(cents: int) -> str:
    return f"{cents // 100}.{cents % 100:02d}"


def results(transactions: DataFrame) -> DataFrame:
    """transaction_id, account_from, seq, status, new_balance_from, new_balance_to, error_message, version."""
    ship(transactions.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, account = None, Account()
        for b in batches:
            status, balance, error, version = [], [], [], []
            for txn, owner, cents, at in zip(*(b.column(c).to_pylist() for c in ("transaction_id", "account_from", "cents", "at")), strict=True):
                if owner != held:
                    held, account = owner, Account()
                s, left, message = account.apply(txn, cents, at)
                status.append(s)
                balance.append(None if left is None else left / 100)
                error.append(message)
                version.append(account.version)
            yield pa.RecordBatch.from_arrays(
                [b.column("transaction_id"), b.column("account_from"), b.column("seq"), pa.array(status, pa.string()), pa.array(balance, pa.float64()),
                 pa.array([None if x is None else 0.0 for x in balance], pa.float64()), pa.array(error, pa.string()), pa.array(version, pa.int64())],
                names=["transaction_id", "account_from", "seq", "status", "new_balance_from", "new_balance_to", "error_message", "version"],
            )

    kinds = dict(transactions.dtypes)
    rows = transactions.select("transaction_id", "account_from", "cents", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), "seq")
    rows = rows.repartition("account_from").sortWithinPartitions("account_from", "at", "seq", "transaction_id")
    return rows.mapInArrow(
        run,
        f"transaction_id {kinds['transaction_id']}, account_from {kinds['account_from']}, seq int, status string, new_balance_from double, new_balance_to double, error_message string, version long",
    )


def balances(done: DataFrame) -> DataFrame:
    """Each account's balance and version after all of its transactions."""
    completed = F.col("status") == "COMPLETED"
    return done.groupBy("account_from").agg(
        F.coalesce(F.min(F.when(completed, F.col("new_balance_from"))), F.lit(OPENING / 100)).alias("balance"), F.max("version").alias("version")
    )

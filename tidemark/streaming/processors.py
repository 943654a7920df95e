"""State machines for transformWithState. Rows of a key that come in one batch are taken in order of event time and
sequence, which is the canonical order of the batch forms."""

from __future__ import annotations

import heapq
import sys
from collections.abc import Iterator
from typing import Any

from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators import ledger
from ..operators.ledger import OPENING, REFUSED, RETENTION_US, money
from ..session import ROCKSDB

TWO_HOURS_MS = 2 * 3600 * 1000
WAIT_MS = 30_000


def ms(t: Any) -> int:
    return round(t.timestamp() * 1000)


def _sent() -> None:
    """A processor also starts beside the driver, in a process that imports nothing of ours: it is sent by value."""
    for module in (sys.modules[__name__], ledger):
        cloudpickle.register_pickle_by_value(module)


def stateful(df: DataFrame, key: str, processor: StatefulProcessor, schema: str, time: str, delay: str = "5 seconds") -> DataFrame:
    """df through a processor in append mode and event time."""
    spark = df.sparkSession
    _sent()
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    return df.withWatermark(time, delay).groupBy(key).transformWithState(statefulProcessor=processor, outputStructType=schema, outputMode="append", timeMode="eventTime")


def by_key(df: DataFrame, key: str, processor: StatefulProcessor, schema: str) -> DataFrame:
    """df, the output of another stateful operator, through a processor without a time of its own."""
    _sent()
    df.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    return df.groupBy(key).transformWithState(statefulProcessor=processor, outputStructType=schema, outputMode="append", timeMode="none")


class TopN(StatefulProcessor):
    """The n rows of a key with the most of rank, equals by names, from the one batch that brings all of the key's rows."""

    def __init__(self, n: int, rank: str, names: list[str], values: list[str]) -> None:
        self.n, self.rank, self.names, self.values = n, rank, names, values

    def init(self, handle: StatefulProcessorHandle) -> None:
        pass

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        best = heapq.nsmallest(self.n, rows, key=lambda r: (-r[self.rank], *((r[c] is not None, r[c]) for c in self.names)))
        for i, r in enumerate(best):
            yield Row(window_start=key[0], **{c: r[c] for c in (*self.names, *self.values)}, rank_num=i + 1)

    def close(self) -> None:
        pass


class LongRides(StatefulProcessor):
    """An alert when a START has waited for its END for the limit, or when the END shows that it did.

    The second case comes up where one batch brings both the END and the time at which the timer would have fired.
    """

    SCHEMA = "ride_id long, message string"
    #: Fixed value.
    MESSAGE = "Ride has been ongoing for more than 2 hours!"

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.start = handle.getValueState("start", "t long")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        for r in sorted(rows, key=lambda r: (ms(r.event_time), not r.is_start)):
            at = ms(r.event_time)
            if r.is_start:
                self.start.update((at,))
                self.handle.registerTimer(at + TWO_HOURS_MS)
            elif self.start.exists():
                begun = self.start.get()[0]
                self.start.clear()
                self.handle.deleteTimer(begun + TWO_HOURS_MS)
                if at >= begun + TWO_HOURS_MS:
                    yield Row(ride_id=key[0], message=self.MESSAGE)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        if self.start.exists():
            self.start.clear()
            yield Row(ride_id=key[0], message=self.MESSAGE)

    def close(self) -> None:
        pass


class Ledger(StatefulProcessor):
    """Idempotent debits of one account: its balance, and the ids that it completed within a day.

    Ids are also listed by the minute in which their day is over, so that a timer takes out that minute's ids and
    doesn't look at any other. An id whose day is over counts as new even before its timer comes.
    """

    SCHEMA = "transaction_id long, account_from long, seq int, status string, new_balance_from double, new_balance_to double, error_message string"

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.balance = handle.getValueState("balance", "cents long")
        self.done = handle.getMapState("done", "id long", "at long")
        self.due = handle.getMapState("due", "minute long", "ids array<long>")

    def _remember(self, txn: int, at: int) -> None:
        self.done.updateValue((txn,), (at,))
        minute = (at + RETENTION_US // 1000) // 60_000 + 1
        ids = list(self.due.getValue((minute,))[0]) if self.due.containsKey((minute,)) else []
        self.due.updateValue((minute,), ([*ids, txn],))
        self.handle.registerTimer(minute * 60_000)

    def _known(self, txn: int, at: int) -> bool:
        return self.done.containsKey((txn,)) and self.done.getValue((txn,))[0] >= at - RETENTION_US // 1000

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        left = self.balance.get()[0] if self.balance.exists() else OPENING
        for r in sorted(rows, key=lambda r: (ms(r.ts), r.seq, r.transaction_id)):
            status, balance, error = "DUPLICATE", None, None
            if not self._known(r.transaction_id, ms(r.ts)):
                if r.cents <= left:
                    left -= r.cents
                    status, balance = "COMPLETED", left / 100
                    self._remember(r.transaction_id, ms(r.ts))
                else:
                    status, error = "FAILED", REFUSED.format(money(r.cents), money(left))
            yield Row(
                transaction_id=r.transaction_id, account_from=key[0], seq=r.seq, status=status, new_balance_from=balance,
                new_balance_to=None if balance is None else 0.0, error_message=error,
            )
        self.balance.update((left,))

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        """Forgets the ids whose day was over in the timer's minute; one that was completed again since stays."""
        end = expiredTimerInfo.getExpiryTimeInMs()
        minute = end // 60_000
        if self.due.containsKey((minute,)):
            for txn in self.due.getValue((minute,))[0]:
                if self.done.containsKey((txn,)) and self.done.getValue((txn,))[0] < end - RETENTION_US // 1000:
                    self.done.removeKey((txn,))
            self.due.removeKey((minute,))
        return iter(())

    def close(self) -> None:
        pass


class Enrich(StatefulProcessor):
    """Orders with the last known version of their customer; without one they wait, until a version comes or time is
    up. Input rows are of two kinds, orders (side 1) and versions (side 0), with one event time."""

    SCHEMA = "order_id long, customer_id long, match string, name string, tier string"

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.customer = handle.getValueState("customer", "name string, tier string")
        self.pending = handle.getMapState("pending", "order_id long", "at long")

    def _flush(self, key: Any, match: str, name: str | None, tier: str | None) -> Iterator[Row]:
        for k, _ in list(self.pending.iterator()):
            yield Row(order_id=k[0], customer_id=key[0], match=match, name=name or "Unknown", tier=tier or "Unknown")
        self.pending.clear()

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        for r in sorted(rows, key=lambda r: (ms(r.at), r.side)):
            if r.side == 0:
                self.customer.update((r.name, r.tier))
                yield from self._flush(key, "delayed", r.name, r.tier)
            elif self.customer.exists():
                name, tier = self.customer.get()
                yield Row(order_id=r.order_id, customer_id=key[0], match="direct", name=name, tier=tier)
            else:
                self.pending.updateValue((r.order_id,), (ms(r.at),))
                self.handle.registerTimer(ms(r.at) + WAIT_MS)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        """Everything that waits goes, also what has not waited for long."""
        if self.customer.exists():
            name, tier = self.customer.get()
            yield from self._flush(key, "timer", name, tier)
        else:
            yield from self._flush(key, "unknown", None, None)

    def close(self) -> None:
        pass


class Catalog(StatefulProcessor):
    """Orders with the last known version of their product; without one they go on at once, with the catalog pending.

    The reference table is kept by key beside the orders of that key, and not on every machine, so it may be of any size.
    Input rows are of two kinds, orders (side 1) and products (side 0), each with an id in order_id. Of a batch's versions
    of one time, the one of the largest id is the last, whatever order the rows come in."""

    SCHEMA = "order_id long, product_id long, message string"

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.product = handle.getValueState("product", "name string, category string, price double")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        product = before = self.product.get() if self.product.exists() else None
        for r in sorted(rows, key=lambda r: (r.at, r.side, r.order_id)):  # whole microseconds
            if r.side == 0:
                product = (r.name, r.category, r.price)
                continue
            # fixed values: the two messages
            if product is not None:
                name, category, price = product
                text = f"Order {r.order_id}: {r.quantity}x {name} ({category}) @ ${price:.2f} each = ${r.amount:.2f}"
            else:
                text = f"Order {r.order_id}: {r.quantity}x product {key[0]} (catalog pending) = ${r.amount:.2f}"
            yield Row(order_id=r.order_id, product_id=key[0], message=text)
        if product is not before:
            self.product.update(product)

    def close(self) -> None:
        pass


class Pair(StatefulProcessor):
    """One-to-one join: each side holds one row, a match uses both up, and a second row overwrites one that waits."""

    SCHEMA = "ride_id long, driver_id long, tip double"

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.ride = handle.getValueState("ride", "driver_id long")
        self.fare = handle.getValueState("fare", "tip double")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        for r in sorted(rows, key=lambda r: (ms(r.at), r.side)):
            own, other, value = (self.ride, self.fare, r.driver_id) if r.side == 0 else (self.fare, self.ride, r.tip)
            if other.exists():
                met = other.get()[0]
                other.clear()
                yield Row(ride_id=key[0], driver_id=value if r.side == 0 else met, tip=met if r.side == 0 else value)
            else:
                own.update((value,))

    def close(self) -> None:
        pass


class LastRecord(StatefulProcessor):
    """The last data of each record, re-emitted with every change; deletes clear it."""

    SCHEMA = "record string, position long, operation string, last_data string, seen_before boolean"

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "data string")
        self.seen = handle.getValueState("seen", "yes boolean")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        for r in sorted(rows, key=lambda r: r.position):
            before = self.last.get()[0] if self.last.exists() else None
            yield Row(record=key[0], position=r.position, operation=r.operation, last_data=before, seen_before=self.seen.exists())
            if r.operation == "DELETE":
                self.last.clear()
            else:
                self.last.update((r.after_data,))
            self.seen.update((True,))

    def close(self) -> None:
        pass

"""Rows that wait a moment before they are stored: the last write of an id within an interval becomes one row, merged into a table.

The pending row of an id is state; its first write sets a processing-time timer, and when that runs out the row goes to the sink and the state is gone, so state is
bounded by what arrives within one interval. An interval of 0 passes the last write of each batch on at once. The table is a VersionedTable, so a batch that
runs again after a restart changes nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from wagerlake.sources.versioned import VersionedTable
from wagerlake.streaming.ledger_stream import STORES

#: Fixed value: seconds that a write waits for a later one.
INTERVAL = 20
ROW = "trade_id string, pos long, ticker string, size double, ts long, entry_price double, usd_notional double, category string, net_ev double, payload string"
_NAMES = [x.split()[0] for x in ROW.split(", ")]


class Pending(StatefulProcessor):
    def __init__(self, interval: int):
        self.interval = interval

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.row = handle, handle.getValueState("row", ROW)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        best = None
        for part in rows:
            last = part.loc[part["pos"].idxmax()]
            best = last if best is None or last["pos"] > best["pos"] else best
        if best is None:
            return
        value = tuple(None if pd.isna(best[n]) else best[n].item() if hasattr(best[n], "item") else best[n] for n in _NAMES)
        if not self.interval:
            yield pd.DataFrame([value], columns=_NAMES)
            return
        self.wait(value, timerValues)

    def wait(self, value: tuple, timerValues) -> None:  # noqa: N803
        if not self.row.exists():
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + 1000 * self.interval)
        self.row.update(value)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        if self.row.exists():
            yield pd.DataFrame([tuple(self.row.get())], columns=_NAMES)
            self.row.clear()

    def close(self) -> None:
        pass


class PendingRows(Pending):
    """The same over rows: an id has a few writes, and no frame of its own."""

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        best = max(rows, key=lambda r: r["pos"], default=None)
        if best is not None:
            self.wait(tuple(best[n] for n in _NAMES), timerValues)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        if self.row.exists():
            yield Row(*_NAMES)(*self.row.get())
            self.row.clear()


def pending(writes: DataFrame, interval: int = INTERVAL) -> DataFrame:
    """A stream of the rows to store from a stream of writes (columns of ROW; later writes have larger pos); writes without an id or a ticker are dropped.

    With an interval of 0 nothing waits, so there is no state: these are the writes themselves, of which keep_storing takes the last of each batch."""
    blank = lambda x: F.trim(F.coalesce(x, F.lit(""))) == ""
    named = writes.where(~blank("trade_id") & ~blank("ticker")).select(*_NAMES)
    return named.groupBy("trade_id").transformWithState(PendingRows(interval), ROW, "Update", "ProcessingTime") if interval else named


def last_writes(batch: DataFrame) -> DataFrame:
    """The write with the largest pos of each id."""
    return batch.groupBy("trade_id").agg(F.max_by(F.struct(*_NAMES), "pos").alias("w")).select("w.*")


def kept(name: str) -> Column:
    """What a stored row takes from a new one of its id: the notional, a category if there is one, and EV with payload if it has an EV; all else stays."""
    if name == "category":
        return F.coalesce("n.category", "o.category")
    if name in ("net_ev", "payload"):
        return F.when(F.col("n.net_ev").isNotNull(), F.col(f"n.{name}")).otherwise(F.col(f"o.{name}"))
    return F.col(f"n.{name}" if name in ("usd_notional", "pos") else f"o.{name}")


def keep_storing(writes: DataFrame, table: VersionedTable, checkpoint: str, interval: int = INTERVAL, writer: str = "shadow", **trigger):
    """The started query that stores what is no longer pending in table (key trade_id)."""
    writes.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STORES)

    def write(batch: DataFrame, number: int) -> None:
        if not table.done(writer, number):
            table.merge(batch if interval else last_writes(batch), writer, number, combine=kept)

    return pending(writes, interval).writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(write).trigger(**(trigger or {"processingTime": "5 seconds"})).start()

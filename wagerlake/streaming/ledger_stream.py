"""Replay of positions as their events arrive: one state a position, late events rebuild only their own position.

A position's state is what the replay has reached (its last episode) and all its events by key. Events behind the last block seen are
stepped on from there; one that belongs before it, or a first MERGE or SPLIT after a re-entry, makes the position replay its events in canonical
order. Whatever order and batches the events come in, the episodes are those of plans.ledger_chain.episodes over all of them. Repeats of a key change nothing.
"""

from __future__ import annotations

import bisect
import uuid
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from wagerlake.sources.shared import shared_folder
from wagerlake.sources.versioned import VersionedTable

EPSILON, FAR = 1e-4, 2**62
_EVENT = "kind string, ts long, shares double, cash double, block long, tx_index long, log_index long"
_SUMS = "shares double, outlay double, most double, buy double, sell double, redeem double"
_NOW = f"free boolean, at long, mixed boolean, episode long, n long, first long, last long, {_SUMS}"
EPISODES = f"wallet long, asset string, episode long, mixed boolean, n long, first long, last long, {_SUMS}, rebuilt boolean"
STORES = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@dataclass
class Event:
    key: str
    kind: str
    ts: int
    shares: float
    cash: float
    block: int | None
    tx_index: int | None
    log_index: int | None

    @property
    def when(self) -> tuple[bool, int]:
        """Behind all blocks or not, and the block or time."""
        chain = self.block is not None and self.block > 0
        return not chain, self.block if chain else self.ts if self.ts > 0 else FAR


@dataclass
class Replay:
    """The last episode so far."""

    free: bool = False
    at: int = -1
    mixed: bool = False
    episode: int = 0
    n: int = 0
    first: int = 0
    last: int = 0
    sums: list[float] = field(default_factory=lambda: [0.0] * 6)

    def row(self) -> tuple:
        return (self.free, self.at, self.mixed, self.episode, self.n, self.first, self.last, *self.sums)

    def take(self, e: Event) -> bool:
        """Steps over an event; whether it opened an episode."""
        shares, outlay, most, buy, sell, redeem = self.sums
        opened = not self.mixed and self.n > 0 and abs(shares) <= EPSILON and buy > EPSILON and e.kind == "BUY"
        if opened:
            self.episode, self.n = self.episode + 1, 0
            shares = outlay = most = buy = sell = redeem = 0.0
        if e.kind == "BUY" or (e.kind == "SPLIT" and e.shares > 0):
            paid = e.cash if e.kind == "BUY" else max(e.cash, 0.0)
            shares, outlay, buy = shares + e.shares, outlay + paid, buy + paid
        elif e.kind == "SELL":
            shares, outlay, sell = shares - e.shares, outlay - e.cash, sell + e.cash
        elif e.kind == "REDEEM":
            shares, outlay, redeem = 0.0, outlay - e.cash, redeem + e.cash
        elif e.kind == "MERGE" and e.shares > 0 and shares > EPSILON:
            gone, paid = min(e.shares, shares), max(e.cash, 0.0)
            outlay = max(0.0, outlay - outlay * (gone / shares)) - paid
            shares, sell = shares - gone, sell + paid
        self.sums = [shares, outlay, max(most, outlay), buy, sell, redeem]
        self.first = e.ts if self.n == 0 else self.first
        self.n, self.last = self.n + 1, e.ts
        self.free, self.at = e.when
        return opened


def in_order(events: list[Event]) -> list[Event]:
    """Canonical order, as plans.ledger_chain.ordered has it."""
    logs: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for e in events:
        if not e.when[0] and e.tx_index is not None and e.log_index is not None:
            logs[e.block].append((e.tx_index, e.log_index))
    most = {}
    for block, known in logs.items():
        known.sort()
        top, tops = -1, []
        for _, log in known:
            top = max(top, log)
            tops.append(top)
        most[block] = ([tx for tx, _ in known], tops)

    def place(e: Event) -> tuple:
        free, at = e.when
        if free:
            return free, at, 0, 0, 0, e.key
        if e.log_index is not None:
            return free, at, e.log_index, 0, 0, e.key
        if e.tx_index is None:
            return free, at, FAR, 2, 0, e.key
        txs, tops = most.get(e.block, ([], []))
        i = bisect.bisect_left(txs, e.tx_index)
        return free, at, tops[i - 1] if i else -1, 1, e.tx_index, e.key

    return sorted(events, key=place)


class PositionReplay(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.now = handle.getValueState("now", _NOW)
        self.events = handle.getMapState("events", "key string", _EVENT)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        none = lambda x: None if pd.isna(x) else int(x)
        fresh: dict[str, Event] = {}
        for part in rows:
            for r in part.itertuples():
                if r.key not in fresh and not self.events.containsKey((r.key,)):
                    fresh[r.key] = Event(r.key, r.kind, int(r.ts), float(r.shares), float(r.cash), none(r.block), none(r.tx_index), none(r.log_index))
        if not fresh:
            return
        for e in fresh.values():
            self.events.updateValue((e.key,), (e.kind, e.ts, e.shares, e.cash, e.block, e.tx_index, e.log_index))
        new, mixed = list(fresh.values()), any(e.kind in ("MERGE", "SPLIT") for e in fresh.values())
        state, out = Replay(), []
        if self.now.exists():
            free, at, was, *rest = self.now.get()
            state = Replay(free, at, was, *rest[:4], list(rest[4:]))
        rebuilt = min(e.when for e in new) <= (state.free, state.at) or (mixed and not state.mixed and state.episode > 0)
        if rebuilt:
            new = [Event(k[0], *v) for k, v in self.events.iterator()]
            state, mixed = Replay(), any(e.kind in ("MERGE", "SPLIT") for e in new)
        state.mixed = state.mixed or mixed
        for e in in_order(new):
            before = state.row()
            if state.take(e):
                out.append(before)
        self.now.update(state.row())
        names = [x.split()[0] for x in EPISODES.split(", ")]
        yield pd.DataFrame([(*key, r[3], state.mixed, *r[4:], rebuilt) for r in [*out, state.row()]], columns=names)

    def close(self) -> None:
        pass


def replayed(events: DataFrame) -> DataFrame:
    """A stream of the episodes that each batch of events (columns of ledger_chain.EVENT) has changed; rebuilt ones replace all of their position."""
    processor = PositionReplay()
    return events.where("asset <> ''").groupBy("wallet", "asset").transformWithStateInPandas(processor, EPISODES, "Update", "None")


def keep_replaying(events: DataFrame, table: VersionedTable, checkpoint: str, writer: str = "replay", **trigger):
    """The started query that merges what changes into table (keys wallet, asset, episode, by wallet and asset); batches that run again change nothing."""
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STORES)

    def write(batch: DataFrame, number: int) -> None:
        if table.done(writer, number):
            return
        batch = batch.persist()
        table.merge(batch.drop("rebuilt"), writer, number, replaced=batch.where("rebuilt").select("wallet", "asset"))
        batch.unpersist()

    return replayed(events).writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(write).trigger(**(trigger or {"processingTime": "20 seconds"})).start()


def replay_table(spark: SparkSession, path: str | None = None) -> VersionedTable:
    return VersionedTable(spark, path or f"{shared_folder(spark)}/replay-{uuid.uuid4().hex}", ["wallet", "asset", "episode"], ["wallet", "asset"], 16)

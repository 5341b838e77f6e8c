"""Versions of a bucketed table, replay by state for any split of the events, snapshots and deltas."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from wagerlake.plans import ledger_chain, ledger_store
from wagerlake.sources.versioned import Conflict, VersionedTable
from wagerlake.streaming import ledger_stream as S

EVENT = "wallet long, kind string, condition string, asset string, ts long, shares double, price double, cash double, block long, tx_index long, log_index long, key string"


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_versions_of_a_table(spark, tmp_path):
    t = VersionedTable(spark, str(tmp_path / "t"), ["k"], buckets=4)
    df = lambda *r: spark.createDataFrame(list(r), "k long, n long, note string")
    assert t.read() is None and t.versions() == []
    assert t.merge(df(*((i, 1, "a") for i in range(20))), "w", 0) == 1
    assert t.merge(df((3, 5, "b"), (100, 7, None)), "w", 1, combine=lambda k: F.col("o.n") + F.col("n.n") if k == "n" else F.coalesce(f"n.{k}", f"o.{k}")) == 2
    assert rows(t.read(1)) == [(i, 1, "a") for i in range(20)]
    assert (3, 6, "b") in rows(t.read()) and (100, 7, None) in rows(t.read()) and t.read().count() == 21
    before, after = t.manifest(1)["folders"], t.manifest(2)["folders"]
    assert sum(before[b] == after[b] for b in before) >= 2  # only touched buckets are written anew
    with pytest.raises(ValueError, match="no version 9"):
        t.read(9)


def test_a_batch_that_runs_twice_adds_once_and_a_broken_one_shows_nothing(spark, tmp_path, monkeypatch):
    t = VersionedTable(spark, str(tmp_path / "t"), ["k"], buckets=2)
    df, add = spark.createDataFrame([(1, 1), (2, 1)], "k long, n long"), lambda k: F.col("o.n") + F.col("n.n")
    t.merge(df, "w", 0, add)
    assert t.merge(df, "w", 0, add) == 1 and rows(t.read()) == [(1, 1), (2, 1)]

    def dies(m):
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(t, "_commit", dies)
        with pytest.raises(OSError, match="lost"):
            t.merge(df, "w", 1, add)
    assert t.versions() == [1] and rows(t.read()) == [(1, 1), (2, 1)] and not t.done("w", 1)
    t.merge(df, "w", 1, add)
    t.merge(df, "other", 1, add)
    assert rows(t.read()) == [(1, 3), (2, 3)] and rows(t.read(1)) == [(1, 1), (2, 1)]


def test_two_writers_of_one_version_conflict(spark, tmp_path):
    a, b = (VersionedTable(spark, str(tmp_path / "t"), ["k"], buckets=2) for _ in range(2))
    df = spark.createDataFrame([(1, 1)], "k long, n long")
    stale = a.manifest()
    b.merge(df, "b", 0)
    a.manifest = lambda version=None: stale
    with pytest.raises(Conflict):
        a.merge(df, "a", 0)
    assert rows(b.read()) == [(1, 1)]


def test_rows_of_replaced_groups_go(spark, tmp_path):
    t = VersionedTable(spark, str(tmp_path / "t"), ["g", "i"], ["g"], 2)
    df = lambda *r: spark.createDataFrame(list(r), "g long, i long, v long")
    t.merge(df((1, 0, 1), (1, 1, 1), (2, 0, 1)), "w", 0)
    t.merge(df((1, 0, 9)), "w", 1, replaced=spark.createDataFrame([(1,), (2,)], "g long"))
    assert rows(t.read()) == [(1, 0, 9)] and len(rows(t.read(1))) == 3


def random_events(seed, n):
    rnd = random.Random(seed)
    maybe = lambda x, p=0.8: x if rnd.random() < p else None
    kinds = rnd.choice([["BUY", "SELL"], ["BUY", "BUY", "SELL", "SELL", "REDEEM"], ["BUY", "SELL", "MERGE", "SPLIT"]])
    return [S.Event(f"k{i:03}", rnd.choice(kinds), rnd.choice([0, rnd.randint(1, 40)]), rnd.choice([1.0, 1.0, 2.0]), rnd.randint(0, 9) / 4, maybe(rnd.randint(0, 6)), maybe(rnd.randint(0, 3)), maybe(rnd.randint(0, 9))) for i in range(n)]


class Handle:
    """State in memory, as much of it as the processor uses."""

    def __init__(self):
        self.map, self.value = {}, None

    def getValueState(self, name, schema):  # noqa: N802
        h = self
        return type("V", (), {"exists": lambda s: h.value is not None, "get": lambda s: h.value, "update": lambda s, v: setattr(h, "value", v)})()

    def getMapState(self, name, key, value):  # noqa: N802
        m = self.map
        return type("M", (), {"containsKey": lambda s, k: k in m, "updateValue": lambda s, k, v: m.__setitem__(k, v), "iterator": lambda s: iter(m.items())})()


def episodes_of(events):
    state, out = S.Replay(mixed=any(e.kind in ("MERGE", "SPLIT") for e in events)), []
    for e in S.in_order(events):
        before = state.row()
        if state.take(e):
            out.append(before)
    return [r[3:] for r in [*out, state.row()]]


@pytest.mark.parametrize("seed", range(60))
def test_any_split_of_the_events_gives_the_same_episodes(seed):
    events, rnd = random_events(seed, 1 + seed % 20), random.Random(seed)
    order = S.in_order(events) if seed % 3 == 0 else rnd.sample(events, len(events))
    p = S.PositionReplay()
    p.init(Handle())
    kept, at, rebuilds = {}, 0, 0
    while at < len(order):
        step = rnd.randint(1, 4)
        some = order[at : at + step] + ([rnd.choice(order[:at])] if at and rnd.random() < 0.3 else [])
        at += step
        for out in p.handleInputRows((1, "a"), iter([pd.DataFrame([vars(e) for e in some])]), None):
            if out["rebuilt"].any():
                kept, rebuilds = {}, rebuilds + 1
            kept |= {r.episode: tuple(r[4:-1]) for r in out.itertuples(index=False)}
    assert [(i, *kept[i]) for i in sorted(kept)] == episodes_of(events)
    assert seed % 3 or rebuilds <= len({e.when for e in events})


def test_order_in_python_is_that_of_spark(spark):
    events = [(i, e) for i in range(40) for e in random_events(i + 100, 12)]
    df = spark.createDataFrame([(i, e.kind, "c", "a", e.ts, e.shares, None, e.cash, e.block, e.tx_index, e.log_index, e.key) for i, e in events], EVENT)
    got = {}
    for r in ledger_chain.ordered(df, "wallet", "asset").orderBy("wallet", "place").collect():
        got.setdefault(r.wallet, []).append(r.key)
    assert got == {i: [e.key for e in S.in_order([e for j, e in events if j == i])] for i in range(40)}


def test_a_delta_touches_its_positions_only_and_changed_inputs_are_noticed(spark, tmp_path):
    e = [(1, "BUY", "c", "x", 1, 2.0, 0.5, 1.0, None, None, None, "a"), (1, "SELL", "c", "x", 2, 2.0, 0.5, 3.0, None, None, None, "b"), (2, "BUY", "c", "y", 1, 1.0, 0.5, 0.5, None, None, None, "d")]
    late = [(1, "BUY", "c", "x", 3, 1.0, 0.5, 1.0, None, None, None, "f"), e[0]]
    store = ledger_store.LedgerVersions(spark, str(tmp_path / "l"), 4)
    store.append(spark.createDataFrame(e, EVENT), 0)
    store.append(spark.createDataFrame(late, EVENT), 1)
    store.append(spark.createDataFrame(late, EVENT), 1)
    count = lambda v: [(r.wallet, r.episode, r.n) for r in store.episodes.read(v).orderBy("wallet", "episode").collect()]
    assert store.episodes.versions() == [1, 2] and count(1) == [(1, 0, 2), (2, 0, 1)] and count(2) == [(1, 0, 2), (1, 1, 1), (2, 0, 1)]
    for v in (1, 2):
        assert rows(store.replay(v).select("wallet", "asset", "episode", "n", "buy")) == rows(store.episodes.read(v).select("wallet", "asset", "episode", "n", "buy"))
    store.events.merge(spark.createDataFrame([(2, "SELL", "c", "y", 5, 1.0, 0.5, 0.5, None, None, None, "z")], EVENT), "x", 0)
    assert [r.wallet for r in store.changed(2).collect()] == [] and store.events.versions() == [1, 2, 3]
    store.digests.merge(store.digests.read().withColumn("events", F.col("events") + 1).where("wallet = 2"), "x", 0)
    with pytest.raises(ledger_store.InputMismatch, match="2"):
        store.replay(3)
    assert store.replay(3, frozen=False).count() == 3


def test_a_stream_kept_in_versions_gives_what_states_give(spark, tmp_path):
    every = [(i, e.kind, "c", "a", e.ts, e.shares, None, e.cash, e.block, e.tx_index, e.log_index, e.key) for i in range(12) for e in random_events(i, 8)]
    df = lambda x: spark.createDataFrame(x, EVENT).coalesce(1)
    for part in (every[::2] + every[:6:2], every[1::2] + every[4:30]):  # repeats in one arrival and in a later one
        df(part).write.mode("append").parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(df(every[:1]).schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    store, states = ledger_store.LedgerVersions(spark, str(tmp_path / "l"), 2, audited=False), S.replay_table(spark, str(tmp_path / "s"))
    store.keep(stream(), str(tmp_path / "c1"), availableNow=True).awaitTermination()
    S.keep_replaying(stream(), states, str(tmp_path / "c2"), availableNow=True).awaitTermination()
    some = lambda x: rows(x.select("wallet", "asset", "episode", "mixed", "n", "first", "last", "shares", "outlay", "most", "buy", "sell", "redeem"))
    whole = ledger_chain.episodes(ledger_chain.ordered(df(every), "wallet", "asset")).select("wallet", "asset", "episode", "mixed", "n", "first", "last", "s.*")
    assert some(store.episodes.read()) == some(states.read()) == some(whole)
    assert store.events.read().count() == len(every) and store.digests.versions() == []

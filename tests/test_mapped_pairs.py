"""Kept prices of mapped pairs, and rows that wait for a later write."""

import time

import pandas as pd

from wagerlake.plans import mapped_pairs as M
from wagerlake.sources.versioned import VersionedTable
from wagerlake.streaming import timed_sink as S

MAPPING = "id long, token string, ticker string, updated long, pm_book struct<bid:double,ask:double,mid:double>, kalshi_book struct<bid:double,ask:double,mid:double>, ensemble double, consensus double"


def test_one_price_a_token_and_a_batch_counts_once(spark, tmp_path):
    first = [(1, " A", "k1", 5, (0.4, 0.5, None), None, None, None), (2, "a ", "k2", 7, None, None, 0.5, 0.6), (3, "a", "k3", 7, None, None, 0.8, None), (4, " ", "k4", 9, None, None, None, None)]
    got = [tuple(r) for r in M.mapped_prices(spark.createDataFrame(first, MAPPING)).select("token", "ticker", "p_true", "source", "source_type", "confidence").collect()]
    assert got == [("a", "K2", 0.6, "sportsbook_consensus", "cross_market", 0.7)]
    store = VersionedTable(spark, str(tmp_path / "p"), ["token"], buckets=2)
    M.persist_prices(store, spark.createDataFrame(first, MAPPING), 0)
    second = spark.createDataFrame([(1, "A", "k1", 8, (0.4, 0.5, None), (0.4, 0.5, None), None, None), (9, "b", "k9", 1, None, None, None, None)], MAPPING)
    assert M.persist_prices(store, second, 1) == M.persist_prices(store, second, 1) == 2
    assert sorted((r.token, r.source, r.priced, r.p_true) for r in store.read().collect()) == [("a", "cross_venue_ob", 2, 0.45), ("b", "universal_prior", 1, 0.5)]
    assert store.read(1).first().source == "sportsbook_consensus"


def test_kinds_of_sources(spark):
    names = {"llm": "llm", "rag_ensemble": "ensemble", "cross_venue_ob": "cross_market", "standalone_ob": "cross_market", "deep_llm": "llm", "derivative_anchor": "ensemble", "execution_price": "ensemble", "manual": "manual"}
    df = spark.createDataFrame([(k,) for k in names], "s string")
    assert {r.s: r.t for r in df.select("s", M.source_type(df.s).alias("t")).collect()} == names


def write(trade, pos, usd, category=None, ev=None, ticker="K"):
    return (trade, pos, ticker, 1.0, pos, 0.5, float(usd), category, ev, f"p{pos}")


def stored(table):
    return sorted((r.trade_id, r.usd_notional, r.category, r.net_ev, r.payload) for r in table.read().collect()) if table.versions() else []


def test_later_writes_of_an_interval_make_one_row_and_survive_a_restart(spark, tmp_path):
    top = str(tmp_path)
    put = lambda *rows: spark.createDataFrame(list(rows), S.ROW).coalesce(1).write.mode("append").parquet(f"{top}/in")
    put(write("a", 1, 10, "c", 4.0), write("a", 2, 20), write("b", 3, 5, "d"), write("x", 4, 5, ticker=" "), write(" ", 5, 5))
    table = VersionedTable(spark, f"{top}/t", ["trade_id"], buckets=2)
    stream = spark.readStream.schema(S.ROW).parquet(f"{top}/in")
    q = S.keep_storing(stream, table, f"{top}/cp", interval=4, processingTime="1 second")
    try:
        end = time.time() + 90
        while not q.lastProgress and time.time() < end:
            time.sleep(0.2)
        assert stored(table) == []  # still pending
        q.stop()
        q = S.keep_storing(stream, table, f"{top}/cp", interval=4, processingTime="1 second")
        while len(stored(table)) < 2 and time.time() < end:
            time.sleep(0.5)
        assert stored(table) == [("a", 20.0, None, None, "p2"), ("b", 5.0, "d", None, "p3")]
        put(write("a", 6, 30, "e"), write("b", 7, 6, None, 2.0))
        while stored(table)[0][1] < 30 and time.time() < end:
            time.sleep(0.5)
        assert stored(table) == [("a", 30.0, "e", None, "p2"), ("b", 6.0, "d", 2.0, "p7")]
    finally:
        q.stop()


def test_last_write_of_a_batch_wins():
    p = S.Pending(0)
    p.init(type("H", (), {"getValueState": lambda s, n, t: None})())
    parts = iter([pd.DataFrame([write("a", 9, 1)], columns=S._NAMES), pd.DataFrame([write("a", 3, 2), write("a", 4, 3)], columns=S._NAMES)])
    assert [tuple(r)[:2] for out in p.handleInputRows(("a",), parts, None) for r in out.itertuples(index=False)] == [("a", 9)]


def test_without_an_interval_a_batch_keeps_its_last_writes_and_no_state(spark, tmp_path):
    top = str(tmp_path)
    for rows in ([write("a", 1, 10, "c", 4.0), write("a", 2, 20), write("b", 3, 5), write("x", 4, 5, ticker=" ")], [write("a", 5, 30, "e")]):
        spark.createDataFrame(rows, S.ROW).coalesce(1).write.mode("append").parquet(f"{top}/in")
    table = VersionedTable(spark, f"{top}/t", ["trade_id"], buckets=2)
    q = S.keep_storing(spark.readStream.schema(S.ROW).option("maxFilesPerTrigger", 1).parquet(f"{top}/in"), table, f"{top}/cp", interval=0, availableNow=True)
    q.awaitTermination()
    assert stored(table) == [("a", 30.0, "e", None, "p2"), ("b", 5.0, None, None, "p3")]
    assert all(not p["stateOperators"] for p in q.recentProgress)

"""Hand-built cases of EV fields, fair-price sources, matrices, chain order, range gaps, watchlists and short-term markets."""

import math

import pytest
from pyspark.sql import functions as F

from wagerlake.plans import evidence as E
from wagerlake.plans import titles as T

c = F.col
NAN, INF = math.nan, math.inf


def rows(df, *by):
    return [tuple(r) for r in df.orderBy(*by).collect()]


def test_ev_fields(spark):
    cases = [
        ((2.0, 5.0, None, None, None, None, None), 2.0), ((NAN, 5.0, None, None, None, None, None), 5.0), ((None, 0.0, 1.5, None, None, None, None), 1.5), ((None, 0.0, None, 0.0, 3.0, None, None), 0.0),
        ((None, INF, None, None, -3.0, None, None), -3.0), ((None, 0.0, None, None, None, 0.0, 0.03), 3.0), ((None, NAN, None, None, None, 0.0, 0.03), 0.0), ((None, None, None, None, None, 4.0, None), 4.0),
        ((None, None, None, None, None, None, -7.0), -7.0), ((None, None, None, None, None, 0.0, None), None), ((None,) * 7, None), ((None, None, None, None, None, NAN, NAN), None),
    ]
    df = spark.createDataFrame([(i, *x) for i, (x, _) in enumerate(cases)], "i int, a double, b double, c double, d double, e double, f double, g double")
    assert [x for _, x in rows(df.select("i", E.trade_ev_percent(*map(F.col, "abcdefg")).alias("x")), "i")] == [y for _, y in cases]


def test_placeholder_and_authority(spark):
    cases = [
        ((0.7, "standalone_ob", 0.9, False), (False, True)), ((None, "standalone_ob", 0.9, False), (True, True)), ((NAN, None, None, None), (True, True)), ((0.7, " Universal_Prior ", None, None), (True, True)),
        ((0.7, "universal_prior", None, None), (True, False)), ((0.7, "llm", 0.34, False), (True, False)), ((0.5, "llm", None, False), (True, True)), ((0.5, "llm", 0.49, False), (True, True)), ((0.5, "llm", 0.5, False), (False, True)),
        ((0.5, "llm", NAN, True), (True, False)),
    ]
    df = spark.createDataFrame([(i, *x) for i, (x, _) in enumerate(cases)], "i int, p double, s string, k double, low boolean")
    got = rows(df.select("i", E.placeholder(c("p"), c("s"), c("k")), E.authoritative(c("s"), c("k"), c("low"))), "i")
    assert [r[1:] for r in got] == [y for _, y in cases]


def test_source_coverage_takes_the_newest_row_of_a_token(spark):
    df = spark.createDataFrame([(1, "A ", "llm", 0.9, 5), (2, "a", "standalone_ob", 0.1, 6), (3, "a", "execution_price", 0.1, 6), (4, "b", "", None, 1), (5, "c", None, 0.2, 1)], "market int, token string, source string, score double, calculated int")
    assert rows(E.source_coverage(df), "source") == [("standalone_ob", 1, 1, 0, 1), ("unknown", 2, 0, 0, 1)]
    assert E.source_coverage(df.limit(0)).count() == 0


def test_matrices(spark):
    df = spark.createDataFrame(
        [("complete", True, False, True, "FAIL", "PASS"), ("complete", False, None, True, "PASS", "PASS"), ("complete", None, True, False, "PASS", "FAIL"), ("failed", True, True, True, "PASS", "PASS"), ("complete", True, True, None, None, "PASS")],
        "status string, production boolean, api boolean, indexed boolean, historical string, validity string",
    )
    got = {r.matrix: tuple(r)[1:] for r in E.confusion_matrices(df).collect()}
    assert got["production"] == (1, 1, 1, 0, 0, 1, 3, 1, 4, pytest.approx(2 / 3))
    assert got["api"] == (0, 2, 1, 0, 1, 0, 3, 1, 4, 1.0)
    assert got["historical"] == (0, 1, 1, 0, 0, 0, 2, 0, 2, 1.0)


def test_chain_order(spark):
    df = spark.createDataFrame([(1, 5, 0), (2, 5, None), (3, 5, -1), (4, 0, 3), (5, None, 3)], "i int, b long, l long")
    assert [x for _, x in rows(df.select("i", E.chain_order(c("b"), c("l"))), "i")] == ["full", "block", "block", "none", "none"]


def test_window_parts(spark):
    df = spark.createDataFrame([("x", 1, 4), ("x", 7, 8), ("x", 12, 30), ("y", 40, 50), ("z", 0, 99)], "k string, a long, b long")
    assert rows(E.window_parts(df, "k", 3, 20), "k", "a") == [("x", "covered", 3, 4), ("x", "gap", 5, 6), ("x", "covered", 7, 8), ("x", "gap", 9, 11), ("x", "covered", 12, 20), ("y", "gap", 3, 20), ("z", "covered", 3, 20)]
    assert E.window_parts(df, "k", 3, 2).count() == 0


def test_modal_condition(spark):
    df = spark.createDataFrame([(1, "b", 1), (1, "a", 2), (1, " a", 3), (1, "b", 4), (2, None, 1), (2, " ", 2), (3, None, 1), (3, None, 2), (3, "q", 3)], "asset int, condition string, raw_id int")
    assert rows(E.modal_condition(df), "asset") == [(1, "b"), (2, ""), (3, "q")]


def test_watchlist(spark):
    df = spark.createDataFrame(
        [(1, 2.0, 9, 5, 50.0, 0, 0.1, None, 7, None), (2, None, 9, 9, 60.0, 1, None, 1.0, 8, True), (3, 3.0, 9, 1, None, 2, 0.3, 2.0, 9, True), (4, 4.0, 0, 1, 1.0, 3, 0.2, 3.0, 1, True), (5, 5.0, 9, 1, 1.0, 3, 0.2, 3.0, 1, False)],
        "wallet int, profit_factor double, closed int, pnl int, win_rate double, open int, roi double, average_ev double, bookmarked_at int, alerts boolean",
    )
    ids = lambda **kw: [r.wallet for r in E.watchlist(df, **kw).collect()]
    assert ids() == [3, 1] and ids(least_factor=0.0) == [3, 1, 2] and ids(alerts=False) == [5] and ids(only_open=True) == [3] and ids(least_positions=0) == [4, 3, 1]
    assert ids(sort="highest_win_rate") == [1, 3] and ids(sort="top_pnl") == [1, 3] and ids(sort="highest_ev") == [3, 1] and all(len(ids(sort=s)) == 2 for s in E.SORTS)


@pytest.mark.parametrize(
    "slug, title, want",
    [
        ("btc-updown-15m-1700000000", None, True), ("sol up down", "", True), ("eth-up-down", None, True), (None, "Ethereum Up or Down - June 3", True), (None, "Will it go up or down 9:15AM - 9:30AM", True), ("x", "up-or-down 10:15–10:30", True),
        ("xrp-updown-5m", None, True), ("15m-updown", None, True), ("updown_5min", None, True), ("xrp-updown", "in May", False), (None, "Solana up or down", False), (None, "match 10:15 - 10:30", False), (None, None, False), ("", "", False),
    ],
)
def test_short_term_markets(spark, slug, title, want):
    df = spark.createDataFrame([(slug, title)], "slug string, title string")
    assert df.select(T.ephemeral(c("slug"), c("title"))).head()[0] is want

"""Golden cases of event order, episodes, lifecycles and the audit, and a plain replay of random ledgers."""

import random

import pytest
from pyspark.sql import functions as F

from wagerlake.plans import ledger_chain as L

EVENT = "wallet long, kind string, condition string, asset string, ts long, shares double, price double, cash double, block long, tx_index long, log_index long, key string"
RAW = "wallet long, raw_type string, side string, condition string, asset string, ts long, shares double, price double, cash double, block long, tx_index long, log_index long, tx string, pos long"


def event(key, kind="BUY", shares=1.0, cash=1.0, ts=1000, block=None, tx=None, log=None, asset="yes", condition="c", wallet=1):
    return (wallet, kind, condition, asset, ts, float(shares), None, float(cash), block, tx, log, key)


def keys_in_order(spark, events):
    e = L.ordered(spark.createDataFrame(events, EVENT), "wallet", "asset")
    return [r.key for r in e.orderBy("place").select("key").collect()]


@pytest.mark.parametrize(("events", "want"), [
    ([event("b", block=101, log=1, ts=0), event("a", block=100, log=1, ts=1_700_000_000)], ["a", "b"]),
    ([event("late", block=100, log=9, ts=1), event("early", block=100, log=4, ts=9_999)], ["early", "late"]),
    ([event("second", block=50, log=8), event("first", block=50, log=2)], ["first", "second"]),
    ([event("zero", ts=0), event("valid", ts=1_700_000_000)], ["valid", "zero"]),
    ([event("free", ts=5), event("chain", ts=0, block=7)], ["chain", "free"]),
    ([event("b", block=7, tx=2), event("a", block=7, tx=3)], ["b", "a"]),
    ([event("x", block=7), event("a", block=7, tx=3), event("c", block=7, tx=1)], ["c", "a", "x"]),
    ([event("n", block=7, tx=2), event("l1", block=7, tx=1, log=5), event("l3", block=7, tx=3, log=9)], ["l1", "n", "l3"]),
    ([event("b", ts=5), event("a", ts=5)], ["a", "b"]),
])
def test_canonical_order(spark, events, want):
    assert keys_in_order(spark, events) == want


def life(spark, events, resolved=(), tokens=None):
    r = spark.createDataFrame(list(resolved), "condition string, final boolean, winning_asset string")
    return L.lifecycles(L.ordered(spark.createDataFrame(events, EVENT), *L.POSITION), r, tokens).orderBy("asset", "episode").collect()


def test_win_and_loss_at_resolution(spark):
    buy = [event("a", shares=100, cash=40)]
    won, lost, none = life(spark, buy, [("c", True, "yes")])[0], life(spark, buy, [("c", True, "no")])[0], life(spark, buy, [("c", False, None)])[0]
    assert (won.completed, won.pnl, won.capital, won.correct, won.reason) == (True, 60.0, 40.0, True, "held_through_resolution")
    assert (lost.completed, lost.pnl, lost.correct) == (True, -40.0, False)
    assert (none.completed, none.pnl, none.status, none.excluded) == (False, None, "open", False)
    unknown = life(spark, buy, [("c", True, None)])[0]
    assert (unknown.completed, unknown.payout, unknown.pnl, unknown.correct) == (True, 0.0, -40.0, None)


def test_exit_completes_before_resolution_and_reentry_opens_an_episode(spark):
    out = life(spark, [event("buy1", block=100, log=1, shares=10, cash=5), event("sell1", "SELL", block=101, log=2, shares=10, cash=6), event("buy2", block=102, log=3, shares=4, cash=2, ts=0)])
    assert [(p.episode, p.n, p.completed, p.pnl, p.reason) for p in out] == [(0, 2, True, 1.0, "fully_exited"), (1, 1, False, None, None)]
    twice = life(spark, [event(f"{i}", "BUY" if i % 2 == 0 else "SELL", ts=i + 1, shares=3, cash=1 + i) for i in range(4)])
    assert [(p.episode, p.completed, p.pnl) for p in twice] == [(0, True, 1.0), (1, True, 1.0)]


def test_capital_is_the_largest_outlay(spark):
    p = life(spark, [event("a", ts=1, shares=10, cash=10), event("b", "SELL", ts=2, shares=5, cash=8), event("d", ts=3, shares=10, cash=9), event("e", "SELL", ts=4, shares=15, cash=20)])[0]
    assert (p.capital, p.pnl, p.roi) == (11.0, 9.0, 9.0 / 11.0)


def test_redeem_merge_and_split(spark):
    p = life(spark, [event("a", ts=1, shares=10, cash=6), event("b", "REDEEM", ts=2, shares=0, cash=10)])[0]
    assert (p.shares, p.redeem, p.pnl, p.reason) == (0.0, 10.0, 4.0, "fully_exited")
    p = life(spark, [event("a", ts=1, shares=10, cash=6), event("b", "SPLIT", ts=2, shares=10, cash=5), event("d", "MERGE", ts=3, shares=5, cash=5)], [("c", True, "yes")])[0]
    assert (p.shares, p.status, p.excluded, p.completed, p.pnl) == (15.0, "requires_merge_split_resolution", True, False, None)
    assert (p.buy, p.sell, p.most) == (11.0, 5.0, 11.0)
    p = life(spark, [event("a", ts=1, shares=4, cash=2), event("b", "MERGE", ts=2, shares=9, cash=0), event("d", ts=3, shares=1, cash=1)])[0]
    assert (p.episode, p.n, p.shares, p.mixed) == (0, 3, 1.0, True)


def test_free_positions_are_invalid_and_zero_shares_resolve(spark):
    p = life(spark, [event("a", "SELL", shares=1, cash=2)])[0]
    assert (p.status, p.excluded, p.pnl) == ("invalid_capital_accounting", True, None)
    p = life(spark, [event("a", ts=1, shares=5, cash=5), event("b", "SELL", ts=2, shares=6, cash=9)], [("c", True, "yes")])[0]
    assert (p.reason, p.payout, p.pnl) == ("market_resolved", 0.0, 4.0)


def test_condition_of_a_position(spark):
    e = [event("a", condition="c2", ts=1), event("b", condition="c1", ts=2), event("d", condition="c1", ts=3), event("f", condition="", asset="no"), event("g", condition="z", asset="tie", ts=1), event("h", condition="y", asset="tie", ts=2), event("i", asset="")]
    assert {p.asset: p.condition for p in life(spark, e)} == {"yes": "c1", "no": "unresolved:asset:no", "tie": "z"}
    tokens = spark.createDataFrame([("no", "by token")], "asset string, condition string")
    assert {p.asset: p.condition for p in life(spark, e, tokens=tokens)}["no"] == "by token"


def raw(raw_type="TRADE", side="BUY", size=10.0, price=0.5, cash=5.0, tx="0xHash", pos=1, log=None, wallet=1, asset=" yes ", ts=100):
    return (wallet, raw_type, side, "c", asset, ts, size, price, cash, 5 if log is not None else None, None, log, tx, pos)


def test_one_fill_of_both_lists_counts_once_with_the_last_activity_row(spark):
    a = L.activity(spark.createDataFrame([raw(pos=1, log=3), raw(pos=2, tx="0xhash", log=9), raw("reward", pos=3), raw(side=None, pos=4)], RAW))
    t = L.fills(spark.createDataFrame([raw(pos=1), raw(pos=2, tx="0xother"), raw(side="buy", pos=3)], RAW))
    got = L.merged(a, t).orderBy("key").collect()
    assert [(r.log_index, r.asset, r.cash) for r in got] == [(9, "yes", 5.0), (None, "yes", 5.0)]


def plain_replay(events):
    """Episodes of one position by the definition, event by event."""
    mixed = any(e[1] in ("MERGE", "SPLIT") for e in events)
    new = lambda: {"n": 0, "shares": 0.0, "outlay": 0.0, "most": 0.0, "buy": 0.0, "sell": 0.0, "redeem": 0.0}
    out, s = [], new()
    for e in events:
        kind, shares, cash = e[1], e[5], e[7]
        if not mixed and s["n"] and abs(s["shares"]) <= 1e-4 and s["buy"] > 1e-4 and kind == "BUY":
            out.append(s)
            s = new()
        s["n"] += 1
        if kind == "BUY":
            s["shares"] += shares
            s["outlay"] += cash
            s["buy"] += cash
        elif kind == "SELL":
            s["shares"] -= shares
            s["outlay"] -= cash
            s["sell"] += cash
        elif kind == "REDEEM":
            s["shares"] = 0.0
            s["outlay"] -= cash
            s["redeem"] += cash
        elif kind == "SPLIT" and shares > 0:
            s["shares"] += shares
            if cash > 0:
                s["outlay"] += cash
                s["buy"] += cash
        elif kind == "MERGE" and shares > 0 and s["shares"] > 1e-4:
            gone = min(shares, s["shares"])
            s["outlay"] = max(0.0, s["outlay"] - s["outlay"] * (gone / s["shares"]))
            s["shares"] -= gone
            if cash > 0:
                s["sell"] += cash
                s["outlay"] -= cash
        s["most"] = max(s["most"], s["outlay"])
    return [*out, s]


def ledgers(seed, kinds):
    rnd = random.Random(seed)
    return [event(f"{a}-{i:03}", rnd.choice(kinds), rnd.choice([1, 1, 2, 0.5]), rnd.randint(0, 90) / 100, ts=i + 1, asset=f"a{a}") for a in range(60) for i in range(rnd.randint(1, 25))]


@pytest.mark.parametrize("kinds", [["BUY", "SELL"], ["BUY", "BUY", "SELL", "SELL", "REDEEM"], ["BUY", "BUY", "SELL", "REDEEM", "SPLIT", "MERGE"]])
def test_random_ledgers_replay_as_by_definition(spark, kinds):
    events = ledgers(len(kinds), kinds)
    e = spark.createDataFrame(random.Random(1).sample(events, len(events)), EVENT)
    got = {(r.asset, r.episode): (r.n, *(round(r.s[x], 9) for x in ("shares", "outlay", "most", "buy", "sell", "redeem"))) for r in L.episodes(L.ordered(e, *L.POSITION)).collect()}
    want = {(a, i): (s["n"], *(round(s[x], 9) for x in ("shares", "outlay", "most", "buy", "sell", "redeem"))) for a in {e[3] for e in events} for i, s in enumerate(plain_replay([e for e in events if e[3] == a]))}
    assert got == want


def test_audit_of_wallets_with_and_without_events(spark):
    a = L.activity(spark.createDataFrame([raw(pos=1, ts=1), raw(side="SELL", cash=8.0, pos=2, ts=2), raw("SPLIT", None, asset="no", pos=3)], RAW))
    t = L.fills(spark.createDataFrame([raw(pos=1, ts=1), raw(pos=2, wallet=2)], RAW))
    wallets = spark.createDataFrame([(1, "direct", False, False, False, False), (2, "direct", False, False, True, False), (3, "unresolved", True, False, False, False)], "wallet long, method string, low boolean, positions_only boolean, activity_truncated boolean, trades_truncated boolean")
    r = {x.wallet: x for x in L.audit(a, t, spark.createDataFrame([("c", False, None)], "condition string, final boolean, winning_asset string"), wallets).collect()}
    assert (r[1].raw_events, r[1].events, r[1].positions, r[1].completed, r[1].merge_split, r[1].ambiguous, r[1].advice) == (4, 3, 2, 1, 1, 1, "exclude_policy_sufficient")
    assert (r[1].observed.total_pnl, r[1].observed.median_capital, r[1].credible.completed, r[1].reasons) == (3.0, 5.0, 1, ["merge_split_unresolved"])
    assert (r[2].coverage, r[2].reasons, r[2].credible, r[2].history) == (0.0, ["activity_truncated", "gamma_resolution_incomplete"], None, "partial-and-metrics-unsafe")
    assert (r[3].events, r[3].metrics, r[3].history, r[3].coverage) == (0, "unusable", "unusable", 1.0)


def test_ledgers_without_rows(spark):
    none = spark.createDataFrame([], EVENT)
    assert L.episodes(L.ordered(none, *L.POSITION)).count() == 0 and L.conditions(L.ordered(none, *L.POSITION)).where(F.lit(True)).count() == 0


def test_six_decimals_of_ratios_beyond_a_long(spark):
    """A return on the dust of a capital is larger than a long holds once it is scaled."""
    x = [1.08987111e16, -5e15, 0.1234565, 2.5e-7, -0.5, 8e9, float("inf"), None]
    got = [r.y for r in spark.createDataFrame([(v,) for v in x], "x double").select(L._six(F.col("x")).alias("y")).collect()]
    assert got[-1] is None and got[:-1] == pytest.approx([1.08987111e16, -5e15, 0.123457, 0.0, -0.5, 8e9, float("inf")], rel=1e-12)

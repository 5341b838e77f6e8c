"""As-of words of several sources, the ladder of fair prices, and EVs of hand-built trades."""

import random

import pytest

from wagerlake.plans import trade_ev as T

QUOTE = "source string, market long, ts long, seq long, q struct<bid:double,ask:double,mid:double,p:double>"
ASK = "id long, market long, ts long, platform string, mapped boolean, price double"


def test_as_of_is_the_last_fresh_word_of_each_source(spark):
    rnd = random.Random(8)
    ages = {"pm_book": 5, "kalshi_book": 20, "ensemble": 50}
    asks = [(i, rnd.choice([1, 1, 1, 2, None]), rnd.choice([rnd.randint(-60, 200), None]) if i % 9 == 0 else rnd.randint(-60, 200), "kalshi", True, None) for i in range(200)]
    quotes = [(rnd.choice([*ages, "other"]), rnd.choice([1, 1, 2, None]), rnd.choice([rnd.randint(-60, 200), None]) if k % 9 == 0 else rnd.randint(-60, 200), k, (None, None, None, float(k))) for k in range(300)]
    got = {r.id: tuple(r[s] and r[s].p for s in ages) for r in T.as_of(spark.createDataFrame(asks, ASK), spark.createDataFrame(quotes, QUOTE), ages).collect()}

    def last(market, ts, source):
        if market is None or ts is None:
            return None
        seen = [(q[2], q[3], q[4][3]) for q in quotes if q[0] == source and q[1] == market and q[2] is not None and q[2] <= ts]
        return max(seen)[2] if seen and ts - max(seen)[0] <= ages[source] else None

    assert got == {a[0]: tuple(last(a[1], a[2], s) for s in ages) for a in asks}


def ev(spark, quotes=(), platform="polymarket", mapped=True, price=0.4):
    q = [(s, 1, 100 - age, k, v) for k, (s, age, v) in enumerate(quotes)]
    asks = spark.createDataFrame([(1, 1, 100, platform, mapped, price)], ASK)
    r = T.trade_ev(asks, spark.createDataFrame(q, QUOTE)).first()
    return r.status, r.from_cache, r.source, r.confidence, r.mode, r.p_true and round(r.p_true, 6), r.p_market and round(r.p_market, 6), r.gross, r.net


BOOK, WIDE, ENS, CONS, MAP = (0.5, 0.52, None, None), (0.3, 0.5, None, None), (None, None, None, 0.7), (None, None, 0.62, None), (None, None, None, None)
CROSS = (0.51 * (0.51 / (0.52 - 0.5)) + 0.4 * (0.4 / (0.5 - 0.3))) / (0.51 / (0.52 - 0.5) + 0.4 / (0.5 - 0.3))


@pytest.mark.parametrize(("quotes", "more", "want"), [
    ([("pm_book", 5, BOOK), ("kalshi_book", 5, WIDE), ("mapping", 9, MAP)], {}, ("cross_venue_ob", 0.85, "paired_cross", CROSS, 0.4)),
    ([("pm_book", 5, BOOK), ("kalshi_book", 11, WIDE), ("mapping", 9, MAP)], {}, ("cross_venue_ob", 0.85, "paired_cross", 0.51, 0.4)),
    ([("pm_book", 5, BOOK), ("mapping", 9, MAP), ("ensemble", 1800, ENS)], {}, ("cached_ensemble", 0.8, "paired_cross", 0.7, 0.4)),
    ([("mapping", 300, MAP), ("ensemble", 1, ENS)], {}, ("cached_ensemble", 0.75, "paired_cross", 0.7, 0.4)),
    ([("mapping", 301, MAP), ("ensemble", 1, ENS)], {}, ("cached_ensemble", 0.65, "standalone_resting", 0.7, 0.4)),
    ([("mapping", 1, MAP), ("consensus", 1, CONS), ("ensemble", 1, (None, None, None, 0.5))], {}, ("sportsbook_consensus", 0.7, "exchange_consensus", 0.62, 0.4)),
    ([("consensus", 1, CONS), ("pm_book", 1, BOOK)], {}, ("sportsbook_consensus", 0.7, "exchange_consensus", 0.62, 0.4)),
    ([("consensus", 1, CONS), ("ensemble", 1, ENS)], {}, ("cached_ensemble", 0.75, "exchange_consensus", 0.7, 0.4)),
    ([("consensus", 1, CONS), ("kalshi_book", 1, WIDE)], {"platform": "kalshi"}, ("standalone_ob", 0.8, "standalone_resting", 0.4, 0.4)),
    ([("consensus", 1, CONS)], {"platform": "kalshi"}, ("sportsbook_consensus", 0.6, "exchange_consensus", 0.62, 0.4)),
    ([("kalshi_book", 1, WIDE)], {}, ("execution_price", 0.25, "standalone_resting", 0.4, 0.4)),
    ([("kalshi_book", 1, WIDE)], {"price": None}, ("universal_prior", 0.1, "standalone_resting", 0.4, 0.4)),
    ([], {"price": 0.0}, ("universal_prior", 0.1, "standalone_resting", 0.5, 0.5)),
    ([("pm_book", 1, (0.6, 0.5, 0.55, None))], {"price": 37.0}, ("standalone_ob", 0.8, "standalone_resting", 0.55, 0.37)),
])
def test_ladder(spark, quotes, more, want):
    status, cached, *got, gross, net = ev(spark, quotes, **more)
    assert (status, cached) == ("ok", False) and tuple(got) == (*want[:3], round(want[3], 6), round(want[4], 6))
    edge = want[3] - want[4]
    fee = 0.07 * want[4] * (1 - want[4]) if more.get("platform") == "kalshi" else 0.001 * want[4]
    assert gross == pytest.approx(edge * 100, abs=0.051) and net == pytest.approx((edge - fee) * 100, abs=0.051)


def test_cached_evs_are_priced_anew(spark):
    cached = ("cached", 1800, (None, None, None, 0.9))
    assert ev(spark, [cached])[1:7] == (True, "cached_ensemble", 0.65, "standalone_resting", 0.9, 0.4)
    assert ev(spark, [cached, ("ensemble", 1, ENS)])[5] == 0.7
    assert ev(spark, [("cached", 1801, cached[2])])[1:4] == (False, "execution_price", 0.25)
    assert ev(spark, [("cached", 1, (None, None, None, 0.8)), ("pm_book", 1, BOOK)], price=None)[1:6] == (True, "cached_ensemble", 0.75, "standalone_resting", 0.8)
    # nothing paid and a net of 0: the ladder decides without the cached one
    assert ev(spark, [("cached", 1, (None, None, None, None))], price=None)[1:4] == (False, "universal_prior", 0.1)


def test_unmapped_trades_have_no_ev(spark):
    assert ev(spark, [("pm_book", 1, BOOK)], mapped=False) == ("unmapped", *[None] * 8)

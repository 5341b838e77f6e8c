"""Hand-built cases of the ledger, profit factor, prices and assignment."""

import itertools
import math
import random

from pyspark.sql import functions as F

from wagerlake.functions import prices
from wagerlake.plans import ledger, matching, performance
from wagerlake.sources.shared import checkpointed

TRADES = "wallet long, asset long, side string, shares long, cash long, ts long, k string"
RESOLUTION = "condition long, final boolean, winning_asset long, resolved_at long"


def test_lifecycles(spark):
    t = [(1, 20, "BUY", 10, 400, 1, "a"), (1, 20, "SELL", 10, 600, 2, "b"), (2, 22, "BUY", 10, 400, 1, "c"), (3, 23, "BUY", 10, 400, 1, "d"), (4, 24, "BUY", 5, 100, 1, "e"), (5, 26, "SELL", 5, 100, 1, "f")]
    r = [(10, True, 20, 9), (11, True, 22, 9), (12, False, 24, 9), (13, True, 26, 9)]
    got = {x.wallet: x for x in ledger.lifecycles(spark.createDataFrame(t, TRADES), spark.createDataFrame(r, RESOLUTION)).collect()}
    assert (got[1].reason, got[1].pnl, got[1].most) == ("fully_exited", 200, 400)
    assert (got[2].reason, got[2].payout, got[2].pnl, got[2].correct) == ("held_through_resolution", 1000, 600, True)
    assert (got[3].payout, got[3].pnl, got[3].correct) == (0, -400, False)
    assert got[4].reason is None and got[4].pnl is None
    assert got[5].reason is None


def test_episodes_open_after_a_full_exit(spark):
    t = [(1, 2, s, 5, 10 * i, i, str(i)) for i, s in enumerate(["BUY", "SELL", "BUY", "SELL", "BUY"], 1)]
    got = ledger.episodes(spark.createDataFrame(t, TRADES), "wallet", "asset").orderBy("episode").collect()
    assert [(x.episode, x.e.n, x.e.s.shares) for x in got] == [(0, 2, 0), (1, 2, 0), (2, 1, 5)]


def test_replay_does_not_depend_on_row_order(spark):
    rnd = random.Random(1)
    t = [(w, 2, rnd.choice(["BUY", "SELL"]), rnd.randint(1, 9), rnd.randint(1, 99), rnd.randint(1, 5), f"{w}-{i}") for w in range(4) for i in range(25)]
    run = lambda rows: sorted(map(str, ledger.replay(spark.createDataFrame(rows, TRADES), "wallet", "asset").select("wallet", "s").collect()))
    assert run(t) == run(rnd.sample(t, len(t)))
    for w in range(4):
        out = most = 0
        for _, _, side, _, cash, *_ in sorted((x for x in t if x[0] == w), key=lambda x: (x[5], x[6])):
            out += cash if side == "BUY" else -cash
            most = max(most, out)
        got = ledger.replay(spark.createDataFrame([x for x in t if x[0] == w], TRADES), "wallet").first().s
        assert (got.outlay, got.most) == (out, most)


def test_profit_factor(spark):
    pf = lambda xs: performance.profit_factor(spark.createDataFrame([(1, x) for x in xs], "wallet long, realized long"), "wallet").first()
    assert round(pf([100, -50, 80, -20]).profit_factor, 2) == 2.57
    assert pf([10, 5]).profit_factor is None
    best = pf([500, 50, -100])
    assert best.without_best < best.profit_factor and best.positions == 3
    flat = pf([90, -30, 0])
    assert (flat.profit_factor, flat.win_rate, flat.positions) == (3, 50, 3)


def test_prices(spark):
    x = lambda *cols: spark.range(1).select(*cols).first()
    lit = F.lit
    assert x(prices.box_cost(lit(0.48), lit(0.49)))[0] == 0.97
    assert x(prices.microprice(lit(0.6), lit(0.5), lit(1.0), lit(1.0)))[0] is None
    assert abs(x(prices.microprice(lit(0.4), lit(0.6), lit(1.0), lit(3.0)))[0] - 0.45) < 1e-12
    assert x(prices.american_odds(lit(100)), prices.american_odds(lit(-300)), prices.american_odds(lit(0)))[:] == (0.5, 0.75, None)
    assert abs(x(prices.normal_cdf(lit(1.96)))[0] - 0.975) < 1e-4


def test_assignment_is_the_greedy_one(spark):
    rnd = random.Random(2)
    scored = [(a, b, rnd.randint(0, 30) / 10) for a, b in itertools.product(range(9), range(20, 28)) if rnd.random() < 0.7]
    used, want = set(), []
    for a, b, s in sorted(scored, key=lambda x: (-x[2], x[0], x[1])):
        if a not in used and b not in used:
            used |= {a, b}
            want.append((a, b, s))
    assert sorted(map(tuple, matching.assigned(spark.createDataFrame(scored, "a long, b long, score double")).collect())) == sorted(want)


def vectors(rnd, n, at=0):
    """Rows past id 500 with copies, a zero vector, a null one, another length and a repeated id."""
    some = [[rnd.choice([-2.0, -1.0, 0.5, 1.0, 3.0]) for _ in range(5)] for _ in range(12)]
    rows = [(at + i, rnd.choice(some), i % 2 if rnd.random() < 0.1 else rnd.randint(0, 2)) for i in range(n)]
    return rows + [(at + n, [0.0] * 5, 0), (at + n + 1, None, 0), (at + n + 2, [1.0, 2.0], 0), (at + n + 3, some[0], None), (at, some[3], 1)]


EMBEDDINGS = "vec_id long, embedding array<float>, label int"


def brute_pairs(rows):
    def score(x, y):
        if not x or not y or len(x) != len(y):
            return 0.0
        size = math.sqrt(sum(p * p for p in x)) * math.sqrt(sum(p * p for p in y))
        return math.floor((sum(p * q for p, q in zip(x, y)) / size if size else 0.0) * 10_000 + 0.5) / 10_000

    return [(a, b, score(x, y)) for a, x, k in rows for b, y, m in rows if a % 2 == 0 and b % 2 == 1 and k is not None and k == m]


def test_pairs_of_all_ids(spark, monkeypatch):
    monkeypatch.setattr(matching, "TILE", 4)
    rows = vectors(random.Random(3), 90, at=460)
    e, want = spark.createDataFrame(rows, EMBEDDINGS), brute_pairs(rows)
    assert sorted(map(tuple, matching.pairs_of(e, 0.3).collect())) == sorted(x for x in want if x[2] >= 0.3)
    best = {}
    for a, b, s in want:
        best[a] = max(best.get(a, (-2, 0)), (s, -b))
    assert {a: (s, -b) for a, b, s in matching.best_of(e).collect()} == best


def one_by_one(scored):
    used, out = set(), []
    for a, b, s in sorted(scored, key=lambda x: (-x[2], x[0], x[1])):
        if (0, a) not in used and (1, b) not in used:
            used |= {(0, a), (1, b)}
            out.append((a, b, s))
    return sorted(out)


def test_assignment_of_many_copies_leaves_no_pair(spark, monkeypatch):
    rows = [(i, [1.0, 2.0], 1) for i in range(500)]
    want = [(i, i + 1, 1.0) for i in range(0, 500, 2)]
    tables = []
    monkeypatch.setattr(matching, "checkpointed", lambda df: tables.append(1) or checkpointed(df))
    for rest in (matching.REST, 0):
        monkeypatch.setattr(matching, "REST", rest)
        assert sorted(map(tuple, matching.assigned_of(spark.createDataFrame(rows, EMBEDDINGS), 0.3).collect())) == want
    assert len(tables) < 25


def test_assignment_of_a_long_chain(spark):
    scored = [(a, b, 1000.0 - 2 * a - (b > a)) for a in range(300) for b in (a, a + 1)]
    assert sorted(map(tuple, matching.assigned(spark.createDataFrame(scored, "a long, b long, score double")).collect())) == one_by_one(scored)


def test_assignment_by_classes_is_the_greedy_one(spark, monkeypatch):
    monkeypatch.setattr(matching, "TILE", 4)
    for seed, rest in ((4, 0), (5, 60), (6, matching.REST)):
        monkeypatch.setattr(matching, "REST", rest)
        rows = vectors(random.Random(seed), 60)
        got = matching.assigned_of(spark.createDataFrame(rows, EMBEDDINGS), 0.3).collect()
        assert sorted(map(tuple, got)) == one_by_one([x for x in brute_pairs(rows) if x[2] >= 0.3])


def test_replay_of_redeem_split_and_merge(spark):
    t = [
        (1, 20, "BUY", 10, 400, 1, "a"), (1, 20, "REDEEM", 7, 1000, 2, "b"),
        (2, 20, "BUY", 10, 400, 1, "a"), (2, 20, "SPLIT", 5, 500, 2, "b"), (2, 20, "SPLIT", 5, 0, 3, "c"), (2, 20, "SPLIT", 0, 90, 4, "d"),
        (3, 20, "BUY", 9, 400, 1, "a"), (3, 20, "MERGE", 3, 0, 2, "b"), (3, 20, "MERGE", 30, 50, 3, "c"), (3, 20, "MERGE", 5, 70, 4, "d"),
        (4, 20, "BUY", 9, 400, 1, "a"), (4, 20, "REWARD", 9, 400, 2, "b"), (4, 20, "SELL", None, None, 3, "c"),
        (5, 20, "BUY", 3, 100, 1, "a"), (5, 20, "MERGE", 1, 0, 2, "b"),
    ]
    got = {x.wallet: tuple(x.s) for x in ledger.replay(spark.createDataFrame(t, TRADES), "wallet", "asset").collect()}
    assert got[1] == (0, -600, 400, 400, 0, 1000)
    assert got[2] == (20, 900, 900, 900, 0, 0)
    assert got[3] == (0, -50, 400, 400, 50, 0)
    assert got[4] == (9, 400, 400, 400, 0, 0)
    assert got[5][0] == 2 and abs(got[5][1] - 200 / 3) < 1e-9


def test_lifecycles_and_episodes_with_redeem_split_and_merge(spark):
    t = [
        (1, 20, "BUY", 10, 400, 1, "a"), (1, 20, "REDEEM", 10, 1000, 2, "b"), (1, 20, "BUY", 4, 200, 3, "c"),
        (2, 20, "BUY", 10, 500, 1, "a"), (2, 20, "MERGE", 10, 0, 2, "b"), (2, 20, "BUY", 4, 200, 3, "c"),
        (3, 20, "BUY", 10, 400, 1, "a"), (3, 20, "REDEEM", 10, 1000, 2, "b"),
        (4, 20, "BUY", 10, 500, 1, "a"), (4, 20, "SELL", 10, 600, 2, "b"), (4, 20, "BUY", 8, 320, 3, "c"), (4, 20, "SELL", 8, 440, 4, "d"),
        (5, 20, "BUY", 100, 5000, 1, "a"), (5, 20, "SELL", 60, 3600, 2, "b"), (5, 20, "BUY", 40, 2800, 3, "c"),
    ]
    df = spark.createDataFrame(t, TRADES)
    got = sorted((x.wallet, x.episode, x.e.n, x.e.s.shares) for x in ledger.episodes(df, "wallet", "asset").collect())
    assert got == [(1, 0, 2, 0), (1, 1, 1, 4), (2, 0, 3, 4), (3, 0, 2, 0), (4, 0, 2, 0), (4, 1, 2, 0), (5, 0, 3, 80)]
    life = {x.wallet: x for x in ledger.lifecycles(df, spark.createDataFrame([(10, True, 20, 9)], RESOLUTION)).collect()}
    assert (life[2].reason, life[2].payout, life[2].pnl, life[2].excluded) == (None, 0, None, True)
    assert (life[3].reason, life[3].redeem, life[3].pnl, life[3].excluded) == ("fully_exited", 1000, 600, False)
    assert life[5].most == 5000


def test_bootstrap_draws_a_thousand_resamples(spark, monkeypatch):
    wallets = spark.range(40).select(F.col("id").alias("wallet"), (F.col("id") % 3).alias("profit"), F.lit(0).alias("loss"))
    monkeypatch.setattr(performance, "by_wallet", lambda *_: wallets)
    given, few = performance.bootstrap(spark, "").first(), performance.bootstrap(spark, "", times=200).first()
    assert given == performance.bootstrap(spark, "", times=1000).first() != few


def test_log_words_are_exact_integers(spark):
    import hashlib

    from wagerlake import registry
    from wagerlake.sources.carriers import feed

    d = "/root/testdata/sf0.001"
    stake = {r.id: r.stake_cents for r in feed(spark, d).collect()}
    got = {r.id: list(r.words) for r in registry.queries()["F17_log_words"](spark, d).collect()}
    assert got == {i: [str(int(hashlib.sha256(str(i).encode()).hexdigest(), 16)), str(s)] for i, s in stake.items()}


def test_fair_lines_before_and_after_the_start(spark):
    """Narrow before the start; fresh on both sides and in agreement after it; the other venue before manifold; own middle where no price was paid."""
    from wagerlake.plans import exchange as X

    cols = "market long, source string, kb double, ka double, kg long, pb double, pa double, pg long, mb double, ma double, mg long, starts_in long, days_off long, paid double"
    rows = [
        (1, "polymarket", 0.50, 0.54, 500, 0.40, 0.44, 500, None, None, None, 100, 0, 0.40),
        (2, "polymarket", 0.50, 0.54, 10, 0.46, 0.50, 10, None, None, None, -100, 0, None),
        (3, "polymarket", 0.50, 0.54, 70, 0.46, 0.50, 10, 0.60, 0.62, 5, -100, 0, 0.5),
        (4, "kalshi", 0.50, 0.54, 10, 0.20, 0.24, 10, None, None, None, -100, 0, 0.5),
        (5, "kalshi", 0.50, 0.54, 10, None, 0.24, 10, None, None, None, 100, 0, 0.5),
        (6, "kalshi", None, None, 10, 0.30, 0.34, 10, None, None, None, 100, 0, None),
    ]
    got = {r.market: (r.reason, r.fair_source, r.ev) for r in X.cross_market(spark.createDataFrame(rows, cols), X.c("source"), X.c("paid")).collect()}
    assert got == {1: ("ok", "kalshi", 30.0), 2: ("ok", "kalshi", 8.3), 3: ("in_play", None, None), 4: ("in_play", None, None), 5: ("fair_line_stale", None, None), 6: ("missing_price", None, None)}

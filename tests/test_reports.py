"""Hand-built cases of verdicts, ladders, consensus, gates and reports."""

import math

import pytest
from pyspark.sql import functions as F

from wagerlake.plans import reports as R

c = F.col


def one(spark, x):
    return spark.range(1).select(x.alias("x")).head().x


def lit(x, kind):
    return F.lit(x).cast(kind)


@pytest.mark.parametrize(
    "verdict, good, known, closed, rate, roi, ev, want",
    [
        (0, 0, False, 50, 90.0, 9.0, 0.5, "Promising Bet, Unproven Trader"), (1, 3, True, 4, 90.0, 9.0, 0.5, "Promising Bet, Unproven Trader"), (1, 2, True, None, None, None, None, "Unproven Trader — Limited Track Record"),
        (3, 1, True, 0, None, None, None, "Weak Signal"), (0, 3, True, 5, 50.0, 0.0, 0.021, "Strong Copy Signal"), (0, 3, True, 5, 50.0, 0.0, 0.02, "Worth Considering"), (0, 3, True, 5, 49.9, 0.0, 0.5, "Worth Considering"),
        (0, 3, True, 5, 50.0, -0.1, 0.5, "Worth Considering"), (0, 3, True, 5, None, 1.0, 0.5, "Worth Considering"), (0, 3, True, 5, 60.0, 1.0, None, "Worth Considering"), (2, 0, True, 9, 10.0, -9.0, None, "Proceed With Caution"),
    ],
)
def test_capped_verdict(spark, verdict, good, known, closed, rate, roi, ev, want):
    assert one(spark, R.capped(F.lit(R.VERDICTS[verdict]), F.lit(good), F.lit(known), lit(closed, "int"), lit(rate, "double"), lit(roi, "double"), lit(ev, "double"))) == want


def stats(total, enough, mean):
    return F.struct(F.lit(total).alias("total"), F.lit(enough).alias("enough"), lit(mean, "double").alias("mean"))


def test_shown_ev_takes_the_first_usable_source(spark):
    none = F.when(F.lit(False), stats(1, True, 1.0))
    show = lambda closed, clv, cross, average: tuple(one(spark, R.shown_ev(lit(closed, "int"), clv, cross, lit(average, "double"))))
    good, thin, empty = stats(9, True, 0.5), stats(9, False, 0.5), stats(0, True, 0.5)
    assert show(0, good, good, 3.0) == show(None, good, good, 3.0) == ("unavailable", None)
    assert show(3, good, stats(9, True, 2.0), 3.0) == ("clv", 0.5)
    assert show(3, thin, stats(9, True, 2.0), 3.0) == show(3, empty, stats(9, True, 2.0), 3.0) == show(3, none, stats(9, True, 2.0), 3.0) == ("cross_market", 2.0)
    assert show(3, stats(9, True, None), thin, 3.0) == ("avg_return_fallback", 3.0)
    assert show(3, none, none, None) == ("unavailable", None)


def plain_consensus(prior, agents):
    clamp = lambda p: min(1 - 1e-6, max(1e-6, p))
    if not agents:
        return clamp(prior), 0.25, 0, 0, 0
    total = sum(w * k for _, w, k in agents)
    mean = sum(p * w * k for p, w, k in agents) / total if total > 0 else 0.5
    variance = sum(w * k * (p - mean) ** 2 for p, w, k in agents) / total if total > 0 else 0.25

    def js(p, q):
        p, q = clamp(p), clamp(q)
        m = (p + q) / 2
        kl = lambda a: a * math.log(a / m) + (1 - a) * math.log((1 - a) / (1 - m))
        return (kl(p) + kl(q)) / 2

    apart = min(1, sum(js(p, mean) for p, _, _ in agents) / len(agents) / math.log(2)) if len(agents) > 1 else 0
    pull = min(0.45, apart * 0.9)
    return clamp((1 - pull) * mean + pull * prior), variance, apart, pull, sum(k * w * k for _, w, k in agents) / total if total > 0 else 0


@pytest.mark.parametrize("agents", [[], [(0.7, 1.0, 0.8)], [(0.7, 1.0, 0.0)], [(0.99, 1.0, 1.0), (0.01, 0.85, 0.55), (0.5, 0.4, 0.35)], [(0.6, 0.9, 0.6), (0.62, 0.4, 0.35)]])
def test_consensus_against_plain_python(spark, agents):
    got = spark.createDataFrame([(0.4, agents)], "prior double, agents array<struct<p:double,weight:double,confidence:double>>").select(R.consensus(c("prior"), c("agents")).alias("s")).select("s.*").head()
    assert tuple(got) == pytest.approx(plain_consensus(0.4, agents), abs=1e-12)


def test_policies_at_their_thresholds(spark):
    says = lambda roi, rate: [one(spark, F.array(*(R.passes(lit(roi, "double"), lit(rate, "double"), p) for p in R.POLICIES)))][0]
    assert says(0.0, 0.4) == [False, False, False, True, False, False, False, False, False, False]
    assert says(0.03, 0.5) == [True, True, False, True, True, False, True, True, True, True]
    assert says(None, None) == says(float("nan"), None) == [False] * 10
    assert says(float("inf"), 0.6) == [False, False, False, True, True, True, False, False, False, False]


def assessed(spark, **change):
    base = dict(identity="direct", low=False, only_positions=False, events=9, backfill=False, activity_cut=False, trades_cut=False, held_missing=0, required=4, covered=4, material=False, unclear=0, unclear_share=0.0, order=False)
    return tuple(one(spark, R.history(**{k: F.lit(v) for k, v in {**base, **change}.items()})))


def test_history_reasons_in_order(spark):
    assert assessed(spark) == ([], "complete", True, "complete")
    assert assessed(spark, covered=3) == (["gamma_resolution_incomplete"], "complete", True, "partial-but-metrics-safe")
    assert assessed(spark, unclear=2, unclear_share=0.01) == (["merge_split_unresolved"], "complete", True, "complete")
    assert assessed(spark, unclear=2, unclear_share=0.05)[1:] == ("partial", False, "partial-and-metrics-unsafe")
    assert assessed(spark, material=True, unclear=2)[0] == ["merge_split_material"]
    assert assessed(spark, events=0, identity="unresolved", trades_cut=True) == (["identity_unresolved", "no_history_events", "trades_truncated"], "unusable", False, "unusable")
    assert assessed(spark, held_missing=1, order=True, low=True)[0] == ["identity_low_confidence", "gamma_resolution_missing_on_held_positions", "unresolved_chain_order"]


def test_kalshi_gate(spark):
    gate = lambda venue, stake, ticker, ev: one(spark, R.kalshi_gate(lit(venue, "string"), lit(stake, "double"), lit(ticker, "string"), lit(ev, "double")))
    assert gate("polymarket", 900, "K", 9) == gate(None, 900, "K", 9) == gate("kalshi", 499.9, "K", 9) == gate("kalshi", None, "K", 9) == "stake_floor"
    assert gate("kalshi", 500, " ", 9) == gate("kalshi", 500, None, 9) == "unmapped_ticker"
    assert gate("kalshi", 500, "K", None) == gate("kalshi", 500, "K", float("nan")) == "missing_trade_ev"
    assert gate("kalshi", 500, "K", 2.9) == "trade_ev" and gate("kalshi", 500, "K", 3) is None


@pytest.mark.parametrize(
    "raw, numbers, words, same, want",
    [
        (0.2, 1, ["team:a", "team:b"], False, (0.85, "token_heuristic")), (0.9, 0, ["team:a", "team:b", "world_cup"], False, (1.0, "token_heuristic")), (0.3, 1, ["nfl", "team:a"], False, (0.85, "token_heuristic")), (0.7, 1, ["x"], True, (0.95, "token_heuristic")),
        (0.7, 1, ["x"], False, (0.7, "vector")), (0.2, 0, ["x", "y"], False, (0.325, "token_boost")), (0.55, 0, ["btc"], False, (0.8, "token_boost")), (0.54, 0, ["btc"], False, (0.54, "vector")), (0.52, 0, ["nba"], False, (0.7075, "token_boost")),
        (0.6, 0, ["cpi"], False, (0.7875, "token_boost")), (0.59, 0, ["cpi"], False, (0.59, "vector")), (0.4, 0, [], True, (0.4, "vector")),
    ],
)
def test_token_ladder(spark, raw, numbers, words, same, want):
    row = spark.createDataFrame([(raw, list(range(numbers)), words, same)], "raw double, n array<int>, w array<string>, same boolean")
    got = row.select(R.by_tokens(c("raw"), c("n"), c("w"), c("same")).alias("s")).select("s.*").head()
    assert (pytest.approx(got.adjusted), got.method) == want


def test_policy_coverage_adds_batches_and_keeps_first_wallets(spark):
    rows = [("d1", 1, "a", True, True, True, "PASS"), ("d1", 1, "a", True, True, False, "PASS"), ("d1", 1, None, False, True, True, "FAIL"), ("d1", 2, "b", True, True, True, "PASS"), ("d1", 2, "c", None, None, True, "UNKNOWN"), ("d2", 5, "a", False, False, None, None)]
    seen = spark.createDataFrame(rows, "day string, batch int, wallet string, qualified boolean, gated boolean, visible boolean, policy string")
    d1, d2 = R.policy_coverage(seen).orderBy("day").collect()
    assert (d1.trades, d1.qualified, d1.production, d1["pass"], d1.fail, d1.unknown, d1.visible, d1.visible_pass, d1.visible_unknown) == (5, 3, 4, 3, 1, 0, 4, 2, 1)
    assert (d1.wallets_production, d1.wallets_pass, d1.wallets_fail) == (1, 1, 0)
    assert (d2.trades, d2.production, d2.visible, d2.wallets_production) == (1, 0, 0, 0)
    assert R.policy_coverage(seen.limit(0)).count() == 0


def test_batch_summary(spark):
    cohort = spark.createDataFrame([("0xA",), ("0xB",), ("0xC",), ("0xD",), ("0xE",)], "wallet string")
    rows = [("0xa", 1, "failed", None, None, None, 900), ("0XA", 2, "complete", None, True, False, 10), ("0xb", 1, "complete", None, None, True, 20), ("0xc", 1, "unusable", "partial-and-metrics-unsafe", None, None, 0), ("0xd", 1, "failed", None, None, None, 30), ("0xz", 1, "complete", None, True, True, 5)]
    schema = "wallet string, run int, status string, validity string, decision boolean, indexed boolean, ms long"
    got = R.batch_summary(cohort, spark.createDataFrame(rows, schema)).head()
    assert (got.cohort, got.attempted, got.metrics_safe, got.metrics_unsafe, got.deferred_infra, got.not_attempted) == (5, 4, 2, 1, 1, 1)
    assert (got.production_pass, got.production_unknown, got.only_production, got.p50_ms, got.p90_ms) == (1, 1, 1, 20, 30)
    none = R.batch_summary(cohort, spark.createDataFrame([], schema)).head()
    assert (none.not_attempted, none.p50_ms) == (5, 0)


def test_receipts(spark):
    posts = spark.createDataFrame([(1, 10), (2, 10), (3, 11), (4, None), (5, 12), (6, 13)], "id long, market long")
    sent = spark.createDataFrame([(2,), (2,)], "id long")
    resolved = spark.createDataFrame([(10, True, True), (11, True, False), (12, False, True)], "condition long, final boolean, yes boolean")
    got = {r.id: (r.enqueued, r.reason) for r in R.receipts(posts, sent, resolved).collect()}
    assert got == {1: (True, None)} | {i: (False, "market_not_resolved_yes") for i in (3, 4, 5, 6)}

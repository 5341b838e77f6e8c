"""Daily states of a watched policy: counts are exact, sketches within their error, states add up."""

import random

import pytest

from wagerlake.plans import shadow_report as S
from wagerlake.sources.versioned import VersionedTable

TRADE = "day string, wallet string, decision string, passes boolean, visible boolean, stake double"
SPAN = "name string, first string, last string"


def test_states_of_any_span_add_up(spark, tmp_path):
    rnd = random.Random(15)
    trades = [(f"2024-01-{1 + i % 9:02}", f"w{rnd.randint(0, 20_000)}", rnd.choice(["PASS", "FAIL", None, "other"]), True, rnd.random() < 0.7, rnd.randint(1, 10**6) / 100) for i in range(40_000)]
    df, store = spark.createDataFrame(trades, TRADE), VersionedTable(spark, str(tmp_path / "s"), ["day"], buckets=2)
    for batch, half in enumerate(df.randomSplit([1.0, 1.0], 3)):
        S.keep_states(store, half, batch)
    assert S.keep_states(store, df, 1) == 2  # a batch that is in already
    spans = [("all", "2024-01-01", "2024-01-09"), ("two", "2024-01-03", "2024-01-04"), ("none", "2025-01-01", "2025-01-02")]
    got = {r.name: r for r in S.report(store.read(), spark.createDataFrame(spans, SPAN), "2024-01-01").collect()}
    for name, first, last in spans:
        mine, r = [t for t in trades if first <= t[0] <= last], got[name]
        seen = [t for t in mine if t[4]]
        assert (r.trades, r.visible, r.trades_pass, r.trades_unknown) == (len(mine), len(seen), sum(t[2] == "PASS" for t in seen), sum(t[2] not in ("PASS", "FAIL") for t in seen))
        assert float(r.stake_retained) == pytest.approx(sum(t[5] for t in seen if t[2] == "PASS"), abs=1e-6)
        for d in ("PASS", "FAIL"):
            assert r[f"wallets_{d.lower()}"] == pytest.approx(len({t[1] for t in mine if t[2] == d}), rel=0.035)
        if seen:
            stakes = sorted(t[5] for t in seen)
            for q, value in zip((0.25, 0.5, 0.75), r.quartiles, strict=True):
                assert abs(sum(s <= value for s in stakes) / len(stakes) - q) < 0.02
        else:
            assert (r.days, r.wallets, r.quartiles, r.recommendation) == (0, 0, None, "MORE_PRODUCTION_COVERAGE_NEEDED")


@pytest.mark.parametrize(("rows", "last", "repairs", "want"), [
    ([("PASS", 9)], "2024-01-10", 0, "SHADOW_PERIOD_IN_PROGRESS"),
    ([("PASS", 9)], "2024-01-15", 0, "READY_FOR_ENFORCEMENT_IMPACT_REVIEW"),
    ([("PASS", 3), (None, 6)], "2024-01-15", 0, "MORE_PRODUCTION_COVERAGE_NEEDED"),
    ([("PASS", 8), (None, 1)], "2024-01-15", 0, "POLICY_RECALIBRATION_NEEDED"),
    ([("PASS", 8), (None, 1)], "2024-01-15", 1, "MORE_PRODUCTION_COVERAGE_NEEDED"),
    ([("PASS", 5), ("FAIL", 4)], "2024-01-15", 1, "POLICY_RECALIBRATION_NEEDED"),
    ([("PASS", 3), ("FAIL", 6)], "2024-01-15", 1, "MORE_PRODUCTION_COVERAGE_NEEDED"),
    ([("PASS", 6), ("FAIL", 4)], "2024-01-15", 1, "READY_FOR_ENFORCEMENT_IMPACT_REVIEW"),
])
def test_recommendations(spark, rows, last, repairs, want):
    trades = [("2024-01-02", f" W{d}{i} ", d, True, True, 1.0) for d, n in rows for i in range(n)] + [("2024-01-02", " ", "FAIL", True, True, 1.0)]
    states = S.daily_states(spark.createDataFrame(trades, TRADE))
    assert S.report(states, spark.createDataFrame([("x", "2024-01-01", last)], SPAN), "2024-01-01", repairs).first().recommendation == want

"""Anchors of derivative markets, against a store that is filled one market after another."""

import random

import pytest

from wagerlake.plans import anchors as A

MARKET = "id long, class string, event string, primary boolean, kind string, direction string, strike double, low double, high double, unit string, p_true double, prior double"


def one_by_one(rows):
    """(id: anchor) by the definition: sorted by priority, each market derives from its store or is priced and put into it."""
    rows = [dict(zip([x.split()[0] for x in MARKET.split(", ")], r, strict=True)) for r in rows]
    lowest = {}
    for r in sorted((r for r in rows if r["class"] == "financial" and r["strike"]), key=lambda r: (r["strike"], r["id"])):
        lowest.setdefault(r["event"], r["id"])
    for r in rows:
        if r["class"] == "financial" and r["strike"] and lowest[r["event"]] != r["id"]:
            r["primary"] = False

    def priority(r):
        k = r["class"]
        if r["primary"] and k:
            return 0
        return {"sports": 11 if r["kind"] == "total" else 12, "financial": 20 + (r["strike"] or 0) / 1e6, "politics": 30, None: 100}.get(k, 40)

    store, out = {}, {}
    for r in sorted(rows, key=lambda r: (priority(r), r["id"])):
        kind = {"financial": "f", "other": "f", "politics": "p"}.get(r["class"])
        at = (kind, r["event"])
        bracket = r["low"] is not None and r["high"] is not None and r["direction"] == "between"
        can = (bracket or r["strike"] is not None) if kind == "f" else kind == "p" and (r["kind"] in ("conditional", "margin") or (r["kind"] == "bracket" and r["low"] is not None))
        if not r["primary"] and at in store and can:
            out[r["id"]] = store[at]
            continue
        out[r["id"]] = None
        if kind == "p" or (kind == "f" and r["strike"] is not None):
            store[at] = r["id"]
    return out


def test_anchors_are_those_of_one_market_after_another(spark):
    rnd = random.Random(11)
    maybe = lambda x: x if rnd.random() < 0.7 else None
    rows = [
        (i, rnd.choice(["financial", "financial", "politics", "politics", "other", "sports", None]), f"e{i % 25}", rnd.random() < 0.2, rnd.choice(["bracket", "conditional", "margin", "winner", "total"]), rnd.choice(["above", "below", "between", None]), maybe(float(rnd.randint(50, 60))), maybe(5.0), maybe(9.0), rnd.choice(["usd", "percent", None]), 0.4, 0.6)
        for i in range(300)
    ]
    got = A.derived(spark.createDataFrame(rows, MARKET)).collect()
    assert {r.id: r.anchor for r in got} == one_by_one(rows) and all((r.method == "ensemble") == (r.anchor is None) for r in got)


@pytest.mark.parametrize(("anchor", "market", "want"), [
    (("above", 100.0, 0.5), ("above", 100.0, None, None), 0.5),
    (("above", 100.0, 0.7), ("below", 100.0, None, None), 0.3),
    (("below", 100.0, 0.3), ("above", 100.0, None, None), 0.3),  # the rule turns the quantile of either direction but once
    (("above", 100.0, 0.5), ("above", 100.0 * 2.718281828 ** 0.25, None, None), 0.1587),
    (("above", 100.0, 0.5), ("between", None, 100.0, 100.0 * 2.718281828 ** 0.25), 0.3413),
])
def test_prices_from_an_anchor(spark, anchor, market, want):
    rows = [(1, "financial", "e", True, None, anchor[0], anchor[1], None, None, "usd", anchor[2], 0.5), (2, "other", "e", False, None, *market, "usd", 0.9, 0.5)]
    r = {x.id: x for x in A.derived(spark.createDataFrame(rows, MARKET)).collect()}
    assert (r[1].p, r[1].method, r[2].anchor) == (anchor[2], "ensemble", 1) and r[2].p == pytest.approx(want, abs=2e-3)

"""Structural pairs of hand-built contracts."""

from wagerlake.plans import structure as S


def pairs(spark, slugs, tickers):
    s = spark.createDataFrame([(x if isinstance(x, tuple) else (x, None)) for x in slugs], "slug string, title string")
    t = spark.createDataFrame([(x,) for x in tickers], "ticker string")
    return sorted((r.slug.strip(), r.ticker, r.kind, r.line) for r in S.structural_pairs(s, t).collect())


GAME, DAY = "fifa-mex-deu-2026-06-11", "26JUN11"


def test_winner_legs(spark):
    tickers = [f"KXGAME-{DAY}GERMEX-{x}" for x in ("GER", "MEX", "TIE", "XYZ")] + ["KXGAME-26JUN12GERMEX-GER", f"KXGAME-{DAY}GERMEX-GER", None, "JUNK"]
    got = pairs(spark, [f"{GAME}-deu", f"{GAME}-deu", (f"{GAME}-more", "Will it end in a draw?"), (f"{GAME}-other", "?"), None, "no-game"], tickers)
    assert got == [(f"{GAME}-deu", f"KXGAME-{DAY}GERMEX-GER", "moneyline", None), (f"{GAME}-more", f"KXGAME-{DAY}GERMEX-TIE", "moneyline", None)]


def test_totals_meet_on_their_line(spark):
    tickers = [f"KXWCTOTAL-{DAY}MEXGER-{x}" for x in ("T25", "35", "T5", "TIE", "2")]
    slugs = [f"{GAME}-total-2-5", f"{GAME}-total-3pt5", (f"{GAME}-goals", "Mexico vs Germany O/U 0.5"), (f"{GAME}-x", "over/under 2.4951"), (f"{GAME}-y", "total 2.489"), (f"{GAME}-z", "total")]
    assert pairs(spark, slugs, tickers) == sorted([
        (f"{GAME}-total-2-5", tickers[0], "total", 2.5), (f"{GAME}-total-3pt5", tickers[1], "total", 3.5), (f"{GAME}-goals", tickers[2], "total", 0.5), (f"{GAME}-x", tickers[0], "total", 2.4951),
    ])


def test_spreads_and_unknown_kinds_need_only_the_game(spark):
    got = pairs(spark, [f"{GAME}-spread-1-5", f"{GAME}-spread-2-5", GAME], [f"KXWCSPREAD-{DAY}GERMEX-GER", f"KXOTHER-{DAY}GERMEX-1", f"KXWCSCORE-{DAY}GERMEX-1"])
    assert [(s, t.split("-")[0], k) for s, t, k, _ in got] == [(GAME, "KXOTHER", "unknown"), (f"{GAME}-spread-1-5", "KXWCSPREAD", "spread"), (f"{GAME}-spread-2-5", "KXWCSPREAD", "spread")]

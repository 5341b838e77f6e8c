"""Positions in plain words: which side a position backs, and when it falls back."""

import pytest

from wagerlake.plans import translate as T

MARKET = "title string, slug string, event_slug string, outcomes array<string>, end_date string, outcome string, side string"


def said(spark, title, outcome, slug=None, event_slug=None, outcomes=None, end=None, side="BUY"):
    r = T.translated(spark.createDataFrame([(title, slug, event_slug, outcomes, end, outcome, side)], MARKET)).first()
    return r.backing, r.side_name, r.exit_by, r.used_fallback


@pytest.mark.parametrize(("market", "want"), [
    (dict(title="Candidate A vs Candidate B", outcome="Yes", end="2026-12-31T00:00:00Z"), ("Backing Candidate A", "Candidate A", "Exit by Dec 31, 2026", False)),
    (dict(title="Candidate A vs Candidate B", outcome="No"), ("Backing Candidate B", "Candidate B", None, False)),
    (dict(title="Will Candidate A win the election?", outcome="No"), ("bought no", "Candidate A win the election", None, True)),
    (dict(title="Will Candidate A win the election?", outcome="Yes"), ("Backing Candidate A win the election", "Candidate A win the election", None, False)),
    (dict(title="Match winner", outcome="No", outcomes=["Lakers", "Celtics"]), ("Backing Celtics", "Celtics", None, False)),
    (dict(title="Match winner", outcome="celtics ", outcomes=["Lakers", "Boston Celtics"]), ("Backing Boston Celtics", "Boston Celtics", None, False)),
    (dict(title="Chiefs vs Ravens — Winner", outcome="No"), ("Backing Ravens", "Ravens", None, False)),
    (dict(title="Chiefs vs Ravens: Over 45.5 points", outcome="No", side="SELL"), ("sold no", "Chiefs vs Ravens: Over 45.5 points", None, True)),
    (dict(title="Chiefs vs Ravens: Will Mahomes throw 3+ TDs?", outcome="No"), ("bought no", "Chiefs vs Ravens: Will Mahomes throw 3+ TDs", None, True)),
    (dict(title="Obscure prop without mapping?", outcome="Yes"), ("bought yes", "Obscure prop without mapping", None, True)),
    (dict(title="Total goals", outcome="false", slug="fifa-mex-ger-2026-06-11"), ("Backing Germany", "Germany", None, False)),
    (dict(title="Total goals", outcome="true", event_slug="nba-lal-bos-2026-01-02"), ("Backing LAL", "LAL", None, False)),
    (dict(title="A vs B", outcome="Nobody else"), ("Backing B", "B", None, False)),
    (dict(title="Ares vs Zeus", outcome="draw"), ("bought draw", "Ares vs Zeus", None, True)),
    (dict(title="Prices", outcome="the Lakers ??"), ("Backing Lakers", "Lakers", None, False)),
    (dict(title=None, outcome=None), ("bought ", "market", None, True)),
    (dict(title="Who will win?", outcome="0xAB", end="soon"), ("bought 0xab", "Who will win", None, True)),
])
def test_positions(spark, market, want):
    assert said(spark, **market) == want


def test_exit_dates(spark):
    df = spark.createDataFrame([("2026-07-31T12:00:00.000Z",), ("2026-07-31T23:30:00-05:00",), ("",), (None,), ("x",)], "e string")
    assert [r[0] for r in df.select(T.exit_by(df.e)).collect()] == ["Exit by Jul 31, 2026", "Exit by Aug 1, 2026", None, None, None]

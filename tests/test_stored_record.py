"""Profit factors from stored positions, verified or not."""

from wagerlake.plans import stored_record as S

CLOSED = "wallet long, realized double, title string, category string"
SYNC = "wallet long, passed boolean, headline double, gap double, closed_sum double"


def test_stored_profit_factors(spark):
    closed = [(1, 6.0, None, " A "), (1, 6.0, None, "A"), (1, -4.0, "x", "B"), (1, 1.0, None, None), (1, float("nan"), None, "B"), (1, 0.0, "Will Bitcoin reach 100k?", " "), (2, 5.0, None, "A"), (4, -1.0, " ", None)]
    sync = [(1, True, None, 0.1, 9.0), (2, False, 3.0, 0.9, 5.0), (3, True, 7.0, 0.0, None), (4, True, 2.0, 0.0, 1.0), (5, None, None, None, None)]
    r = {x.wallet: x for x in S.stored_profit_factor(spark.createDataFrame(closed, CLOSED), spark.createDataFrame(sync, SYNC)).collect()}
    one = r[1]
    assert (one.availability, one.overall.positions, one.overall.profit, one.overall.loss, one.overall.profit_factor, one.overall.without_best, one.overall.wins, one.overall.losses, one.overall.win_rate) == ("verified", 5, 13.0, 4.0, 3.25, 1.75, 3, 1, 75.0)
    assert (one.ex_best.positions, one.ex_best.profit, one.ex_best.wins, one.ex_best.without_best, one.net) == (4, 7.0, 2, 0.25, 9.0)
    labels = [(s.label, s.positions, s.profit_factor, s.limited) for s in one.categories]
    assert labels[0] == ("A", 2, None, True) and {x[0] for x in labels[1:]} > {"B"} and len(labels) == 3
    assert (r[2].availability, r[2].overall, r[2].net, r[2].headline, r[2].gap) == ("unavailable", None, 5.0, 3.0, 0.9)
    assert (r[3].availability, r[3].net, r[3].headline) == ("unavailable", None, None)
    assert (r[4].availability, r[4].categories, r[4].net, r[4].overall.profit_factor, r[4].ex_best.positions) == ("verified", [], 2.0, 0.0, 1)
    assert (r[5].availability, r[5].net) == ("unavailable", None)

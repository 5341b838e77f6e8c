"""Plans that read, gather or deal the events once."""

from wagerlake.plans import ledger, titles


def test_a_plan_gathers_the_events_once(spark):
    t = [(1, 1, 5, "a", "BUY", 2, 10), (2, 1, 5, "b", "BUY", 2, 10), (2, 1, 9, "c", "SELL", 1, 7), (3, 1, 9, "d", "BUY", 1, 1), (4, 1, 5, "e", "BUY", 1, 3), (4, 1, 9, "f", "SPLIT", 1, 0), (5, 1, 5, "g", "BUY", 1, 3), (5, 1, 8, "h", "REDEEM", 0, 1), (6, 1, 5, "i", "BUY", 2, 3), (6, 1, 9, "j", "MERGE", 1, 2)]
    df = spark.createDataFrame(t, "wallet long, asset long, ts long, k string, side string, shares long, cash long")
    plan = ledger.planned(df, 8)
    assert {r.wallet: r.action for r in plan.collect()} == {1: "unchanged", 2: "update", 3: "insert", 4: "unchanged", 5: "update", 6: "update"}
    whole = ledger.write_plan(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert whole.count("Relation [") == 2


def test_hints_deal_the_events_once_and_do_not_expand_them(spark):
    q = titles.event_hints(spark, "/root/testdata/sf0.001")
    assert "Expand" not in q._jdf.queryExecution().optimizedPlan().toString()
    assert q.rdd.getNumPartitions() == 16 * spark.sparkContext.defaultParallelism

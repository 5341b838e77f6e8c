"""What a policy would have done to a feed: one mergeable state a day, from which any span of days is answered without its trades."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wagerlake.registry import query
from wagerlake.sources.carriers import feed
from wagerlake.sources.shared import shared_folder
from wagerlake.sources.versioned import VersionedTable

c = F.col
#: Days that the policy is watched, evaluable and unknown shares and reductions (percent) that decide what is recommended.
PERIOD, EVALUABLE, UNKNOWN, MUCH, SOME = 14, 50, 40, 60, 40
#: Registers of a distinct sketch (2 to this power: 1.04 / sqrt of it, 0.8 %, is its standard error) and size of a quantile sketch (rank error of some 1 % at 99 % confidence).
REGISTERS, QUANTILES = 14, 400
DECISIONS = ("PASS", "FAIL", "UNKNOWN")


def daily_states(trades: DataFrame) -> DataFrame:
    """A row a day of trades (day, wallet, decision, passes, visible, stake): counts, exact stakes, a sketch of the wallets of each decision, and one of the visible stakes.

    A decision other than PASS and FAIL, null too, is UNKNOWN. Trades without a wallet count nowhere. Only trades that pass and are visible are kept or lost; states of
    one day add up, so late trades may come as a second state.
    """
    t = trades.where(F.trim(F.coalesce("wallet", F.lit(""))) != "").withColumn("wallet", F.lower(F.trim("wallet")))
    t = t.withColumn("decision", F.when(c("decision").isin("PASS", "FAIL"), c("decision")).otherwise("UNKNOWN"))
    shown = F.coalesce(c("visible"), F.lit(False))
    stake = F.coalesce(c("stake"), F.lit(0.0)).cast("decimal(38,6)")
    of = lambda d: shown & (c("decision") == d)
    money = lambda where: F.coalesce(F.sum(F.when(where, stake)), F.lit(0).cast("decimal(38,6)")).cast("decimal(38,6)")
    return t.groupBy("day").agg(
        F.count("*").alias("trades"), F.count_if(F.coalesce("passes", F.lit(False))).alias("passing"), F.count_if(shown).alias("visible"), *(F.count_if(of(d)).alias(f"trades_{d.lower()}") for d in DECISIONS),
        money(shown & (c("decision") != "PASS")).alias("stake_affected"), money(of("PASS")).alias("stake_retained"),
        *(F.hll_sketch_agg(F.when(c("decision") == d, c("wallet")), F.lit(REGISTERS)).alias(f"wallets_{d.lower()}") for d in DECISIONS), F.hll_sketch_agg(F.when(of("UNKNOWN"), c("wallet")), F.lit(REGISTERS)).alias("unknown_shown"),
        F.kll_sketch_agg_double(F.when(shown, c("stake").cast("double")), F.lit(QUANTILES)).alias("stakes"),
    )


def recommendation(complete: Column, evaluable: Column, unknown: Column, reduction: Column, unknown_shown: Column, repairs: Column) -> Column:
    more, anew = F.lit("MORE_PRODUCTION_COVERAGE_NEEDED"), F.lit("POLICY_RECALIBRATION_NEEDED")
    return F.when(~complete, "SHADOW_PERIOD_IN_PROGRESS").when((evaluable < EVALUABLE) | (unknown > UNKNOWN), more).when((reduction > MUCH) | (unknown_shown > 0), F.when(repairs > 0, more).otherwise(anew)).when(reduction > SOME, anew).otherwise("READY_FOR_ENFORCEMENT_IMPACT_REVIEW")


def report(states: DataFrame, spans: DataFrame, started: str, repairs: int = 0) -> DataFrame:
    """A row for each of spans (name, first, last: days, both included) from states alone; counts and stakes are exact, numbers of wallets and quartiles estimates. A wallet whose decision changes
    inside a span counts for each of its decisions.

    The period is complete once the span's last day is PERIOD days after started. A span without states has zeros and no quartiles.
    """
    met = spans.join(states, (c("day") >= c("first")) & (c("day") <= c("last")), "left")
    total = lambda x: F.coalesce(F.sum(x), F.lit(0)).alias(x)
    counts = ("trades", "passing", "visible", *(f"trades_{d.lower()}" for d in DECISIONS))
    wallets = tuple(f"wallets_{d.lower()}" for d in DECISIONS)
    per = met.groupBy("name", "first", "last").agg(F.count("day").alias("days"), *map(total, counts), total("stake_affected"), total("stake_retained"), *(F.coalesce(F.hll_sketch_estimate(F.hll_union_agg(x)), F.lit(0).cast("long")).alias(x) for x in (*wallets, "unknown_shown")), F.kll_merge_agg_double("stakes").alias("stakes"))
    every = c("wallets_pass") + c("wallets_fail") + c("wallets_unknown")
    share = lambda a, b: F.when(b > 0, a / b * 100).otherwise(0.0)
    per = per.withColumns({"wallets": every, "evaluable": share(c("wallets_pass") + c("wallets_fail"), every), "unknown": share(c("wallets_unknown"), every), "reduction": share(c("visible") - c("trades_pass"), c("visible"))})
    complete = F.date_diff(c("last").cast("date"), F.lit(started).cast("date")) >= PERIOD
    says = recommendation(complete, c("evaluable"), c("unknown"), c("reduction"), c("unknown_shown"), F.lit(repairs))
    enough = F.when(F.kll_sketch_get_n_double("stakes") > 0, c("stakes"))
    quartiles = F.kll_sketch_get_quantile_double(enough, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return per.select("name", "days", *counts, "stake_affected", "stake_retained", "wallets", *wallets, "unknown_shown", "evaluable", "reduction", says.alias("recommendation"), quartiles.alias("quartiles"))


def keep_states(store: VersionedTable, trades: DataFrame, batch: int, writer: str = "shadow-days") -> int:
    """States of the days of a batch of trades into store (key day); a day that comes again has its sums added and its sketches united."""

    def both(name: str) -> Column:
        if name.startswith("wallets_") or name == "unknown_shown":
            return F.hll_union(f"o.{name}", f"n.{name}")
        return F.kll_sketch_merge_double("o.stakes", "n.stakes") if name == "stakes" else (c(f"o.{name}") + c(f"n.{name}")).cast(types[name])

    if store.done(writer, batch):
        return store.manifest()["version"]
    states = daily_states(trades)
    types = {f.name: f.dataType for f in states.schema}
    return store.merge(states, writer, batch, combine=both)


_SPANS = (("week", "2024-01-08", "2024-01-14"), ("month", "2024-01-01", "2024-01-31"), ("day", "2024-01-20", "2024-01-20"), ("later", "2025-01-01", "2025-01-31"))
_TRADES = "SELECT day, wallet, CASE wallet % 4 WHEN 0 THEN 'FAIL' WHEN 1 THEN 'UNKNOWN' ELSE 'PASS' END AS decision, id % 5 > 0 AS passes, id % 5 > 0 AND id % 3 > 0 AS visible, stake_cents / 100.0::DOUBLE AS stake FROM v_feed"


@query("C15_shadow_report", f"""WITH t AS ({_TRADES}), s(name, first, last) AS (VALUES {", ".join(map(str, _SPANS))}), g AS (SELECT s.name, s.last, count(DISTINCT day) AS days, count(t.day) AS trades, count(*) FILTER (passes) AS passing, count(*) FILTER (visible) AS visible, count(*) FILTER (visible AND decision = 'PASS') AS trades_pass, count(*) FILTER (visible AND decision = 'FAIL') AS trades_fail,
 count(*) FILTER (visible AND decision = 'UNKNOWN') AS trades_unknown, coalesce(sum(CAST(stake AS DECIMAL(38,6))) FILTER (visible AND decision <> 'PASS'), 0)::DOUBLE AS stake_affected, coalesce(sum(CAST(stake AS DECIMAL(38,6))) FILTER (visible AND decision = 'PASS'), 0)::DOUBLE AS stake_retained,
 count(DISTINCT wallet) AS w, count(DISTINCT wallet) FILTER (decision = 'UNKNOWN') AS u, count(*) FILTER (visible AND decision = 'UNKNOWN') AS shown FROM s LEFT JOIN t ON t.day BETWEEN s.first AND s.last GROUP BY ALL)
SELECT name, days, trades, passing, visible, trades_pass, trades_fail, trades_unknown, stake_affected, stake_retained, CASE WHEN date_diff('day', DATE '2024-01-01', last::DATE) < 14 THEN 'SHADOW_PERIOD_IN_PROGRESS' WHEN w = 0 OR (w - u) * 100.0 / w < 50 OR u * 100.0 / w > 40 THEN 'MORE_PRODUCTION_COVERAGE_NEEDED' WHEN shown > 0 OR (visible - trades_pass) * 100.0 / nullif(visible, 0) > 40 THEN 'POLICY_RECALIBRATION_NEEDED' ELSE 'READY_FOR_ENFORCEMENT_IMPACT_REVIEW' END AS recommendation FROM g""")
def shadow_report(spark: SparkSession, d: str) -> DataFrame:
    """Reports of four spans from the states of all days, which come in two batches, one of them twice; the estimates are left to tests."""
    w, i = c("wallet"), c("id")
    t = feed(spark, d).select("day", w.cast("string").alias("wallet"), F.when(w % 4 == 0, "FAIL").when(w % 4 > 1, "PASS").alias("decision"), (i % 5 > 0).alias("passes"), ((i % 5 > 0) & (i % 3 > 0)).alias("visible"), (c("stake_cents") / 100).alias("stake"), "id")
    store = VersionedTable(spark, f"{shared_folder(spark)}/shadow-{uuid.uuid4().hex}", ["day"], buckets=4)
    for batch in (0, 1, 1):
        keep_states(store, t.where(f"id % 2 = {batch}").drop("id"), batch)
    out = report(store.read(), spark.createDataFrame(_SPANS, "name string, first string, last string"), "2024-01-01")
    return out.select("name", "days", "trades", "passing", "visible", "trades_pass", "trades_fail", "trades_unknown", c("stake_affected").cast("double").alias("stake_affected"), c("stake_retained").cast("double").alias("stake_retained"), "recommendation")

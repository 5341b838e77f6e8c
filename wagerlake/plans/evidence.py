"""How far numbers can be trusted: EV fields, sources of fair prices, confusion matrices, chain order, gaps in block ranges, watchlists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wagerlake.plans.matching import _ISL, ranges
from wagerlake.plans.performance import track_record
from wagerlake.plans.reports import _chosen, chosen, holds
from wagerlake.registry import query
from wagerlake.sources.carriers import chain_events, feed, table

c = F.col
#: Sources of a fair price that rank high and low, and the scores and distance from one half that tell a placeholder.
HIGH_TIER, LOW_TIER = ("cross_venue_ob", "standalone_ob", "sportsbook_consensus"), ("universal_prior", "execution_price")
LEAST_SCORE, EVEN_SCORE, EVEN_EPS = 0.35, 0.5, 1e-6
SOURCES = ("cross_venue_ob", "universal_prior", None, "sportsbook_consensus", " Execution_Price", "standalone_ob", "", "execution_price", "llm")


def finite(x: Column) -> Column:
    """False for null, NaN and infinities; Spark orders NaN above infinity."""
    return holds(F.abs(x) < F.lit(float("inf")))


def trade_ev_percent(trade: Column, net: Column, pct: Column, trade_ev: Column, gross: Column, average: Column, ev: Column) -> Column:
    """A trade's EV in percent from the first of seven fields that is usable, null if none is. A net of zero is stale; so is an average of
    zero, unless there is a net that isn't a number. The last field is a fraction up to 1 in size, a percentage beyond."""
    odd_net = net.isNotNull() & ~finite(net)
    return F.coalesce(
        F.when(finite(trade), trade), F.when(finite(net) & (net != 0), net), F.when(finite(pct), pct), F.when(finite(trade_ev), trade_ev), F.when(finite(gross), gross),
        F.when(finite(average) & ((average != 0) | odd_net), average), F.when(finite(ev), F.when(F.abs(ev) <= 1, ev * 100).otherwise(ev)),
    )


@query("P24_trade_ev_fields", """SELECT id, coalesce(CASE WHEN id % 11 = 0 THEN (id % 13 - 6) / 2.0::DOUBLE END, CASE WHEN id % 5 < 3 AND id % 7 <> 3 THEN (id % 7 - 3)::DOUBLE END, CASE WHEN id % 17 = 0 THEN (id % 9) / 4.0::DOUBLE END,
 CASE WHEN id % 19 = 0 THEN (id % 8) / 4.0::DOUBLE END, CASE WHEN id % 6 = 0 THEN (id % 10 - 5)::DOUBLE END, CASE WHEN id % 4 < 3 AND id % 3 <> 1 THEN (id % 3 - 1)::DOUBLE END,
 CASE WHEN id % 2 = 0 THEN CASE WHEN abs(id % 40 - 20) <= 8 THEN (id % 40 - 20) / 8.0::DOUBLE * 100 ELSE (id % 40 - 20) / 8.0::DOUBLE END END) AS ev FROM v_feed""")
def trade_ev_fields(spark: SparkSession, d: str) -> DataFrame:
    k = c("id")
    there = lambda when, x, by=1.0: F.when(when, x / F.lit(by))
    fields = (
        there(k % 11 == 0, k % 13 - 6, 2.0), there(k % 5 < 3, k % 7 - 3), there(k % 17 == 0, k % 9, 4.0), there(k % 19 == 0, k % 8, 4.0),
        there(k % 6 == 0, k % 10 - 5), there(k % 4 < 3, k % 3 - 1), there(k % 2 == 0, k % 40 - 20, 8.0),
    )
    return feed(spark, d).select("id", trade_ev_percent(*fields).alias("ev"))


def placeholder(p_true: Column, source: Column, score: Column) -> Column:
    """Whether a fair price stands for no knowledge: unusable, from a prior or the price paid, of a low score, or one half without a score of 0.5."""
    known = F.lower(F.trim(F.coalesce(source, F.lit(""))))
    even = (F.abs(p_true - 0.5) <= EVEN_EPS) & ~(finite(score) & holds(score >= EVEN_SCORE))
    return ~finite(p_true) | known.isin(*LOW_TIER) | (finite(score) & holds(score < LEAST_SCORE)) | holds(even)


def authoritative(source: Column, confidence: Column, low: Column) -> Column:
    """Whether a fair price may carry a trade's EV; a missing source or confidence doesn't speak against it."""
    return ~(holds(source.isin(*LOW_TIER)) | holds(low) | (finite(confidence) & holds(confidence < LEAST_SCORE)))


_TRUTHS = f"""SELECT p_partkey AS market, CASE WHEN p_partkey % 2 = 0 THEN ' T' ELSE 't' END || p_partkey // 2 AS token, {_chosen(SOURCES, 'p_partkey')} AS source, CASE WHEN p_partkey % 7 > 0 THEN (p_partkey % 10) / 10.0::DOUBLE END AS score,
 CASE WHEN p_partkey % 11 > 0 THEN (p_partkey % 5) / 4.0::DOUBLE END AS p_true, p_partkey % 12 = 0 AS low, p_partkey * 7 // 3 % 4 AS calculated FROM part"""


def truths(spark: SparkSession, d: str) -> DataFrame:
    k = c("p_partkey")
    return table(spark, d, "part").select(
        k.alias("market"), F.concat(F.when(k % 2 == 0, " T").otherwise("t"), F.floor(k / 2).cast("string")).alias("token"), chosen(SOURCES, k).alias("source"), F.when(k % 7 > 0, k % 10 / F.lit(10.0)).alias("score"),
        F.when(k % 11 > 0, k % 5 / F.lit(4.0)).alias("p_true"), (k % 12 == 0).alias("low"), (F.floor(k * 7 / 3) % 4).alias("calculated"),
    )


@query("P25_P35_p_true_trust", f"""SELECT market, p_true IS NULL OR lower(trim(coalesce(source, ''))) IN ('universal_prior', 'execution_price') OR coalesce(score < 0.35::DOUBLE, false) OR (p_true = 0.5 AND (score IS NULL OR score < 0.5)) AS placeholder,
 NOT (coalesce(source IN ('universal_prior', 'execution_price'), false) OR low OR coalesce(score < 0.35::DOUBLE, false)) AS authoritative FROM ({_TRUTHS})""")
def p_true_trust(spark: SparkSession, d: str) -> DataFrame:
    return truths(spark, d).select("market", placeholder(c("p_true"), c("source"), c("score")).alias("placeholder"), authoritative(c("source"), c("score"), c("low")).alias("authoritative"))


def source_coverage(rows: DataFrame) -> DataFrame:
    """Tokens by the source of their newest fair price: how many, of high and low tier, with a low score. Tokens are compared trimmed, in lower case; of equal times the least market stands."""
    first = F.min_by(F.struct("source", "score"), F.struct(-c("calculated"), c("market")))
    newest = rows.groupBy(F.lower(F.trim("token")).alias("token")).agg(first.alias("s")).select(F.coalesce(F.nullif("s.source", F.lit("")), F.lit("unknown")).alias("source"), "s.score")
    return newest.groupBy("source").agg(F.count("*").alias("tokens"), F.count_if(c("source").isin(*HIGH_TIER)).alias("high"), F.count_if(c("source").isin(*LOW_TIER)).alias("low"), F.count_if(c("score") < LEAST_SCORE).alias("weak"))


@query("A29_source_coverage", f"""SELECT source, count(*) AS tokens, count(*) FILTER (source IN ('cross_venue_ob', 'standalone_ob', 'sportsbook_consensus')) AS high, count(*) FILTER (source IN ('universal_prior', 'execution_price')) AS low,
 count(*) FILTER (score < 0.35::DOUBLE) AS weak FROM (SELECT coalesce(nullif(source, ''), 'unknown') AS source, score FROM ({_TRUTHS}) QUALIFY row_number() OVER (PARTITION BY lower(trim(token)) ORDER BY calculated DESC, market) = 1) GROUP BY source""")
def p_true_sources(spark: SparkSession, d: str) -> DataFrame:
    return source_coverage(truths(spark, d))


CELLS = ("pass_to_pass", "pass_to_fail", "fail_to_pass", "fail_to_fail", "null_to_pass", "null_to_fail")


def confusion_matrices(rows: DataFrame) -> DataFrame:
    """Old against new decisions of complete comparisons, a row a matrix: production and api against the indexed decision, production against
    historical performance (only with valid data and a historical decision). A missing old decision is counted apart; a missing new one is a fail."""
    done = c("status") == "complete"
    kind = lambda name, among, old, new: F.struct(F.lit(name).alias("matrix"), holds(among).alias("among"), old.alias("old"), holds(new).alias("new"))
    kinds = F.array(
        kind("production", done, c("production"), c("indexed")), kind("api", done, c("api"), c("indexed")),
        kind("historical", done & c("historical").isNotNull() & (c("validity") == "PASS"), c("production"), c("historical") == "PASS"),
    )
    old, new, known = c("old"), c("new"), c("old").isNotNull()
    cells = (old & new, old & ~new, ~old & new, ~old & ~new, ~known & new, ~known & ~new)
    counts = [F.count_if(c("among") & x).alias(name) for name, x in zip(CELLS, cells, strict=True)]
    out = rows.select(F.explode(kinds).alias("k")).select("k.*").groupBy("matrix").agg(*counts, F.count_if(c("among") & known).alias("known"), F.count_if(c("among") & ~known).alias("unknown"))
    changed = (c("pass_to_fail") + c("fail_to_pass")) / F.nullif(c("known"), F.lit(0))
    return out.withColumn("total", c("known") + c("unknown")).withColumn("change_rate", F.coalesce(changed, F.lit(0.0)))


_KINDS = "SELECT 'production' AS matrix, production AS old, indexed AS new, done AS among FROM r UNION ALL SELECT 'api', api, indexed, done FROM r UNION ALL SELECT 'historical', production, coalesce(historical = 'PASS', false), done AND historical IS NOT NULL AND valid FROM r"


@query("A24_A25_decision_matrices", f"""WITH r AS (SELECT c_custkey % 7 > 0 AS done, CASE WHEN c_custkey % 5 > 0 THEN c_custkey % 2 = 0 END AS production, CASE WHEN c_custkey % 4 > 0 THEN c_custkey % 3 = 0 END AS api, c_custkey % 3 < 2 AS indexed,
 CASE WHEN c_custkey % 6 = 0 THEN NULL WHEN c_custkey % 4 = 1 THEN 'PASS' ELSE 'FAIL' END AS historical, c_custkey % 8 > 0 AS valid FROM customer), k AS ({_KINDS}),
 n AS (SELECT matrix, count(*) FILTER (among AND old AND new) AS pass_to_pass, count(*) FILTER (among AND old AND NOT new) AS pass_to_fail, count(*) FILTER (among AND NOT old AND new) AS fail_to_pass, count(*) FILTER (among AND NOT old AND NOT new) AS fail_to_fail,
 count(*) FILTER (among AND old IS NULL AND new) AS null_to_pass, count(*) FILTER (among AND old IS NULL AND NOT new) AS null_to_fail, count(*) FILTER (among AND old IS NOT NULL) AS known, count(*) FILTER (among AND old IS NULL) AS unknown FROM k GROUP BY matrix)
 SELECT *, known + unknown AS total, coalesce((pass_to_fail + fail_to_pass) / nullif(known, 0), 0)::DOUBLE AS change_rate FROM n""")
def decision_matrices(spark: SparkSession, d: str) -> DataFrame:
    k = c("c_custkey")
    rows = table(spark, d, "customer").select(
        F.when(k % 7 > 0, "complete").otherwise("failed").alias("status"), F.when(k % 5 > 0, k % 2 == 0).alias("production"), F.when(k % 4 > 0, k % 3 == 0).alias("api"), (k % 3 < 2).alias("indexed"),
        F.when(k % 6 == 0, None).when(k % 4 == 1, "PASS").otherwise("FAIL").alias("historical"), F.when(k % 8 > 0, "PASS").otherwise("UNKNOWN").alias("validity"),
    )
    return confusion_matrices(rows)


def chain_order(block: Column, log_index: Column) -> Column:
    """What a row's coordinates allow: full with block and log index, block with the block alone, else none."""
    return F.when(holds(block > 0), F.when(holds(log_index >= 0), "full").otherwise("block")).otherwise("none")


@query("L20_chain_order", """SELECT wallet, count(*) AS total, count(*) FILTER (block > 0 AND log_index >= 0) AS full_order, count(*) FILTER (block > 0 AND log_index IS NULL) AS block_only,
 count(*) FILTER (block IS NULL OR block <= 0) AS no_order FROM v_chain GROUP BY wallet""")
def chain_order_counts(spark: SparkSession, d: str) -> DataFrame:
    order = chain_order(c("block"), c("log_index"))
    return chain_events(spark, d).groupBy("wallet").agg(F.count("*").alias("total"), *(F.count_if(order == x).alias(name) for x, name in (("full", "full_order"), ("block", "block_only"), ("none", "no_order"))))


def window_parts(covered: DataFrame, key: str, first: int, last: int) -> DataFrame:
    """The window [first, last] of each key in parts (part, a, b): covered where its ranges, joined beforehand, meet the window, gap elsewhere.

    Keys whose ranges all lie outside have the whole window as one gap; a window that ends before it starts has no parts.
    """
    inside = covered.where((c("b") >= first) & (c("a") <= last)).select(key, F.lit("covered").alias("part"), F.greatest("a", F.lit(first)).alias("a"), F.least("b", F.lit(last)).alias("b"))
    ends = covered.select(key).distinct().select(key, F.lit("end").alias("part"), F.lit(last + 1).cast("long").alias("a"), F.lit(last + 1).cast("long").alias("b"))
    before = F.coalesce(F.lag("b").over(Window.partitionBy(key).orderBy("a")), F.lit(first - 1))
    gap = F.struct(F.lit("gap").alias("part"), (before + 1).alias("a"), (c("a") - 1).alias("b"))
    parts = inside.unionByName(ends).select(key, F.array(F.struct("part", "a", "b"), gap).alias("parts"))
    return parts.select(key, F.explode("parts").alias("p")).select(key, "p.*").where((c("part") != "end") & (c("a") <= c("b")))


@query("J19_window_gaps", f"""WITH i AS ({_ISL}), x AS (SELECT condition, greatest(a, 9000) AS a, least(b, 13000) AS b FROM i WHERE b >= 9000 AND a <= 13000), y AS (SELECT * FROM x UNION ALL SELECT DISTINCT condition, 13001, 13001 FROM i)
 SELECT condition, 'covered' AS part, a, b FROM x UNION ALL SELECT condition, 'gap', prev + 1, a - 1 FROM (SELECT *, coalesce(lag(b) OVER (PARTITION BY condition ORDER BY a), 8999) AS prev FROM y) WHERE prev + 1 <= a - 1""")
def window_gaps(spark: SparkSession, d: str, first: int = 9000, last: int = 13000) -> DataFrame:
    return window_parts(ranges(spark, d), "condition", first, last)


def modal_condition(events: DataFrame, key: str = "asset", order: str = "raw_id") -> DataFrame:
    """The commonest condition of each key, of equally common ones that seen first; empty where none is given."""
    named = F.nullif(F.trim(c("condition").cast("string")), F.lit(""))
    n = events.select(key, named.alias("condition"), order).groupBy(key, "condition").agg(F.count("*").alias("n"), F.min(order).alias("first"))
    best = F.max_by(F.when(c("condition").isNotNull(), c("condition")), F.when(c("condition").isNotNull(), F.struct(c("n"), -c("first"))))
    return n.groupBy(key).agg(F.coalesce(best, F.lit("")).alias("condition"))


@query("L08_condition_of_asset", """WITH e AS (SELECT asset, raw_id, CASE WHEN asset % 9 > 0 AND raw_id % 5 > 0 THEN (raw_id // 80 % 4)::VARCHAR END AS condition FROM v_chain), n AS (SELECT asset, condition, count(*) AS n, min(raw_id) AS f FROM e WHERE condition IS NOT NULL GROUP BY ALL),
 b AS (SELECT asset, condition FROM n QUALIFY row_number() OVER (PARTITION BY asset ORDER BY n DESC, f) = 1) SELECT asset, coalesce(b.condition, '') AS condition FROM (SELECT DISTINCT asset FROM e) LEFT JOIN b USING (asset)""")
def condition_of_asset(spark: SparkSession, d: str) -> DataFrame:
    i = c("raw_id")
    return modal_condition(chain_events(spark, d).select("asset", "raw_id", F.when((c("asset") % 9 > 0) & (i % 5 > 0), F.floor(i / 80) % 4).alias("condition")))


#: Sort modes of a watchlist and the column that each ranks by, the largest first.
SORTS = {
    "highest_profit_factor": "profit_factor", "most_positions": "closed", "top_pnl": "pnl", "highest_win_rate": "win_rate", "most_open_positions": "open", "top_roi": "roi", "highest_ev": "average_ev", "recently_active": "bookmarked_at",
}


def watchlist(profiles: DataFrame, sort: str = "highest_profit_factor", least_factor: float = 1.0, least_positions: int = 1, alerts: bool = True, only_open: bool = False) -> DataFrame:
    """Profiles that pass the filters, sorted by any of SORTS, those without the value last; equal ones by wallet. Alerts are on unless switched off;
    a profile without a profit factor passes only where none is asked for."""
    enough = F.coalesce(c("profit_factor") >= least_factor, F.lit(least_factor <= 0)) & holds(c("closed") >= least_positions)
    kept = profiles.where(enough & (F.coalesce(c("alerts"), F.lit(True)) == alerts) & (F.lit(not only_open) | holds(c("open") > 0)))
    return kept.orderBy(c(SORTS[sort]).desc_nulls_last(), "wallet")


@query("P27_watchlist_sorts", f"""SELECT mode, wallet, key FROM (UNPIVOT (SELECT wallet, {', '.join(f'({x})::DOUBLE AS {mode}' for mode, x in (('highest_profit_factor', 'pf'), ('most_positions', 'closed'), ('top_pnl', 'pnl'), ('highest_win_rate', 'wins * 100 / nullif(closed, 0)'), ('most_open_positions', 'wallet % 9'), ('highest_ev', '(wallet % 31 - 15) / 4.0'), ('recently_active', 'wallet * 977 % 1000')))}
 FROM (SELECT wallet, count(*) FILTER (realized <> 0) AS closed, count(*) FILTER (realized > 0) AS wins, sum(realized)::BIGINT AS pnl, CASE WHEN wallet % 6 > 0 THEN (wallet * 37 % 300) / 100.0::DOUBLE END AS pf FROM v_positions GROUP BY wallet) WHERE coalesce(pf >= 1, false) AND closed >= 1 AND wallet % 10 > 0) ON COLUMNS(* EXCLUDE (wallet)) INTO NAME mode VALUE key)""")
def watchlist_sorts(spark: SparkSession, d: str) -> DataFrame:
    """The kept profiles with the value that each sort mode ranks them by; return on investment has its own query (A06)."""
    w = c("wallet")
    rows = track_record(spark, d).select(
        "wallet", "closed", "pnl", (c("wins") * 100 / F.nullif(c("closed"), F.lit(0))).alias("win_rate"), F.when(w % 6 > 0, w * 37 % 300 / F.lit(100.0)).alias("profit_factor"), (w % 9).alias("open"),
        "roi", ((w % 31 - 15) / F.lit(4.0)).alias("average_ev"), (w * 977 % 1000).alias("bookmarked_at"), (w % 10 > 0).alias("alerts"),
    )
    keys = F.explode(F.array(*(F.struct(F.lit(mode).alias("mode"), c(x).cast("double").alias("key")) for mode, x in SORTS.items() if mode != "top_roi")))
    return watchlist(rows).select("wallet", keys.alias("k")).select("k.mode", "wallet", "k.key")

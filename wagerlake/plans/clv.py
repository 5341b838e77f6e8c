"""Closing lines and closing-line value: as-of joins, settlement detection, rankings and the panel backtest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wagerlake.registry import query
from wagerlake.sources.carriers import cents, resolution, ticks, trades

c = F.col
#: Near settlement, uncollapsed range, points needed, hours of freshness; settlement margins of history and tape.
NEAR, LOW, HIGH, POINTS, FRESH, HISTORY_EPS, TAPE_EPS = 0.03, 0.1, 0.9, 5, 24, 0.02, 0.05


@query("W01_A29_latest_tick", "SELECT token, arg_max(p, struct_pack(t := t, k := k)) AS p, max(t) AS t FROM v_ticks GROUP BY token")
def latest_tick(spark: SparkSession, d: str) -> DataFrame:
    return ticks(spark, d).groupBy("token").agg(F.max_by("p", F.struct("t", "k")).alias("p"), F.max("t").alias("t"))


@query("W03_median_of_three", "SELECT token, k, median(p) OVER (PARTITION BY token ORDER BY t, k ROWS 2 PRECEDING) AS m FROM v_ticks")
def median_of_three(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("token").orderBy("t", "k").rowsBetween(-2, 0)
    s, n = F.array_sort(F.collect_list("p").over(w)), F.count("p").over(w)
    return ticks(spark, d).select("token", "k", F.when(n == 2, (s[0] + s[1]) / 2).when(n == 1, s[0]).otherwise(F.get(s, F.lit(1))).alias("m"))


@query("W04_first_last_delta", "SELECT token, arg_max(p, struct_pack(t := t, k := k)) - arg_min(p, struct_pack(t := t, k := k)) AS delta FROM v_ticks GROUP BY token HAVING abs(arg_max(p, struct_pack(t := t, k := k)) - arg_min(p, struct_pack(t := t, k := k))) > 0.005")
def first_last_delta(spark: SparkSession, d: str, least: float = 0.005) -> DataFrame:
    at = F.struct("t", "k")
    return ticks(spark, d).groupBy("token").agg((F.max_by("p", at) - F.min_by("p", at)).alias("delta")).where(F.abs("delta") > least)


@query("W02_closing_line", """WITH s AS (SELECT token, t, k, p, row_number() OVER (PARTITION BY token ORDER BY t, k) AS i, count(*) OVER (PARTITION BY token) AS n, median(p) OVER (PARTITION BY token ORDER BY t, k ROWS 2 PRECEDING) AS m FROM v_ticks),
e AS (SELECT token, n, coalesce(max(i) FILTER (abs(p - token % 2) > 0.03::DOUBLE), 0) AS last FROM s GROUP BY token, n),
f AS (SELECT e.token, e.n, last, max(s.i) FILTER (s.i <= last AND p BETWEEN 0.1 AND 0.9) AS cl FROM e JOIN s USING (token) GROUP BY e.token, e.n, last)
SELECT f.token, CASE WHEN f.n < 5 THEN 'incomplete' WHEN last = 0 THEN 'always_collapsed' WHEN last = f.n THEN 'incomplete' WHEN cl IS NULL THEN 'always_collapsed' WHEN (b.t - a.t) / 3600 > 24 THEN 'stale_line' ELSE 'ok' END AS state,
 CASE WHEN f.n >= 5 AND last > 0 AND last < f.n AND cl IS NOT NULL AND (b.t - a.t) / 3600 <= 24 THEN a.m END AS closing_line FROM f LEFT JOIN s a ON a.token = f.token AND a.i = cl LEFT JOIN s b ON b.token = f.token AND b.i = last + 1""")
def closing_line(spark: SparkSession, d: str) -> DataFrame:
    """Behind the last point away from settlement (token % 2) lies the settlement run; the line is the last uncollapsed point before it, as a median of three."""
    order = Window.partitionBy("token").orderBy("t", "k")
    whole, three = Window.partitionBy("token"), order.rowsBetween(-2, 0)
    s = F.array_sort(F.collect_list("p").over(three))
    n3 = F.count("p").over(three)
    x = ticks(spark, d).withColumn("i", F.row_number().over(order)).withColumn("n", F.count("*").over(whole))
    x = x.withColumn("m", F.when(n3 == 2, (s[0] + s[1]) / 2).when(n3 == 1, s[0]).otherwise(F.get(s, F.lit(1))))
    x = x.withColumn("last", F.coalesce(F.max(F.when(F.abs(c("p") - c("token") % 2) > NEAR, c("i"))).over(whole), F.lit(0)))
    line = F.max(F.when((c("i") <= c("last")) & c("p").between(LOW, HIGH), F.struct("i", "t", "m")))
    per = x.groupBy("token", "n", "last").agg(line.alias("cl"), F.max(F.when(c("i") == c("last") + 1, c("t"))).alias("commit"))
    bad = F.when(c("n") < POINTS, "incomplete").when(c("last") == 0, "always_collapsed").when(c("last") == c("n"), "incomplete").when(c("cl").isNull(), "always_collapsed").when((c("commit") - c("cl.t")) / 3600 > FRESH, "stale_line").otherwise("ok")
    return per.withColumn("state", bad).select("token", "state", F.when(c("state") == "ok", c("cl.m")).alias("closing_line"))


@query("J09_asof_midpoint", """SELECT token, coalesce(arg_max(p, struct_pack(t := t, k := k)) FILTER (p > 0.02 AND p < 0.98), arg_max(p, struct_pack(t := t, k := k))) AS closing_line FROM v_ticks WHERE t <= 1704067200 + 43200 + token * 300 GROUP BY token""")
def asof_midpoint(spark: SparkSession, d: str) -> DataFrame:
    """Last point at or before each token's close, rather one that isn't settled yet."""
    before = ticks(spark, d).where(c("t") <= F.lit(1704067200 + 43200) + c("token") * 300)
    at = F.struct("t", "k")
    active = F.max_by(F.when(c("p").between(HISTORY_EPS, 1 - HISTORY_EPS), c("p")), F.when((c("p") > HISTORY_EPS) & (c("p") < 1 - HISTORY_EPS), at))
    return before.groupBy("token").agg(F.coalesce(active, F.max_by("p", at)).alias("closing_line"))


_VWAP = "SELECT asset, sum(cents * shares)::BIGINT / sum(shares)::BIGINT AS vwap, count(*) AS n FROM (SELECT t.*, row_number() OVER (PARTITION BY asset ORDER BY ts DESC, k DESC) AS r FROM v_trades t JOIN v_resolution USING (condition) WHERE ts < resolved_at + 157680000 AND cents > 5 AND cents < 95) WHERE r <= 5 GROUP BY asset HAVING count(*) >= 2"


def vwap_lines(t: DataFrame, r: DataFrame, last: int = 5, least: int = 2) -> DataFrame:
    """Volume-weighted price of the last trades strictly before the cutoff, outside the settlement margin."""
    tape = t.join(r.select("condition", "resolved_at"), "condition").where((c("ts") < c("resolved_at") + 157680000) & (c("cents") > 5) & (c("cents") < 95))
    top = tape.withColumn("r", F.row_number().over(Window.partitionBy("asset").orderBy(F.desc("ts"), F.desc("k")))).where(c("r") <= last)
    return top.groupBy("asset").agg((F.sum(c("cents") * c("shares")) / F.sum("shares")).alias("vwap"), F.count("*").alias("n")).where(c("n") >= least)


@query("J10_vwap_closing", _VWAP)
def vwap_closing(spark: SparkSession, d: str) -> DataFrame:
    return vwap_lines(trades(spark, d), resolution(spark, d))


_CLV = f"SELECT k, wallet, cash, floor((coalesce(vwap, last) - cents) * 10 + 0.5) / 10.0::DOUBLE AS clv_cents, CASE WHEN vwap IS NOT NULL THEN 'tape' ELSE 'history' END AS source FROM v_trades t LEFT JOIN ({_VWAP}) v USING (asset) LEFT JOIN (SELECT condition, arg_max(cents, struct_pack(t := ts, k := k)) AS last FROM v_trades GROUP BY condition) h USING (condition) JOIN v_resolution r USING (condition) WHERE side = 'BUY' AND ts < resolved_at + 157680000 AND final"


def clv_records(spark: SparkSession, d: str) -> DataFrame:
    """CLV of every gated fill: tape first, last price of the condition second."""
    t, r = trades(spark, d), resolution(spark, d)
    last = t.groupBy("condition").agg(F.max_by("cents", F.struct("ts", "k")).alias("last"))
    fills = t.where("side = 'BUY'").join(r.where("final").select("condition", "resolved_at"), "condition").where(c("ts") < c("resolved_at") + 157680000)
    met = fills.join(vwap_lines(t, r).select("asset", "vwap"), "asset", "left").join(last, "condition", "left")
    delta = F.coalesce("vwap", "last") - c("cents")
    return met.select("k", "wallet", "cash", (F.floor(delta * 10 + 0.5) / F.lit(10.0)).alias("clv_cents"), F.when(c("vwap").isNotNull(), "tape").otherwise("history").alias("source"))


@query("J01_J11_P36_clv_records", _CLV)
def clv_of_fills(spark: SparkSession, d: str) -> DataFrame:
    return clv_records(spark, d)


@query("A08_A09_C16_clv_ranking", f"SELECT wallet, count(*) AS trades, sum(x)::BIGINT / count(*) / 10 AS mean, sum(x * cash)::BIGINT / sum(cash)::BIGINT / 10 AS weighted FROM (SELECT *, round(clv_cents * 10)::BIGINT AS x FROM ({_CLV})) GROUP BY wallet HAVING count(*) >= 5")
def clv_ranking(spark: SparkSession, d: str, least: int = 5) -> DataFrame:
    """Mean and stake-weighted CLV; sums run over whole tenths of a cent, so their order doesn't matter."""
    x = F.round(c("clv_cents") * 10).cast("long")
    per = clv_records(spark, d).groupBy("wallet").agg(F.count("*").alias("trades"), (F.sum(x) / F.count("*") / 10).alias("mean"), (F.sum(x * c("cash")) / F.sum("cash") / 10).alias("weighted"))
    return per.where(c("trades") >= least)


@query("J18_minimum_trades", "SELECT k FROM v_trades WHERE wallet IN (SELECT wallet FROM v_trades GROUP BY wallet HAVING count(*) >= 40)")
def minimum_trades(spark: SparkSession, d: str, least: int = 40) -> DataFrame:
    t = trades(spark, d)
    busy = t.groupBy("wallet").agg(F.count("*").alias("n")).where(c("n") >= least)
    return t.join(busy, "wallet", "left_semi").select("k")


@query("A42_leakage", f"SELECT count(*) AS lines, count(*) FILTER (vwap > 94 OR vwap < 6) / count(*) AS share FROM ({_VWAP})")
def leakage(spark: SparkSession, d: str) -> DataFrame:
    v = vwap_lines(trades(spark, d), resolution(spark, d))
    return v.agg(F.count("*").alias("lines"), (F.count_if((c("vwap") > 94) | (c("vwap") < 6)) / F.count("*")).alias("share"))


_FILTER = "CASE WHEN r.condition IS NULL THEN 'missing_condition' WHEN NOT final THEN 'unresolved_market' WHEN ts >= resolved_at + 157680000 THEN 'after_close' WHEN side <> 'BUY' THEN 'not_a_buy' WHEN cents > 95 OR cents < 5 THEN 'extreme_price' WHEN cash < 100 THEN 'small' END"


def market_filter() -> Column:
    return F.when(c("final").isNull(), "missing_condition").when(~c("final"), "unresolved_market").when(c("ts") >= c("resolved_at") + 157680000, "after_close").when(c("side") != "BUY", "not_a_buy").when((c("cents") > 95) | (c("cents") < 5), "extreme_price").when(c("cash") < 100, "small")


@query("P19_market_filter", f"SELECT k, {_FILTER} AS reason FROM v_trades t LEFT JOIN v_resolution r USING (condition)".replace("r.condition IS NULL", "r.final IS NULL"))
def market_filters(spark: SparkSession, d: str) -> DataFrame:
    return trades(spark, d).join(resolution(spark, d), "condition", "left").select("k", market_filter().alias("reason"))


@query("A10_wallet_funnel", f"SELECT wallet, arg_max(reason, struct_pack(n := n, f := -f)) AS reason, sum(n)::BIGINT AS excluded FROM (SELECT wallet, reason, count(*) AS n, min(ts * 1000 + length(reason)) AS f FROM (SELECT t.*, {_FILTER} AS reason FROM v_trades t LEFT JOIN v_resolution r USING (condition)) WHERE reason IS NOT NULL GROUP BY ALL) GROUP BY wallet".replace("r.condition IS NULL", "r.final IS NULL"))
def wallet_funnel(spark: SparkSession, d: str) -> DataFrame:
    """Each wallet's most frequent exclusion; of equal ones the one met first."""
    x = trades(spark, d).join(resolution(spark, d), "condition", "left").withColumn("reason", market_filter()).where("reason is not null")
    n = x.groupBy("wallet", "reason").agg(F.count("*").alias("n"), F.min(c("ts") * 1000 + F.length("reason")).alias("f"))
    return n.groupBy("wallet").agg(F.max_by("reason", F.struct("n", -c("f"))).alias("reason"), F.sum("n").alias("excluded"))


@query("S23_M54_C18_fill_extraction", "SELECT wallet, count(*) AS rows, count(*) FILTER (side = 'BUY' AND ts BETWEEN 883612800 AND 978307200) AS buys, count(*) FILTER (side = 'BUY' AND ts BETWEEN 883612800 AND 978307200 AND cents % 7 <> 0) AS extractable FROM v_trades GROUP BY wallet")
def fill_extraction(spark: SparkSession, d: str) -> DataFrame:
    buy = (c("side") == "BUY") & c("ts").between(883612800, 978307200)
    return trades(spark, d).groupBy("wallet").agg(F.count("*").alias("rows"), F.count_if(buy).alias("buys"), F.count_if(buy & (c("cents") % 7 != 0)).alias("extractable"))


@query("M55_closing_cutoff", "SELECT condition, condition % 2 = 0 AS sports, CASE WHEN condition % 2 = 0 THEN resolved_at - 10800 ELSE resolved_at - 7200 END AS cutoff FROM v_resolution")
def closing_cutoff(spark: SparkSession, d: str, hours: int = 2) -> DataFrame:
    sports = c("condition") % 2 == 0
    return resolution(spark, d).select("condition", sports.alias("sports"), F.when(sports, c("resolved_at") - 10800).otherwise(c("resolved_at") - hours * 3600).alias("cutoff"))

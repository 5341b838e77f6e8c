"""The trade feed: gates with reasons, daily rollups, venue mixes and top lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wagerlake.registry import query
from wagerlake.sources.carriers import feed

c = F.col
#: Fixed values of the gates: stake in cents, EV percent, resolved bets, resolved volume; target trades a day.
STAKE, EV, BETS, VOLUME, TARGET = 50_000, 3.0, 10, 300, (3, 5)
PM_SLOTS, KALSHI_SLOTS, FEED, FLOOR, BUFFER_FLOOR = 30, 20, 50, 20, 15


def block_reason() -> Column:
    """First failing check of a feed trade, null if it passes."""
    w = c("wallet")
    return (
        F.when(c("stake_cents") < STAKE, "trade_stake_below_minimum").when(c("ev").isNull(), "trade_ev_missing").when(c("ev") < EV, "trade_ev_below_minimum").when(w % 9 == 0, "wallet_not_in_registry")
        .when(w % 8 == 0, "hydration_incomplete").when(w * 7 % 40 < BETS, "insufficient_resolved_bets_count").when(w % 10 == 1, "historical_volume_unavailable").when(w * 13 % 1000 < VOLUME, "historical_volume_below_minimum")
    )


_REASON = """CASE WHEN stake_cents < 50000 THEN 'trade_stake_below_minimum' WHEN ev IS NULL THEN 'trade_ev_missing' WHEN ev < 3 THEN 'trade_ev_below_minimum' WHEN wallet % 9 = 0 THEN 'wallet_not_in_registry' WHEN wallet % 8 = 0 THEN 'hydration_incomplete'
 WHEN wallet * 7 % 40 < 10 THEN 'insufficient_resolved_bets_count' WHEN wallet % 10 = 1 THEN 'historical_volume_unavailable' WHEN wallet * 13 % 1000 < 300 THEN 'historical_volume_below_minimum' END"""
_ROWS = f"SELECT *, {_REASON} AS reason FROM v_feed"


def judged(spark: SparkSession, d: str) -> DataFrame:
    return feed(spark, d).withColumn("reason", block_reason())


@query("P12_P13_P14_P15_P17_gate_reason", f"SELECT id, stake_cents >= 50000 AS stake_pass, coalesce(ev >= 3, false) AS ev_pass, reason FROM ({_ROWS})")
def gate_reason(spark: SparkSession, d: str) -> DataFrame:
    return judged(spark, d).select("id", (c("stake_cents") >= STAKE).alias("stake_pass"), F.coalesce(c("ev") >= EV, F.lit(False)).alias("ev_pass"), "reason")


@query("P16_gate_matrix", "SELECT id, [stake_cents >= 50000, coalesce(ev >= 3, false), wallet % 9 <> 0, wallet % 8 <> 0, wallet * 7 % 40 >= 10, wallet * 13 % 1000 >= 300] AS gates FROM v_feed")
def gate_matrix(spark: SparkSession, d: str) -> DataFrame:
    w = c("wallet")
    return feed(spark, d).select("id", F.array(c("stake_cents") >= STAKE, F.coalesce(c("ev") >= EV, F.lit(False)), w % 9 != 0, w % 8 != 0, w * 7 % 40 >= BETS, w * 13 % 1000 >= VOLUME).alias("gates"))


@query("A33_C12_drop_counts", f"SELECT venue, coalesce(reason, 'passed') AS reason, count(*) AS trades FROM ({_ROWS}) GROUP BY ALL")
def drop_counts(spark: SparkSession, d: str) -> DataFrame:
    return judged(spark, d).groupBy("venue", F.coalesce("reason", F.lit("passed")).alias("reason")).agg(F.count("*").alias("trades"))


@query("P11_notional", "SELECT id, CASE WHEN stake_cents <= 0 OR price <= 0 THEN 0::DOUBLE WHEN price <= 1 THEN price * stake_cents WHEN price <= 100 THEN price / 100 * stake_cents ELSE 0 END AS usd FROM (SELECT id, stake_cents, (id % 130)::DOUBLE / CASE WHEN id % 2 = 0 THEN 1 ELSE 100 END AS price FROM v_feed)")
def notional(spark: SparkSession, d: str) -> DataFrame:
    price = (c("id") % 130).cast("double") / F.when(c("id") % 2 == 0, 1).otherwise(100)
    x = F.when((c("stake_cents") <= 0) | (price <= 0), 0.0).when(price <= 1, price * c("stake_cents")).when(price <= 100, price / 100 * c("stake_cents")).otherwise(0.0)
    return feed(spark, d).select("id", x.alias("usd"))


@query("P18_P32_tiers", "SELECT id, CASE wallet % 3 WHEN 0 THEN 250 WHEN 1 THEN 1000 ELSE 500 END AS floor_usd, CASE WHEN stake_cents >= 1000000 THEN 5 WHEN stake_cents >= 500000 THEN 4 WHEN stake_cents >= 100000 THEN 3 WHEN stake_cents >= 50000 THEN 2 WHEN stake_cents >= 10000 THEN 1 ELSE 0 END AS tier FROM v_feed")
def tiers(spark: SparkSession, d: str) -> DataFrame:
    bands = F.array(*(F.lit(x) for x in (10_000, 50_000, 100_000, 500_000, 1_000_000)))
    kind = c("wallet") % 3
    return feed(spark, d).select("id", F.when(kind == 0, 250).when(kind == 1, 1000).otherwise(500).alias("floor_usd"), F.size(F.filter(bands, lambda b: b <= c("stake_cents"))).alias("tier"))


@query("P23_json_predicate", "SELECT event_id, coalesce(try_cast(json_extract_string(props, '$.k') AS DOUBLE) >= 50, false) AS high FROM events")
def json_predicate(spark: SparkSession, d: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").try_cast("double")
    return spark.read.parquet(f"{d}/events.parquet").select("event_id", F.coalesce(k >= 50, F.lit(False)).alias("high"))


@query("P24_ev_coalesce", "SELECT id, CASE WHEN ev IS NOT NULL AND ev <> 0 THEN ev WHEN wallet % 5 > 0 THEN (wallet % 5)::DOUBLE END AS ev FROM v_feed")
def ev_coalesce(spark: SparkSession, d: str) -> DataFrame:
    """First of several fields that is there; a zero counts as stale."""
    return feed(spark, d).select("id", F.coalesce(F.nullif("ev", F.lit(0.0)), F.nullif((c("wallet") % 5).cast("double"), F.lit(0.0))).alias("ev"))


@query("P22_volume_trust", "SELECT DISTINCT wallet, CASE WHEN wallet % 10 = 1 THEN 'unavailable' WHEN wallet * 13 % 1000 < 300 THEN 'below_threshold' ELSE 'trusted' END AS status FROM v_feed")
def volume_trust(spark: SparkSession, d: str) -> DataFrame:
    w = c("wallet")
    return feed(spark, d).select("wallet").distinct().select("wallet", F.when(w % 10 == 1, "unavailable").when(w * 13 % 1000 < VOLUME, "below_threshold").otherwise("trusted").alias("status"))


_DAILY = f"SELECT day, count(*) AS candidates, count(*) FILTER (stake_cents >= 50000 AND ev >= 3) AS stake_ev, count(*) FILTER (reason IS NULL) AS eligible, count(DISTINCT CASE WHEN reason IS NULL THEN wallet END) AS wallets, coalesce(sum(stake_cents) FILTER (reason IS NULL), 0)::BIGINT AS stake, count(*) FILTER (reason IS NULL) BETWEEN 3 AND 5 AS in_range FROM ({_ROWS}) GROUP BY day"


def daily(spark: SparkSession, d: str) -> DataFrame:
    """One row a day between the first and the last, days without a trade too."""
    ok = c("reason").isNull()
    t = judged(spark, d)
    span = t.agg(F.to_date(F.min("day")).alias("a"), F.to_date(F.max("day")).alias("b")).where("a is not null").select(F.explode(F.sequence("a", "b")).alias("x")).select(F.date_format("x", "yyyy-MM-dd").alias("day"))
    per = t.groupBy("day").agg(F.count("*").alias("candidates"), F.count_if((c("stake_cents") >= STAKE) & (c("ev") >= EV)).alias("stake_ev"), F.count_if(ok).alias("eligible"), F.count_distinct(F.when(ok, c("wallet"))).alias("wallets"), F.coalesce(F.sum(F.when(ok, c("stake_cents"))), F.lit(0)).alias("stake"))
    return span.join(per, "day", "left").na.fill(0).withColumn("in_range", c("eligible").between(*TARGET))


_SPAN = "SELECT strftime(unnest(generate_series(min(day)::DATE, max(day)::DATE, INTERVAL 1 DAY)), '%Y-%m-%d') AS day FROM v_feed"
_FULL = f"SELECT s.day, coalesce(candidates, 0) AS candidates, coalesce(stake_ev, 0) AS stake_ev, coalesce(eligible, 0) AS eligible, coalesce(wallets, 0) AS wallets, coalesce(stake, 0) AS stake, coalesce(in_range, false) AS in_range FROM ({_SPAN}) s LEFT JOIN ({_DAILY}) USING (day)"


@query("A18_W06_daily_rollup", _FULL)
def daily_rollup(spark: SparkSession, d: str) -> DataFrame:
    return daily(spark, d)


@query("A19_W05_streak", f"SELECT count(*) AS days, sum(eligible)::BIGINT AS total, min(eligible) AS low, max(eligible) AS high, count(*) FILTER (in_range) AS within, coalesce((SELECT max(n) FROM (SELECT count(*) AS n FROM (SELECT day, in_range, row_number() OVER (ORDER BY day) - row_number() OVER (PARTITION BY in_range ORDER BY day) AS g FROM ({_FULL})) WHERE in_range GROUP BY g)), 0) AS streak FROM ({_FULL})")
def streak(spark: SparkSession, d: str) -> DataFrame:
    """Longest run of days within the target; the windows run over the days, a table as long as the calendar."""
    x = daily(spark, d)
    run = F.row_number().over(Window.orderBy("day")) - F.row_number().over(Window.partitionBy("in_range").orderBy("day"))
    longest = x.withColumn("g", run).where("in_range").groupBy("g").agg(F.count("*").alias("n")).agg(F.coalesce(F.max("n"), F.lit(0)).alias("streak"))
    sums = x.agg(F.count("*").alias("days"), F.sum("eligible").alias("total"), F.min("eligible").alias("low"), F.max("eligible").alias("high"), F.count_if("in_range").alias("within"))
    return sums.crossJoin(longest)  # one row and one row


@query("A20_A21_S17_daily_counters", f"SELECT day, venue, count(*) AS detected, count(*) FILTER (reason IS NULL) AS passed, count(DISTINCT wallet) AS whales FROM ({_ROWS}) GROUP BY ALL")
def daily_counters(spark: SparkSession, d: str) -> DataFrame:
    return judged(spark, d).groupBy("day", "venue").agg(F.count("*").alias("detected"), F.count_if(c("reason").isNull()).alias("passed"), F.count_distinct("wallet").alias("whales"))


@query("A26_unknown_reasons", f"SELECT r AS reason, count(t.reason) AS trades FROM (SELECT unnest(['hydration_incomplete', 'historical_volume_unavailable', 'other']) AS r) LEFT JOIN ({_ROWS}) t ON t.reason = r GROUP BY r")
def unknown_reasons(spark: SparkSession, d: str) -> DataFrame:
    names = spark.createDataFrame([(x,) for x in ("hydration_incomplete", "historical_volume_unavailable", "other")], "reason string")
    return names.join(judged(spark, d).groupBy("reason").agg(F.count("*").alias("n")), "reason", "left").select("reason", F.coalesce("n", F.lit(0)).alias("trades"))


@query("A27_visible_stake", f"SELECT wallet, sum(stake_cents)::BIGINT AS stake FROM ({_ROWS}) WHERE reason IS NULL GROUP BY wallet")
def visible_stake(spark: SparkSession, d: str) -> DataFrame:
    return judged(spark, d).where("reason is null").groupBy("wallet").agg(F.sum("stake_cents").alias("stake"))


@query("A30_market_flow", "SELECT day, count(*) AS large, coalesce(sum(stake_cents) FILTER (id % 2 = 0), 0)::BIGINT AS yes, coalesce(sum(stake_cents) FILTER (id % 2 = 1), 0)::BIGINT AS no, coalesce(sum(stake_cents) FILTER (id % 2 = 0), 0) / sum(stake_cents) * 100 AS yes_pct FROM v_feed WHERE stake_cents >= 50000 GROUP BY day")
def market_flow(spark: SparkSession, d: str) -> DataFrame:
    yes = F.coalesce(F.sum(F.when(c("id") % 2 == 0, c("stake_cents"))), F.lit(0))
    no = F.coalesce(F.sum(F.when(c("id") % 2 == 1, c("stake_cents"))), F.lit(0))
    return feed(spark, d).where(c("stake_cents") >= STAKE).groupBy("day").agg(F.count("*").alias("large"), yes.alias("yes"), no.alias("no"), (yes / F.sum("stake_cents") * 100).alias("yes_pct"))


def latest(df: DataFrame, n: int, *order: Column) -> DataFrame:
    """The first n rows of each venue with their rank; a limit on the rank keeps a task's part of the window short."""
    return df.withColumn("r", F.row_number().over(Window.partitionBy("venue").orderBy(*order))).where(c("r") <= n)


@query("K02_reserved_slots", """WITH x AS (SELECT id, venue, row_number() OVER (PARTITION BY venue ORDER BY ts DESC, id DESC) AS r FROM v_feed), n AS (SELECT least(count(*) FILTER (venue = 'kalshi'), 20) AS k, least(count(*) FILTER (venue <> 'kalshi'), 30) AS p FROM v_feed),
y AS (SELECT id, venue, r FROM x, n WHERE r <= CASE WHEN venue = 'kalshi' THEN 20 + 30 - p ELSE 30 + 20 - k END), m AS (SELECT count(*) FILTER (venue = 'kalshi') AS k, count(*) FILTER (venue <> 'kalshi') AS p FROM y),
z AS (SELECT id, venue, r, CASE WHEN venue = 'kalshi' THEN CASE WHEN 2 * r <= p THEN 3 * r ELSE p + r END ELSE CASE WHEN (r - 1) // 2 <= k THEN r + (r - 1) // 2 ELSE k + r END END AS slot FROM y, m)
SELECT id, venue, row_number() OVER (ORDER BY slot, venue DESC, r) AS pos FROM z QUALIFY pos <= 50""")
def reserved_slots(spark: SparkSession, d: str) -> DataFrame:
    """30 and 20 of two venues, what one lacks going to the other, interleaved two to one: the k-th of the second venue stands at 3k as long as both have rows."""
    top = latest(feed(spark, d), FEED, F.desc("ts"), F.desc("id"))
    is_k = c("venue") == "kalshi"
    have = top.agg(F.least(F.count_if(is_k), F.lit(KALSHI_SLOTS)).alias("k"), F.least(F.count_if(~is_k), F.lit(PM_SLOTS)).alias("p"))
    taken = top.crossJoin(have).where(c("r") <= F.when(is_k, FEED - c("p")).otherwise(FEED - c("k"))).select("id", "venue", "r")  # at most 100 rows and one
    n = taken.agg(F.count_if(is_k).alias("k"), F.count_if(~is_k).alias("p"))
    before = F.floor((c("r") - 1) / 2)
    slot = F.when(is_k, F.when(2 * c("r") <= c("p"), 3 * c("r")).otherwise(c("p") + c("r"))).otherwise(F.when(before <= c("k"), c("r") + before).otherwise(c("k") + c("r")))
    pos = F.row_number().over(Window.orderBy("slot", F.desc("venue"), "r")).cast("long")
    return taken.crossJoin(n).withColumn("slot", slot).select("id", "venue", pos.alias("pos")).where(c("pos") <= FEED)


@query("K03_C13_recent_trades", """WITH x AS (SELECT id, venue, ts, row_number() OVER (PARTITION BY venue ORDER BY ts DESC, id DESC) AS r FROM v_feed), n AS (SELECT least(count(*) FILTER (venue = 'kalshi'), 20) AS fl, count(*) FILTER (venue <> 'kalshi') AS pm FROM v_feed)
SELECT id, venue FROM x, n WHERE (venue <> 'kalshi' AND r <= least(pm, 50 - fl)) OR (venue = 'kalshi' AND r <= 50 - least(pm, 50 - fl))""")
def recent_trades(spark: SparkSession, d: str) -> DataFrame:
    """The latest 50 with a floor of 20 for the smaller venue; counts come from the ranked top alone."""
    top = latest(feed(spark, d), FEED, F.desc("ts"), F.desc("id"))
    n = top.agg(F.least(F.count_if(c("venue") == "kalshi"), F.lit(FLOOR)).alias("fl"), F.count_if(c("venue") != "kalshi").alias("pm"))
    take = F.least(c("pm"), FEED - c("fl"))
    return top.crossJoin(n).where(((c("venue") != "kalshi") & (c("r") <= take)) | ((c("venue") == "kalshi") & (c("r") <= FEED - take))).select("id", "venue")  # at most 100 rows and one


@query("K04_buffer_trim", """WITH x AS (SELECT id, venue, row_number() OVER (PARTITION BY venue ORDER BY ts DESC, id DESC) AS r FROM v_feed), n AS (SELECT least(count(*) FILTER (venue = 'kalshi'), 15) AS fl, count(*) FILTER (venue <> 'kalshi') AS pm FROM v_feed)
SELECT id FROM x, n WHERE (venue <> 'kalshi' AND r <= least(pm, 200 - fl)) OR (venue = 'kalshi' AND r <= 200 - least(pm, 200 - fl))""")
def buffer_trim(spark: SparkSession, d: str, most: int = 200) -> DataFrame:
    top = latest(feed(spark, d), most, F.desc("ts"), F.desc("id"))
    n = top.agg(F.least(F.count_if(c("venue") == "kalshi"), F.lit(BUFFER_FLOOR)).alias("fl"), F.count_if(c("venue") != "kalshi").alias("pm"))
    take = F.least(c("pm"), most - c("fl"))
    return top.crossJoin(n).where(((c("venue") != "kalshi") & (c("r") <= take)) | ((c("venue") == "kalshi") & (c("r") <= most - take))).select("id")  # at most 2 * most rows and one


@query("K07_fallback_feed", f"SELECT id FROM ({_ROWS}) WHERE reason IS NULL ORDER BY ts DESC, id DESC LIMIT 20")
def fallback_feed(spark: SparkSession, d: str, n: int = 20) -> DataFrame:
    return judged(spark, d).where("reason is null").orderBy(F.desc("ts"), F.desc("id")).select("id").limit(n)


@query("K08_repair_queue", "SELECT wallet, tier, visible FROM (SELECT wallet, wallet % 4 AS tier, count(*) FILTER (ev >= 3) AS visible, count(*) AS n FROM v_feed GROUP BY wallet) WHERE (visible > 0 OR (n >= 3 AND tier <= 3)) ORDER BY tier, visible DESC, wallet")
def repair_queue(spark: SparkSession, d: str) -> DataFrame:
    per = feed(spark, d).groupBy("wallet").agg(F.count_if(c("ev") >= EV).alias("visible"), F.count("*").alias("n")).withColumn("tier", c("wallet") % 4)
    return per.where("visible > 0 or (n >= 3 and tier <= 3)").orderBy("tier", F.desc("visible"), "wallet").select("wallet", "tier", "visible")


@query("W07_related_trades", "SELECT a.id, count(*) AS related FROM v_feed a JOIN v_feed b ON a.wallet = b.wallet AND b.ts BETWEEN a.ts - 60 AND a.ts + 60 GROUP BY a.id")
def related_trades(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("wallet").orderBy("ts").rangeBetween(-60, 60)
    return feed(spark, d).select("id", F.count("*").over(w).alias("related"))


@query("W09_trending", "SELECT id FROM v_feed WHERE stake_cents >= 50000 AND ts >= 1704067200 + 86400")
def trending(spark: SparkSession, d: str, now: int = 1704067200 + 87000, window: int = 600) -> DataFrame:
    return feed(spark, d).where((c("stake_cents") >= STAKE) & (c("ts") >= now - window)).select("id")


@query("A48_gate_ring", "SELECT id, sum(CASE WHEN ev >= 3 THEN 1 ELSE 0 END) OVER (PARTITION BY venue ORDER BY ts, id ROWS 999 PRECEDING)::BIGINT AS passed FROM v_feed")
def gate_ring(spark: SparkSession, d: str, ring: int = 1000, cell: int = 3600) -> DataFrame:
    """How many of the last ring trades of a venue passed. No task sorts a venue: places are counted inside hours, hours are summed up over their
    table alone, and the window runs in blocks of ring places, each with the block before."""
    t = feed(spark, d).select("id", "venue", "ts", F.when(c("ev") >= EV, 1).otherwise(0).alias("ok"), F.floor(c("ts") / cell).alias("hour"))
    hours = t.groupBy("venue", "hour").agg(F.count("*").alias("n"))
    start = hours.withColumn("before", F.sum("n").over(Window.partitionBy("venue").orderBy("hour").rowsBetween(Window.unboundedPreceding, -1))).select("venue", "hour", F.coalesce("before", F.lit(0)).alias("before"))
    placed = t.withColumn("r", F.row_number().over(Window.partitionBy("venue", "hour").orderBy("ts", "id"))).join(start, ["venue", "hour"]).select("id", "venue", "ok", (c("before") + c("r") - 1).alias("place"))
    own = F.floor(c("place") / ring)
    both = placed.withColumn("block", F.explode(F.array(own, own + 1))).withColumn("own", c("block") == own)
    w = Window.partitionBy("venue", "block").orderBy("place").rowsBetween(1 - ring, 0)
    return both.select("id", "own", F.sum("ok").over(w).alias("passed")).where("own").select("id", "passed")


@query("F14_day_key", "SELECT id, day FROM v_feed")
def day_key(spark: SparkSession, d: str) -> DataFrame:
    return feed(spark, d).select("id", "day")


@query("U04_wallet_list", "SELECT lower(trim(w)) AS wallet, min(id) AS first FROM (SELECT id, CASE WHEN id % 13 = 0 THEN NULL WHEN id % 2 = 0 THEN ' W' || wallet ELSE 'w' || wallet || ' ' END AS w FROM v_feed) WHERE w IS NOT NULL GROUP BY 1")
def wallet_list(spark: SparkSession, d: str) -> DataFrame:
    raw = F.when(c("id") % 13 == 0, None).when(c("id") % 2 == 0, F.concat(F.lit(" W"), "wallet")).otherwise(F.concat(F.lit("w"), "wallet", F.lit(" ")))
    return feed(spark, d).select("id", F.lower(F.trim(raw)).alias("wallet")).where("wallet is not null").groupBy("wallet").agg(F.min("id").alias("first"))

"""The market domain over the given tables: trades, unit events, resolutions, ticks, books, positions, and their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

VIEWS = {
    "v_trades": """SELECT o_custkey AS wallet, l_partkey AS condition, l_partkey * 2 + (l_linestatus = 'O')::INT AS asset, CASE WHEN l_returnflag = 'R' THEN 'SELL' ELSE 'BUY' END AS side,
 l_quantity::BIGINT AS shares, (l_partkey * 37 + l_suppkey * 11 + l_linenumber * 7) % 97 + 1 AS cents, l_quantity::BIGINT * ((l_partkey * 37 + l_suppkey * 11 + l_linenumber * 7) % 97 + 1) AS cash,
 epoch(l_shipdate)::BIGINT AS ts, concat_ws('|', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS k FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "v_unit_events": "SELECT user_id AS wallet, event_id % 5 AS asset, CASE WHEN event_type IN ('purchase', 'signup', 'view') THEN 'BUY' ELSE 'SELL' END AS side, 1 AS shares, event_id % 89 + 5 AS cash, (epoch_us(ts) // 1000000)::BIGINT AS ts, event_id AS k FROM events",
    "v_resolution": "SELECT p_partkey AS condition, p_partkey % 3 <> 0 AS final, p_partkey * 2 + p_size % 2 AS winning_asset, 788918400 + p_partkey % 500 * 86400 AS resolved_at FROM part",
    "v_ticks": "SELECT user_id AS token, (epoch_us(ts) // 1000000)::BIGINT AS t, event_id AS k, ((event_id * 29) % 97 + 2) / 100.0::DOUBLE AS p FROM events",
    "v_books": """SELECT p_partkey AS market, (p_partkey * 13 % 90 + 3) / 100.0::DOUBLE AS bid, (p_partkey * 13 % 90 + 4 + p_size % 5) / 100.0::DOUBLE AS ask, p_size::DOUBLE AS bid_size, (p_partkey % 7)::DOUBLE AS ask_size,
 (p_partkey * 17 % 90 + 3) / 100.0::DOUBLE AS bid2, (p_partkey * 17 % 90 + 4 + p_size % 3) / 100.0::DOUBLE AS ask2, (p_partkey * 29 % 97 + 2) / 100.0::DOUBLE AS p_true, p_partkey % 4 AS kind, p_brand AS brand FROM part""",
    "v_positions": """SELECT wallet, condition, category, bought, CASE WHEN condition % 4 = 0 THEN 0 ELSE (wallet * 7919 + condition * 104729) % 20001 - 10000 END AS realized, (wallet * 31 + condition * 17) % 4001 - 2000 AS total,
 CASE condition % 3 WHEN 0 THEN 'CLOSED' WHEN 1 THEN 'OPEN' ELSE 'REDEEMABLE' END AS status, condition % 3 = 2 AS redeemable, CASE condition % 5 WHEN 0 THEN 0.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE (condition % 97) / 100.0::DOUBLE END AS price
 FROM (SELECT wallet, condition, sum(CASE WHEN side = 'BUY' THEN cash ELSE 0 END)::BIGINT AS bought FROM v_trades GROUP BY ALL) JOIN (SELECT p_partkey AS condition, p_type AS category FROM part) USING (condition)""",
    "v_feed": """SELECT event_id AS id, CASE WHEN event_type IN ('click', 'view') THEN 'kalshi' ELSE 'polymarket' END AS venue, user_id AS wallet, (epoch_us(ts) // 1000000)::BIGINT AS ts, (value * 100)::BIGINT * 10 AS stake_cents,
 CASE WHEN event_id % 7 = 0 THEN NULL ELSE (event_id * 31 % 200 - 60) / 10.0::DOUBLE END AS ev, strftime(ts, '%Y-%m-%d') AS day FROM events""",
    "v_chain": """SELECT event_id AS raw_id, user_id AS wallet, CASE event_id % 6 WHEN 0 THEN 'redeem' WHEN 1 THEN 'MERGE' WHEN 2 THEN 'Split' WHEN 3 THEN 'reward' ELSE 'TRADE' END AS raw_type, CASE WHEN event_id % 11 = 0 THEN NULL WHEN event_id % 2 = 0 THEN 'BUY' ELSE 'SELL' END AS side, event_id % 40 AS condition, event_id % 80 + 1 AS asset,
 (event_id * 7 % 50)::BIGINT AS shares, (event_id * 13 % 97 + 1) / 100.0::DOUBLE AS price, (event_id * 7 % 50)::BIGINT * 3 AS cash, CASE WHEN event_id % 19 > 0 THEN (epoch_us(ts) // 1000000)::BIGINT // 3600 * 3600 END AS ts, CASE WHEN event_id % 9 > 0 THEN (CASE WHEN event_id % 2 = 0 THEN '0xAB' ELSE '0xab' END) || (event_id // 2 % 300) END AS tx,
 CASE WHEN event_id % 8 > 0 THEN event_id // 2 % 1000 END AS block, CASE WHEN event_id // 2 % 300 % 4 > 0 AND event_id % 3 > 0 THEN event_id % 50 END AS log_index, CASE WHEN event_id % 5 = 0 THEN 'activity' ELSE 'polygon' END AS source FROM events""",
    "v_rows": """SELECT event_id AS id, user_id AS wallet, CASE event_id * 7919 % 23 WHEN 0 THEN 'redeem' WHEN 1 THEN 'MERGE' WHEN 2 THEN 'Split' WHEN 3 THEN 'reward' ELSE 'TRADE' END AS raw_type, CASE WHEN event_id % 31 = 0 THEN NULL WHEN event_type IN ('purchase', 'signup', 'view') THEN 'BUY' ELSE 'SELL' END AS side,
 event_id % 12 + 2 AS asset, CASE WHEN event_id % 13 = 0 THEN NULL WHEN event_id % 17 = 0 THEN 40 ELSE (event_id % 12 + 2) // 2 END AS condition, (1 + (event_id % 5 = 0)::INT)::DOUBLE AS shares, (event_id * 13 % 97 + 1) / 100.0::DOUBLE AS price,
 CASE WHEN event_id * 7919 % 23 < 4 THEN 0.25::DOUBLE * (event_id % 4) ELSE (1 + (event_id % 5 = 0)::INT)::DOUBLE * ((event_id * 13 % 97 + 1) / 100.0::DOUBLE) END AS cash, CASE WHEN event_id % 19 > 0 THEN (epoch_us(ts) // 1000000)::BIGINT END AS ts,
 CASE WHEN event_id % 9 > 0 THEN (CASE WHEN event_id % 2 = 0 THEN '0xAB' ELSE '0xab' END) || (event_id // 2) END AS tx, CASE WHEN event_id % 8 > 0 THEN (epoch_us(ts) // 1000000)::BIGINT // 259200 END AS block, CASE WHEN event_id % 6 > 0 THEN event_id % 10 END AS tx_index, CASE WHEN event_id % 7 > 0 THEN event_id % 10 * 5 + event_id % 3 END AS log_index FROM events""",
    "v_games": """SELECT p_partkey AS market, CASE WHEN p_partkey % 2 = 0 THEN 'polymarket' ELSE 'kalshi' END AS source, CASE WHEN p_partkey % 7 > 0 THEN (p_partkey * 13 % 90 + 3) / 100.0::DOUBLE END AS kb, (p_partkey * 13 % 90 + 4 + p_size % 8) / 100.0::DOUBLE AS ka, p_partkey * 11 % 90 AS kg,
 (p_partkey * 17 % 90 + 3) / 100.0::DOUBLE AS pb, CASE WHEN p_partkey % 13 > 0 THEN (p_partkey * 17 % 90 + 4 + p_size % 7) / 100.0::DOUBLE END AS pa, CASE WHEN p_partkey % 17 > 0 THEN p_partkey * 19 % 80 END AS pg, CASE WHEN p_partkey % 5 = 0 THEN (p_partkey * 29 % 97 + 1) / 100.0::DOUBLE END AS mb,
 CASE WHEN p_partkey % 5 = 0 THEN (p_partkey * 29 % 97 + 4) / 100.0::DOUBLE END AS ma, p_partkey * 23 % 70 AS mg, CASE WHEN p_partkey % 3 > 0 THEN p_partkey % 200 - 100 END AS starts_in, p_partkey % 5 - 2 AS days_off, CASE WHEN p_partkey % 10 > 0 THEN (p_partkey * 7 % 100) / 100.0::DOUBLE END AS paid FROM part""",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, key: str, each: int = 4) -> DataFrame:
    """df dealt to all cores by a key, each tasks a core: a small file is one task, however much there is to work out for each of its rows."""
    return df.repartition(each * df.sparkSession.sparkContext.defaultParallelism, key)


def seconds(ts: Column) -> Column:
    """Whole seconds since 1970 of a time stamp without zone."""
    return F.floor(F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), ts) / 1_000_000).cast("long")


def cents(x: Column) -> Column:
    return x / F.lit(100.0)


def trades(spark: SparkSession, d: str) -> DataFrame:
    cost = (F.col("l_partkey") * 37 + F.col("l_suppkey") * 11 + F.col("l_linenumber") * 7) % 97 + 1
    shares = F.col("l_quantity").cast("long")
    joined = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return joined.select(
        F.col("o_custkey").alias("wallet"), F.col("l_partkey").alias("condition"), (F.col("l_partkey") * 2 + (F.col("l_linestatus") == "O").cast("int")).alias("asset"),
        F.when(F.col("l_returnflag") == "R", "SELL").otherwise("BUY").alias("side"), shares.alias("shares"), cost.alias("cents"), (shares * cost).alias("cash"),
        seconds(F.col("l_shipdate")).alias("ts"), F.concat_ws("|", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("k"),
    )


def unit_events(spark: SparkSession, d: str) -> DataFrame:
    side = F.when(F.col("event_type").isin("purchase", "signup", "view"), "BUY").otherwise("SELL")
    return table(spark, d, "events").select(F.col("user_id").alias("wallet"), (F.col("event_id") % 5).alias("asset"), side.alias("side"), F.lit(1).alias("shares"), (F.col("event_id") % 89 + 5).alias("cash"), seconds(F.col("ts")).alias("ts"), F.col("event_id").alias("k"))


def resolution(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("p_partkey")
    return table(spark, d, "part").select(key.alias("condition"), (key % 3 != 0).alias("final"), (key * 2 + F.col("p_size") % 2).alias("winning_asset"), (F.lit(788918400) + key % 500 * 86400).alias("resolved_at"))


def games(spark: SparkSession, d: str) -> DataFrame:
    """Markets with the books of three venues (bid, ask, age of the quote), when they start, and a price paid."""
    k, size = F.col("p_partkey"), F.col("p_size")
    return table(spark, d, "part").select(
        k.alias("market"), F.when(k % 2 == 0, "polymarket").otherwise("kalshi").alias("source"), F.when(k % 7 > 0, cents(k * 13 % 90 + 3)).alias("kb"), cents(k * 13 % 90 + 4 + size % 8).alias("ka"), (k * 11 % 90).alias("kg"),
        cents(k * 17 % 90 + 3).alias("pb"), F.when(k % 13 > 0, cents(k * 17 % 90 + 4 + size % 7)).alias("pa"), F.when(k % 17 > 0, k * 19 % 80).alias("pg"), F.when(k % 5 == 0, cents(k * 29 % 97 + 1)).alias("mb"),
        F.when(k % 5 == 0, cents(k * 29 % 97 + 4)).alias("ma"), (k * 23 % 70).alias("mg"), F.when(k % 3 > 0, k % 200 - 100).alias("starts_in"), (k % 5 - 2).alias("days_off"), F.when(k % 10 > 0, cents(k * 7 % 100)).alias("paid"),
    )


def chain_events(spark: SparkSession, d: str) -> DataFrame:
    """Rows of several sources as they come: types in any case, hashes in any case or missing, blocks and log indexes with gaps."""
    i, whole = F.col("event_id"), lambda n: F.floor(F.col("event_id") / n).cast("long")
    return table(spark, d, "events").select(
        i.alias("raw_id"), F.col("user_id").alias("wallet"), F.when(i % 6 == 0, "redeem").when(i % 6 == 1, "MERGE").when(i % 6 == 2, "Split").when(i % 6 == 3, "reward").otherwise("TRADE").alias("raw_type"),
        F.when(i % 11 == 0, None).when(i % 2 == 0, "BUY").otherwise("SELL").alias("side"), (i % 40).alias("condition"), (i % 80 + 1).alias("asset"), (i * 7 % 50).cast("long").alias("shares"), cents(i * 13 % 97 + 1).alias("price"), (i * 7 % 50 * 3).cast("long").alias("cash"),
        F.when(i % 19 > 0, F.floor(seconds(F.col("ts")) / 3600).cast("long") * 3600).alias("ts"), F.when(i % 9 > 0, F.concat(F.when(i % 2 == 0, "0xAB").otherwise("0xab"), (whole(2) % 300).cast("string"))).alias("tx"),
        F.when(i % 8 > 0, whole(2) % 1000).alias("block"), F.when((whole(2) % 300 % 4 > 0) & (i % 3 > 0), i % 50).alias("log_index"), F.when(i % 5 == 0, "activity").otherwise("polygon").alias("source"),
    )


def ledger_rows(spark: SparkSession, d: str) -> DataFrame:
    """Rows of a ledger of all five event types, with conditions, times, hashes, blocks and places in a block missing here and there."""
    i, kind, time = F.col("event_id"), F.col("event_id") * 7919 % 23, seconds(F.col("ts"))
    shares, price = F.when(i % 5 == 0, 2.0).otherwise(1.0), cents(i * 13 % 97 + 1)
    return table(spark, d, "events").select(
        i.alias("id"), F.col("user_id").alias("wallet"), F.when(kind == 0, "redeem").when(kind == 1, "MERGE").when(kind == 2, "Split").when(kind == 3, "reward").otherwise("TRADE").alias("raw_type"),
        F.when(i % 31 == 0, None).when(F.col("event_type").isin("purchase", "signup", "view"), "BUY").otherwise("SELL").alias("side"), (i % 12 + 2).alias("asset"),
        F.when(i % 13 == 0, None).when(i % 17 == 0, 40).otherwise(F.floor((i % 12 + 2) / 2).cast("long")).alias("condition"), shares.alias("shares"), price.alias("price"), F.when(kind < 4, F.lit(0.25) * (i % 4)).otherwise(shares * price).alias("cash"),
        F.when(i % 19 > 0, time).alias("ts"), F.when(i % 9 > 0, F.concat(F.when(i % 2 == 0, "0xAB").otherwise("0xab"), F.floor(i / 2).cast("long").cast("string"))).alias("tx"),
        F.when(i % 8 > 0, F.floor(time / 259200).cast("long")).alias("block"), F.when(i % 6 > 0, i % 10).alias("tx_index"), F.when(i % 7 > 0, i % 10 * 5 + i % 3).alias("log_index"),
    )


def ticks(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(F.col("user_id").alias("token"), seconds(F.col("ts")).alias("t"), F.col("event_id").alias("k"), cents((F.col("event_id") * 29) % 97 + 2).alias("p"))


def books(spark: SparkSession, d: str) -> DataFrame:
    key, size = F.col("p_partkey"), F.col("p_size")
    low, low2 = key * 13 % 90 + 3, key * 17 % 90 + 3
    return table(spark, d, "part").select(
        key.alias("market"), cents(low).alias("bid"), cents(low + 1 + size % 5).alias("ask"), size.cast("double").alias("bid_size"), (key % 7).cast("double").alias("ask_size"),
        cents(low2).alias("bid2"), cents(low2 + 1 + size % 3).alias("ask2"), cents(key * 29 % 97 + 2).alias("p_true"), (key % 4).alias("kind"), F.col("p_brand").alias("brand"),
    )


def positions(spark: SparkSession, d: str) -> DataFrame:
    c, w = F.col("condition"), F.col("wallet")
    held = trades(spark, d).groupBy("wallet", "condition").agg(F.sum(F.when(F.col("side") == "BUY", F.col("cash")).otherwise(0)).alias("bought"))
    held = held.join(table(spark, d, "part").select(F.col("p_partkey").alias("condition"), F.col("p_type").alias("category")), "condition")
    return held.select(
        "wallet", "condition", "category", "bought", F.when(c % 4 == 0, 0).otherwise((w * 7919 + c * 104729) % 20001 - 10000).alias("realized"), ((w * 31 + c * 17) % 4001 - 2000).alias("total"),
        F.when(c % 3 == 0, "CLOSED").when(c % 3 == 1, "OPEN").otherwise("REDEEMABLE").alias("status"), (c % 3 == 2).alias("redeemable"), F.when(c % 5 == 0, 0.0).when(c % 5 == 1, 1.0).otherwise(cents(c % 97)).alias("price"),
    )


def feed(spark: SparkSession, d: str) -> DataFrame:
    return feed_of(table(spark, d, "events")).drop("at")


def feed_of(events: DataFrame) -> DataFrame:
    """Feed trades of rows of the events table, batch or stream; at keeps the time stamp."""
    i = F.col("event_id")
    return events.select(
        i.alias("id"), F.when(F.col("event_type").isin("click", "view"), "kalshi").otherwise("polymarket").alias("venue"), F.col("user_id").alias("wallet"), seconds(F.col("ts")).alias("ts"),
        (F.round(F.col("value") * 100).cast("long") * 10).alias("stake_cents"), F.when(i % 7 != 0, (i * 31 % 200 - 60) / F.lit(10.0)).alias("ev"), F.date_format("ts", "yyyy-MM-dd").alias("day"), F.col("ts").alias("at"),
    )

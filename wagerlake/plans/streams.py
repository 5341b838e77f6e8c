"""The streaming side as queries: each runs its stream over the events table to the end and returns the sink's table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wagerlake.registry import query
from wagerlake.sources.carriers import table
from wagerlake.sources.shared import shared_folder
from wagerlake.streaming.feed_stream import daily_counts, fresh_trades, run_to_end, trending_windows


@query("S13_stream_dedupe", "SELECT id, venue, stake_cents FROM v_feed")
def stream_dedupe(spark: SparkSession, d: str) -> DataFrame:
    return run_to_end(spark, d, fresh_trades, "append").select("id", "venue", "stake_cents")


@query("S14_stream_daily_counters", "SELECT day, venue, count(*) AS trades, sum(stake_cents)::BIGINT AS stake FROM v_feed GROUP BY ALL")
def stream_daily_counters(spark: SparkSession, d: str) -> DataFrame:
    return run_to_end(spark, d, daily_counts, "complete")


@query("W09_stream_trending", "SELECT strftime(to_timestamp(w * 600)::TIMESTAMP, '%Y-%m-%d %H:%M:%S') AS start, venue, count(*) AS trades FROM (SELECT ts // 600 AS w, venue FROM v_feed) GROUP BY ALL")
def stream_trending(spark: SparkSession, d: str) -> DataFrame:
    return run_to_end(spark, d, trending_windows, "complete")


@query("S13_stream_repeats", "SELECT id, venue, stake_cents FROM v_feed")
def stream_repeats(spark: SparkSession, d: str) -> DataFrame:
    """The stream fed with repeats: a third of the trades twice in one arrival, a fifth of them again in a later one, where the state knows the latest and the watermark drops the rest as late."""
    top = f"{shared_folder(spark)}/repeats-{uuid.uuid4().hex}"
    e = table(spark, d, "events")
    i = F.col("event_id")
    arrived = e.withColumn("arrival", F.lit(0)).unionByName(e.where(i % 3 == 0).withColumn("arrival", F.lit(0))).unionByName(e.where(i % 5 == 0).withColumn("arrival", F.lit(1)))
    for k in (0, 1):
        arrived.where(F.col("arrival") == k).drop("arrival").coalesce(1).write.mode("append").parquet(f"{top}/events.parquet")
    return run_to_end(spark, top, fresh_trades, "append", files=1).select("id", "venue", "stake_cents")

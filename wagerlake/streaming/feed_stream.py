"""Live trades with Structured Streaming: deduplication within a watermark, daily counters, trending windows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wagerlake.sources.carriers import feed_of
from wagerlake.sources.shared import shared_folder

#: Lateness that is waited for, and the flush interval of a live sink.
LATE, FLUSH = "30 minutes", "20 seconds"


def trades_stream(spark: SparkSession, sf_dir: str, files: int = 1000) -> DataFrame:
    """Rows of the events table as they arrive, a file or a folder of files, files a batch; the schema is that of the table."""
    path = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(path).schema
    return feed_of(spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(f"{path}*")).withColumn("at", F.col("at").cast("timestamp"))


def fresh_trades(stream: DataFrame) -> DataFrame:
    """Each trade once. State lasts as long as the watermark, not for a fixed number of trades: later repeats pass."""
    return stream.withWatermark("at", LATE).dropDuplicatesWithinWatermark(["id"])


def daily_counts(stream: DataFrame) -> DataFrame:
    return stream.groupBy("day", "venue").agg(F.count("*").alias("trades"), F.sum("stake_cents").alias("stake"))


def trending_windows(stream: DataFrame, size: str = "10 minutes") -> DataFrame:
    counts = stream.withWatermark("at", LATE).groupBy(F.window("at", size), "venue").agg(F.count("*").alias("trades"))
    return counts.select(F.date_format("window.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "venue", "trades")


def run_to_end(spark: SparkSession, sf_dir: str, step: Callable[[DataFrame], DataFrame], mode: str, files: int = 1000) -> DataFrame:
    """The sink after all that is there now: every micro-batch replaces (complete) or adds to (append) a table in the shared folder."""
    top = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    out = step(trades_stream(spark, sf_dir, files))

    def write(batch: DataFrame, number: int) -> None:
        # a batch that runs again after a failure overwrites its own folder
        target = f"{top}/table" if mode == "complete" else f"{top}/table/batch={number}"
        batch.write.mode("overwrite").parquet(target)

    sink = out.writeStream.outputMode(mode).option("checkpointLocation", f"{top}/checkpoint").trigger(availableNow=True)
    sink.foreachBatch(write).start().awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{top}/table")

"""Cutting lineage in the folder that the cluster shares."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or wagerlake.shared.dir where a session has none; a folder of one machine serves on one machine only."""
    top = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("wagerlake.shared.dir", "")
    if not top and spark.sparkContext.master.startswith("local"):
        top = f"{spark.conf.get('spark.sql.warehouse.dir')}/wagerlake-shared"
    if not top:
        raise ValueError("set spark.checkpoint.dir (or wagerlake.shared.dir) to a folder that all executors share")
    return top.rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder, read again: lineage ends here."""
    path = f"{shared_folder(df.sparkSession)}/round-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

"""A table of buckets with versions: batches are merged into copies of the buckets they touch, and a manifest written last makes them visible.

A version is a small JSON file that names, for each bucket of the keys' hash, one folder of Parquet files. Nothing that a manifest names is ever changed,
so readers of any version go on undisturbed, and a batch that dies half way leaves only folders that no manifest names. A batch is named by its writer and a
number that grows; one that has been merged before is left out, so that it may run again.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

c = F.col


class Conflict(RuntimeError):
    """Another writer has made the version that this one was about to make."""


class VersionedTable:
    """path in the shared folder; rows are unique by keys, and lie in the bucket of the hash of by (a part of the keys, all by default)."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str], by: list[str] | None = None, buckets: int = 64):
        self.spark, self.path, self.keys, self.by, self.buckets = spark, path.rstrip("/"), keys, by or keys, buckets
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.by), F.lit(self.buckets)).cast("int")

    def versions(self) -> list[int]:
        at = self._path(f"{self.path}/versions")
        found = self._fs.listStatus(at) if self._fs.exists(at) else []
        return sorted(int(f.getPath().getName()[:-5]) for f in found if f.getPath().getName().endswith(".json"))

    def manifest(self, version: int | None = None) -> dict:
        known = self.versions()
        if version is None and not known:
            return {"version": 0, "folders": {}, "writers": {}, "schema": None}
        if version is not None and version not in known:
            raise ValueError(f"{self.path}: no version {version}")
        at = f"{self.path}/versions/{known[-1] if version is None else version:010d}.json"
        return json.loads(self.spark.read.text(at, wholetext=True).first()[0])

    def read(self, version: int | None = None, buckets: list[int] | None = None) -> DataFrame | None:
        """The rows of a version, the last one by default; None while there is none."""
        m = self.manifest(version)
        if m["schema"] is None:
            return None
        schema = self._schema(m)
        at = [f"{self.path}/{f}" for b, f in m["folders"].items() if buckets is None or int(b) in buckets]
        return self.spark.read.schema(schema).parquet(*at) if at else self.spark.createDataFrame([], schema)

    @staticmethod
    def _with_bucket(schema):
        from pyspark.sql.types import IntegerType, StructField, StructType

        return StructType([*schema.fields, StructField("bucket", IntegerType())])

    @staticmethod
    def _schema(m: dict):
        from pyspark.sql.types import StructType

        return StructType.fromJson(m["schema"])

    def done(self, writer: str, batch: int) -> bool:
        return self.manifest()["writers"].get(writer, -1) >= batch

    def merge(self, updates: DataFrame, writer: str, batch: int, combine: Callable[[str], Column] | None = None, replaced: DataFrame | None = None) -> int:
        """Puts updates (unique by keys) into the table as its next version, and returns the version that has them.

        combine(column) gives the value of a column from its old one (o.column) and the new one (n.column) of a row that both sides have; by default the new
        one wins. Old rows whose by columns are in replaced go, whatever their other keys. Only buckets with updates or replaced rows are written anew.
        """
        m = self.manifest()
        if m["writers"].get(writer, -1) >= batch:
            return m["version"]
        schema = self._schema(m) if m["schema"] else updates.schema
        incoming = f"{self.path}/incoming/{uuid.uuid4().hex}"  # written once, so that what made the updates doesn't run for their buckets and again for their rows
        updates.select(*schema.names).withColumn("bucket", self.bucket()).write.parquet(incoming)
        new = self.spark.read.schema(self._with_bucket(schema)).parquet(incoming)
        touched = new.select("bucket") if replaced is None else new.select("bucket").unionByName(replaced.select(*self.by).withColumn("bucket", self.bucket()).select("bucket"))
        some = sorted(r.bucket for r in touched.distinct().collect())  # at most self.buckets rows
        folders = dict(m["folders"])
        old = self.read(m["version"], some) if m["schema"] else None
        if old is not None:
            if replaced is not None:
                old = old.join(replaced.select(*self.by).distinct(), self.by, "left_anti")
            both, right = c("o._there") & c("n._there"), c("n._there")
            met = old.withColumn("_there", F.lit(True)).alias("o").join(new.drop("bucket").withColumn("_there", F.lit(True)).alias("n"), [c(f"o.{k}").eqNullSafe(c(f"n.{k}")) for k in self.keys], "full")
            pick = lambda k: F.when(both, c(f"n.{k}") if combine is None or k in self.keys else combine(k)).when(right, c(f"n.{k}")).otherwise(c(f"o.{k}"))
            new = met.select(*(pick(k).alias(k) for k in schema.names)).withColumn("bucket", self.bucket())
        folder = f"data/{uuid.uuid4().hex}"
        new.repartition("bucket").write.partitionBy("bucket").parquet(f"{self.path}/{folder}")
        written = {f.getPath().getName() for f in self._fs.listStatus(self._path(f"{self.path}/{folder}"))}
        for b in some:
            folders.pop(str(b), None)
            if f"bucket={b}" in written:
                folders[str(b)] = f"{folder}/bucket={b}"
        version = self._commit({"version": m["version"] + 1, "folders": folders, "writers": m["writers"] | {writer: batch}, "schema": schema.jsonValue()})
        self._fs.delete(self._path(incoming), True)
        return version

    def _commit(self, m: dict) -> int:
        """Writes the manifest under another name and moves it to its own, which fails where that name is taken."""
        target, draft = (f"{self.path}/versions/{x}" for x in (f"{m['version']:010d}.json", f"draft-{uuid.uuid4().hex}"))
        self._fs.mkdirs(self._path(f"{self.path}/versions"))
        out = self._fs.create(self._path(draft))
        out.write(bytearray(json.dumps(m).encode()))
        out.close()
        if self._fs.exists(self._path(target)) or not self._fs.rename(self._path(draft), self._path(target)):
            self._fs.delete(self._path(draft), False)
            raise Conflict(f"{self.path}: version {m['version']} is there already")
        return m["version"]

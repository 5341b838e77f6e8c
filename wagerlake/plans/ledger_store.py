"""Ledgers that are kept: replay by state as events arrive, versions with their deltas, batches merged once."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wagerlake.plans.ledger_chain import _LISTS, _REPLAY, EVENT, POSITION, _lists, _six, episodes, merged, ordered
from wagerlake.registry import query
from wagerlake.sources.shared import checkpointed, shared_folder
from wagerlake.sources.versioned import VersionedTable
from wagerlake.streaming.ledger_stream import replay_table

c = F.col
_SUMS = ("shares", "most", "buy", "sell", "redeem")
_EPISODES = f"SELECT wallet, asset, episode, mixed, n, first, last, {', '.join(f'floor({x} * 1000000 + 0.5) / 1000000 AS {x}' for x in _SUMS)} FROM y"


def _plain(df: DataFrame) -> DataFrame:
    return df.select("wallet", "asset", c("episode").cast("int").alias("episode"), "mixed", "n", "first", "last", *(_six(c(x)).alias(x) for x in _SUMS))


@query("C09_incremental_audit", f"WITH RECURSIVE {_REPLAY} {_EPISODES}")
def incremental_audit(spark: SparkSession, d: str, parts: int = 3, files: int = 4) -> DataFrame:
    """Episodes of all positions after a stream has had the events in parts, dealt by a hash, so that most parts bring events from before the ones had; a third of the first part comes again."""
    e = merged(*_lists(spark, d))
    top = f"{shared_folder(spark)}/arrivals-{uuid.uuid4().hex}"
    part = F.pmod(F.xxhash64("key"), F.lit(parts))
    dealt = e.withColumn("part", part).unionByName(e.where((part == 0) & (F.pmod(F.xxhash64("key", "wallet"), F.lit(3)) == 0)).withColumn("part", F.lit(parts).cast("long")))
    dealt.repartition(files, "wallet").write.partitionBy("part").parquet(f"{top}/all")
    for k in range(parts + 1):
        spark.read.schema(e.schema).parquet(f"{top}/all/part={k}").repartition(files).write.mode("append").parquet(f"{top}/arrived")
    stream = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", files).parquet(f"{top}/arrived")
    store = LedgerVersions(spark, f"{top}/ledger", audited=False)
    store.keep(stream, f"{top}/checkpoint", availableNow=True).awaitTermination()
    return _plain(store.episodes.read())


def input_digest(e: DataFrame, *keys: str) -> DataFrame:
    """For each group of keys: events, and two digests of 64 bits of what a replay takes in, without and with its order; sums, so parts add up and no group is gathered."""
    line = F.xxhash64("key", "kind", "ts", F.col("shares").cast("string"), F.col("cash").cast("string"), "block", "tx_index", "log_index")
    at = F.row_number().over(Window.partitionBy(*POSITION).orderBy("place"))
    sum_ = lambda x: F.sum(x.cast("decimal(38,0)"))
    fold = lambda x: F.pmod(sum_(x), F.lit(2**62).cast("decimal(38,0)")).cast("long")
    return e.withColumn("line", line).withColumn("at", at).groupBy(*keys).agg(F.count("*").alias("events"), fold(c("line")).alias("input"), fold(F.xxhash64("line", "asset", "at")).alias("sequence"))


class InputMismatch(ValueError):
    """The events of a version are not those that it was made from."""


class LedgerVersions:
    """Events and episodes of all positions in versions: a snapshot, then deltas that rebuild only the positions they touch. Both tables lie in buckets of (wallet, asset).

    Without audited no digests are kept, and versions can't be replayed frozen.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int = 16, audited: bool = True):
        self.audited, top = audited, path or f"{shared_folder(spark)}/ledger-{uuid.uuid4().hex}"
        self.events = VersionedTable(spark, f"{top}/events", ["wallet", "asset", "key"], [*POSITION], buckets)
        self.episodes = VersionedTable(spark, f"{top}/episodes", ["wallet", "asset", "episode"], [*POSITION], buckets)
        self.digests = VersionedTable(spark, f"{top}/digests", ["wallet"], ["wallet"], buckets)

    def append(self, novel: DataFrame, batch: int, writer: str = "ledger") -> int:
        """Events (ledger_chain.EVENT) into a next version of all tables; known keys stay as they are, of a new one that repeats one row counts. A batch that broke off is finished, one that is done left out."""
        last = self.digests if self.audited else self.episodes
        if last.done(writer, batch):
            return last.manifest()["version"]
        novel = checkpointed(novel.select(*EVENT).where("asset <> ''").dropDuplicates([*POSITION, "key"]))
        self.events.merge(novel, writer, batch, combine=lambda k: c(f"o.{k}"))
        touched = novel.select(*POSITION).distinct()
        now = ordered(self.events.read().join(touched, [*POSITION], "left_semi"), *POSITION)
        flat = episodes(now).select(*POSITION, "episode", "mixed", "n", "first", "last", "s.*")
        version = self.episodes.merge(flat, writer, batch, replaced=touched)
        if not self.audited:
            return version
        wallets = touched.select("wallet").distinct()
        digest = input_digest(ordered(self.events.read().join(wallets, "wallet", "left_semi"), *POSITION), "wallet")
        return self.digests.merge(digest, writer, batch)

    def keep(self, events: DataFrame, checkpoint: str, writer: str = "stream", **trigger):
        """The started query that appends a stream of events (ledger_chain.EVENT) batch by batch; batches that run again change nothing.

        A batch costs Spark a few joins and windows over the positions it touches, and no call a position: streaming.ledger_stream, which steps a position on by its own
        state, answers small batches faster, and takes some milliseconds of a core for each position of a large one.
        """
        write = lambda batch, number: self.append(batch, number, writer)
        return events.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write).trigger(**(trigger or {"processingTime": "20 seconds"})).start()

    def changed(self, version: int | None = None) -> DataFrame:
        """Wallets whose events don't give the digests of that version."""
        said, now = self.digests.read(version), input_digest(ordered(self.events.read(version), *POSITION), "wallet")
        met = said.alias("a").join(now.alias("b"), c("a.wallet") == c("b.wallet"), "full")
        same = (c("a.events") == c("b.events")) & (c("a.input") == c("b.input")) & (c("a.sequence") == c("b.sequence"))
        return met.where(~F.coalesce(same, F.lit(False))).select(F.coalesce("a.wallet", "b.wallet").alias("wallet"))

    def replay(self, version: int | None = None, frozen: bool = True) -> DataFrame:
        """Episodes replayed from the events of a version; with frozen, events that don't give its digests raise."""
        if frozen and (other := self.changed(version).limit(3).collect()):
            raise InputMismatch(f"events of wallets {[r.wallet for r in other]} are not those of version {version}")
        return episodes(ordered(self.events.read(version), *POSITION)).select(*POSITION, "episode", "mixed", "n", "first", "last", "s.*")


@query("C10_snapshot_replay", f"""WITH {_LISTS}, s AS (SELECT wallet, count(*) AS events, count(*) FILTER (NOT late) AS events_1 FROM (SELECT *, ts > 1705000000 AS late FROM e WHERE asset <> '') GROUP BY wallet)
SELECT wallet, events_1, events AS events_2, true AS same_1, true AS same_2 FROM s""")
def snapshot_replay(spark: SparkSession, d: str, until: int = 1_705_000_000) -> DataFrame:
    """Events of each wallet in a snapshot and in the version after a delta, and whether the stored episodes of either version are those of a replay of all its events."""
    e = checkpointed(merged(*_lists(spark, d)))
    store = LedgerVersions(spark)
    store.append(e.where(c("ts") <= until), 0)
    store.append(e.where(c("ts") > until), 1)
    out = e.where("asset <> ''").groupBy("wallet").agg(F.count_if(c("ts") <= until).alias("events_1"), F.count("*").alias("events_2"))
    for v in (1, 2):
        whole, kept = store.replay(v), store.episodes.read(v)
        line = F.xxhash64("asset", "episode", "mixed", "n", "first", "last", "shares", "outlay", "most", "buy", "sell", "redeem").cast("decimal(38,0)")
        sums = lambda df, name: df.groupBy("wallet").agg(F.struct(F.count("*"), F.sum(line)).alias(name))  # noqa: B023, E731
        met = sums(whole, "x").join(sums(kept, "y"), "wallet", "full").select("wallet", F.coalesce(c("x") == c("y"), F.lit(False)).alias(f"same_{v}"))
        out = out.join(met, "wallet", "left").withColumn(f"same_{v}", F.coalesce(f"same_{v}", c(f"events_{v}") == 0))
    return out


def write_plan(stored: DataFrame, computed: DataFrame, touched: DataFrame | None = None) -> DataFrame:
    """What bringing stored episodes up to computed ones takes: insert, update, delete or unchanged for each (wallet, asset, episode).

    Full mode (touched null) plans all positions; the incremental one only those in touched (wallet, asset), and leaves stored rows of others alone. Rows are
    equal if everything but the key is, sums to six decimals.
    """
    keys = [*POSITION, "episode"]
    line = F.xxhash64("mixed", "n", "first", "last", *(_six(c(x)) for x in _SUMS))
    of = lambda df, name: df.select(*keys, line.alias(name))
    old, new = of(stored, "old"), of(computed, "new")
    if touched is not None:
        only = touched.select(*POSITION).distinct()
        old, new = (x.join(only, [*POSITION], "left_semi") for x in (old, new))
    action = F.when(c("old").isNull(), "insert").when(c("new").isNull(), "delete").when(c("old") == c("new"), "unchanged").otherwise("update")
    return old.join(new, keys, "full").select(*keys, action.alias("action"))


def parity(stored: DataFrame, computed: DataFrame) -> DataFrame:
    """For each wallet: episodes of either side, equal ones, and those that are only stored, only computed or differ."""
    plan = write_plan(stored, computed)
    of = lambda x: F.count_if(c("action") == x)
    return plan.groupBy("wallet").agg(F.count("*").alias("episodes"), of("unchanged").alias("equal"), of("delete").alias("only_stored"), of("insert").alias("only_computed"), of("update").alias("different"))


_UNTIL = 1_705_500_000


def _stored_and_computed(spark: SparkSession, d: str, until: int = _UNTIL) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Episodes stored from the events up to a time (none of wallets that end in 0, one too many of those that end in 1), episodes of all events, positions with events behind that time."""
    e = merged(*_lists(spark, d))
    flat = lambda x: episodes(ordered(x, *POSITION)).select(*POSITION, c("episode").cast("long").alias("episode"), "mixed", "n", "first", "last", "s.*")
    store = replay_table(spark)
    old = flat(e.where(c("ts") <= until)).where("wallet % 10 <> 0")
    gone = old.where("wallet % 10 = 1 and episode = 0").withColumn("episode", F.lit(99).cast("long"))
    store.merge(old.unionByName(gone), "ledger", 0)
    return store.read(), flat(e), e.where(c("ts") > until).select(*POSITION)


_KEPT_EVENTS = "e AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY wallet, key ORDER BY rank, at_) = 1)"
_BEFORE = _REPLAY.replace(_KEPT_EVENTS, f"{_KEPT_EVENTS[:-1].replace('(SELECT * FROM k', '(SELECT * FROM (SELECT * FROM k')}) WHERE ts <= {_UNTIL})", 1)
_ROW = "struct_pack(m := mixed, n := n, f := first, l := last, " + ", ".join(f"{x} := floor({x} * 1000000 + 0.5)" for x in _SUMS) + ") AS r"
_PLAN = f"""WITH y0 AS (SELECT wallet, asset, episode, {_ROW} FROM (WITH RECURSIVE {_BEFORE} SELECT * FROM y)), n AS (SELECT wallet, asset, episode, {_ROW} FROM (WITH RECURSIVE {_REPLAY} SELECT * FROM y)),
t AS (SELECT DISTINCT wallet, asset FROM (WITH {_LISTS} SELECT * FROM e) WHERE ts > {_UNTIL}), o2 AS (SELECT * FROM y0 WHERE wallet % 10 <> 0), o3 AS (SELECT * FROM o2 UNION ALL SELECT wallet, asset, 99, r FROM o2 WHERE wallet % 10 = 1 AND episode = 0),
p AS (SELECT coalesce(o3.wallet, n.wallet) AS wallet, coalesce(o3.asset, n.asset) AS asset, coalesce(o3.episode, n.episode)::BIGINT AS episode, CASE WHEN o3.r IS NULL THEN 'insert' WHEN n.r IS NULL THEN 'delete' WHEN o3.r = n.r THEN 'unchanged' ELSE 'update' END AS action FROM o3 FULL JOIN n ON o3.wallet = n.wallet AND o3.asset = n.asset AND o3.episode = n.episode)"""


@query("L16_stored_write_plan", f"{_PLAN} SELECT p.*, t.wallet IS NOT NULL AS incremental FROM p LEFT JOIN t ON t.wallet = p.wallet AND t.asset = p.asset")
def stored_write_plan(spark: SparkSession, d: str) -> DataFrame:
    """The full plan against a stored table, and which of its rows the incremental one has too."""
    stored, computed, touched = _stored_and_computed(spark, d)
    some = write_plan(stored, computed, touched).select(*POSITION, "episode", F.lit(True).alias("incremental"))
    return write_plan(stored, computed).join(some, [*POSITION, "episode"], "left").withColumn("incremental", F.coalesce("incremental", F.lit(False)))


@query("L18_stored_parity", f"{_PLAN} SELECT wallet, count(*) AS episodes, count(*) FILTER (action = 'unchanged') AS equal, count(*) FILTER (action = 'delete') AS only_stored, count(*) FILTER (action = 'insert') AS only_computed, count(*) FILTER (action = 'update') AS different FROM p GROUP BY wallet")
def stored_parity(spark: SparkSession, d: str) -> DataFrame:
    """A stored table against the replay of all events."""
    stored, computed, _ = _stored_and_computed(spark, d)
    return parity(stored, computed)

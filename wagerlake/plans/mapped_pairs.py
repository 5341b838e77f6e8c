"""Mapped pairs of two venues: their fair price, kept batch by batch, and trades that are stored after a moment."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wagerlake.functions import prices as P
from wagerlake.plans.evidence import placeholder
from wagerlake.plans.trade_ev import fair_price, priced, with_mids
from wagerlake.registry import query
from wagerlake.sources.carriers import cents, feed, table
from wagerlake.sources.shared import shared_folder
from wagerlake.sources.versioned import VersionedTable
from wagerlake.streaming.timed_sink import keep_storing

c = F.col
#: Names of sources that a stored fair price keeps, and what stands in names of the other kinds.
KEPT, OF_ENSEMBLES, OF_VENUES = ("ensemble", "llm", "cross_market", "manual"), ("ensemble", "rag", "derivative_anchor"), ("ob", "consensus", "cross", "venue")


def source_type(source: Column) -> Column:
    """The kind under which a fair price of a source is stored."""
    has = lambda names: F.exists(F.array(*map(F.lit, names)), lambda x: F.contains(source, x))
    return F.when(source.isin(*KEPT), source).when(has(OF_ENSEMBLES), "ensemble").when(has(OF_VENUES), "cross_market").when(F.contains(source, F.lit("llm")), "llm").otherwise("ensemble")


def mapped_prices(mappings: DataFrame) -> DataFrame:
    """token, ticker, p_true, source, source_type, confidence, net of mappings (id, token, ticker, updated, pm_book, kalshi_book, ensemble, consensus).

    One mapping a token, whatever its case: the one updated last, of equal ones that with the smallest id. A book that is missing takes the place of no book; the
    price is the ladder's for a pair, its EV against the first venue's middle, or else the pair's.
    """
    m = mappings.withColumns({"token": F.lower(F.trim("token")), "ticker": F.upper(F.trim("ticker"))}).where("token <> ''")
    m = m.groupBy("token").agg(F.max_by(F.struct(*[x for x in m.columns if x != "token"]), F.struct("updated", -c("id"))).alias("m")).select("token", "m.*")
    m = with_mids(m.withColumn("platform", F.lit("polymarket")))
    none = lambda t: F.lit(None).cast(t)
    known = F.when(~placeholder(c("ensemble"), none("string"), none("double")), c("ensemble"))
    m = m.withColumn("known", known)
    m = m.withColumn("fair", fair_price(F.lit(True), F.lit(True), c("cross"), c("own"), c("prior"), c("consensus"), c("known"), none("double")))
    m = m.withColumn("market", F.coalesce("own", "prior")).withColumn("ev", priced(c("fair"), c("market"), F.lit(True)))
    return m.select("token", "ticker", P.half_up(c("fair.p_true"), 6).alias("p_true"), c("fair.source").alias("source"), source_type(c("fair.source")).alias("source_type"), c("fair.confidence").alias("confidence"), c("ev.net").alias("net"))


def persist_prices(store: VersionedTable, mappings: DataFrame, batch: int, writer: str = "p_true") -> int:
    """Prices of a batch of mappings into store (key token), with the number of batches that have priced a token; a batch counts once however often it runs."""
    if store.done(writer, batch):
        return store.manifest()["version"]
    rows = mapped_prices(mappings).withColumn("priced", F.lit(1).cast("long"))
    return store.merge(rows, writer, batch, combine=lambda k: c("o.priced") + c("n.priced") if k == "priced" else c(f"n.{k}"))


def _mappings(spark: SparkSession, d: str, batch: int) -> DataFrame:
    k, size = c("p_partkey"), c("p_size")
    low, low2 = cents((k * 13 + batch * 7) % 90 + 3), cents((k * 17 + batch * 5) % 90 + 3)
    book = lambda there, x, wide: F.when(there, F.struct(x.alias("bid"), (x + cents(wide)).alias("ask"), x.alias("mid")))
    p = table(spark, d, "part").where(k % 3 != batch)
    return p.select(
        k.alias("id"), F.concat(F.when(k % 2 == 0, " T").otherwise("t"), F.floor(k / 2).cast("string")).alias("token"), F.concat(F.lit("kx"), k.cast("string")).alias("ticker"), (k * 7 % 4).alias("updated"),
        book(k % 4 > 0, low, 1 + size % 4).alias("pm_book"), book(k % 5 > 1, low2, size % 3).alias("kalshi_book"), F.when(k % 6 == 0, 0.5).when(k % 6 < 3, cents(k * 29 % 100)).alias("ensemble"), F.when(k % 7 < 2, cents(k * 31 % 100)).alias("consensus"),
    )


def _priced_sql(batch: int) -> str:
    rest = "CASE WHEN {b} > 0 AND {a} > {b} THEN ({b} + {a}) / 2 ELSE {b} END"
    weight = "coalesce(nullif({m} * (1 / greatest({a} - {b}, 0.001::DOUBLE)), 0), {m})"
    return f"""SELECT token, upper(ticker) AS ticker, f.p AS p, f.s AS s, f.c AS c, coalesce(ra, rb, 0.5) AS mk FROM (SELECT *, CASE WHEN cm IS NOT NULL THEN struct_pack(p := coalesce(en, cm), s := CASE WHEN en IS NULL THEN 'cross_venue_ob' ELSE 'cached_ensemble' END, c := CASE WHEN en IS NULL THEN 0.85 ELSE 0.8 END::DOUBLE)
 WHEN en IS NOT NULL THEN struct_pack(p := en, s := 'cached_ensemble', c := 0.75::DOUBLE) WHEN cons IS NOT NULL THEN struct_pack(p := cons, s := 'sportsbook_consensus', c := 0.7::DOUBLE) ELSE struct_pack(p := 0.5::DOUBLE, s := 'universal_prior', c := 0.1::DOUBLE) END AS f FROM (
 SELECT *, CASE WHEN ra IS NULL THEN rb WHEN rb IS NULL THEN ra ELSE (ra * {weight.format(m="ra", a="pa", b="pb")} + rb * {weight.format(m="rb", a="ka", b="kb")}) / ({weight.format(m="ra", a="pa", b="pb")} + {weight.format(m="rb", a="ka", b="kb")}) END AS cm FROM (
 SELECT *, {rest.format(a="pa", b="pb")} AS ra, {rest.format(a="ka", b="kb")} AS rb FROM (SELECT *, CASE WHEN p4 THEN lo + (1 + size % 4) / 100.0::DOUBLE END AS pa, CASE WHEN p4 THEN lo END AS pb, CASE WHEN p5 THEN lo2 + (size % 3) / 100.0::DOUBLE END AS ka, CASE WHEN p5 THEN lo2 END AS kb FROM (
 SELECT p_partkey AS id, 't' || p_partkey // 2 AS token, 'kx' || p_partkey AS ticker, p_size AS size, ((p_partkey * 13 + {batch * 7}) % 90 + 3) / 100.0::DOUBLE AS lo, ((p_partkey * 17 + {batch * 5}) % 90 + 3) / 100.0::DOUBLE AS lo2, p_partkey % 4 > 0 AS p4, p_partkey % 5 > 1 AS p5,
 CASE WHEN p_partkey % 6 IN (1, 2) AND p_partkey * 29 % 100 <> 50 THEN (p_partkey * 29 % 100) / 100.0::DOUBLE END AS en, CASE WHEN p_partkey % 7 < 2 THEN (p_partkey * 31 % 100) / 100.0::DOUBLE END AS cons FROM part WHERE p_partkey % 3 <> {batch} QUALIFY row_number() OVER (PARTITION BY p_partkey // 2 ORDER BY p_partkey * 7 % 4 DESC, p_partkey) = 1)))))"""


_CL = "least(greatest({}, 1e-9::DOUBLE), 1 - 1e-9::DOUBLE)"


@query("C03_C04_persisted_prices", f"""WITH a AS ({_priced_sql(0)}), b AS ({_priced_sql(1)}), u AS (SELECT *, 0 AS o FROM a UNION ALL SELECT *, 1 FROM b), l AS (SELECT token, count(*) AS priced, arg_max(struct_pack(ticker := ticker, p := p, s := s, c := c, mk := mk), o) AS r FROM u GROUP BY token)
SELECT token, r.ticker AS ticker, floor({_CL.format("r.p")} * 1000000 + 0.5) / 1000000 AS p_true, r.s AS source, CASE WHEN r.s = 'cached_ensemble' OR r.s = 'universal_prior' THEN 'ensemble' ELSE 'cross_market' END AS source_type, r.c AS confidence, priced,
 floor((({_CL.format("r.p")} * (1 - {_CL.format("r.mk")}) - (1 - {_CL.format("r.p")}) * {_CL.format("r.mk")}) - 0.001::DOUBLE * {_CL.format("r.mk")}) * 1000 + 0.5) / 10 AS net FROM l""")
def persisted_prices(spark: SparkSession, d: str) -> DataFrame:
    """Stored prices of all tokens after two batches of mappings, the second of which runs twice."""
    store = VersionedTable(spark, f"{shared_folder(spark)}/prices-{uuid.uuid4().hex}", ["token"], buckets=8)
    for batch in (0, 1, 1):
        persist_prices(store, _mappings(spark, d, batch), batch)
    return store.read()


@query("S14_timed_trades", """WITH w AS (SELECT id // 3 AS k, id % 3 AS i, id, (stake_cents / 100.0::DOUBLE) AS usd, CASE WHEN id % 2 = 0 THEN 'cat' || id % 4 END AS category, ev FROM v_feed WHERE id % 41 > 0), f AS (SELECT k, arg_max(struct_pack(id := id, usd := usd, category := category, ev := ev), i) AS r FROM w WHERE i < 2 GROUP BY k),
s AS (SELECT k, any_value(struct_pack(id := id, usd := usd, category := category, ev := ev)) AS r FROM w WHERE i = 2 GROUP BY k)
SELECT 't' || coalesce(f.k, s.k) AS trade_id, coalesce(f.r.id, s.r.id) AS ts, coalesce(s.r.usd, f.r.usd) AS usd_notional, coalesce(s.r.category, f.r.category) AS category, coalesce(s.r.ev, f.r.ev) AS net_ev, CASE WHEN s.r.ev IS NOT NULL OR f.k IS NULL THEN 'p' || s.r.id ELSE 'p' || f.r.id END AS payload FROM f FULL JOIN s ON f.k = s.k""")
def timed_trades(spark: SparkSession, d: str) -> DataFrame:
    """Stored trades after three writes of each: two that meet while pending, so the later one stands, and one that is merged into the stored row; some have no ticker."""
    i, top = c("id"), f"{shared_folder(spark)}/writes-{uuid.uuid4().hex}"
    w = feed(spark, d).select(
        F.concat(F.lit("t"), F.floor(i / 3).cast("long").cast("string")).alias("trade_id"), i.alias("pos"), F.when(i % 41 > 0, F.concat(F.lit("K"), i % 5)).otherwise(" ").alias("ticker"), F.lit(1.0).alias("size"), i.alias("ts"), F.lit(0.5).alias("entry_price"),
        cents(c("stake_cents")).alias("usd_notional"), F.when(i % 2 == 0, F.concat(F.lit("cat"), (i % 4).cast("string"))).alias("category"), c("ev").alias("net_ev"), F.concat(F.lit("p"), i.cast("string")).alias("payload"),
    )
    files = 4
    for part in ("pos % 3 < 2", "pos % 3 = 2"):
        w.where(part).repartition(files).write.mode("append").parquet(f"{top}/arrived")
    store = VersionedTable(spark, f"{top}/stored", ["trade_id"], buckets=8)
    stream = spark.readStream.schema(w.schema).option("maxFilesPerTrigger", files).parquet(f"{top}/arrived")
    keep_storing(stream, store, f"{top}/checkpoint", interval=0, availableNow=True).awaitTermination()
    return store.read().select("trade_id", "ts", "usd_notional", "category", "net_ev", "payload")

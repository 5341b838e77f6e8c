"""Store maintenance and audits: upserts as latest-by-key, patches, identity and duplicate checks, decoding."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wagerlake.registry import query
from wagerlake.sources.carriers import feed, table, trades

c = F.col


@query("S11_S12_keyset_scan", "SELECT ts, k FROM v_trades WHERE ts > 946684800 OR (ts = 946684800 AND k > '5') ORDER BY ts, k LIMIT 500")
def keyset_page(spark: SparkSession, d: str, ts: int = 946684800, k: str = "5", page: int = 500) -> DataFrame:
    """One page behind a cursor, for callers that page; a full scan needs none."""
    return trades(spark, d).where((c("ts") > ts) | ((c("ts") == ts) & (c("k") > k))).select("ts", "k").orderBy("ts", "k").limit(page)


@query("S15_U05_latest_by_key", "SELECT wallet, asset, arg_max(k, struct_pack(t := ts, k := k)) AS k FROM v_trades GROUP BY wallet, asset")
def latest_by_key(spark: SparkSession, d: str) -> DataFrame:
    return trades(spark, d).groupBy("wallet", "asset").agg(F.max_by("k", F.struct("ts", "k")).alias("k"))


@query("S18_J02_patch_nulls", "SELECT k, coalesce(CASE WHEN cents % 3 <> 0 THEN ts END, patch) AS ts FROM v_trades LEFT JOIN (SELECT condition, min(ts) AS patch FROM v_trades WHERE cents % 3 <> 0 GROUP BY condition) USING (condition)")
def patch_nulls(spark: SparkSession, d: str) -> DataFrame:
    """Unknown times (cents % 3 = 0) are taken from a patch table; known ones stay."""
    t = trades(spark, d).withColumn("ts", F.when(c("cents") % 3 != 0, c("ts")))
    return t.join(t.groupBy("condition").agg(F.min("ts").alias("patch")), "condition", "left").select("k", F.coalesce("ts", "patch").alias("ts"))


@query("S19_derive_identity", "SELECT k, CASE WHEN regexp_matches(split_part(k, '|', 2), '^[0-9]+$') AND cents % 2 = 0 THEN split_part(k, '|', 1) || '|' || split_part(k, '|', 2) END AS identity FROM v_trades")
def derive_identity(spark: SparkSession, d: str) -> DataFrame:
    part = F.split("k", r"\|")
    return trades(spark, d).select("k", F.when(part[1].rlike("^[0-9]+$") & (c("cents") % 2 == 0), F.concat_ws("|", part[0], part[1])).alias("identity"))


@query("S20_coalesce_upsert", "SELECT coalesce(a.id, b.id) AS id, coalesce(b.ev, a.ev) AS ev, coalesce(b.stake_cents, a.stake_cents) AS stake_cents FROM (SELECT * FROM v_feed WHERE id % 3 <> 0) a FULL JOIN (SELECT id, CASE WHEN id % 4 = 0 THEN NULL ELSE ev + 1 END AS ev, stake_cents + 1 AS stake_cents FROM v_feed WHERE id % 2 = 0) b ON a.id = b.id")
def coalesce_upsert(spark: SparkSession, d: str) -> DataFrame:
    f = feed(spark, d)
    new = f.where("id % 2 = 0").select("id", F.when(c("id") % 4 != 0, c("ev") + 1).alias("new_ev"), (c("stake_cents") + 1).alias("new_stake"))
    return f.where("id % 3 <> 0").join(new, "id", "full").select("id", F.coalesce("new_ev", "ev").alias("ev"), F.coalesce("new_stake", "stake_cents").alias("stake_cents"))


@query("S06_fan_in", "SELECT 'parts' AS platform, count(*) AS markets FROM part UNION ALL SELECT 'customers', count(*) FROM customer")
def fan_in(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "part").select(F.lit("parts").alias("platform"), c("p_partkey").alias("id"), c("p_name").alias("title"))
    b = table(spark, d, "customer").select(F.lit("customers").alias("platform"), c("c_custkey").alias("id"))
    return a.unionByName(b, allowMissingColumns=True).groupBy("platform").agg(F.count("*").alias("markets"))


@query("S21_S22_log_dedupe", "SELECT DISTINCT split_part(k, '|', 1) || ':' || split_part(k, '|', 2) AS key FROM v_trades")
def log_dedupe(spark: SparkSession, d: str) -> DataFrame:
    part = F.split("k", r"\|")
    return trades(spark, d).select(F.concat_ws(":", part[0], part[1]).alias("key")).dropDuplicates(["key"])


@query("A44_duplicate_keys", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def duplicate_keys(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n")).where("n > 1")


@query("A45_A46_coverage", "SELECT count(*) AS rows, count(ev) AS with_ev, count(DISTINCT wallet) AS wallets, count(*) FILTER (venue = 'kalshi') AS kalshi FROM v_feed")
def coverage(spark: SparkSession, d: str) -> DataFrame:
    return feed(spark, d).agg(F.count("*").alias("rows"), F.count("ev").alias("with_ev"), F.count_distinct("wallet").alias("wallets"), F.count_if(c("venue") == "kalshi").alias("kalshi"))


@query("A47_identity_collision", "SELECT asset, count(DISTINCT wallet) AS wallets FROM v_trades GROUP BY asset HAVING count(DISTINCT wallet) > 1")
def identity_collision(spark: SparkSession, d: str) -> DataFrame:
    return trades(spark, d).groupBy("asset").agg(F.count_distinct("wallet").alias("wallets")).where("wallets > 1")


@query("U01_report_diff", "SELECT wallet, a.n AS before, b.n AS after FROM (SELECT wallet, count(*) AS n FROM v_trades WHERE cents % 9 <> 0 GROUP BY wallet) a FULL JOIN (SELECT wallet, count(*) AS n FROM v_trades GROUP BY wallet) b USING (wallet) WHERE a.n IS DISTINCT FROM b.n")
def report_diff(spark: SparkSession, d: str) -> DataFrame:
    t = trades(spark, d)
    count = lambda df, name: df.groupBy("wallet").agg(F.count("*").alias(name))
    return count(t.where("cents % 9 <> 0"), "before").join(count(t, "after"), "wallet", "full").where(~c("before").eqNullSafe(c("after")))


@query("U02_duplicate_delta", "SELECT count(*) AS duplicates FROM (SELECT k FROM v_trades WHERE cents % 2 = 0 INTERSECT SELECT k FROM v_trades WHERE cents % 3 = 0)")
def duplicate_delta(spark: SparkSession, d: str) -> DataFrame:
    t = trades(spark, d)
    return t.where("cents % 2 = 0").select("k").intersect(t.where("cents % 3 = 0").select("k")).agg(F.count("*").alias("duplicates"))


@query("U03_field_merge", "SELECT k, coalesce(max(CASE WHEN s = 0 THEN cents END), max(CASE WHEN s = 1 THEN cents END)) AS cents FROM (SELECT k, cents, 0 AS s FROM v_trades WHERE cents % 2 = 0 UNION ALL SELECT k, cents + 100, 1 FROM v_trades) GROUP BY k")
def field_merge(spark: SparkSession, d: str) -> DataFrame:
    """Persisted rows first, a delta's fields where they have none."""
    t = trades(spark, d)
    both = t.where("cents % 2 = 0").select("k", c("cents").alias("old"), F.lit(None).cast("long").alias("new")).unionByName(t.select("k", F.lit(None).cast("long").alias("old"), (c("cents") + 100).alias("new")))
    return both.groupBy("k").agg(F.coalesce(F.max("old"), F.max("new")).alias("cents"))


@query("P25_P35_placeholder", "SELECT id, ev IS NULL OR id % 5 = 0 OR id % 100 / 100.0::DOUBLE < 0.35::DOUBLE OR (abs(ev) <= 0.000001 AND id % 100 / 100.0::DOUBLE < 0.5::DOUBLE) AS placeholder FROM v_feed")
def placeholder(spark: SparkSession, d: str) -> DataFrame:
    score = c("id") % 100 / F.lit(100.0)
    return feed(spark, d).select("id", (c("ev").isNull() | (c("id") % 5 == 0) | (score < 0.35) | ((F.abs("ev") <= 1e-6) & (score < 0.5))).alias("placeholder"))


@query("P27_watchlist", "SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal >= 1000 AND c_mktsegment <> 'MACHINERY' ORDER BY c_acctbal DESC, c_custkey")
def watchlist(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").where("c_acctbal >= 1000 and c_mktsegment <> 'MACHINERY'").select("c_custkey", "c_acctbal").orderBy(F.desc("c_acctbal"), "c_custkey")


@query("F12_adjacent_dates", "SELECT DISTINCT id, strftime(day::DATE + o::INT, '%Y-%m-%d') AS near FROM v_feed, (SELECT unnest([-1, 0, 1]) AS o)")
def adjacent_dates(spark: SparkSession, d: str) -> DataFrame:
    day = F.to_date("day")
    return feed(spark, d).select("id", F.explode(F.sequence(F.date_sub(day, 1), F.date_add(day, 1))).alias("x")).select("id", F.date_format("x", "yyyy-MM-dd").alias("near"))


@query("F15_F16_json_prices", "SELECT id, [(wallet % 100) / 100.0::DOUBLE, 1 - (wallet % 100) / 100.0::DOUBLE] AS prices FROM v_feed")
def json_prices(spark: SparkSession, d: str) -> DataFrame:
    """Prices that come as a JSON array of strings inside a string."""
    p = (c("wallet") % 100) / F.lit(100.0)
    raw = F.to_json(F.array(p.cast("string"), (1 - p).cast("string")))
    return feed(spark, d).select("id", F.transform(F.from_json(raw, "array<string>"), lambda x: x.cast("double")).alias("prices"))


_FNV = "list_reduce(list_prepend(2166136261::HUGEINT, list_transform(string_split(lower('0xW' || wallet), ''), lambda x: ascii(x)::HUGEINT)), lambda s, x: xor(s, x) * 16777619 % 4294967296)"


@query("F19_F18_wallet_hash", f"SELECT wallet, hash, hash % 40 AS first, hash // 40 % 40 AS second FROM (SELECT wallet, ({_FNV})::BIGINT AS hash FROM (SELECT DISTINCT wallet FROM v_feed))")
def wallet_hash(spark: SparkSession, d: str) -> DataFrame:
    """FNV-1a of 32 bits over the lower-cased wallet, folded in Catalyst, and the two list places that it picks for a pseudonym."""
    text = F.lower(F.concat(F.lit("0xW"), "wallet"))
    chars = F.transform(F.split(text, ""), F.ascii)
    h = F.aggregate(chars, F.lit(2166136261).cast("long"), lambda s, x: F.when(x == 0, s).otherwise(s.bitwiseXOR(x.cast("long")) * 16777619 % (1 << 32)))
    return feed(spark, d).select("wallet").distinct().select("wallet", h.alias("hash")).select("wallet", "hash", (c("hash") % 40).alias("first"), (F.floor(c("hash") / 40) % 40).alias("second"))


@query("F17_log_words", None)
def log_words(spark: SparkSession, d: str) -> DataFrame:
    """256-bit words of hex log data as decimal strings, which no numeric type of Spark holds."""

    @F.pandas_udf("array<string>")
    def words(raw: pd.Series) -> pd.Series:
        return raw.map(lambda x: [str(int(x[i : i + 64], 16)) for i in range(0, len(x), 64)])

    return feed(spark, d).select("id", words(F.concat(F.sha2(c("id").cast("string"), 256), F.lpad(F.hex("stake_cents"), 64, "0"))).alias("words"))


@query("K09_K10_A31_depth", "SELECT p_partkey AS market, list_sort([1 - 0.01::DOUBLE * p_size, 1 - 0.005::DOUBLE * p_size]) AS asks, 0.01::DOUBLE * p_size AS best_bid, (p_size + 10)::BIGINT AS depth FROM part WHERE p_size > 0")
def depth(spark: SparkSession, d: str) -> DataFrame:
    bids = F.array(F.struct((0.01 * c("p_size")).alias("price"), c("p_size").cast("long").alias("size")), F.struct((0.005 * c("p_size")).alias("price"), F.lit(10).cast("long").alias("size")))
    p = table(spark, d, "part").where("p_size > 0").select(c("p_partkey").alias("market"), bids.alias("bids"))
    return p.select("market", F.array_sort(F.transform("bids", lambda b: 1 - b["price"])).alias("asks"), F.array_max(F.transform("bids", lambda b: b["price"])).alias("best_bid"), F.aggregate("bids", F.lit(0).cast("long"), lambda s, b: s + b["size"]).alias("depth"))


@query("A49_cohort_fill", """SELECT wallet, tier, pos FROM (SELECT wallet, tier, row_number() OVER (ORDER BY tier, wallet) AS pos FROM (SELECT wallet, CASE WHEN wallet % 50 = 0 THEN 0 WHEN count(*) >= 20 THEN 1 ELSE 2 END AS tier FROM v_trades GROUP BY wallet)) WHERE pos <= 220""")
def cohort_fill(spark: SparkSession, d: str, size: int = 220) -> DataFrame:
    """Anchors first, then strata by priority until the cohort is full; the rank is over the cohort alone."""
    tier = F.when(c("wallet") % 50 == 0, 0).when(c("n") >= 20, 1).otherwise(2)
    cohort = trades(spark, d).groupBy("wallet").agg(F.count("*").alias("n")).select("wallet", tier.alias("tier")).orderBy("tier", "wallet").limit(size)
    return cohort.withColumn("pos", F.row_number().over(Window.orderBy("tier", "wallet")).cast("long"))

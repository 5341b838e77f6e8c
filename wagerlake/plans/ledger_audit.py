"""From rows of several sources to ledger events, whose identity each can prove, and what an audit says about them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wagerlake.registry import query
from wagerlake.sources.carriers import chain_events, positions, table, trades

c = F.col
#: Prices of a settled winner and loser, completed positions that count as experience, resolved bets and mean EV of a credible wallet.
WINNER, LOSER, EXPERIENCE, BETS, MEAN_EV = 0.95, 0.05, 10, 10, 0.03


def six(x: Column) -> Column:
    """A number with six decimals, empty if there is none."""
    return F.coalesce(x.cast("decimal(38,6)").cast("string"), F.lit(""))


def event_key(tx: Column, condition: Column, asset: Column, ts: Column, kind: Column, side: Column, shares: Column, price: Column, cash: Column) -> Column:
    """The nine fields that tell one fill from another, whichever source it comes from."""
    hash_ = F.when(F.coalesce(tx, F.lit("")) == "", "notx").otherwise(F.lower(tx))
    text = lambda x: F.coalesce(x.cast("string"), F.lit(""))
    return F.concat_ws("|", hash_, text(condition), text(asset), F.coalesce(ts, F.lit(0)).cast("string"), kind, text(side), six(shares), six(price), six(cash))


_SIX = "coalesce(CAST({} AS DECIMAL(38,6))::VARCHAR, '')"
_KEY = f"CASE WHEN coalesce(tx, '') = '' THEN 'notx' ELSE lower(tx) END || '|' || condition || '|' || asset || '|' || coalesce(ts, 0) || '|' || kind || '|' || coalesce(side, '') || '|' || {_SIX.format('shares')} || '|' || {_SIX.format('price')} || '|' || {_SIX.format('cash')}"
_ACTIVITY = """SELECT CASE WHEN kind = 'TRADE' THEN side ELSE kind END AS kind, tx, condition, asset, ts, CASE WHEN kind = 'TRADE' THEN side END AS side, shares, cash, CASE WHEN kind = 'TRADE' THEN price END AS price FROM (SELECT *, upper(raw_type) AS kind FROM v_chain)
 WHERE (kind = 'TRADE' AND side IN ('BUY', 'SELL')) OR kind IN ('REDEEM', 'MERGE', 'SPLIT')"""


@query("P01_P03_activity_events", f"SELECT kind, shares, cash, price, {_KEY} AS key FROM ({_ACTIVITY})")
def activity_events(spark: SparkSession, d: str) -> DataFrame:
    """Activity rows as ledger events: a TRADE by its side, REDEEM, MERGE and SPLIT as they are, other types dropped."""
    kind, trade = F.upper("raw_type"), F.upper("raw_type") == "TRADE"
    e = chain_events(spark, d).where((trade & c("side").isin("BUY", "SELL")) | kind.isin("REDEEM", "MERGE", "SPLIT"))
    e = e.select(F.when(trade, c("side")).otherwise(kind).alias("kind"), "tx", "condition", "asset", "ts", F.when(trade, c("side")).alias("side"), "shares", "cash", F.when(trade, c("price")).alias("price"))
    return e.select("kind", "shares", "cash", "price", event_key(c("tx"), c("condition"), c("asset"), c("ts"), c("kind"), c("side"), c("shares"), c("price"), c("cash")).alias("key"))


@query("P02_trade_events", f"SELECT kind, shares, cash, {_KEY} AS key FROM (SELECT side AS kind, tx, condition, asset, ts, side, shares, shares * price AS cash, price FROM v_chain WHERE side IN ('BUY', 'SELL'))")
def trade_events(spark: SparkSession, d: str) -> DataFrame:
    """Trade rows as ledger events; the cash is shares times price."""
    e = chain_events(spark, d).where(c("side").isin("BUY", "SELL")).withColumn("cash", c("shares") * c("price"))
    return e.select(c("side").alias("kind"), "shares", "cash", event_key(c("tx"), c("condition"), c("asset"), c("ts"), c("side"), c("side"), c("shares"), c("price"), c("cash")).alias("key"))


_KEYED = f"SELECT *, {_KEY} AS key FROM (SELECT 0 AS rank, raw_id, kind, tx, condition, asset, ts, side, shares, price, cash FROM (SELECT raw_id, side AS kind, tx, condition, asset, ts, side, shares, price, cash FROM v_chain WHERE side IN ('BUY', 'SELL') AND raw_id % 3 <> 0) UNION ALL SELECT 1, raw_id + 1000000000, side, tx, condition, asset, ts, side, shares, price, cash FROM v_chain WHERE side IN ('BUY', 'SELL'))"


@query("J03_merge_by_key", f"SELECT key, arg_min(raw_id, struct_pack(r := rank, i := raw_id)) AS raw_id, CASE WHEN min(rank) = 0 THEN 'activity' ELSE 'trades' END AS source, count(*) AS rows FROM ({_KEYED}) GROUP BY key")
def merge_by_key(spark: SparkSession, d: str) -> DataFrame:
    """Two sources of one ledger under the nine-field key: activity wins with its own fields, trades fill the gaps."""
    e = chain_events(spark, d).where(c("side").isin("BUY", "SELL"))
    key = event_key(c("tx"), c("condition"), c("asset"), c("ts"), c("side"), c("side"), c("shares"), c("price"), c("cash")).alias("key")
    both = e.where("raw_id % 3 <> 0").select(key, F.lit(0).alias("rank"), "raw_id").unionByName(e.select(key, F.lit(1).alias("rank"), (c("raw_id") + 1_000_000_000).alias("raw_id")))
    per = both.groupBy("key").agg(F.min(F.struct("rank", "raw_id")).alias("best"), F.count("*").alias("rows"))
    return per.select("key", "best.raw_id", F.when(c("best.rank") == 0, "activity").otherwise("trades").alias("source"), "rows")


def identity_class(known_tx: Column) -> Column:
    """canonical, recoverable or unresolved chain log, or synthetic; known_tx: whether any log of the transaction is there."""
    bare = (F.trim(F.coalesce("tx", F.lit(""))) == "") | (F.coalesce("block", F.lit(0)) <= 0)
    return F.when((c("source") != "polygon") | bare, "synthetic_non_log").when(c("log_index").isNotNull(), "canonical_chain_log").when(known_tx, "recoverable_chain_log").otherwise("unresolved_chain_log")


_CLASS = """SELECT e.*, CASE WHEN source <> 'polygon' OR trim(coalesce(tx, '')) = '' OR coalesce(block, 0) <= 0 THEN 'synthetic_non_log' WHEN log_index IS NOT NULL THEN 'canonical_chain_log'
 WHEN known.t IS NOT NULL THEN 'recoverable_chain_log' ELSE 'unresolved_chain_log' END AS class FROM v_chain e LEFT JOIN (SELECT DISTINCT lower(trim(tx)) AS t FROM v_chain WHERE log_index IS NOT NULL AND block > 0) known ON known.t = lower(trim(e.tx))"""


def classified(e: DataFrame) -> DataFrame:
    logs = e.where("log_index is not null and block > 0").select(F.lower(F.trim("tx")).alias("t")).where("t is not null").distinct().withColumn("known", F.lit(True))
    met = e.withColumn("t", F.lower(F.trim("tx"))).join(logs, "t", "left")
    return met.withColumn("class", identity_class(F.coalesce("known", F.lit(False)))).drop("t", "known")


@query("P06_identity_class", f"SELECT raw_id, class FROM ({_CLASS})")
def identity_classes(spark: SparkSession, d: str) -> DataFrame:
    return classified(chain_events(spark, d)).select("raw_id", "class")


@query("L27_log_index_gaps", f"""SELECT wallet, count(*) AS chain_events, count(*) FILTER (class <> 'synthetic_non_log') AS expecting, count(*) FILTER (class = 'canonical_chain_log') AS with_index, count(*) FILTER (class = 'recoverable_chain_log') AS normalization_dropped,
 count(*) FILTER (class = 'unresolved_chain_log') AS unmatched_identity, count(*) FILTER (class = 'synthetic_non_log') AS non_log_synthetic FROM ({_CLASS}) WHERE source = 'polygon' GROUP BY wallet""")
def log_index_gaps(spark: SparkSession, d: str) -> DataFrame:
    """Why chain events of a wallet lack a log index."""
    of = lambda name: F.count_if(c("class") == name)
    return classified(chain_events(spark, d)).where("source = 'polygon'").groupBy("wallet").agg(
        F.count("*").alias("chain_events"), F.count_if(c("class") != "synthetic_non_log").alias("expecting"), of("canonical_chain_log").alias("with_index"), of("recoverable_chain_log").alias("normalization_dropped"),
        of("unresolved_chain_log").alias("unmatched_identity"), of("synthetic_non_log").alias("non_log_synthetic"),
    )


@query("L21_unresolved_order", f"""SELECT wallet, count(*) FILTER (class = 'unresolved_chain_log') AS unresolved, count(*) FILTER (class = 'unresolved_chain_log' AND (n > 1 OR upper(raw_type) <> 'REDEEM')) AS affected, bool_or(class = 'unresolved_chain_log') AS blocks
 FROM (SELECT *, count(*) FILTER (class = 'unresolved_chain_log') OVER (PARTITION BY wallet, asset, block) AS n FROM ({_CLASS}) WHERE source = 'polygon') GROUP BY wallet""")
def unresolved_order(spark: SparkSession, d: str) -> DataFrame:
    """Events whose order inside their block is open, and how many of them touch a position: others of the same block and position, or any but a lone REDEEM."""
    e = classified(chain_events(spark, d)).where("source = 'polygon'")
    per = e.groupBy("wallet", "asset", "block").agg(F.count_if(c("class") == "unresolved_chain_log").alias("open"), F.count_if((c("class") == "unresolved_chain_log") & (F.upper("raw_type") != "REDEEM")).alias("moving"))
    affected = F.when(c("open") > 1, c("open")).otherwise(c("moving"))
    return per.groupBy("wallet").agg(F.sum("open").alias("unresolved"), F.sum(affected).alias("affected"), (F.sum("open") > 0).alias("blocks"))


@query("L22_funnel", f"""SELECT stage, n FROM (SELECT 1 AS o, 'raw' AS stage, count(*) AS n FROM v_chain UNION ALL SELECT 2, 'parsed', count(*) FILTER (upper(raw_type) IN ('TRADE', 'REDEEM', 'MERGE', 'SPLIT')) FROM v_chain UNION ALL SELECT 3, 'normalised', count(*) FROM ({_ACTIVITY})
 UNION ALL SELECT 4, 'deduped', count(DISTINCT key) FROM (SELECT {_KEY} AS key FROM ({_ACTIVITY})) UNION ALL SELECT 5, 'lifecycle', count(DISTINCT key) FROM (SELECT {_KEY} AS key FROM ({_ACTIVITY}) WHERE shares > 0 AND coalesce(ts, 0) > 0))""")
def funnel(spark: SparkSession, d: str) -> DataFrame:
    """How many events are left after each step from raw rows to lifecycles, in one pass over the keys."""
    kind, trade = F.upper("raw_type"), F.upper("raw_type") == "TRADE"
    parsed = kind.isin("TRADE", "REDEEM", "MERGE", "SPLIT")
    normal = (trade & c("side").isin("BUY", "SELL")) | kind.isin("REDEEM", "MERGE", "SPLIT")
    of, side = F.when(trade, c("side")).otherwise(kind), F.when(trade, c("side"))
    key = F.when(normal, event_key(c("tx"), c("condition"), c("asset"), c("ts"), of, side, c("shares"), F.when(trade, c("price")), c("cash")))
    whole = (c("shares") > 0) & (F.coalesce("ts", F.lit(0)) > 0)
    per = chain_events(spark, d).select(parsed.alias("parsed"), key.alias("key"), whole.alias("whole")).groupBy("key").agg(F.count("*").alias("n"), F.count_if("parsed").alias("parsed"), F.max("whole").alias("whole"))
    real = c("key").isNotNull()
    sums = per.agg(F.sum("n").alias("raw"), F.sum("parsed").alias("parsed"), F.sum(F.when(real, c("n"))).alias("normalised"), F.count("key").alias("deduped"), F.count_if(real & c("whole")).alias("lifecycle"))
    return sums.select(F.inline(F.array(*(F.struct(F.lit(x).alias("stage"), F.coalesce(x, F.lit(0)).alias("n")) for x in ("raw", "parsed", "normalised", "deduped", "lifecycle")))))


@query("P07_fill_legs", """SELECT raw_id, CASE WHEN wallet = maker AND maker_asset = 0 THEN 'BUY' WHEN wallet = maker THEN 'SELL' WHEN taker_asset = 0 THEN 'BUY' ELSE 'SELL' END AS side, CASE WHEN maker_asset <> 0 THEN maker_asset ELSE taker_asset END AS asset,
 CASE WHEN (wallet = maker) = (maker_asset = 0 OR taker_asset = 0) AND wallet = maker AND maker_asset = 0 THEN taker_amt WHEN wallet = maker THEN maker_amt WHEN taker_asset = 0 THEN maker_amt ELSE taker_amt END AS shares,
 CASE WHEN wallet = maker AND maker_asset = 0 THEN maker_amt WHEN wallet = maker THEN taker_amt WHEN taker_asset = 0 THEN taker_amt ELSE maker_amt END AS cash FROM (
 SELECT raw_id, wallet, CASE WHEN raw_id % 3 = 2 THEN -1 WHEN raw_id % 3 = 0 THEN wallet ELSE wallet + 1 END AS maker, CASE WHEN raw_id % 3 = 1 THEN wallet ELSE wallet + 2 END AS taker, CASE WHEN raw_id % 5 = 0 THEN 0 WHEN raw_id % 2 = 0 THEN 0 ELSE asset END AS maker_asset,
 CASE WHEN raw_id % 5 = 0 THEN 0 WHEN raw_id % 2 = 0 THEN asset ELSE 0 END AS taker_asset, shares AS maker_amt, cash AS taker_amt FROM v_chain) WHERE (wallet = maker OR wallet = taker) AND (maker_asset <> 0 OR taker_asset <> 0)""")
def fill_legs(spark: SparkSession, d: str) -> DataFrame:
    """A fill seen from one wallet: who gives the collateral (asset 0) buys; fills of others, and without an outcome asset, are none of its own."""
    i, w, coin = c("raw_id"), c("wallet"), c("raw_id") % 5 == 0
    e = chain_events(spark, d).select(
        "raw_id", "wallet", F.when(i % 3 == 2, -1).when(i % 3 == 0, w).otherwise(w + 1).alias("maker"), F.when(i % 3 == 1, w).otherwise(w + 2).alias("taker"), c("shares").alias("maker_amt"), c("cash").alias("taker_amt"),
        F.when(coin | (i % 2 == 0), 0).otherwise(c("asset")).alias("maker_asset"), F.when(~coin & (i % 2 == 0), c("asset")).otherwise(0).alias("taker_asset"),
    )
    own = e.where(((w == c("maker")) | (w == c("taker"))) & ((c("maker_asset") != 0) | (c("taker_asset") != 0)))
    makes, outcome = w == c("maker"), F.when(c("maker_asset") != 0, c("maker_asset")).otherwise(c("taker_asset"))
    gives, gets = F.when(makes, c("maker_amt")).otherwise(c("taker_amt")), F.when(makes, c("taker_amt")).otherwise(c("maker_amt"))
    buys = F.when(makes, c("maker_asset")).otherwise(c("taker_asset")) == 0
    return own.select("raw_id", F.when(buys, "BUY").otherwise("SELL").alias("side"), outcome.alias("asset"), F.when(buys, gets).otherwise(gives).alias("shares"), F.when(buys, gives).otherwise(gets).alias("cash"))


@query("P08_block_times", "SELECT raw_id, coalesce(b.at, 0) AS at, CASE WHEN upper(raw_type) = 'TRADE' THEN side ELSE upper(raw_type) END AS kind FROM v_chain LEFT JOIN (SELECT block, min(ts) AS at FROM v_chain WHERE block > 0 AND block % 3 <> 0 GROUP BY block) b USING (block) WHERE source = 'polygon'")
def block_times(spark: SparkSession, d: str) -> DataFrame:
    """Chain events take their time from the table of blocks; of unknown blocks it is 0."""
    e = chain_events(spark, d)
    known = e.where("block > 0 and block % 3 <> 0").groupBy("block").agg(F.min("ts").alias("at"))
    kind = F.when(F.upper("raw_type") == "TRADE", c("side")).otherwise(F.upper("raw_type"))
    return e.where("source = 'polygon'").join(known, "block", "left").select("raw_id", F.coalesce("at", F.lit(0)).alias("at"), kind.alias("kind"))


_PRICES = ('["0.97","0.03"]', '["0.03","0.96"]', '["0.50","0.50"]', '["0.95","0.05"]', '["0.94","0.06"]', "not json", '["1"]', "[]", '["x","0.97","0.02"]')
_UMA = ("", "resolved", "proposed", "disputed", "Final")


@query("P09_resolution_class", f"""SELECT market, CASE WHEN NOT found THEN 'missing_metadata' WHEN uma <> '' AND NOT regexp_matches(lower(uma), 'resolved|confirmed|final') THEN 'unresolved_or_disputed' WHEN closed AND win IS NOT NULL AND len(p) >= 2 AND list_max(p) >= 0.95 AND list_min(p) <= 0.05 THEN 'resolved'
 WHEN closed AND win IS NULL THEN 'unresolved_or_disputed' ELSE 'open' END AS status, win FROM (SELECT *, CASE WHEN list_contains(list_transform(p, lambda x: x >= 0.95), true) THEN list_position(list_transform(p, lambda x: x >= 0.95), true) - 1 END AS win FROM (
 SELECT p_partkey AS market, p_partkey % 10 <> 0 AS found, p_partkey % 3 <> 0 AS closed, ({list(_UMA)!r})[p_partkey % 5 + 1] AS uma, list_filter(list_transform(coalesce(try_cast(CASE WHEN json_valid(raw) THEN raw END AS VARCHAR[]), []), lambda x: try_cast(trim(x, '"') AS DOUBLE)), lambda x: x IS NOT NULL) AS p FROM (SELECT p_partkey, ([{", ".join("'" + x + "'" for x in _PRICES)}])[p_partkey % {len(_PRICES)} + 1] AS raw FROM part)))""")
def resolution_class(spark: SparkSession, d: str) -> DataFrame:
    """A market's state from its metadata row: missing, disputed, resolved with a winner at 0.95 or more and a loser at 0.05 or less, or open."""
    pick = lambda xs, n: F.get(F.array(*map(F.lit, xs)), (c("p_partkey") % n).cast("int"))
    m = table(spark, d, "part").select(c("p_partkey").alias("market"), (c("p_partkey") % 10 != 0).alias("found"), (c("p_partkey") % 3 != 0).alias("closed"), pick(_UMA, 5).alias("uma"), pick(_PRICES, len(_PRICES)).alias("raw"))
    numbers = F.transform(F.coalesce(F.from_json("raw", "array<string>"), F.array().cast("array<string>")), lambda x: x.try_cast("double"))
    m = m.withColumn("p", F.filter(numbers, lambda x: x.isNotNull()))  # what is no number has no place, so that winners are counted among prices
    at = F.array_position(F.transform("p", lambda x: x >= WINNER), True)
    m = m.withColumn("win", F.when(at > 0, at - 1))
    settled = c("win").isNotNull() & (F.size("p") >= 2) & (F.array_max("p") >= WINNER) & (F.array_min("p") <= LOSER)
    disputed = (c("uma") != "") & ~F.lower("uma").rlike("resolved|confirmed|final")
    status = F.when(~c("found"), "missing_metadata").when(disputed, "unresolved_or_disputed").when(c("closed") & settled, "resolved").when(c("closed") & c("win").isNull(), "unresolved_or_disputed").otherwise("open")
    return m.select("market", status.alias("status"), "win")


@query("J17_legacy_delta", "SELECT wallet, raw_id FROM v_chain WHERE wallet % 7 = 0 OR (wallet % 7 > 1 AND coalesce(block, 0) > 500)")
def legacy_delta(spark: SparkSession, d: str) -> DataFrame:
    """Events behind the last indexed block: all if a bound is unknown, none if no new block is there; events without a block count as block 0."""
    last, through = F.when(c("wallet") % 7 != 0, 500), F.when(c("wallet") % 7 == 1, 500).otherwise(10**9)
    keep = last.isNull() | through.isNull() | ((through > last) & (F.coalesce("block", F.lit(0)) > last))
    return chain_events(spark, d).where(keep).select("wallet", "raw_id")


@query("L12_merge_split_impact", """SELECT wallet, count(*) FILTER (ms) AS touched, count(*) FILTER (ms AND done) / nullif(count(*) FILTER (done), 0) AS share, coalesce(sum(bought + abs(realized)) FILTER (ms), 0)::BIGINT AS gross, count(*) FILTER (ms AND safe) AS safe, count(*) FILTER (ms AND NOT safe) AS ambiguous,
 CASE WHEN coalesce(count(*) FILTER (ms AND NOT safe AND done) / nullif(count(*) FILTER (done), 0), 0) < 0.05 THEN 'exclude_policy_sufficient' ELSE 'phase_2c_accounting_required' END AS advice FROM (
 SELECT *, condition % 6 = 0 AS ms, status <> 'OPEN' AS done, condition % 12 = 0 AND bought > 0 AS safe FROM v_positions) GROUP BY wallet""")
def merge_split_impact(spark: SparkSession, d: str, most: float = 0.05) -> DataFrame:
    """How much of a wallet's record rests on positions with MERGE or SPLIT events; those fully left with a cost are safe in spite of them."""
    ms, done, safe = c("condition") % 6 == 0, c("status") != "OPEN", (c("condition") % 12 == 0) & (c("bought") > 0)
    share = lambda x: F.count_if(x & done) / F.nullif(F.count_if(done), F.lit(0))
    return positions(spark, d).groupBy("wallet").agg(
        F.count_if(ms).alias("touched"), share(ms).alias("share"), F.coalesce(F.sum(F.when(ms, c("bought") + F.abs("realized"))), F.lit(0)).alias("gross"), F.count_if(ms & safe).alias("safe"), F.count_if(ms & ~safe).alias("ambiguous"),
        F.when(F.coalesce(share(ms & ~safe), F.lit(0.0)) < most, "exclude_policy_sufficient").otherwise("phase_2c_accounting_required").alias("advice"),
    )


_BOUND = "SELECT *, CASE WHEN wallet % 9 > 0 THEN 700000000 + wallet % 300 * 1000000 END AS bound FROM v_chain"


@query("L24_P31_truncation", f"""SELECT wallet, oldest, CASE WHEN oldest < bound THEN earlier ELSE 0 END AS earlier, truncated, NOT truncated OR (oldest < bound AND earlier > 0) IS TRUE OR wallet % 11 = 0 AS immune, truncated AND NOT ((oldest < bound AND earlier > 0) IS TRUE OR wallet % 11 = 0) AS effective FROM (
 SELECT wallet, bound, wallet % 2 = 0 AS truncated, min(ts) FILTER (ts > 0) AS oldest, count(*) FILTER (ts > 0 AND ts < bound) AS earlier FROM ({_BOUND}) GROUP BY wallet, bound)""")
def truncation(spark: SparkSession, d: str) -> DataFrame:
    """Whether an API list that was cut off hides anything: not if indexed events, this run's or stored ones, reach behind its oldest row."""
    e = chain_events(spark, d).withColumn("bound", F.when(c("wallet") % 9 > 0, 700_000_000 + c("wallet") % 300 * 1_000_000))
    per = e.groupBy("wallet", "bound").agg(F.min(F.when(c("ts") > 0, c("ts"))).alias("oldest"), F.count_if((c("ts") > 0) & (c("ts") < c("bound"))).alias("n"))
    reaches = F.coalesce(c("oldest") < c("bound"), F.lit(False))
    cut, seen = c("wallet") % 2 == 0, (reaches & (c("n") > 0)) | (c("wallet") % 11 == 0)
    return per.select("wallet", "oldest", F.when(reaches, c("n")).otherwise(0).alias("earlier"), cut.alias("truncated"), (~cut | seen).alias("immune"), (cut & ~seen).alias("effective"))


def credibility(valid: Column, completed: Column, performance: Column, capital: Column, floor: int = EXPERIENCE) -> Column:
    """PASS, FAIL or UNKNOWN of a wallet: any failure first, then what is unknown."""
    return F.when(~valid | (completed < floor) | (performance == "FAIL"), "FAIL").when(performance == "UNKNOWN", "UNKNOWN").when(capital == "FAIL", "FAIL").when((performance == "PASS") & capital.isin("NOT_USED", "PASS"), "PASS").otherwise("UNKNOWN")


@query("P30_P34_credibility", """SELECT wallet, CASE WHEN wallet % 4 = 0 OR done < 10 OR perf = 'FAIL' THEN 'FAIL' WHEN perf = 'UNKNOWN' THEN 'UNKNOWN' WHEN cap = 'FAIL' THEN 'FAIL' WHEN perf = 'PASS' AND cap IN ('NOT_USED', 'PASS') THEN 'PASS' ELSE 'UNKNOWN' END AS decision, done >= 10 AND wallet % 50 / 1000.0::DOUBLE >= 0.03::DOUBLE AS credible FROM (
 SELECT wallet, count(*) FILTER (status <> 'OPEN') AS done, (['PASS', 'FAIL', 'UNKNOWN', 'PASS'])[wallet % 4 + 1] AS perf, (['NOT_USED', 'PASS', 'FAIL', 'UNKNOWN'])[wallet % 5 % 4 + 1] AS cap FROM v_positions GROUP BY wallet)""")
def wallet_credibility(spark: SparkSession, d: str) -> DataFrame:
    w = c("wallet")
    per = positions(spark, d).groupBy("wallet").agg(F.count_if(c("status") != "OPEN").alias("done"))
    pick = lambda xs, at: F.get(F.array(*map(F.lit, xs)), at.cast("int"))
    perf, cap = pick(("PASS", "FAIL", "UNKNOWN", "PASS"), w % 4), pick(("NOT_USED", "PASS", "FAIL", "UNKNOWN"), w % 5 % 4)
    return per.select("wallet", credibility(w % 4 != 0, c("done"), perf, cap).alias("decision"), ((c("done") >= BETS) & (w % 50 / F.lit(1000.0) >= MEAN_EV)).alias("credible"))


@query("L26_disambiguate", """WITH f AS (SELECT condition, shares, cash, count(*) AS n, min(k) AS one, count(*) FILTER (fill) AS nf, min(k) FILTER (fill) AS f1, count(*) FILTER (fill AND mine) AS nr, min(k) FILTER (fill AND mine) AS r1, count(*) FILTER (exch) AS ne, min(k) FILTER (exch) AS e1
 FROM (SELECT condition, shares, cash, k, asset % 2 = 0 AS fill, ts % 5 < 2 AS mine, ts % 7 < 3 AS exch FROM v_trades WHERE cents % 5 <> 0) GROUP BY ALL)
SELECT t.k, CASE WHEN n = 1 THEN one WHEN nf = 1 THEN f1 WHEN nf > 1 AND nr = 1 THEN r1 WHEN ne = 1 THEN e1 END AS log FROM v_trades t LEFT JOIN f USING (condition, shares, cash) WHERE t.cents % 2 = 0""")
def disambiguate(spark: SparkSession, d: str) -> DataFrame:
    """The chain log of an event without one: equal in condition, shares and cash, then only order fills, only its own, only those of the exchange; a step counts if one is left.

    The logs of an economic class are counted once, so that a class that many events share is not paired with them.
    """
    t = trades(spark, d)
    of = lambda name, where: [F.count_if(where).alias(f"n_{name}"), F.min(F.when(where, c("k"))).alias(f"k_{name}")]
    fill, mine, exch = c("asset") % 2 == 0, c("ts") % 5 < 2, c("ts") % 7 < 3
    logs = t.where("cents % 5 <> 0").groupBy("condition", "shares", "cash").agg(*of("all", F.lit(True)), *of("fill", fill), *of("own", fill & mine), *of("exch", exch))
    log = F.when(c("n_all") == 1, c("k_all")).when(c("n_fill") == 1, c("k_fill")).when((c("n_fill") > 1) & (c("n_own") == 1), c("k_own")).when(c("n_exch") == 1, c("k_exch"))
    return t.where("cents % 2 = 0").join(logs, ["condition", "shares", "cash"], "left").select("k", log.alias("log"))

"""Wallet ledgers: canonical order, replay of positions, episodes, lifecycles and their metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wagerlake.registry import query
from wagerlake.sources.carriers import chain_events, resolution, trades, unit_events

c = F.col
_STATE = "struct<shares:bigint,outlay:double,most:double,buy:bigint,sell:bigint,redeem:bigint>"


def events_of(df: DataFrame, *keys: str) -> DataFrame:
    """A position's events as one array in canonical order: time, then the unique key."""
    return df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("ts", "k", "side", c("shares").cast("long").alias("shares"), c("cash").cast("long").alias("cash")))).alias("events"))


def applied(s: Column, e: Column) -> Column:
    """State after an event: shares and outlay, the largest outlay so far, gross cash bought, sold and redeemed.

    REDEEM leaves no shares; SPLIT adds shares, for cash or none; MERGE gives shares back and releases their part of the outlay, so
    outlays are doubles. Events of any other kind change nothing.
    """
    is_ = lambda *kinds: F.coalesce(e["side"].isin(*kinds), F.lit(False))
    zero = F.lit(0).cast("long")
    shares, cash = F.coalesce(e["shares"], zero), F.coalesce(e["cash"], zero)
    split = is_("SPLIT") & (shares > 0)
    merge = is_("MERGE") & (shares > 0) & (s["shares"] > 0)
    paid, gone = F.greatest(cash, zero), F.least(shares, s["shares"])
    bought = F.when(is_("BUY"), cash).when(split, paid).otherwise(zero)
    sold = F.when(is_("SELL"), cash).when(merge, paid).otherwise(zero)
    redeemed = F.when(is_("REDEEM"), cash).otherwise(zero)
    kept = F.when(merge, F.greatest(F.lit(0.0), s["outlay"] - s["outlay"] * gone / s["shares"])).otherwise(s["outlay"])
    outlay = kept + bought - sold - redeemed
    held = F.when(is_("BUY") | split, s["shares"] + shares).when(is_("SELL"), s["shares"] - shares).when(is_("REDEEM"), zero).when(merge, s["shares"] - gone).otherwise(s["shares"])
    return F.struct(
        held.alias("shares"), outlay.alias("outlay"), F.greatest(s["most"], outlay).alias("most"), (s["buy"] + bought).alias("buy"), (s["sell"] + sold).alias("sell"), (s["redeem"] + redeemed).alias("redeem")
    ).cast(_STATE)


def empty() -> Column:
    return F.struct(*(F.lit(0).alias(x) for x in ("shares", "outlay", "most", "buy", "sell", "redeem"))).cast(_STATE)


def mixed() -> Column:
    """Whether a position's events have a MERGE or SPLIT."""
    return F.exists("events", lambda e: F.coalesce(e["side"].isin("MERGE", "SPLIT"), F.lit(False)))


def replay(df: DataFrame, *keys: str) -> DataFrame:
    return events_of(df, *keys).withColumn("s", F.aggregate("events", empty(), applied))


@query("L01_K01_canonical_order", "SELECT wallet, k, row_number() OVER (PARTITION BY wallet ORDER BY ts, k) AS pos FROM v_trades")
def canonical_order(spark: SparkSession, d: str) -> DataFrame:
    return trades(spark, d).select("wallet", "k", F.row_number().over(Window.partitionBy("wallet").orderBy("ts", "k")).cast("long").alias("pos"))


_RUN = "SELECT *, sum(CASE WHEN side = 'BUY' THEN cash ELSE -cash END) OVER (PARTITION BY wallet, asset ORDER BY ts, k ROWS UNBOUNDED PRECEDING) AS outlay FROM v_trades"
_POS = f"SELECT wallet, asset, min(condition) AS condition, count(*) AS n, sum(CASE WHEN side = 'BUY' THEN shares ELSE -shares END)::BIGINT AS shares, greatest(max(outlay), 0)::BIGINT AS most, sum(CASE WHEN side = 'BUY' THEN cash ELSE 0 END)::BIGINT AS buy, sum(CASE WHEN side = 'BUY' THEN 0 ELSE cash END)::BIGINT AS sell FROM ({_RUN}) GROUP BY wallet, asset"


@query("L02_L03_position_replay", f"SELECT wallet, asset, n, shares, most, buy, sell FROM ({_POS})")
def position_replay(spark: SparkSession, d: str) -> DataFrame:
    r = replay(trades(spark, d), "wallet", "asset")
    return r.select("wallet", "asset", F.size("events").cast("long").alias("n"), "s.shares", c("s.most").cast("long").alias("most"), "s.buy", "s.sell")


@query("W08_running_outlay", f"SELECT wallet, asset, k, outlay::BIGINT AS outlay FROM ({_RUN})")
def running_outlay(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("wallet", "asset").orderBy("ts", "k").rowsBetween(Window.unboundedPreceding, 0)
    return trades(spark, d).select("wallet", "asset", "k", F.sum(F.when(c("side") == "BUY", c("cash")).otherwise(-c("cash"))).over(w).alias("outlay"))


def episodes(df: DataFrame, *keys: str) -> DataFrame:
    """One row an episode: a BUY after the shares came back to nothing, with something bought, opens the next one;
    positions with a MERGE or SPLIT stay whole."""

    def step(acc: Column, e: Column) -> Column:
        s, done = acc["now"], acc["done"]
        over = ~c("mixed") & (acc["n"] > 0) & (s["shares"] == 0) & (s["buy"] > 0) & (e["side"] == "BUY")
        fresh = F.when(over, empty()).otherwise(s)
        kept = F.when(over, F.concat(done, F.array(F.struct(acc["n"].alias("n"), s.alias("s"))))).otherwise(done)
        return F.struct(kept.alias("done"), F.when(over, F.lit(1)).otherwise(acc["n"] + 1).alias("n"), applied(fresh, e).alias("now"))

    start = F.struct(F.array().cast(f"array<struct<n:int,s:{_STATE}>>").alias("done"), F.lit(0).alias("n"), empty().alias("now"))
    whole = lambda acc: F.concat(acc["done"], F.array(F.struct(acc["n"].alias("n"), acc["now"].alias("s"))))
    return events_of(df, *keys).withColumn("mixed", mixed()).select(*keys, F.posexplode(F.aggregate("events", start, step, whole)).alias("episode", "e"))


@query("L04_episodes", """WITH RECURSIVE e AS (SELECT wallet, asset, side, cash, row_number() OVER (PARTITION BY wallet, asset ORDER BY ts, k) AS i FROM v_unit_events),
r AS (SELECT wallet, asset, i, 0 AS episode, 1 AS n, CASE WHEN side = 'BUY' THEN 1 ELSE -1 END AS shares, CASE WHEN side = 'BUY' THEN cash ELSE 0 END AS buy, CASE WHEN side = 'BUY' THEN 0 ELSE cash END AS sell FROM e WHERE i = 1
 UNION ALL SELECT r.wallet, r.asset, e.i, r.episode + o, CASE o WHEN 1 THEN 1 ELSE r.n + 1 END, CASE o WHEN 1 THEN 0 ELSE r.shares END + CASE WHEN e.side = 'BUY' THEN 1 ELSE -1 END, CASE o WHEN 1 THEN 0 ELSE r.buy END + CASE WHEN e.side = 'BUY' THEN e.cash ELSE 0 END, CASE o WHEN 1 THEN 0 ELSE r.sell END + CASE WHEN e.side = 'BUY' THEN 0 ELSE e.cash END
 FROM r JOIN e ON e.wallet = r.wallet AND e.asset = r.asset AND e.i = r.i + 1, LATERAL (SELECT (r.shares = 0 AND r.buy > 0 AND e.side = 'BUY')::INT AS o))
SELECT wallet, asset, episode, max(n) AS n, arg_max(shares, i)::BIGINT AS shares, arg_max(buy, i)::BIGINT AS buy, arg_max(sell, i)::BIGINT AS sell FROM r GROUP BY ALL""")
def unit_episodes(spark: SparkSession, d: str) -> DataFrame:
    return episodes(unit_events(spark, d), "wallet", "asset").select("wallet", "asset", "episode", "e.n", "e.s.shares", "e.s.buy", "e.s.sell")


def lifecycles(t: DataFrame, r: DataFrame) -> DataFrame:
    """Every position of every wallet: completion, payout (100 cents a winning share), profit and exclusion. Positions with a MERGE or SPLIT
    are excluded, neither completed nor counted."""
    p = replay(t, "wallet", "asset").select("wallet", "asset", F.floor(c("asset") / 2).cast("long").alias("condition"), mixed().alias("mixed"), "s.*")
    p = p.join(r, "condition", "left")
    exited = (c("shares") == 0) & (c("buy") > 0)
    final = F.coalesce("final", F.lit(False)) & (c("buy") > 0)
    held = ~exited & final & (c("shares") > 0)
    p = p.withColumn("reason", F.when(c("mixed"), None).when(exited, "fully_exited").when(held, "held_through_resolution").when(final, "market_resolved"))
    p = p.withColumn("payout", F.when(c("reason") == "held_through_resolution", F.when(c("winning_asset") == c("asset"), c("shares") * 100).otherwise(0)).otherwise(0))
    counted = c("reason").isNotNull() & (c("most") > 0)
    return p.select("wallet", "asset", "condition", "shares", "most", "buy", "sell", "redeem", "reason", "payout", F.when(counted, c("sell") + c("redeem") + c("payout") - c("buy")).alias("pnl"), F.when(c("reason") == "held_through_resolution", c("winning_asset") == c("asset")).alias("correct"), (c("mixed") | (c("reason").isNotNull() & (c("most") <= 0))).alias("excluded"))


_LIFE = f"""SELECT wallet, asset, p.condition, shares, most, buy, sell, reason, payout, CASE WHEN reason IS NOT NULL AND most > 0 THEN sell + payout - buy END AS pnl, CASE WHEN reason = 'held_through_resolution' THEN winning_asset = asset END AS correct, reason IS NOT NULL AND most <= 0 AS excluded
 FROM (SELECT *, CASE WHEN reason = 'held_through_resolution' AND winning_asset = asset THEN shares * 100 ELSE 0 END AS payout FROM (SELECT p.*, winning_asset, CASE WHEN shares = 0 AND buy > 0 THEN 'fully_exited' WHEN final AND buy > 0 AND shares > 0 THEN 'held_through_resolution' WHEN final AND buy > 0 THEN 'market_resolved' END AS reason FROM ({_POS}) p LEFT JOIN v_resolution USING (condition))) p"""


@query("L05_L06_L07_lifecycles", _LIFE)
def all_lifecycles(spark: SparkSession, d: str) -> DataFrame:
    return lifecycles(trades(spark, d), resolution(spark, d)).drop("redeem").withColumn("most", c("most").cast("long"))


@query("L08_modal_condition", "SELECT wallet, side, arg_max(condition, struct_pack(n := n, f := -f)) AS condition, max(n) AS n FROM (SELECT wallet, side, condition, count(*) AS n, min(ts * 100000 + condition) AS f FROM v_trades GROUP BY ALL) GROUP BY wallet, side")
def modal_condition(spark: SparkSession, d: str) -> DataFrame:
    """The most frequent condition of a group; of equal ones the one seen first."""
    n = trades(spark, d).groupBy("wallet", "side", "condition").agg(F.count("*").alias("n"), F.min(c("ts") * 100000 + c("condition")).alias("first"))
    return n.groupBy("wallet", "side").agg(F.max_by("condition", F.struct("n", -c("first"))).alias("condition"), F.max("n").alias("n"))


def ratio(a: Column, b: Column) -> Column:
    return F.when(b != 0, a / b)


@query("L09_L13_metric_bundle", f"""SELECT wallet, count(*) AS completed, count(*) FILTER (reason = 'held_through_resolution') AS held, count(*) FILTER (pnl > 0) / count(*) AS profitable_rate, sum(pnl)::DOUBLE / sum(most)::DOUBLE AS portfolio_roi, median(most) AS median_capital,
 median(pnl / most) AS median_roi, CASE WHEN count(*) FILTER (reason = 'held_through_resolution') > 0 THEN count(*) FILTER (correct) / count(*) FILTER (reason = 'held_through_resolution') END AS win_rate FROM ({_LIFE}) WHERE reason IS NOT NULL AND NOT excluded GROUP BY wallet""")
def metric_bundle(spark: SparkSession, d: str) -> DataFrame:
    held = F.count_if(c("reason") == "held_through_resolution")
    done = all_lifecycles(spark, d).where("reason is not null and not excluded")
    return done.groupBy("wallet").agg(F.count("*").alias("completed"), held.alias("held"), (F.count_if(c("pnl") > 0) / F.count("*")).alias("profitable_rate"), (F.sum("pnl") / F.sum("most")).alias("portfolio_roi"), F.median("most").alias("median_capital"), F.median(c("pnl") / c("most")).alias("median_roi"), ratio(F.count_if("correct"), held).alias("win_rate"))


@query("L10_resolution_coverage", f"SELECT wallet, count(DISTINCT l.condition) AS required, count(DISTINCT CASE WHEN final THEN l.condition END) AS resolved, count(DISTINCT CASE WHEN final THEN l.condition END) / count(DISTINCT l.condition) AS coverage FROM ({_LIFE}) l LEFT JOIN v_resolution r ON r.condition = l.condition WHERE shares > 0 AND buy > 0 GROUP BY wallet")
def resolution_coverage(spark: SparkSession, d: str) -> DataFrame:
    need = all_lifecycles(spark, d).where("shares > 0 and buy > 0").join(resolution(spark, d).select("condition", "final"), "condition", "left")
    got = F.count_distinct(F.when(c("final"), c("condition")))
    return need.groupBy("wallet").agg(F.count_distinct("condition").alias("required"), got.alias("resolved"), (got / F.count_distinct("condition")).alias("coverage"))


@query("L11_validity", f"""SELECT wallet, list_filter([CASE WHEN n < 3 THEN 'few_positions' END, CASE WHEN excluded > 0 THEN 'excluded_positions' END, CASE WHEN open > n THEN 'mostly_open' END], lambda x: x IS NOT NULL) AS reasons FROM (SELECT wallet, count(*) FILTER (reason IS NOT NULL) AS n, count(*) FILTER (excluded) AS excluded, count(*) FILTER (reason IS NULL) AS open FROM ({_LIFE}) GROUP BY wallet)""")
def validity(spark: SparkSession, d: str) -> DataFrame:
    per = all_lifecycles(spark, d).groupBy("wallet").agg(F.count("reason").alias("n"), F.count_if("excluded").alias("excluded"), F.count_if(c("reason").isNull()).alias("open"))
    return per.select("wallet", F.array_compact(F.array(F.when(c("n") < 3, "few_positions"), F.when(c("excluded") > 0, "excluded_positions"), F.when(c("open") > c("n"), "mostly_open"))).alias("reasons"))


_ID = "'chain|137|' || split_part(k, '|', 1) || '|' || split_part(k, '|', 2)"


@query("L14_collapse_identity", """SELECT 'chain|137|' || t || '|' || log_index AS identity, n AS rows, coalesce(timed, first) AS kept, conflict FROM (SELECT lower(trim(tx)) AS t, log_index, count(*) AS n, min(raw_id) AS first, min(raw_id) FILTER (ts > 0) AS timed,
 min(upper(raw_type)) <> max(upper(raw_type)) OR min(shares) <> max(shares) OR min(cash) <> max(cash) OR count(DISTINCT ts) FILTER (ts > 0) > 1 AS conflict FROM v_chain WHERE source = 'polygon' AND trim(coalesce(tx, '')) <> '' AND block > 0 AND log_index IS NOT NULL GROUP BY ALL)""")
def collapse_identity(spark: SparkSession, d: str) -> DataFrame:
    """Rows of one physical log entry become one: the first with a time, or else the first; conflict tells that the rows differ in what they say."""
    e = chain_events(spark, d).where("source = 'polygon' and trim(coalesce(tx, '')) <> '' and block > 0 and log_index is not null")
    timed = F.when(c("ts") > 0, c("raw_id"))
    apart = lambda x: F.min(x) != F.max(x)
    time = F.when(c("ts") > 0, c("ts"))
    conflict = apart(F.upper("raw_type")) | apart(c("shares")) | apart(c("cash")) | F.coalesce(apart(time), F.lit(False))
    per = e.groupBy(F.lower(F.trim("tx")).alias("t"), "log_index").agg(F.count("*").alias("rows"), F.coalesce(F.min(timed), F.min("raw_id")).alias("kept"), conflict.alias("conflict"))
    return per.select(F.concat_ws("|", F.lit("chain"), F.lit("137"), "t", c("log_index").cast("string")).alias("identity"), "rows", "kept", "conflict")


def chain_identity() -> Column:
    part = F.split("k", r"\|")
    return F.concat_ws("|", F.lit("chain"), F.lit("137"), part[0], part[1])


@query("L15_identity_fingerprint", f"SELECT wallet, sha256(string_agg({_ID}, chr(10) ORDER BY {_ID})) AS fingerprint FROM v_trades GROUP BY wallet")
def identity_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    return trades(spark, d).groupBy("wallet").agg(F.sha2(F.array_join(F.array_sort(F.collect_list(chain_identity())), "\n"), 256).alias("fingerprint"))


@query("L19_input_hash", "SELECT wallet, asset, sha256(string_agg(k || ':' || side || ':' || shares || ':' || cash, chr(10) ORDER BY ts, k)) AS input_hash FROM v_trades GROUP BY ALL")
def input_hash(spark: SparkSession, d: str) -> DataFrame:
    line = lambda e: F.concat_ws(":", e["k"], e["side"], e["shares"], e["cash"])
    return events_of(trades(spark, d), "wallet", "asset").select("wallet", "asset", F.sha2(F.array_join(F.transform("events", line), "\n"), 256).alias("input_hash"))


@query("L17_affected_positions", "SELECT DISTINCT t.wallet, t.asset FROM v_trades t JOIN (SELECT DISTINCT wallet, condition FROM v_trades WHERE ts >= 978307200) n USING (wallet, condition)")
def affected_positions(spark: SparkSession, d: str, since: int = 978307200) -> DataFrame:
    """Positions that events since then touch; an event reaches all assets of its condition."""
    t = trades(spark, d)
    return t.join(t.where(c("ts") >= since).select("wallet", "condition"), ["wallet", "condition"], "left_semi").select("wallet", "asset").distinct()


@query("L16_write_plan", f"""SELECT wallet, asset, CASE WHEN o.buy IS NULL THEN 'insert' WHEN o.buy = n.buy AND o.sell = n.sell THEN 'unchanged' ELSE 'update' END AS action FROM (SELECT wallet, asset, buy, sell FROM ({_POS})) n
 LEFT JOIN (SELECT wallet, asset, sum(CASE WHEN side = 'BUY' THEN cash ELSE 0 END) AS buy, sum(CASE WHEN side = 'BUY' THEN 0 ELSE cash END) AS sell FROM v_trades WHERE ts < 978307200 GROUP BY ALL) o USING (wallet, asset)""")
def write_plan(spark: SparkSession, d: str, since: int = 978307200) -> DataFrame:
    return planned(trades(spark, d), since)


def planned(t: DataFrame, since: int) -> DataFrame:
    """insert, unchanged or update for each position: what all its events give against what those before since give, both from one gathering of the events."""
    e = events_of(t, "wallet", "asset").withColumn("before", F.filter("events", lambda x: x["ts"] < since))
    e = e.select("wallet", "asset", F.size("before").alias("stored"), F.aggregate("before", empty(), applied).alias("o"), F.aggregate("events", empty(), applied).alias("s"))
    same = (c("o.buy") == c("s.buy")) & (c("o.sell") == c("s.sell")) & (c("o.redeem") == c("s.redeem"))
    return e.select("wallet", "asset", F.when(c("stored") == 0, "insert").when(same, "unchanged").otherwise("update").alias("action"))


@query("L18_parity", f"SELECT count(*) AS positions, count(*) FILTER (a.buy = b.buy AND a.sell = b.sell) AS equal, count(*) FILTER (a.wallet IS NULL OR b.wallet IS NULL) AS missing FROM ({_POS}) a FULL JOIN (SELECT * FROM ({_POS}) WHERE wallet % 10 <> 0) b ON a.wallet = b.wallet AND a.asset = b.asset")
def parity(spark: SparkSession, d: str) -> DataFrame:
    """Replayed against stored positions; the stored table lacks the wallets that end in 0."""
    a = replay(trades(spark, d), "wallet", "asset").select("wallet", "asset", "s.buy", "s.sell", "s.redeem")
    b = a.where("wallet % 10 <> 0").select("wallet", "asset", c("buy").alias("b_buy"), c("sell").alias("b_sell"), c("redeem").alias("b_redeem"))
    both = a.join(b, ["wallet", "asset"], "full")
    return both.agg(F.count("*").alias("positions"), F.count_if((c("buy") == c("b_buy")) & (c("sell") == c("b_sell")) & (c("redeem") == c("b_redeem"))).alias("equal"), F.count_if(c("buy").isNull() | c("b_buy").isNull()).alias("missing"))


@query("L20_order_diagnostics", "SELECT wallet, count(*) AS total, count(*) FILTER (asset % 3 = 0 AND shares % 2 = 0) AS full_order, count(*) FILTER (asset % 3 = 0 AND shares % 2 = 1) AS block_only, count(*) FILTER (asset % 3 <> 0) AS none FROM v_trades GROUP BY wallet")
def order_diagnostics(spark: SparkSession, d: str) -> DataFrame:
    block, log = c("asset") % 3 == 0, c("shares") % 2 == 0
    return trades(spark, d).groupBy("wallet").agg(F.count("*").alias("total"), F.count_if(block & log).alias("full_order"), F.count_if(block & ~log).alias("block_only"), F.count_if(~block).alias("none"))


@query("L25_reconcile", "SELECT wallet, count(*) AS api, count(*) FILTER (met) AS matched, count(*) FILTER (met) / count(*) AS rate FROM (SELECT wallet, EXISTS (SELECT 1 FROM v_trades b WHERE b.cents % 5 <> 0 AND b.k = a.k AND abs(a.shares - b.shares) < 0.01) AS met FROM v_trades a) GROUP BY wallet")
def reconcile(spark: SparkSession, d: str) -> DataFrame:
    """API rows with a chain fill of the same key and, to 0.01, the same shares; a row counts once, however many fills it meets."""
    t = trades(spark, d)
    chain = t.where("cents % 5 <> 0").groupBy("k", c("shares").alias("chain_shares")).agg(F.lit(True).alias("there"))
    near = t.join(chain, "k", "left").withColumn("ok", F.coalesce(c("there") & (F.abs(c("shares") - c("chain_shares")) < 0.01), F.lit(False)))
    # rows of one key and number of shares meet the same fills, so how many there are is taken from the API side alone
    per = near.groupBy("k", "wallet", "shares").agg(F.max("ok").alias("ok")).join(t.groupBy("k", "wallet", "shares").agg(F.count("*").alias("n")), ["k", "wallet", "shares"])
    api, matched = F.sum("n"), F.coalesce(F.sum(F.when(c("ok"), c("n"))), F.lit(0))
    return per.groupBy("wallet").agg(api.alias("api"), matched.alias("matched"), (matched / api).alias("rate"))


@query("L23_identity_rank", "SELECT wallet, arg_max(condition, struct_pack(n := n, c := -condition)) AS best, max(n) AS n, coalesce(list_sort(list(n), 'DESC')[2] >= 0.8::DOUBLE * max(n), false) AS ambiguous FROM (SELECT wallet, condition, count(*) AS n FROM v_trades GROUP BY ALL) GROUP BY wallet")
def identity_rank(spark: SparkSession, d: str, close: float = 0.8) -> DataFrame:
    n = trades(spark, d).groupBy("wallet", "condition").agg(F.count("*").alias("n"))
    w = Window.partitionBy("wallet").orderBy(F.desc("n"), "condition")
    top = n.select("wallet", "condition", "n", F.row_number().over(w).alias("r"), F.lead("n").over(w).alias("next")).where("r = 1")
    return top.select("wallet", c("condition").alias("best"), "n", F.coalesce(c("next") >= close * c("n"), F.lit(False)).alias("ambiguous"))


@query("J03_J04_source_merge", "SELECT k, CASE WHEN bool_or(cents % 3 <> 0) THEN 'activity' ELSE 'trades' END AS source FROM v_trades GROUP BY k")
def source_merge(spark: SparkSession, d: str) -> DataFrame:
    """Two sources of one ledger: activity wins, trades fill the gaps."""
    t = trades(spark, d)
    both = t.where("cents % 3 <> 0").select("k", F.lit(0).alias("rank")).unionByName(t.select("k", F.lit(1).alias("rank")))
    return both.groupBy("k").agg(F.min("rank").alias("rank")).select("k", F.when(c("rank") == 0, "activity").otherwise("trades").alias("source"))


@query("J16_S16_not_persisted", "SELECT k FROM v_trades WHERE cents % 4 = 0")
def not_persisted(spark: SparkSession, d: str) -> DataFrame:
    t = trades(spark, d)
    return t.join(t.where("cents % 4 <> 0").select("k"), "k", "left_anti").select("k")


@query("P03_dedupe_key", "SELECT lower(k) || '|' || condition || '|' || asset || '|' || ts || '|' || side || '|' || shares || '|' || cash AS key FROM v_trades")
def dedupe_key(spark: SparkSession, d: str) -> DataFrame:
    return trades(spark, d).select(F.concat_ws("|", F.lower("k"), "condition", "asset", "ts", "side", "shares", "cash").alias("key"))


@query("P04_P05_chain_identity", f"SELECT k, {_ID} AS identity FROM v_trades")
def identities(spark: SparkSession, d: str) -> DataFrame:
    return trades(spark, d).select("k", chain_identity().alias("identity"))


@query("P10_winning_asset", "SELECT DISTINCT asset, CASE WHEN final THEN winning_asset = asset END AS won FROM v_trades JOIN v_resolution USING (condition)")
def winning_asset(spark: SparkSession, d: str) -> DataFrame:
    return trades(spark, d).select("asset", "condition").distinct().join(resolution(spark, d), "condition").select("asset", F.when(c("final"), c("winning_asset") == c("asset")).alias("won"))

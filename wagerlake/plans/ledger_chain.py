"""The whole ledger of a wallet: two lists of raw rows to events, canonical order, episodes, lifecycles, metrics and the audit over all of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wagerlake.plans.ledger_audit import _KEY, event_key
from wagerlake.plans.reports import history
from wagerlake.registry import query
from wagerlake.sources.carriers import ledger_rows, resolution

c = F.col
#: Shares that count as none, share of completed positions with unclear merges that blocks a record.
EPSILON, MATERIAL = 1e-4, 0.05
_FAR = 2**62
_STATE = "struct<shares:double,outlay:double,most:double,buy:double,sell:double,redeem:double>"
EVENT = ("wallet", "kind", "condition", "asset", "ts", "shares", "price", "cash", "block", "tx_index", "log_index", "key")
POSITION = ("wallet", "asset")


def activity(rows: DataFrame) -> DataFrame:
    """Rows of an activity list as events: a TRADE by its side, REDEEM, MERGE and SPLIT as they are; other types and trades without a side are dropped."""
    kind, trade = F.upper("raw_type"), F.upper("raw_type") == "TRADE"
    e = rows.where((trade & F.upper("side").isin("BUY", "SELL")) | kind.isin("REDEEM", "MERGE", "SPLIT"))
    e = e.withColumn("kind", F.when(trade, F.upper("side")).otherwise(kind)).withColumn("side", F.when(trade, F.upper("side"))).withColumn("price", F.when(trade, F.coalesce("price", F.lit(0.0))))
    return _keyed(e.withColumn("cash", F.coalesce("cash", F.lit(0.0))))


def fills(rows: DataFrame) -> DataFrame:
    """Rows of a trades list as events; the cash is shares times price."""
    e = rows.where(c("side").isin("BUY", "SELL")).withColumn("kind", c("side")).withColumn("price", F.coalesce("price", F.lit(0.0)))
    return _keyed(e.withColumn("cash", F.coalesce("shares", F.lit(0.0)) * c("price")))


def _keyed(e: DataFrame) -> DataFrame:
    text = lambda x: F.trim(F.coalesce(c(x).cast("string"), F.lit("")))
    e = e.withColumns({"condition": text("condition"), "asset": text("asset"), "ts": F.coalesce("ts", F.lit(0)).cast("long"), "shares": F.coalesce("shares", F.lit(0.0))})
    return e.withColumn("key", event_key(c("tx"), c("condition"), c("asset"), c("ts"), c("kind"), c("side"), c("shares"), c("price"), c("cash")))


def merged(of_activity: DataFrame, of_fills: DataFrame, pos: str = "pos") -> DataFrame:
    """One event for each wallet and key: the last one of the activity list (by pos), or else the first of the trades list."""
    cell = lambda e, rank: e.select("wallet", "key", F.struct(F.lit(rank).alias("rank"), (c(pos) if rank else -c(pos)).alias("at"), *EVENT[1:-1]).alias("e"))
    both = cell(of_activity, 0).unionByName(cell(of_fills, 1))
    return both.groupBy("wallet", "key").agg(F.min_by("e", F.struct("e.rank", "e.at")).alias("e")).select("wallet", "key", "e.*").select(*EVENT)


def ordered(e: DataFrame, *keys: str) -> DataFrame:
    """e with a column place, a sortable struct: block, then log index, transaction index and key; the time only without a block, behind all blocks.

    Inside a block log indexes decide. An event without one stands behind the last log of the transactions before its own; one without either
    stands at the end of its block. Where all events of a block have the same coordinates this is the pairwise rule (log, or else
    transaction, or else key); where they are mixed the pairwise rule can go round in circles, and this is a total order all the same.
    Times of 0 or null are behind all others. Keys are compared by their bytes.
    """
    e = e.repartition(*keys)  # one exchange for this window and all that follow by the same keys
    before = Window.partitionBy(*keys, "block").orderBy("tx_index").rangeBetween(Window.unboundedPreceding, -1)
    e = e.withColumn("tx_index", c("tx_index").cast("long")).withColumn("log_index", c("log_index").cast("long"))
    met = F.max(F.when(c("tx_index").isNotNull(), c("log_index"))).over(before)
    chain, log, tx = F.coalesce(c("block") > 0, F.lit(False)), c("log_index").isNotNull(), c("tx_index").isNotNull()
    zero = F.lit(0).cast("long")
    return e.withColumn("place", F.struct(
        (~chain).alias("free"), F.when(chain, c("block").cast("long")).when(c("ts") > 0, c("ts")).otherwise(F.lit(_FAR)).alias("at"), F.when(~chain, zero).when(log, c("log_index")).when(tx, F.coalesce(met, F.lit(-1).cast("long"))).otherwise(F.lit(_FAR)).alias("log"),
        F.when(~chain | log, 0).when(tx, 1).otherwise(2).alias("kind"), F.when(chain & ~log & tx, c("tx_index")).otherwise(zero).alias("tx"), c("key"),
    ))


def stepped(s: Column, e: Column) -> Column:
    """State after an event. REDEEM leaves no shares; SPLIT adds shares, for cash or none; MERGE gives shares back and releases their part of the outlay."""
    is_ = lambda *kinds: e["kind"].isin(*kinds)
    split, merge = is_("SPLIT") & (e["shares"] > 0), is_("MERGE") & (e["shares"] > 0) & (s["shares"] > EPSILON)
    zero, paid, gone = F.lit(0.0), F.greatest(e["cash"], F.lit(0.0)), F.least(e["shares"], s["shares"])
    bought, sold = F.when(is_("BUY"), e["cash"]).when(split, paid).otherwise(zero), F.when(is_("SELL"), e["cash"]).when(merge, paid).otherwise(zero)
    redeemed = F.when(is_("REDEEM"), e["cash"]).otherwise(zero)
    kept = F.when(merge, F.greatest(zero, s["outlay"] - s["outlay"] * (gone / s["shares"]))).otherwise(s["outlay"])
    outlay = kept + bought - sold - redeemed
    held = F.when(is_("BUY") | split, s["shares"] + e["shares"]).when(is_("SELL"), s["shares"] - e["shares"]).when(is_("REDEEM"), zero).when(merge, s["shares"] - gone).otherwise(s["shares"])
    return F.struct(held.alias("shares"), outlay.alias("outlay"), F.greatest(s["most"], outlay).alias("most"), (s["buy"] + bought).alias("buy"), (s["sell"] + sold).alias("sell"), (s["redeem"] + redeemed).alias("redeem")).cast(_STATE)


def _empty() -> Column:
    return F.struct(*(F.lit(0.0).alias(x) for x in ("shares", "outlay", "most", "buy", "sell", "redeem"))).cast(_STATE)


def opens(s: Column, n: Column, kind: Column) -> Column:
    """Whether an event begins an episode: a BUY after the shares came back to nothing, with something bought before."""
    return (n > 0) & (F.abs(s["shares"]) <= EPSILON) & (s["buy"] > EPSILON) & (kind == "BUY")


def folded(events: Column, mixed: Column) -> Column:
    """Array of the episodes (n, first, last, state) of a position's events in order; with a MERGE or SPLIT it is one."""
    episode = f"struct<n:bigint,first:bigint,last:bigint,s:{_STATE}>"
    begin = F.struct(F.lit(0).alias("n"), F.lit(0).alias("first"), F.lit(0).alias("last"), _empty().alias("s")).cast(episode)

    def step(acc: Column, e: Column) -> Column:
        now = acc["now"]
        over = ~mixed & opens(now["s"], now["n"], e["kind"])
        base = F.when(over, begin).otherwise(now)
        after = F.struct((base["n"] + 1).alias("n"), F.when(base["n"] == 0, e["ts"]).otherwise(base["first"]).alias("first"), e["ts"].alias("last"), stepped(base["s"], e).alias("s")).cast(episode)
        return F.struct(F.when(over, F.concat(acc["done"], F.array(now))).otherwise(acc["done"]).alias("done"), after.alias("now"))

    start = F.struct(F.array().cast(f"array<{episode}>").alias("done"), begin.alias("now"))
    return F.aggregate(events, start, step, lambda acc: F.concat(acc["done"], F.array(acc["now"])))


def episodes(e: DataFrame) -> DataFrame:
    """wallet, asset, episode, mixed, n, first, last, s for every position of events with a place; events without an asset have none.

    Positions of BUY and SELL that never re-enter, nearly all, are window sums over the position's order, and no task holds one as an array; only
    those with a REDEEM, MERGE or SPLIT, or a re-entry, are gathered and folded. Both add in the same order.
    """
    e = e.where("asset <> ''")
    run = Window.partitionBy(*POSITION).orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    earlier, all_ = Window.partitionBy(*POSITION).orderBy("place").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(*POSITION)
    buy = c("kind") == "BUY"
    signed = lambda x: F.when(buy, c(x)).otherwise(-c(x))
    again = buy & (F.abs(F.sum(signed("shares")).over(earlier)) <= EPSILON) & (F.sum(F.when(buy, c("cash")).otherwise(0.0)).over(earlier) > EPSILON)
    e = e.withColumn("outlay", F.sum(signed("cash")).over(run)).withColumn("odd", ~c("kind").isin("BUY", "SELL") | F.coalesce(again, F.lit(False)))
    e = e.withColumn("odd", F.max("odd").over(all_)).withColumn("held", F.sum(signed("shares")).over(run)).withColumn("row", F.row_number().over(Window.partitionBy(*POSITION).orderBy("place")))
    last = lambda x: F.max_by(x, "row")
    plain = F.struct(
        F.count("*").alias("n"), F.min_by("ts", "row").alias("first"), last("ts").alias("last"),
        F.struct(last("held").alias("shares"), last("outlay").alias("outlay"), F.greatest(F.lit(0.0), F.max("outlay")).alias("most"), last("bought").alias("buy"), last("sold").alias("sell"), F.lit(0.0).alias("redeem")).alias("s"),
    )
    e = e.withColumn("bought", F.sum(F.when(buy, c("cash")).otherwise(0.0)).over(run)).withColumn("sold", F.sum(F.when(buy, 0.0).otherwise(c("cash"))).over(run))
    per = e.groupBy(*POSITION).agg(
        F.max("odd").alias("odd"), F.max(c("kind").isin("MERGE", "SPLIT")).alias("mixed"), plain.alias("plain"),
        F.array_sort(F.collect_list(F.when(c("odd"), F.struct("place", "kind", "ts", "shares", "cash")))).alias("events"),
    )
    one = F.array(c("plain").cast(f"struct<n:bigint,first:bigint,last:bigint,s:{_STATE}>"))
    return per.select(*POSITION, "mixed", F.posexplode(F.when(c("odd"), folded(c("events"), c("mixed"))).otherwise(one)).alias("episode", "e")).select(*POSITION, "episode", "mixed", "e.n", "e.first", "e.last", "e.s")


def conditions(e: DataFrame, tokens: DataFrame | None = None) -> DataFrame:
    """The condition of each position: its events' commonest one, of equal ones that seen first; without one, that of its asset in tokens (asset, condition), or unresolved:asset:..."""
    per = e.where("asset <> ''").groupBy(*POSITION, "condition").agg(F.count("*").alias("n"), F.min("place").alias("seen"))
    named = F.when(c("condition") != "", F.struct((-c("n")).alias("n"), "seen"))
    per = per.groupBy(*POSITION).agg(F.min_by(F.when(c("condition") != "", c("condition")), named).alias("condition"))
    if tokens is not None:
        per = per.join(tokens.groupBy("asset").agg(F.min("condition").alias("by_asset")), "asset", "left").withColumn("condition", F.coalesce("condition", "by_asset")).drop("by_asset")
    return per.withColumn("condition", F.coalesce("condition", F.concat(F.lit("unresolved:asset:"), "asset")))


def lifecycles(e: DataFrame, resolved: DataFrame, tokens: DataFrame | None = None) -> DataFrame:
    """Every episode of every position with its completion, payout, profit, return and exclusion; resolved has condition, final, winning_asset (null: unknown)."""
    r = resolved.select(c("condition").cast("string").alias("condition"), "final", c("winning_asset").cast("string").alias("winning_asset"))
    p = episodes(e).join(conditions(e, tokens), [*POSITION]).join(r, "condition", "left").select("*", "s.*").drop("s")
    ok, exited = ~c("mixed"), F.abs("shares") <= EPSILON
    final = F.coalesce("final", F.lit(False))
    done = ok & (c("buy") > EPSILON) & (exited | final)
    held = done & ~exited & (c("shares") > EPSILON)
    won = c("winning_asset") == c("asset")
    capital = F.greatest("most", F.lit(0.0))
    invalid = ok & ((capital <= 0) & ((c("buy") <= 0) | done))
    payout = F.when(held & F.coalesce(won, F.lit(False)), c("shares")).otherwise(0.0)
    pnl = F.when(done & ~((capital <= 0) & (c("buy") <= 0)), c("sell") + c("redeem") + payout - c("buy"))
    status = F.when(c("mixed"), "requires_merge_split_resolution").when(invalid, "invalid_capital_accounting").when(done, "ok").otherwise("open")
    return p.select(
        *POSITION, "condition", c("episode").alias("episode"), "n", "first", "last", "mixed", "shares", "most", "buy", "sell", "redeem", F.coalesce("final", F.lit(False)).alias("final"), exited.alias("fully_exited"), done.alias("completed"),
        F.when(done & exited, "fully_exited").when(held, "held_through_resolution").when(done, "market_resolved").alias("reason"), payout.alias("payout"), capital.alias("capital"), pnl.alias("pnl"), F.when(pnl.isNotNull() & (capital > 0), pnl / capital).alias("roi"),
        held.alias("held"), F.when(held, won).alias("correct"), status.alias("status"), (c("mixed") | invalid).alias("excluded"),
    )


def money(x: Column) -> Column:
    """The sum of x, each to six decimals: the same in whatever order rows come."""
    return F.coalesce(F.sum(x.cast("decimal(38,6)")).cast("double"), F.lit(0.0))


def _bundle(where: Column, name: str) -> list[Column]:
    """Twelve measures of the positions where it holds; medians are exact."""
    of = lambda x: F.when(where, x)
    capital, total, pnl = of(F.when(c("capital") > 0, c("capital"))), money(of(c("capital"))), money(of(c("pnl")))
    n, held = F.count_if(where), F.count_if(where & c("held"))
    return [F.struct(
        n.alias("completed"), held.alias("held"), F.when(n > 0, F.count_if(where & (c("pnl") > 0)) / n).alias("profitable_rate"), F.when(total > 0, pnl / total).alias("portfolio_roi"), F.coalesce(F.median(capital), F.lit(0.0)).alias("median_capital"),
        F.coalesce(total / F.nullif(F.count(capital), F.lit(0)), F.lit(0.0)).alias("mean_capital"), total.alias("total_capital"), pnl.alias("total_pnl"), F.median(of(c("roi"))).alias("median_roi"), F.when(held > 0, F.count_if(where & c("held") & c("correct")) / held).alias("win_rate"),
        total.alias("resolved_volume"), F.lit(None).cast("double").alias("avg_ev"),
    ).alias(name)]


def wallet_metrics(p: DataFrame) -> DataFrame:
    """A wallet's measures over its lifecycles: observed and credible bundle, coverage of resolutions, effect of MERGE and SPLIT."""
    done, share = c("completed") & c("pnl").isNotNull(), lambda x: F.coalesce(F.count_if(x & c("completed")) / F.nullif(F.count_if("completed"), F.lit(0)), F.lit(0.0))
    credible = done & ~c("excluded") & ((c("reason") == "fully_exited") | c("final"))
    safe = c("mixed") & c("fully_exited") & (c("buy") > 0)
    need = c("held") | (~c("fully_exited") & (c("shares") > 0) & (c("buy") > 0) & ~c("mixed"))
    cash = money(F.when(c("mixed"), c("buy") + c("sell") + c("redeem")))
    return p.groupBy("wallet").agg(
        F.count("*").alias("positions"), F.count_if("completed").alias("completed"), F.count_if(~c("completed")).alias("open"), F.count_if("excluded").alias("excluded"), F.count_if("fully_exited").alias("fully_exited"), F.count_if("held").alias("held"),
        F.count_if(c("correct")).alias("winning_held"), F.count_if(~c("correct")).alias("losing_held"), F.count_if(c("held") & ~c("final")).alias("unresolved_held"), *_bundle(done, "observed"), *_bundle(credible, "credible"),
        F.count_distinct(F.when(need, c("condition"))).alias("required"), F.count_distinct(F.when(need & c("final"), c("condition"))).alias("resolved"), F.count_if("mixed").alias("merge_split"), share(c("mixed")).alias("share_affected"), cash.alias("cash_affected"),
        money(F.when(c("mixed"), c("capital"))).alias("capital_affected"), F.count_if(safe).alias("safe"), F.count_if(c("mixed") & ~safe).alias("ambiguous"), share(c("mixed") & ~safe).alias("share_ambiguous"),
    ).withColumn("advice", F.when(c("share_ambiguous") < MATERIAL, "exclude_policy_sufficient").otherwise("phase_2c_accounting_required"))


def audit(of_activity: DataFrame, of_fills: DataFrame, resolved: DataFrame, wallets: DataFrame, tokens: DataFrame | None = None) -> DataFrame:
    """A row for each of wallets (wallet, method, low, positions_only, activity_truncated, trades_truncated): events, reconciliation, measures and what they are worth.

    Takes events of both lists with a column pos. A wallet without events has zeros and unusable metrics; credible is null where the history doesn't bear it.
    """
    e = merged(of_activity, of_fills)
    raw = of_activity.select("wallet").unionByName(of_fills.select("wallet")).groupBy("wallet").agg(F.count("*").alias("raw_events"))
    kept = e.groupBy("wallet").agg(F.count("*").alias("events"))
    m = wallet_metrics(lifecycles(ordered(e, *POSITION), resolved, tokens))
    out = wallets.join(raw, "wallet", "left").join(kept, "wallet", "left").join(m, "wallet", "left")
    counts = ["raw_events", "events", "positions", "completed", "open", "excluded", "fully_exited", "held", "winning_held", "losing_held", "unresolved_held", "required", "resolved", "merge_split", "safe", "ambiguous"]
    out = out.fillna(0, counts).fillna(0.0, ["share_affected", "cash_affected", "capital_affected", "share_ambiguous"]).fillna("exclude_policy_sufficient", ["advice"])
    says = history(c("method"), c("low"), c("positions_only"), c("events"), F.lit(False), c("activity_truncated"), c("trades_truncated"), c("unresolved_held"), c("required"), c("resolved"), c("advice") == "phase_2c_accounting_required", c("ambiguous"), c("share_ambiguous"), F.lit(False))
    out = out.withColumn("h", says).withColumn("coverage", F.coalesce(c("resolved") / F.nullif(c("required"), F.lit(0)), F.lit(1.0)))
    return out.withColumn("credible", F.when(c("h.credible"), c("credible"))).select("wallet", *counts, "coverage", "share_affected", "cash_affected", "capital_affected", "share_ambiguous", "advice", "observed", "credible", "h.reasons", "h.metrics", "h.history")


#: Rows of an activity list from which on the query takes it for cut off.
CAP = 55
_LISTS = f"""a0 AS (SELECT *, id AS pos FROM v_rows WHERE id % 4 <> 0 UNION ALL SELECT * REPLACE (NULL AS log_index), id + 1000000000 FROM v_rows WHERE id % 4 <> 0 AND id % 9 = 0),
a AS (SELECT wallet, CASE WHEN upper(raw_type) = 'TRADE' THEN side ELSE upper(raw_type) END AS kind, coalesce(condition::VARCHAR, '') AS condition, asset::VARCHAR AS asset, coalesce(ts, 0) AS ts, tx, CASE WHEN upper(raw_type) = 'TRADE' THEN side END AS side, shares, CASE WHEN upper(raw_type) = 'TRADE' THEN price END AS price, cash, block, tx_index, log_index, 0 AS rank, -pos AS at_
 FROM a0 WHERE (upper(raw_type) = 'TRADE' AND side IN ('BUY', 'SELL')) OR upper(raw_type) IN ('REDEEM', 'MERGE', 'SPLIT')),
b AS (SELECT wallet, side AS kind, coalesce(condition::VARCHAR, '') AS condition, asset::VARCHAR AS asset, coalesce(ts, 0) AS ts, tx, side, shares, price, shares * price AS cash, block, tx_index, log_index, 1 AS rank, id AS at_ FROM v_rows WHERE raw_type = 'TRADE' AND id % 7 <> 0 AND side IN ('BUY', 'SELL')),
k AS (SELECT *, {_KEY} AS key FROM (SELECT * FROM a UNION ALL SELECT * FROM b)),
e AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY wallet, key ORDER BY rank, at_) = 1),
m AS (SELECT *, coalesce(block > 0, false) AS chain, max(CASE WHEN tx_index IS NOT NULL THEN log_index END) OVER (PARTITION BY wallet, asset, block ORDER BY tx_index RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS met, bool_or(kind IN ('MERGE', 'SPLIT')) OVER (PARTITION BY wallet, asset) AS mixed FROM e),
o AS (SELECT *, row_number() OVER (PARTITION BY wallet, asset ORDER BY NOT chain, CASE WHEN chain THEN block WHEN ts > 0 THEN ts ELSE {_FAR} END, CASE WHEN NOT chain THEN 0 WHEN log_index IS NOT NULL THEN log_index WHEN tx_index IS NOT NULL THEN coalesce(met, -1) ELSE {_FAR} END,
 CASE WHEN NOT chain OR log_index IS NOT NULL THEN 0 WHEN tx_index IS NOT NULL THEN 1 ELSE 2 END, CASE WHEN chain AND log_index IS NULL THEN coalesce(tx_index, 0) ELSE 0 END, key) AS rn FROM m)"""
_REPLAY = f"""{_LISTS},
z AS (SELECT DISTINCT wallet, asset, mixed, 0::BIGINT AS rn, 0 AS ep, 0::BIGINT AS n, 0::DOUBLE AS s, 0::DOUBLE AS o, 0::DOUBLE AS m, 0::DOUBLE AS b, 0::DOUBLE AS l, 0::DOUBLE AS r, 0::BIGINT AS f, 0::BIGINT AS t FROM o
 UNION ALL SELECT z.wallet, z.asset, z.mixed, e.rn, z.ep + x, w.n + 1, CASE WHEN e.kind = 'BUY' OR (e.kind = 'SPLIT' AND e.shares > 0) THEN w.s + e.shares WHEN e.kind = 'SELL' THEN w.s - e.shares WHEN e.kind = 'REDEEM' THEN 0 WHEN mg THEN w.s - least(e.shares, w.s) ELSE w.s END, u.o, greatest(w.m, u.o), w.b + bought, w.l + sold, w.r + redeemed,
 CASE WHEN w.n = 0 THEN e.ts ELSE w.f END, e.ts FROM z JOIN o e ON e.wallet = z.wallet AND e.asset = z.asset AND e.rn = z.rn + 1,
 LATERAL (SELECT (NOT z.mixed AND z.n > 0 AND abs(z.s) <= 1e-4 AND z.b > 1e-4 AND e.kind = 'BUY')::INT AS x) v,
 LATERAL (SELECT CASE x WHEN 1 THEN 0 ELSE z.n END AS n, CASE x WHEN 1 THEN 0 ELSE z.s END AS s, CASE x WHEN 1 THEN 0 ELSE z.o END AS o, CASE x WHEN 1 THEN 0 ELSE z.m END AS m, CASE x WHEN 1 THEN 0 ELSE z.b END AS b, CASE x WHEN 1 THEN 0 ELSE z.l END AS l, CASE x WHEN 1 THEN 0 ELSE z.r END AS r, z.f AS f) w,
 LATERAL (SELECT e.kind = 'MERGE' AND e.shares > 0 AND w.s > 1e-4 AS mg) g,
 LATERAL (SELECT CASE WHEN e.kind = 'BUY' THEN e.cash WHEN e.kind = 'SPLIT' AND e.shares > 0 THEN greatest(e.cash, 0) ELSE 0 END AS bought, CASE WHEN e.kind = 'SELL' THEN e.cash WHEN mg THEN greatest(e.cash, 0) ELSE 0 END AS sold, CASE WHEN e.kind = 'REDEEM' THEN e.cash ELSE 0 END AS redeemed) h,
 LATERAL (SELECT CASE WHEN mg THEN greatest(0, w.o - w.o * (least(e.shares, w.s) / w.s)) ELSE w.o END + bought - sold - redeemed AS o) u),
y AS (SELECT wallet, asset, ep AS episode, mixed, max(n) AS n, arg_max(s, rn) AS shares, arg_max(m, rn) AS most, arg_max(b, rn) AS buy, arg_max(l, rn) AS sell, arg_max(r, rn) AS redeem, arg_max(f, rn) AS first, arg_max(t, rn) AS last FROM z WHERE rn > 0 GROUP BY ALL),
cd AS (SELECT wallet, asset, coalesce(arg_max(condition, struct_pack(n := n, f := -f)) FILTER (condition <> ''), 'unresolved:asset:' || asset) AS condition FROM (SELECT wallet, asset, condition, count(*) AS n, min(rn) AS f FROM o GROUP BY ALL) GROUP BY wallet, asset),
q AS (SELECT y.*, cd.condition, coalesce(final, false) AS final, winning_asset::VARCHAR = y.asset AS won, abs(shares) <= 1e-4 AS exited FROM y JOIN cd USING (wallet, asset) LEFT JOIN v_resolution v ON v.condition::VARCHAR = cd.condition),
q2 AS (SELECT *, NOT mixed AND buy > 1e-4 AND (exited OR final) AS done, greatest(most, 0) AS capital FROM q),
q3 AS (SELECT *, done AND NOT exited AND shares > 1e-4 AS held, NOT mixed AND capital <= 0 AND (buy <= 0 OR done) AS invalid FROM q2),
q4 AS (SELECT *, CASE WHEN held AND won THEN shares ELSE 0 END AS payout FROM q3),
q5 AS (SELECT *, CASE WHEN done AND NOT (capital <= 0 AND buy <= 0) THEN sell + redeem + payout - buy END AS pnl FROM q4),
life AS (SELECT wallet, asset, condition, episode, n, first, last, mixed, shares, most, buy, sell, redeem, final, exited AS fully_exited, done AS completed, CASE WHEN done AND exited THEN 'fully_exited' WHEN held THEN 'held_through_resolution' WHEN done THEN 'market_resolved' END AS reason, payout, capital, pnl,
 CASE WHEN pnl IS NOT NULL AND capital > 0 THEN pnl / capital END AS roi, held, CASE WHEN held THEN won END AS correct, CASE WHEN mixed THEN 'requires_merge_split_resolution' WHEN invalid THEN 'invalid_capital_accounting' WHEN done THEN 'ok' ELSE 'open' END AS status, mixed OR invalid AS excluded FROM q5)"""


def _lists(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Two lists over the ledger rows: activity, some rows twice, the later ones without a log index, and fills of trades; each has rows that the other lacks."""
    rows = ledger_rows(spark, d)
    listed = rows.where("id % 4 <> 0")
    twice = listed.where("id % 9 = 0").withColumn("pos", c("id") + 1_000_000_000).withColumn("log_index", F.lit(None).cast("long"))
    return activity(listed.withColumn("pos", c("id")).unionByName(twice)), fills(rows.where("raw_type = 'TRADE' and id % 7 <> 0").withColumn("pos", c("id")))


@query("L01_K01_J04_chain_order", f"WITH RECURSIVE {_LISTS} SELECT wallet, asset, key, kind, rank = 0 AS listed, log_index, rn AS pos FROM o")
def chain_order(spark: SparkSession, d: str) -> DataFrame:
    """Place of each event in its position; keys of both lists once, with the fields of the last row of the activity list that has them."""
    a, b = _lists(spark, d)
    e = ordered(merged(a, b).join(a.select("wallet", "key", F.lit(True).alias("listed")).distinct(), ["wallet", "key"], "left"), *POSITION)
    return e.select("wallet", "asset", "key", "kind", F.coalesce("listed", F.lit(False)).alias("listed"), "log_index", F.row_number().over(Window.partitionBy(*POSITION).orderBy("place")).cast("long").alias("pos"))


def _six(x: Column) -> Column:
    """x to six decimals; a double from 2^53 on is whole as it is, and floor's long would stop at 2^63."""
    y = x * 1_000_000 + 0.5
    return F.when(F.abs(y) < 2.0**53, F.floor(y).cast("double")).otherwise(y) / 1_000_000


_LIFE_OUT = "SELECT * REPLACE (" + ", ".join(f"floor({x} * 1000000 + 0.5) / 1000000 AS {x}" for x in ("shares", "most", "buy", "sell", "redeem", "payout", "capital", "pnl", "roi")) + ") FROM life"


@query("L02_L08_chain_lifecycles", f"WITH RECURSIVE {_REPLAY} {_LIFE_OUT}")
def chain_lifecycles(spark: SparkSession, d: str) -> DataFrame:
    """Episodes of all positions over BUY, SELL, REDEEM, SPLIT and MERGE, money to six decimals."""
    a, b = _lists(spark, d)
    p = lifecycles(ordered(merged(a, b), *POSITION), resolution(spark, d))
    return p.withColumns({x: _six(c(x)) for x in ("shares", "most", "buy", "sell", "redeem", "payout", "capital", "pnl", "roi")})


def _money(x: str) -> str:
    return f"sum(CAST({x} AS DECIMAL(38,6)))"


def _bundle_sql(where: str, name: str) -> str:
    f = f"FILTER ({where})"
    return f"""struct_pack(completed := count(*) {f}, held := count(*) FILTER (({where}) AND held), profitable_rate := count(*) FILTER (({where}) AND pnl > 0) / nullif(count(*) {f}, 0), portfolio_roi := CASE WHEN {_money("capital")} {f} > 0 THEN ({_money("pnl")} {f})::DOUBLE / ({_money("capital")} {f})::DOUBLE END, median_capital := coalesce(median(capital) FILTER (({where}) AND capital > 0), 0),
 mean_capital := coalesce(({_money("capital")} {f})::DOUBLE / nullif(count(*) FILTER (({where}) AND capital > 0), 0), 0), total_capital := coalesce(({_money("capital")} {f})::DOUBLE, 0), total_pnl := coalesce(({_money("pnl")} {f})::DOUBLE, 0), median_roi := median(roi) {f}, win_rate := count(*) FILTER (({where}) AND held AND correct) / nullif(count(*) FILTER (({where}) AND held), 0)) AS {name}"""


_MEASURES = ("profitable_rate", "portfolio_roi", "median_capital", "mean_capital", "total_capital", "total_pnl", "median_roi", "win_rate")
_COUNTS = ("raw_events", "events", "positions", "completed", "open", "excluded", "fully_exited", "held", "winning_held", "losing_held", "required", "resolved", "merge_split", "safe", "ambiguous")
_FLAT = ", ".join(f"{b}.completed AS {b}_completed, {b}.held AS {b}_held, " + ", ".join(f"floor({b}.{x} * 1000000 + 0.5) / 1000000 AS {b}_{x}" for x in _MEASURES) for b in ("observed", "credible"))


@query("C08_ledger_audit", f"""WITH RECURSIVE {_REPLAY}, w AS (SELECT user_id AS wallet, count(*) FILTER (event_id % 4 <> 0) >= {CAP} AS cut FROM events GROUP BY ALL),
g AS (SELECT wallet, count(*) AS positions, count(*) FILTER (completed) AS completed, count(*) FILTER (NOT completed) AS open, count(*) FILTER (excluded) AS excluded, count(*) FILTER (fully_exited) AS fully_exited, count(*) FILTER (held) AS held, count(*) FILTER (correct) AS winning_held, count(*) FILTER (NOT correct) AS losing_held,
 {_bundle_sql("completed AND pnl IS NOT NULL", "observed")}, {_bundle_sql("completed AND pnl IS NOT NULL AND NOT excluded AND (reason = 'fully_exited' OR final)", "credible")}, count(DISTINCT condition) FILTER (need) AS required, count(DISTINCT condition) FILTER (need AND final) AS resolved,
 count(*) FILTER (mixed) AS merge_split, coalesce(count(*) FILTER (mixed AND completed) / nullif(count(*) FILTER (completed), 0), 0) AS share_affected, coalesce(({_money("(buy + sell + redeem)")} FILTER (mixed))::DOUBLE, 0) AS cash_affected, coalesce(({_money("capital")} FILTER (mixed))::DOUBLE, 0) AS capital_affected, count(*) FILTER (safe) AS safe, count(*) FILTER (mixed AND NOT safe) AS ambiguous
 FROM (SELECT *, held OR (NOT fully_exited AND shares > 0 AND buy > 0 AND NOT mixed) AS need, mixed AND fully_exited AND buy > 0 AS safe FROM life) GROUP BY wallet),
n AS (SELECT wallet, count(*) AS raw_events FROM (SELECT wallet FROM a UNION ALL SELECT wallet FROM b) GROUP BY wallet), n2 AS (SELECT wallet, count(*) AS events FROM e GROUP BY wallet),
j AS (SELECT w.*, {", ".join(f"coalesce({x}, 0)::BIGINT AS {x}" for x in _COUNTS)}, coalesce(resolved / nullif(required, 0), 1) AS coverage, coalesce(share_affected, 0) AS share_affected, coalesce(cash_affected, 0) AS cash_affected, coalesce(capital_affected, 0) AS capital_affected, observed, credible AS cred,
 CASE wallet % 16 WHEN 1 THEN 'ambiguous' WHEN 2 THEN 'unresolved' ELSE 'direct' END AS method, wallet % 19 = 0 AS low FROM w LEFT JOIN n USING (wallet) LEFT JOIN n2 USING (wallet) LEFT JOIN g USING (wallet)),
i AS (SELECT *, low OR method <> 'direct' OR events = 0 OR cut AS blocked FROM j), l AS (SELECT *, CASE WHEN NOT blocked THEN cred END AS credible FROM i)
SELECT wallet, {", ".join(_COUNTS)}, coverage, share_affected, floor(cash_affected * 1000000 + 0.5) / 1000000 AS cash_affected, floor(capital_affected * 1000000 + 0.5) / 1000000 AS capital_affected, {_FLAT},
 list_filter([CASE WHEN method = 'ambiguous' THEN 'identity_ambiguous' END, CASE WHEN method = 'unresolved' THEN 'identity_unresolved' END, CASE WHEN low THEN 'identity_low_confidence' END, CASE WHEN events = 0 THEN 'no_history_events' END, CASE WHEN cut THEN 'activity_truncated' END, CASE WHEN resolved < required THEN 'gamma_resolution_incomplete' END, CASE WHEN ambiguous > 0 THEN 'merge_split_unresolved' END], lambda x: x IS NOT NULL) AS reasons,
 CASE WHEN events = 0 THEN 'unusable' WHEN blocked THEN 'partial' ELSE 'complete' END AS metrics, CASE WHEN events = 0 THEN 'unusable' WHEN blocked THEN 'partial-and-metrics-unsafe' WHEN resolved < required THEN 'partial-but-metrics-safe' ELSE 'complete' END AS history FROM l""")
def ledger_audit(spark: SparkSession, d: str) -> DataFrame:
    """The audit of every wallet from its raw rows; a list of CAP rows or more counts as cut off."""
    a, b = _lists(spark, d)
    w = c("wallet")
    wallets = ledger_rows(spark, d).groupBy("wallet").agg((F.count_if(c("id") % 4 != 0) >= CAP).alias("activity_truncated"))
    wallets = wallets.select("wallet", F.when(w % 16 == 1, "ambiguous").when(w % 16 == 2, "unresolved").otherwise("direct").alias("method"), (w % 19 == 0).alias("low"), F.lit(False).alias("positions_only"), "activity_truncated", F.lit(False).alias("trades_truncated"))
    out = audit(a, b, resolution(spark, d), wallets)
    flat = [x for b in ("observed", "credible") for x in (c(f"{b}.completed").alias(f"{b}_completed"), c(f"{b}.held").alias(f"{b}_held"), *(_six(c(f"{b}.{m}")).alias(f"{b}_{m}") for m in _MEASURES))]
    return out.select("wallet", *_COUNTS, "coverage", "share_affected", _six(c("cash_affected")).alias("cash_affected"), _six(c("capital_affected")).alias("capital_affected"), *flat, "reasons", "metrics", "history")

"""Wallet performance: profit factor, track record, portfolio sums, distributions and policy statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wagerlake.registry import query
from wagerlake.sources.carriers import positions

c = F.col
#: Positions below which data are limited; resolved bets of a reliable record.
LIMITED, RELIABLE = 30, 5
_PF = """SELECT {k}, count(*) AS positions, coalesce(sum(realized) FILTER (realized > 0), 0)::BIGINT AS profit, coalesce(-sum(realized) FILTER (realized < 0), 0)::BIGINT AS loss, sum(realized) FILTER (realized > 0) / nullif(-sum(realized) FILTER (realized < 0), 0) AS profit_factor,
 (sum(realized) FILTER (realized > 0) - greatest(max(realized), 0)) / nullif(-sum(realized) FILTER (realized < 0), 0) AS without_best, count(*) FILTER (realized > 0) AS wins, count(*) FILTER (realized > 0) / nullif(count(*) FILTER (realized <> 0), 0) * 100 AS win_rate, count(*) < 30 AS limited FROM v_positions GROUP BY {k}"""


def profit_factor(p: DataFrame, *keys: str) -> DataFrame:
    """Gross profit and loss, their ratio with and without the best win, win rate and the limited-data flag; null ratio without loss."""
    up, down = F.sum(F.when(c("realized") > 0, c("realized"))), -F.sum(F.when(c("realized") < 0, c("realized")))
    loss = F.nullif(down, F.lit(0))
    wins, all_ = F.count_if(c("realized") > 0), F.nullif(F.count_if(c("realized") != 0), F.lit(0))
    return p.groupBy(*keys).agg(
        F.count("*").alias("positions"), F.coalesce(up, F.lit(0)).alias("profit"), F.coalesce(down, F.lit(0)).alias("loss"), (up / loss).alias("profit_factor"), ((up - F.greatest(F.max("realized"), F.lit(0))) / loss).alias("without_best"),
        wins.alias("wins"), (wins / all_ * 100).alias("win_rate"), (F.count("*") < LIMITED).alias("limited"),
    )


@query("A01_A04_category_profit_factor", _PF.format(k="category"))
def by_category(spark: SparkSession, d: str) -> DataFrame:
    return profit_factor(positions(spark, d), "category")


@query("A02_wallet_profit_factor", _PF.format(k="wallet"))
def by_wallet(spark: SparkSession, d: str) -> DataFrame:
    return profit_factor(positions(spark, d), "wallet")


@query("A02_A05_wallet_category_profit_factor", _PF.format(k="wallet, category"))
def by_wallet_category(spark: SparkSession, d: str) -> DataFrame:
    return profit_factor(positions(spark, d), "wallet", "category")


@query("A03_without_best_win", "SELECT wallet, condition, realized FROM (SELECT *, row_number() OVER (PARTITION BY wallet ORDER BY realized DESC, condition) AS r FROM v_positions) WHERE NOT (r = 1 AND realized > 0)")
def without_best_win(spark: SparkSession, d: str) -> DataFrame:
    r = F.row_number().over(Window.partitionBy("wallet").orderBy(F.desc("realized"), "condition"))
    return positions(spark, d).withColumn("r", r).where("not (r = 1 and realized > 0)").select("wallet", "condition", "realized")


@query("A06_A12_track_record", "SELECT wallet, count(*) AS bets, count(*) FILTER (realized <> 0) AS closed, count(*) FILTER (realized > 0) AS wins, sum(realized)::BIGINT AS pnl, sum(bought) FILTER (realized <> 0)::BIGINT AS invested, sum(realized) / nullif(sum(bought) FILTER (realized <> 0), 0) * 100 AS roi, sum(realized) / nullif(count(*) FILTER (realized <> 0), 0) AS average, count(*) FILTER (realized <> 0) >= 5 AS reliable FROM v_positions GROUP BY wallet")
def track_record(spark: SparkSession, d: str) -> DataFrame:
    live = c("realized") != 0
    closed, spent = F.count_if(live), F.sum(F.when(live, c("bought")))
    return positions(spark, d).groupBy("wallet").agg(F.count("*").alias("bets"), closed.alias("closed"), F.count_if(c("realized") > 0).alias("wins"), F.sum("realized").alias("pnl"), spent.alias("invested"), (F.sum("realized") / F.nullif(spent, F.lit(0)) * 100).alias("roi"), (F.sum("realized") / F.nullif(closed, F.lit(0))).alias("average"), (closed >= RELIABLE).alias("reliable"))


@query("A07_category_stats", "SELECT wallet, category, sum(bets)::BIGINT AS bets, sum(wins)::BIGINT AS wins, sum(staked)::BIGINT AS staked, sum(pnl)::BIGINT AS pnl FROM (SELECT wallet, CASE WHEN count(*) < 3 THEN 'Other' ELSE category END AS category, count(*) AS bets, count(*) FILTER (realized > 0) AS wins, sum(bought) AS staked, sum(realized) AS pnl FROM v_positions WHERE realized <> 0 GROUP BY wallet, v_positions.category) GROUP BY ALL")
def category_stats(spark: SparkSession, d: str) -> DataFrame:
    """Per wallet and category; categories of fewer than three bets are one, Other."""
    fine = positions(spark, d).where("realized <> 0").groupBy("wallet", "category").agg(F.count("*").alias("bets"), F.count_if(c("realized") > 0).alias("wins"), F.sum("bought").alias("staked"), F.sum("realized").alias("pnl"))
    coarse = F.when(c("bets") < 3, "Other").otherwise(c("category")).alias("category")
    return fine.groupBy("wallet", coarse).agg(*(F.sum(x).alias(x) for x in ("bets", "wins", "staked", "pnl")))


@query("A11_average_ev", "SELECT wallet, floor(avg((condition % 2 * 100 - (1 + condition % 90)) / (1 + condition % 90)) * 1000000 + 0.5) / 1000000.0::DOUBLE AS average_ev FROM v_positions GROUP BY wallet")
def average_ev(spark: SparkSession, d: str) -> DataFrame:
    """Mean of (payout - entry) / entry over resolved bets, in cents."""
    entry = 1 + c("condition") % 90
    x = F.avg((c("condition") % 2 * 100 - entry) / entry)
    return positions(spark, d).groupBy("wallet").agg((F.floor(x * 1_000_000 + 0.5) / F.lit(1_000_000.0)).alias("average_ev"))


@query("A13_pnl_signs", "SELECT wallet, count(*) AS total, count(*) FILTER (realized > 0) AS positive, count(*) FILTER (realized < 0) AS negative, count(*) FILTER (realized = 0) AS zero, count(*) FILTER (realized < 0 AND NOT redeemable) AS negative_not_redeemable FROM v_positions GROUP BY wallet")
def pnl_signs(spark: SparkSession, d: str) -> DataFrame:
    x = c("realized")
    return positions(spark, d).groupBy("wallet").agg(F.count("*").alias("total"), F.count_if(x > 0).alias("positive"), F.count_if(x < 0).alias("negative"), F.count_if(x == 0).alias("zero"), F.count_if((x < 0) & ~c("redeemable")).alias("negative_not_redeemable"))


TERMINAL = 0.001
_TERM = "(price <= 0.001 OR price >= 0.999)"


def settled():
    return (c("status") != "CLOSED") & ((c("price") <= TERMINAL) | (c("price") >= 1 - TERMINAL))


@query("A14_M29_reconciled_pnl", f"SELECT wallet, sum(x)::BIGINT AS pnl, CASE WHEN abs(sum(total)) >= 1 THEN abs(sum(x) - sum(total)) / abs(sum(total)) * 100 END AS gap FROM (SELECT wallet, total, CASE WHEN status = 'CLOSED' THEN realized WHEN {_TERM} AND realized = 0 THEN total ELSE 0 END AS x FROM v_positions) GROUP BY wallet")
def reconciled_pnl(spark: SparkSession, d: str) -> DataFrame:
    x = F.when(c("status") == "CLOSED", c("realized")).when(settled() & (c("realized") == 0), c("total")).otherwise(0)
    head = F.abs(F.sum("total"))
    return positions(spark, d).withColumn("x", x).groupBy("wallet").agg(F.sum("x").alias("pnl"), F.when(head >= 1, F.abs(F.sum("x") - F.sum("total")) / head * 100).alias("gap"))


@query("A15_P21_profit_factor_rows", f"SELECT wallet, condition, CASE WHEN status = 'CLOSED' THEN realized ELSE total END AS pnl FROM v_positions WHERE status = 'CLOSED' OR ({_TERM} AND realized = 0)")
def profit_factor_rows(spark: SparkSession, d: str) -> DataFrame:
    closed = c("status") == "CLOSED"
    return positions(spark, d).where(closed | (settled() & (c("realized") == 0))).select("wallet", "condition", F.when(closed, c("realized")).otherwise(c("total")).alias("pnl"))


@query("A16_resolved_summary", f"SELECT status, count(*) AS n, sum(total)::BIGINT AS total, (list(price ORDER BY wallet, condition))[1:5] AS samples FROM v_positions WHERE status <> 'CLOSED' AND {_TERM} GROUP BY status")
def resolved_summary(spark: SparkSession, d: str) -> DataFrame:
    """Counts and the first five prices; the samples come from a top five per status, not from a list of all."""
    p = positions(spark, d).where(settled())
    first = p.withColumn("r", F.row_number().over(Window.partitionBy("status").orderBy("wallet", "condition"))).where("r <= 5")
    samples = first.groupBy("status").agg(F.array_sort(F.collect_list(F.struct("r", "price"))).alias("s")).select("status", c("s.price").alias("samples"))
    return p.groupBy("status").agg(F.count("*").alias("n"), F.sum("total").alias("total")).join(samples, "status").select("status", "n", "total", "samples")


@query("A17_closed_sum", "SELECT wallet, status, coalesce(sum(realized), 0)::BIGINT AS pnl FROM v_positions GROUP BY wallet, status")
def closed_sum(spark: SparkSession, d: str) -> DataFrame:
    return positions(spark, d).groupBy("wallet", "status").agg(F.coalesce(F.sum("realized"), F.lit(0)).alias("pnl"))


@query("A34_A50_portfolio_ev", "SELECT wallet, sum(realized * bought)::DOUBLE AS total_ev, sum(bought)::BIGINT AS allocation, count(*) AS positions FROM v_positions GROUP BY wallet")
def portfolio_ev(spark: SparkSession, d: str) -> DataFrame:
    return positions(spark, d).groupBy("wallet").agg(F.sum(c("realized") * c("bought")).cast("double").alias("total_ev"), F.sum("bought").alias("allocation"), F.count("*").alias("positions"))


@query("A35_A36_distribution", "SELECT category, count(*) AS n, min(realized) AS low, quantile_disc(realized, 0.1) AS p10, quantile_disc(realized, 0.25) AS p25, quantile_disc(realized, 0.5) AS p50, quantile_disc(realized, 0.75) AS p75, quantile_disc(realized, 0.9) AS p90, max(realized) AS high FROM v_positions GROUP BY category")
def distribution(spark: SparkSession, d: str) -> DataFrame:
    """Nearest-rank percentiles: the value of rank ceil(share * n), by counts of distinct values, so no group is sorted in one task's memory."""
    p = positions(spark, d).groupBy("category", "realized").agg(F.count("*").alias("m"))
    w = Window.partitionBy("category").orderBy("realized")
    up = p.withColumn("to", F.sum("m").over(w)).withColumn("n", F.sum("m").over(Window.partitionBy("category")))
    at = lambda q: F.min(F.when(c("to") >= F.ceil(F.round(c("n") * q, 9)), c("realized")))
    return up.groupBy("category").agg(F.sum("m").alias("n"), F.min("realized").alias("low"), *(at(q).alias(f"p{round(q * 100)}") for q in (0.1, 0.25, 0.5, 0.75, 0.9)), F.max("realized").alias("high"))


@query("A37_pearson", "SELECT category, floor(corr(realized, bought) * 1000000 + 0.5) / 1000000.0::DOUBLE AS r FROM v_positions GROUP BY category HAVING count(*) >= 3")
def pearson(spark: SparkSession, d: str) -> DataFrame:
    r = F.floor(F.corr("realized", "bought") * 1_000_000 + 0.5) / F.lit(1_000_000.0)
    return positions(spark, d).groupBy("category").agg(F.count("*").alias("n"), r.alias("r")).where("n >= 3").select("category", "r")


@query("A38_spearman", "SELECT category, floor(corr(a, b) * 1000000 + 0.5) / 1000000.0::DOUBLE AS r FROM (SELECT category, row_number() OVER (PARTITION BY category ORDER BY realized, wallet, condition) AS a, row_number() OVER (PARTITION BY category ORDER BY bought, wallet, condition) AS b FROM v_positions) GROUP BY category")
def spearman(spark: SparkSession, d: str) -> DataFrame:
    """Rank correlation within a category. Ranks are counted inside cells of values and shifted by what the cells below hold, so no task sorts a category."""
    ranked = positions(spark, d).select("category", "wallet", "condition", "realized", "bought")
    for x, to, width in (("realized", "a", 256), ("bought", "b", 256)):
        ranked = ranked.withColumn("cell", F.floor(c(x) / width))
        cells = ranked.groupBy("category", "cell").agg(F.count("*").alias("n"))
        below = F.coalesce(F.sum("n").over(Window.partitionBy("category").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        inside = F.row_number().over(Window.partitionBy("category", "cell").orderBy(x, "wallet", "condition"))
        ranked = ranked.withColumn("inside", inside).join(cells.select("category", "cell", below.alias("below")), ["category", "cell"]).withColumn(to, c("below") + c("inside")).drop("cell", "inside", "below")
    return ranked.groupBy("category").agg((F.floor(F.corr("a", "b") * 1_000_000 + 0.5) / F.lit(1_000_000.0)).alias("r"))


@query("A39_bootstrap", None)
def bootstrap(spark: SparkSession, d: str, times: int = 1000, seed: int = 7) -> DataFrame:
    """Pass rate over Poisson resamples of the wallets: each wallet counts with a Poisson(1) weight in each of them, drawn from its own hash."""
    rates = by_wallet(spark, d).select("wallet", (c("profit") > c("loss")).cast("int").alias("passed"))
    each = rates.withColumn("i", F.explode(F.sequence(F.lit(1), F.lit(times))))
    u = F.pmod(F.xxhash64("wallet", "i", F.lit(seed)), F.lit(1 << 40)) / float(1 << 40)
    weight = sum((F.when(u > x, 1).otherwise(0) for x in (0.36787944, 0.73575888, 0.91969860, 0.98101184, 0.99634015)), F.lit(0))
    per = each.groupBy("i").agg((F.sum(weight * c("passed")) / F.nullif(F.sum(weight), F.lit(0))).alias("rate"))
    return per.agg(F.avg("rate").alias("mean"), F.percentile("rate", 0.05).alias("p5"), F.percentile("rate", 0.95).alias("p95"), F.stddev_pop("rate").alias("std"))


@query("A40_leave_one_out", "SELECT greatest(CASE WHEN k > 0 THEN abs((k - 1) / (n - 1) - k / n) ELSE 0 END, CASE WHEN k < n THEN abs(k / (n - 1) - k / n) ELSE 0 END) AS swing, k / n AS rate FROM (SELECT count(*) AS n, count(*) FILTER (p > l) AS k FROM (SELECT wallet, sum(greatest(realized, 0)) AS p, sum(greatest(-realized, 0)) AS l FROM v_positions GROUP BY wallet))")
def leave_one_out(spark: SparkSession, d: str) -> DataFrame:
    """Closed form: without a passing wallet the rate is (k - 1) / (n - 1), without a failing one k / (n - 1)."""
    t = by_wallet(spark, d).agg(F.count("*").alias("n"), F.count_if(c("profit") > c("loss")).alias("k"))
    rate = c("k") / c("n")
    one = F.when(c("k") > 0, F.abs((c("k") - 1) / F.nullif(c("n") - 1, F.lit(0)) - rate)).otherwise(0.0)
    other = F.when(c("k") < c("n"), F.abs(c("k") / F.nullif(c("n") - 1, F.lit(0)) - rate)).otherwise(0.0)
    return t.select(F.greatest(one, other).alias("swing"), rate.alias("rate"))


@query("M53_cost_basis", "SELECT wallet, condition, CASE WHEN bought > 0 THEN bought::DOUBLE WHEN price > 0 AND condition % 11 > 0 THEN price * (condition % 11) ELSE greatest(total, 0)::DOUBLE END AS basis FROM v_positions")
def cost_basis(spark: SparkSession, d: str) -> DataFrame:
    size = c("condition") % 11
    basis = F.when(c("bought") > 0, c("bought").cast("double")).when((c("price") > 0) & (size > 0), c("price") * size).otherwise(F.greatest("total", F.lit(0)).cast("double"))
    return positions(spark, d).select("wallet", "condition", basis.alias("basis"))


@query("F25_profit_factor_text", "SELECT wallet, CASE WHEN pf IS NULL THEN 'No losses yet' ELSE printf('%.2f', floor(pf * 100 + 0.5) / 100.0::DOUBLE) END AS text FROM (SELECT wallet, sum(realized) FILTER (realized > 0) / nullif(-sum(realized) FILTER (realized < 0), 0) AS pf FROM v_positions GROUP BY wallet)")
def profit_factor_text(spark: SparkSession, d: str) -> DataFrame:
    pf = F.floor(c("profit_factor") * 100 + 0.5) / F.lit(100.0)
    return by_wallet(spark, d).select("wallet", F.coalesce(F.format_string("%.2f", pf), F.lit("No losses yet")).alias("x"), "profit_factor").select("wallet", F.when(c("profit_factor").isNull(), "No losses yet").otherwise(c("x")).alias("text"))


_VERDICT = "CASE WHEN profit + loss = 0 THEN 'UNKNOWN' WHEN positions < 3 THEN 'UNKNOWN' WHEN profit > loss AND win_rate >= 40 THEN 'PASS' ELSE 'FAIL' END"


@query("P28_P29_performance_verdict", f"SELECT wallet, {_VERDICT} AS verdict FROM ({_PF.format(k='wallet')})")
def performance_verdict(spark: SparkSession, d: str) -> DataFrame:
    v = F.when(c("profit") + c("loss") == 0, "UNKNOWN").when(c("positions") < 3, "UNKNOWN").when((c("profit") > c("loss")) & (c("win_rate") >= 40), "PASS").otherwise("FAIL")
    return by_wallet(spark, d).select("wallet", v.alias("verdict"))


@query("A23_A24_A25_confusion", f"SELECT gate, verdict, count(*) AS wallets, sum(profit)::BIGINT AS stake FROM (SELECT *, positions >= 10 AS gate, {_VERDICT} AS verdict FROM ({_PF.format(k='wallet')})) GROUP BY ALL")
def confusion(spark: SparkSession, d: str) -> DataFrame:
    v = performance_verdict(spark, d)
    g = by_wallet(spark, d).select("wallet", (c("positions") >= 10).alias("gate"), "profit")
    return g.join(v, "wallet").groupBy("gate", "verdict").agg(F.count("*").alias("wallets"), F.sum("profit").alias("stake"))


@query("J14_J15_directory", f"SELECT c_custkey AS wallet, c_mktsegment AS label, positions, profit_factor FROM customer JOIN ({_PF.format(k='wallet')}) ON lower(wallet::VARCHAR) = lower(c_custkey::VARCHAR) WHERE NOT limited OR wins > 0")
def directory(spark: SparkSession, d: str) -> DataFrame:
    names = spark.read.parquet(f"{d}/customer.parquet").select(c("c_custkey").alias("wallet"), c("c_mktsegment").alias("label"))
    return by_wallet(spark, d).where("not limited or wins > 0").join(names, "wallet").select("wallet", "label", "positions", "profit_factor")

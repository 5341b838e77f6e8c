"""A wallet's profit factor from its stored closed positions, where their sum agrees with what the venue says."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wagerlake.plans.evidence import finite
from wagerlake.plans.performance import LIMITED
from wagerlake.plans.titles import _LABEL, TITLES, _pick, badge, pick
from wagerlake.registry import query
from wagerlake.sources.carriers import positions

c = F.col


def _slice(label: Column, without_best: bool = False) -> Column:
    """A slice of additive sums n, up, down, wins, losses and best: without its best win, if it has one."""
    drop = F.lit(without_best) & (c("best") > 0)
    up, n, wins = (F.when(drop, c(x) - y).otherwise(c(x)) for x, y in (("up", c("best")), ("n", F.lit(1)), ("wins", F.lit(1))))
    per = lambda x: F.when(c("down") > 0, x / c("down"))
    decided = wins + c("losses")
    next_ = F.when(c("best") > 0, c("second") if without_best else c("best")).otherwise(0.0)
    return F.struct(
        label.alias("label"), n.alias("positions"), up.alias("profit"), c("down").alias("loss"), per(up).alias("profit_factor"), per(up - F.greatest(next_, F.lit(0.0))).alias("without_best"), (n < LIMITED).alias("limited"),
        wins.alias("wins"), c("losses"), F.when(decided > 0, wins / decided * 100).alias("win_rate"),
    )


def stored_profit_factor(closed: DataFrame, sync: DataFrame) -> DataFrame:
    """A row for each wallet of sync (wallet, passed, headline, gap, closed_sum) from closed (wallet, realized, title, category).

    Unverified wallets (passed is not true) have no slices, but what sync knows; wallets without stored positions are unavailable as well. Labels are the category, or else
    the badge of the title; positions without either count in the whole only. Positions without a finite profit don't count. Categories are ordered by
    positions, then label. The net is the venue's headline, or else profit less loss.
    """
    blank = lambda x: F.trim(F.coalesce(x, F.lit(""))) == ""
    label = F.when(~blank("category"), F.trim("category")).when(~blank("title"), badge(c("title"))["label"])
    r = c("realized")
    sums = closed.withColumn("label", label).groupBy("wallet", "label").agg(
        F.count("*").alias("stored"), F.count_if(finite(r)).alias("n"), F.coalesce(F.sum(F.when(finite(r) & (r > 0), r)), F.lit(0.0)).alias("up"), F.coalesce(F.sum(F.when(finite(r) & (r < 0), -r)), F.lit(0.0)).alias("down"),
        F.count_if(finite(r) & (r > 0)).alias("wins"), F.count_if(finite(r) & (r < 0)).alias("losses"), F.max(F.when(finite(r), r)).alias("best"),
    )
    # the second largest profit of a wallet, for the slice without its best trade; distinct profits with their counts, so copies of one are no rows of their own
    wins = closed.where(finite(r) & (r > 0)).groupBy("wallet", "realized").agg(F.count("*").alias("times"))
    best = wins.groupBy("wallet").agg(F.max(F.struct("realized", "times")).alias("best"))
    below = wins.join(best, "wallet").groupBy("wallet").agg(F.first("best").alias("best"), F.max(F.when(r < c("best.realized"), r)).alias("below"))
    second = below.select("wallet", F.when(c("best.times") > 1, c("best.realized")).otherwise(F.coalesce("below", F.lit(0.0))).alias("second"))
    zero = F.lit(0.0)
    of_label = sums.where("label is not null and n > 0").withColumn("second", zero).withColumn("best", F.coalesce("best", zero)).withColumn("s", _slice(c("label")))
    labels = of_label.groupBy("wallet").agg(F.array_sort(F.collect_list(F.struct((-c("n")).alias("by"), c("label"), c("s")))).alias("x")).select("wallet", F.transform("x", lambda e: e["s"]).alias("categories"))
    whole = sums.groupBy("wallet").agg(*(F.sum(x).alias(x) for x in ("stored", "n", "up", "down", "wins", "losses")), F.coalesce(F.max("best"), zero).alias("best"))
    whole = whole.join(second, "wallet", "left").withColumn("second", F.coalesce("second", zero)).select("wallet", "stored", _slice(F.lit("All")).alias("overall"), _slice(F.lit("All (ex. best trade)"), True).alias("ex_best"))
    out = sync.join(whole, "wallet", "left").join(labels, "wallet", "left")
    passed = F.coalesce("passed", F.lit(False))
    verified = passed & c("overall").isNotNull()
    show = lambda x: F.when(verified, x)
    return out.select(
        "wallet", F.when(verified, "verified").otherwise("unavailable").alias("availability"), show(c("overall")).alias("overall"), show(c("ex_best")).alias("ex_best"), F.when(verified, F.coalesce("categories", F.array().cast(labels.schema["categories"].dataType))).alias("categories"),
        F.when(verified, F.coalesce("headline", c("overall.profit") - c("overall.loss"))).when(~passed, c("closed_sum")).alias("net"), F.when(verified | ~passed, c("headline")).alias("headline"), F.when(verified | ~passed, c("gap")).alias("gap"),
    )


_SLICE = "count(*) AS n, coalesce(sum(r) FILTER (r > 0), 0) AS up, coalesce(-sum(r) FILTER (r < 0), 0) AS down, count(*) FILTER (r > 0) AS wins, count(*) FILTER (r < 0) AS losses, greatest(coalesce(max(r), 0), 0) AS best"


@query("C11_stored_profit_factor", f"""WITH p AS (SELECT wallet, realized / 100.0::DOUBLE AS r, CASE WHEN condition % 5 > 1 THEN trim(category) WHEN condition % 5 = 1 AND trim(t) <> '' THEN {_LABEL} END AS label FROM (SELECT *, lower({_pick(TITLES, 'condition')}) AS t FROM v_positions) WHERE status = 'CLOSED'),
s AS (SELECT DISTINCT wallet FROM v_positions), w AS (SELECT wallet, {_SLICE} FROM p GROUP BY wallet), l AS (SELECT wallet, label, {_SLICE} FROM p WHERE label IS NOT NULL GROUP BY ALL),
k AS (SELECT wallet, list(label || ':' || n || ':' || coalesce((floor(up / nullif(down, 0) * 1000000 + 0.5) / 1000000 * 1000000)::BIGINT::VARCHAR, '-') ORDER BY n DESC, label) AS categories FROM l GROUP BY wallet),
e AS (SELECT wallet, max(r) AS second FROM (SELECT wallet, r, row_number() OVER (PARTITION BY wallet ORDER BY r DESC) AS i FROM p) WHERE i = 2 AND r > 0 GROUP BY wallet),
j AS (SELECT s.wallet, s.wallet % 3 > 0 AS passed, CASE WHEN s.wallet % 4 > 0 THEN (s.wallet % 1000)::DOUBLE END AS headline, (s.wallet % 7) / 10.0::DOUBLE AS gap, w.* EXCLUDE (wallet), w.n IS NOT NULL AND s.wallet % 3 > 0 AS ok, coalesce(second, 0) AS second, categories FROM s LEFT JOIN w USING (wallet) LEFT JOIN e USING (wallet) LEFT JOIN k USING (wallet))
SELECT wallet, CASE WHEN ok THEN 'verified' ELSE 'unavailable' END AS availability, CASE WHEN ok THEN n END AS positions, CASE WHEN ok THEN floor(up / nullif(down, 0) * 1000000 + 0.5) / 1000000 END AS profit_factor, CASE WHEN ok THEN floor((up - best) / nullif(down, 0) * 1000000 + 0.5) / 1000000 END AS ex_best,
 CASE WHEN ok THEN floor((up - best - CASE WHEN best > 0 THEN second ELSE 0 END) / nullif(down, 0) * 1000000 + 0.5) / 1000000 END AS ex_two, CASE WHEN ok THEN floor(wins / nullif(wins + losses, 0) * 100 * 1000000 + 0.5) / 1000000 END AS win_rate, CASE WHEN ok THEN n - (best > 0)::INT < 30 END AS limited, CASE WHEN ok THEN coalesce(categories, []) END AS categories,
 floor(CASE WHEN ok THEN coalesce(headline, up - down) WHEN NOT passed THEN wallet % 500 END * 1000000 + 0.5) / 1000000 AS net, CASE WHEN ok OR NOT passed THEN headline END AS headline, CASE WHEN ok OR NOT passed THEN gap END AS gap FROM j""")
def stored_factors(spark: SparkSession, d: str) -> DataFrame:
    """Profit factors of all wallets from closed positions, some of which have a title only, or neither title nor category."""
    p, cond, w = positions(spark, d), c("condition"), c("wallet")
    closed = p.where("status = 'CLOSED'").select("wallet", (c("realized") / F.lit(100.0)).alias("realized"), F.when(cond % 5 == 1, pick(TITLES, cond)).otherwise(" ").alias("title"), F.when(cond % 5 > 1, c("category")).alias("category"))
    sync = p.select("wallet").distinct().select("wallet", (w % 3 > 0).alias("passed"), F.when(w % 4 > 0, (w % 1000).cast("double")).alias("headline"), (w % 7 / F.lit(10.0)).alias("gap"), (w % 500).cast("double").alias("closed_sum"))
    out = stored_profit_factor(closed, sync)
    six = lambda x: F.floor(x * 1_000_000 + 0.5) / 1_000_000
    line = lambda s: F.concat_ws(":", s["label"], s["positions"], F.coalesce(F.floor(s["profit_factor"] * 1_000_000 + 0.5).cast("string"), F.lit("-")))
    return out.select(
        "wallet", "availability", "overall.positions", six(c("overall.profit_factor")).alias("profit_factor"), six(c("overall.without_best")).alias("ex_best"), six(c("ex_best.without_best")).alias("ex_two"), six(c("overall.win_rate")).alias("win_rate"), c("ex_best.limited").alias("limited"),
        F.transform("categories", line).alias("categories"), six(c("net")).alias("net"), "headline", "gap",
    )

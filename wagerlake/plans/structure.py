"""Contracts of two venues on the same game by their structure: winner legs, totals of the same line, spreads; many pairs a game."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wagerlake.plans.titles import _CODE, _G, _MONTH, _S, _pick, parse_slug, parse_ticker, pick
from wagerlake.registry import query
from wagerlake.sources.carriers import table

c = F.col
#: Words and lines of totals, wording of draws, score of a structural pair, how close lines must be.
LINE, TOTALS = r"\b(?:o/u|over/under|over under|total|line)\s*(\d+(?:\.\d+)?)\b", ("o/u", "over/under", "over under", "total")
DRAW = r"\b(?:end|finish|result)(?:\s+\w+){0,6}\s+(?:in\s+)?(?:a\s+)?(?:draw|tie)\b|\b(?:draw|tie)\s*\?"
SCORE, NEAR = 0.95, 0.01


def number(text: Column, pattern: str, k: int = 1) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, k), F.lit(""))


def kind_of(text: Column) -> Column:
    """total, spread, moneyline or unknown, from lower-case text."""
    has = lambda *words: F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(text, w))
    return F.when(has(*TOTALS), "total").when(has("spread"), "spread").when(has("advance", "winner"), "moneyline").otherwise("unknown")


def slug_contract(slug: Column, title: Column, g: Column) -> Column:
    """g is parse_slug(slug). Game (date, a, b: teams in order), kind, line and leg of a contract with a game's slug; null without one. A leg is a team's code or draw, null if open."""
    low = F.lower(F.trim(slug))
    corpus = F.concat_ws(" ", low, F.lower(F.coalesce(title, F.lit(""))))
    suffix = F.coalesce(g["suffix"], F.lit(""))
    inferred = kind_of(F.concat_ws(" ", suffix, corpus))
    direct = g["outcome"].isNotNull()
    kind = F.when(direct, "moneyline").when((inferred == "unknown") & (suffix != ""), "moneyline").otherwise(inferred)
    leg = F.when(g["outcome"] == "draw", "draw").when(g["outcome"] == "team_a", g["team_a"]).when(g["outcome"] == "team_b", g["team_b"]).when((kind == "moneyline") & ((suffix == "tie") | F.coalesce(F.lower(title).rlike(DRAW), F.lit(False))), "draw")
    point, dash = r"(\d+)pt(\d+)", r"(?:total|spread)-(\d+)-(\d+)"
    joined = lambda p: F.when(suffix.rlike(p), F.concat(F.regexp_extract(suffix, p, 1), F.lit("."), F.regexp_extract(suffix, p, 2)))
    line = F.coalesce(number(corpus, LINE), joined(point), joined(dash), number(suffix, LINE)).cast("double")
    return F.when(g.isNotNull(), F.struct(g["date"].alias("date"), F.least(g["team_a"], g["team_b"]).alias("a"), F.greatest(g["team_a"], g["team_b"]).alias("b"), kind.alias("kind"), F.when(~direct, line).alias("line"), F.when(kind == "moneyline", leg).alias("leg")))


def ticker_contract(ticker: Column, g: Column) -> Column:
    """g is parse_ticker(ticker). The same of a ticker that names a game: its kind is that of the series, its line T35 or 35 for 3.5, its leg a team in the other venue's code or draw."""
    last = F.upper(F.get(F.split(ticker, "-"), F.lit(2)))
    series = F.regexp_replace(F.upper(g["series"]), "^KX", "")
    has = lambda w: F.contains(series, F.lit(w))
    kind = F.when(has("TOTAL"), "total").when(has("SPREAD"), "spread").when(has("SCORE"), "score").when(has("GAME") | (series == "WC"), "moneyline").otherwise("unknown")
    raw = F.regexp_extract(last, r"^T?(\d+)$", 1)
    tenths = raw.try_cast("double") / 10
    line = F.when(last.rlike(r"^T\d+$"), tenths).when(last.rlike(r"^\d{1,3}$"), F.when(tenths < 1, tenths * 10).otherwise(tenths))
    leg = F.when(last == "TIE", "draw").when(g["outcome"] == "team_a", g["team_a"]).when(g["outcome"] == "team_b", g["team_b"])
    return F.when(g.isNotNull(), F.struct(g["date"].alias("date"), F.least(g["team_a"], g["team_b"]).alias("a"), F.greatest(g["team_a"], g["team_b"]).alias("b"), kind.alias("kind"), line.alias("line"), F.when(kind == "moneyline", leg).alias("leg")))


def structural_pairs(slugs: DataFrame, tickers: DataFrame) -> DataFrame:
    """slug, ticker, kind, line, score of all pairs of slugs (slug, title) and tickers (ticker) on one game, of one kind.

    Winners need the same leg, totals lines less than 0.01 apart; spreads and kinds unknown on both sides need no more than the game. A slug or ticker that comes twice counts
    once, a slug with the least of its titles. All of it is one equi-join: on the game, the kind, and the leg or the line's bucket, of which a total stands in three.
    """
    s = slugs.where("slug is not null").groupBy("slug").agg(F.min("title").alias("title")).withColumn("p", parse_slug(c("slug"))).where("p is not null").withColumn("g", slug_contract(c("slug"), c("title"), c("p"))).select("slug", "g.*")
    t = tickers.where("ticker is not null").select("ticker").distinct().withColumn("p", parse_ticker(c("ticker"))).where("p is not null").withColumn("g", ticker_contract(c("ticker"), c("p"))).select("ticker", c("g.line").alias("other"), *(c(f"g.{x}").alias(x) for x in ("date", "a", "b", "kind", "leg")))
    usable = ((c("kind") != "moneyline") | c("leg").isNotNull()) & (c("kind") != "score")
    bucket = lambda line: F.round(line / NEAR).cast("long")
    at = lambda line: F.when(c("kind") == "total", bucket(line).cast("string")).when(c("kind") == "moneyline", c("leg")).otherwise("")
    near = F.when(c("kind") == "total", F.transform(F.sequence(bucket(c("line")) - 1, bucket(c("line")) + 1), lambda x: x.cast("string"))).otherwise(F.array(at(c("line"))))
    left = s.where(usable).withColumn("at", F.explode(near)).drop("leg")
    right = t.where(usable).withColumn("at", at(c("other"))).where("at is not null").drop("leg")
    met = left.join(right, ["date", "a", "b", "kind", "at"])
    return met.where((c("kind") != "total") | (F.abs(c("line") - c("other")) < NEAR)).select("slug", "ticker", "kind", F.when(c("kind") == "total", c("line")).alias("line"), F.lit(SCORE).alias("score"))


_DATES = ("11", "12", "13")
_SUFFIX = ("deu", "draw", "total-2-5", "total-3pt5", "spread-1-5", "more", "", "over/under 2.5", "mex")
_SERIES = ("KXGAME", "KXWCTOTAL", "KXWCSPREAD", "KXWCSCORE", "KXOTHER", "KXWC")
_LAST = ("GER", "TIE", "T25", "35", "MEX", "T5", "2")


@query("J06_structural_pairs", rf"""WITH s AS (SELECT DISTINCT 'fifa-mex-deu-2026-06-' || ({list(_DATES)!r})[p_partkey % 3 + 1] || CASE WHEN x = '' THEN '' ELSE '-' || x END AS slug FROM (SELECT p_partkey, {_pick(_SUFFIX, 'p_partkey // 3')} AS x FROM part)),
t AS (SELECT DISTINCT {_pick(_SERIES, 'p_partkey // 7')} || '-26JUN' || ({list(_DATES)!r})[p_partkey % 3 + 1] || 'GERMEX-' || {_pick(_LAST, 'p_partkey')} AS ticker FROM part),
sg AS (SELECT slug, regexp_extract(slug, {_S}, 4) AS date, regexp_extract(slug, {_S}, 5) AS x FROM s), sk AS (SELECT *, CASE WHEN x IN ('deu', 'mex', 'draw') THEN 'moneyline' WHEN contains(slug, 'total') OR contains(slug, 'over/under') THEN 'total' WHEN contains(slug, 'spread') THEN 'spread' WHEN x <> '' THEN 'moneyline' ELSE 'unknown' END AS kind,
 CASE WHEN x IN ('deu', 'mex', 'draw') THEN x END AS leg, CASE x WHEN 'total-2-5' THEN 2.5 WHEN 'total-3pt5' THEN 3.5 WHEN 'over/under 2.5' THEN 2.5 END::DOUBLE AS line FROM sg),
tp AS (SELECT ticker, string_split(ticker, '-') AS p FROM t), tg AS (SELECT ticker, p[1] AS series, p[3] AS last, '20' || regexp_extract(p[2], {_G}, 1) || '-' || lpad({_MONTH}::VARCHAR, 2, '0') || '-' || regexp_extract(p[2], {_G}, 3) AS date FROM (SELECT *, regexp_extract(p[2], {_G}, 2) AS mon FROM tp)),
tk AS (SELECT *, CASE WHEN contains(series, 'TOTAL') THEN 'total' WHEN contains(series, 'SPREAD') THEN 'spread' WHEN contains(series, 'SCORE') THEN 'score' WHEN contains(series, 'GAME') OR series = 'KXWC' THEN 'moneyline' ELSE 'unknown' END AS kind, CASE last WHEN 'TIE' THEN 'draw' WHEN 'GER' THEN {_CODE.format("'GER'")} WHEN 'MEX' THEN 'mex' END AS leg,
 CASE last WHEN 'T25' THEN 2.5 WHEN '35' THEN 3.5 WHEN 'T5' THEN 0.5 WHEN '2' THEN 2 END::DOUBLE AS line FROM tg)
SELECT slug, ticker, sk.kind, CASE WHEN sk.kind = 'total' THEN sk.line END AS line, 0.95::DOUBLE AS score FROM sk JOIN tk ON sk.date = tk.date AND sk.kind = tk.kind AND CASE sk.kind WHEN 'moneyline' THEN sk.leg = tk.leg WHEN 'total' THEN abs(sk.line - tk.line) < 0.01 ELSE true END""")
def structural(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of contracts on three games of two teams, of all kinds of slugs and tickers."""
    k = c("p_partkey")
    part, half = table(spark, d, "part"), lambda n: F.floor(c("p_partkey") / n).cast("long")
    suffix, day = pick(_SUFFIX, half(3)), pick(_DATES, k)
    s = part.select(F.concat(F.lit("fifa-mex-deu-2026-06-"), day, F.when(suffix == "", "").otherwise(F.concat(F.lit("-"), suffix))).alias("slug"), F.lit(None).cast("string").alias("title"))
    t = part.select(F.concat(pick(_SERIES, half(7)), F.lit("-26JUN"), day, F.lit("GERMEX-"), pick(_LAST, k)).alias("ticker"))
    return structural_pairs(s, t)

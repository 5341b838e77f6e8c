"""Positions in plain words: which side a YES, a NO or a named outcome backs, by the declared outcomes, the title or the slug of its market."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wagerlake.plans.countries import COUNTRIES
from wagerlake.plans.titles import GAME_SLUGS, _pick, parse_slug, pick
from wagerlake.registry import query
from wagerlake.sources.carriers import spread, table

c = F.col
#: How titles name two sides, and what makes one a question of who wins.
VERSUS = r"(?i)^(.+?)\s+vs\.?\s+(.+?)(?:\?|:|\s+winner|\s+to\s+win|$)"
WINNER = (r"(?i)\b(?:match\s+)?winner\b", r"(?i)\bto\s+win\b", r"(?i)^who\s+will\s+win\b", r"(?i)^[^:?]+\s+vs\.?\s+[^:?]+\s*\??\s*$")
WILL = r"(?i)^Will\s+(.+?)\?$"
#: The first readable name of each code of a slug; other codes are shown in capitals.
TEAM_NAMES = {code: name for name, code in reversed(COUNTRIES.items()) if len(name) > 2 and name != code and "-" not in name and not re.fullmatch(r"[a-z]{2,4}", name)}


def stripped(x: Column) -> Column:
    return F.regexp_replace(x, r"^\s+|\s+$", "")


def titled(x: Column) -> Column:
    return F.concat(F.upper(F.substring(x, 1, 1)), F.substring(x, 2, 2**30))


def label(x: Column) -> Column:
    """A side's name without question marks, dashes at its end and a leading the; null if nothing or an address is left."""
    s = F.regexp_replace(F.regexp_replace(stripped(x), r"\?+$", ""), r"\s*[-–—]+\s*$", "")
    s = stripped(F.regexp_replace(s, r"(?i)^the\s+", ""))
    return F.when((s != "") & ~s.rlike(r"(?i)^0x[a-f0-9]+$"), titled(s))


def plain(x: Column) -> Column:
    return F.regexp_replace(F.lower(stripped(x)), r"\s+", " ")


def token(outcome: Column) -> Column:
    """YES, NO or NAMED."""
    s = plain(outcome)
    return F.when(s.isin("yes", "true"), "YES").when(s.isin("no", "false"), "NO").otherwise("NAMED")


def same_name(a: Column, b: Column) -> Column:
    x, y = plain(a), plain(b)
    return F.coalesce((x != "") & (y != "") & (F.contains(x, y) | F.contains(y, x)), F.lit(False))


def team(code: Column) -> Column:
    names = F.create_map(*(F.lit(x) for kv in TEAM_NAMES.items() for x in kv))
    return F.coalesce(titled(F.element_at(names, code)), F.when(code.rlike("^[a-z0-9]{2,8}$"), F.upper(code)))


def both(a: Column, b: Column) -> Column:
    return F.when(a.isNotNull() & b.isNotNull(), F.struct(a.alias("a"), b.alias("b")))


def exit_by(end: Column) -> Column:
    """Exit by and the UTC date of an ISO time; null without one."""
    day = F.when(stripped(end) != "", stripped(end).try_cast("timestamp"))
    return F.when(day.isNotNull(), F.concat(F.lit("Exit by "), F.date_format(day, "MMM d, yyyy")))


def translated(markets: DataFrame) -> DataFrame:
    """markets (title, slug, event_slug, outcomes, end_date, outcome, side) with backing, side_name, exit_by, used_fallback.

    The sides are two declared outcomes that aren't yes and no, or else those of a title that asks who wins, or else the teams of a game's slug; YES backs the first, NO the second,
    a name the one it fits. Without sides YES backs the subject of a "Will ...?" title and a name itself. What can't be said so, NO without sides above all, falls
    back to "bought" or "sold" with the title. Nulls count as empty texts.
    """
    text = lambda x: F.coalesce(c(x), F.lit(""))
    title, first, second = text("title"), F.get("outcomes", F.lit(0)), F.get("outcomes", F.lit(1))
    named = (F.size(F.coalesce("outcomes", F.array().cast("array<string>"))) == 2) & (token(F.coalesce(first, F.lit(""))) == "NAMED") & (token(F.coalesce(second, F.lit(""))) == "NAMED")
    m = markets.withColumn("_declared", F.when(named, both(label(first), label(second))))
    asks = stripped(title) != ""
    asks = asks & F.reduce(F.array(*(stripped(title).rlike(r) for r in WINNER)), F.lit(False), lambda x, y: x | y)
    side = lambda k: F.nullif(F.regexp_extract(title, VERSUS, k), F.lit(""))
    m = m.withColumn("_titled", F.when(asks, both(label(side(1)), label(side(2)))))
    m = m.withColumn("_game", parse_slug(F.coalesce("slug", "event_slug", F.lit(""))))
    m = m.withColumn("_sides", F.coalesce("_declared", "_titled", both(team(c("_game.team_a")), team(c("_game.team_b")))))
    m = m.withColumn("_token", token(text("outcome"))).withColumn("_named", label(text("outcome")))
    a, b = c("_sides.a"), c("_sides.b")
    fits = lambda x: same_name(text("outcome"), x)
    clean = lambda x: same_name(c("_named"), x)
    of_name = F.when(fits(a), a).when(fits(b), b).when(clean(a), a).when(clean(b), b)
    told = F.when(c("_sides").isNotNull(), F.when(c("_token") == "YES", a).when(c("_token") == "NO", b).otherwise(of_name))
    subject = label(F.nullif(F.regexp_extract(stripped(title), WILL, 1), F.lit("")))
    told = F.when(c("_sides").isNotNull(), told).when(c("_token") == "YES", subject).when(c("_token") == "NAMED", c("_named"))
    m = m.withColumn("_told", told)
    rest = stripped(F.regexp_replace(F.regexp_replace(stripped(title), r"\?+$", ""), r"(?i)^Will\s+", ""))
    word = F.when(c("_token") == "YES", "yes").when(c("_token") == "NO", "no").otherwise(F.lower(F.coalesce("_named", stripped(text("outcome")))))
    verb = F.when(c("side") == "SELL", "sold").otherwise("bought")
    known = c("_told").isNotNull()
    return m.select(
        *markets.columns, F.when(known, F.concat(F.lit("Backing "), c("_told"))).otherwise(F.concat(verb, F.lit(" "), word)).alias("backing"), F.when(known, c("_told")).otherwise(F.when(rest == "", "market").otherwise(rest)).alias("side_name"),
        exit_by(c("end_date")).alias("exit_by"), (~known).alias("used_fallback"),
    )


_FORMS = ("{n} vs {t}", "Will {n} win?", "the {n} vs. {t} — Winner", "{n} vs {t}: Over 45.5", "Who will win, {n} vs {t}?", "{n} prices", "Will {n}", "")
_OUTCOMES = ("Yes", "no", "TRUE", "{n}", "The {t}?", "0xab12", " No ", "nobody")
_ENDS = ("2026-07-31T12:00:00.000Z", "2026-12-01", "soon", "", " ")


def _label_sql(x: str) -> str:
    s = rf"trim(regexp_replace(regexp_replace(regexp_replace(trim({x}), '\?+$', ''), '\s*[-–—]+\s*$', ''), '(?i)^the\s+', ''))"
    return rf"(CASE WHEN {s} <> '' AND NOT regexp_matches({s}, '(?i)^0x[a-f0-9]+$') THEN upper({s}[1]) || {s}[2:] END)"


def _token_sql(x: str) -> str:
    return f"(CASE WHEN lower(trim({x})) IN ('yes', 'true') THEN 'YES' WHEN lower(trim({x})) IN ('no', 'false') THEN 'NO' ELSE 'NAMED' END)"


def _fits_sql(x: str, y: str) -> str:
    return f"(trim({x}) <> '' AND (contains(lower(trim({x})), lower({y})) OR contains(lower({y}), lower(trim({x})))))"


def _form_sql(forms: tuple[str, ...], at: str) -> str:
    return f"replace(replace({_pick(forms, at)}, '{{n}}', n), '{{t}}', t)"


_S = r"'^([a-z0-9]+)-([a-z]{2,4})-([a-z]{2,4})-(\d{4}-\d{2}-\d{2})(?:-(.+))?$'"
_NAMES_SQL = "CASE {0} " + " ".join(f"WHEN '{k}' THEN '{v[0].upper() + v[1:].replace(chr(39), chr(39) * 2)}'" for k, v in TEAM_NAMES.items()) + " ELSE upper({0}) END"


@query("F13_plain_positions", rf"""WITH p AS (SELECT p_partkey AS market, string_split(p_name, ' ')[1] AS n, p_brand AS t FROM part),
m AS (SELECT market, n, t, {_form_sql(_FORMS, "market")} AS title, CASE WHEN market % 3 > 0 THEN {_pick(GAME_SLUGS, "market // 2")} END AS slug, market % 11 AS o, {_form_sql(_OUTCOMES, "market // 5")} AS outcome, market % 4 = 0 AS sold, {_pick(_ENDS, "market // 3")} AS e FROM p),
d AS (SELECT *, CASE WHEN o = 0 THEN ['Yes', 'No'] WHEN o = 1 THEN [n, 'the ' || t] WHEN o = 2 THEN [n, ' ? '] WHEN o = 3 THEN [n] END AS declared FROM m),
s AS (SELECT *, CASE WHEN len(declared) = 2 AND {_token_sql("declared[1]")} = 'NAMED' AND {_token_sql("declared[2]")} = 'NAMED' THEN {_label_sql("declared[1]")} END AS da, CASE WHEN len(declared) = 2 AND {_token_sql("declared[1]")} = 'NAMED' AND {_token_sql("declared[2]")} = 'NAMED' THEN {_label_sql("declared[2]")} END AS db,
 trim(title) <> '' AND ({" OR ".join(f"regexp_matches(trim(title), '{r}')" for r in WINNER)}) AS asks, {_label_sql(f"nullif(regexp_extract(title, '{VERSUS}', 1), '')")} AS ta, {_label_sql(f"nullif(regexp_extract(title, '{VERSUS}', 2), '')")} AS tb, lower(trim(coalesce(slug, ''))) AS g FROM d),
g AS (SELECT *, CASE WHEN regexp_matches(g, {_S}) THEN regexp_extract(g, {_S}, 2) END AS ga, CASE WHEN regexp_matches(g, {_S}) THEN regexp_extract(g, {_S}, 3) END AS gb FROM s),
b AS (SELECT *, CASE WHEN da IS NOT NULL AND db IS NOT NULL THEN [da, db] WHEN asks AND ta IS NOT NULL AND tb IS NOT NULL THEN [ta, tb] WHEN ga IS NOT NULL THEN [{_NAMES_SQL.format("ga")}, {_NAMES_SQL.format("gb")}] END AS sides, {_token_sql("outcome")} AS tok, {_label_sql("outcome")} AS named FROM g),
x AS (SELECT *, CASE WHEN sides IS NOT NULL THEN CASE WHEN tok = 'YES' THEN sides[1] WHEN tok = 'NO' THEN sides[2] WHEN {_fits_sql("outcome", "sides[1]")} THEN sides[1] WHEN {_fits_sql("outcome", "sides[2]")} THEN sides[2] WHEN {_fits_sql("named", "sides[1]")} THEN sides[1] WHEN {_fits_sql("named", "sides[2]")} THEN sides[2] END
 WHEN tok = 'YES' THEN {_label_sql(f"nullif(regexp_extract(trim(title), '{WILL}', 1), '')")} WHEN tok = 'NAMED' THEN named END AS told, trim(regexp_replace(regexp_replace(trim(title), '\?+$', ''), '(?i)^Will\s+', '')) AS rest, try_cast(nullif(trim(e), '') AS TIMESTAMP) AS day FROM b)
SELECT market, coalesce('Backing ' || told, CASE WHEN sold THEN 'sold ' ELSE 'bought ' END || CASE tok WHEN 'YES' THEN 'yes' WHEN 'NO' THEN 'no' ELSE lower(coalesce(named, trim(outcome))) END) AS backing, coalesce(told, nullif(rest, ''), 'market') AS side_name, 'Exit by ' || strftime(day, '%b %-d, %Y') AS exit_by, told IS NULL AS used_fallback FROM x""")
def plain_positions(spark: SparkSession, d: str) -> DataFrame:
    """Positions of made-up bets on the given parts: titles of eight forms around names of the table, slugs, outcomes and ends of all kinds."""
    k = c("p_partkey")
    p = spread(table(spark, d, "part"), "p_partkey").select(k, F.get(F.split("p_name", " "), F.lit(0)).alias("n"), c("p_brand").alias("t"))
    form = lambda forms, at: F.replace(F.replace(pick(forms, at), F.lit("{n}"), c("n")), F.lit("{t}"), c("t"))
    half = lambda n: F.floor(k / n).cast("long")
    o = k % 11
    declared = F.when(o == 0, F.array(F.lit("Yes"), F.lit("No"))).when(o == 1, F.array(c("n"), F.concat(F.lit("the "), c("t")))).when(o == 2, F.array(c("n"), F.lit(" ? "))).when(o == 3, F.array("n"))
    m = p.select(k.alias("market"), form(_FORMS, k).alias("title"), F.when(k % 3 > 0, pick(GAME_SLUGS, half(2))).alias("slug"), F.lit(None).cast("string").alias("event_slug"), declared.alias("outcomes"), pick(_ENDS, half(3)).alias("end_date"), form(_OUTCOMES, half(5)).alias("outcome"), F.when(k % 4 == 0, "SELL").otherwise("BUY").alias("side"))
    return translated(m).select("market", "backing", "side_name", "exit_by", "used_fallback")

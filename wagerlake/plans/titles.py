"""What titles, slugs and tickers say: categories, games, short-term markets, sides and lookup keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wagerlake.registry import query
from wagerlake.sources.carriers import spread, table, trades

c = F.col
#: Words that name a category, in the order in which categories are tried.
SPORTS = "mlb|marlins|pirates|vs\\.|nfl|nba|nhl|mls|fifa|world cup|goals|spread|soccer|o/u|wta|atp|tennis|yankees|dodgers|lakers|celtics"
ESPORTS = "lol|lec|lcs|lck|lpl|cs2|csgo|valorant|dota|dota2|esports|esport|vct|msi|worlds|blast|iem|esl|major|map\\s*[0-9]"
POLITICS = "congress|trump|election|senate|president|house|federal|fed |governor|primary|democrat|republican"
CULTURE = "oscar|grammy|movie|album|celebrity|tiktok|twitter|culture"
CRYPTO = "btc|eth|crypto|bitcoin|solana|token"
#: Words of a badge, its label and its tone, in the order in which badges are tried.
BADGES = (
    ("wta|tennis", "WTA", "sports"), ("atp", "ATP", "sports"), ("mlb|marlins|pirates|yankees|dodgers", "MLB", "sports"), ("nba|lakers|celtics", "NBA", "sports"), ("nfl", "NFL", "sports"), ("fifa|world cup|soccer", "SOCCER", "sports"),
    ("lol|lec|lcs|lck|lpl", "ESPORTS", "sports"), ("cs2|csgo|valorant|dota", "ESPORTS", "sports"), ("congress|house of representatives", "CONGRESS", "politics"), ("federal|fed chair|fed rate", "FEDERAL", "politics"),
    ("trump|biden|election|president|senate", "POLITICS", "politics"), ("oscar|grammy|celebrity", "CULTURE", "culture"),
)
TITLES = (
    "Marlins vs. Pirates", "Will Trump win the election?", "Best movie at the Oscars", "Bitcoin above 100k", "Rain in May", "WTA Rome final", "ATP: set spread", "Lakers o/u 220", "CS2: map 3 winner", "Fed rate in June", "House of Representatives control",
    "Solana ETF token", "LCK summer", "Grammy album of the year", "World Cup goals", "NFL draft", "Governor of Ohio", "Metropolitan opera", "", "US Senate primary", "Dota major", "Celebrity twitter feud", "Tennis: Yankees fan", "federal funds",
)
SLUGS = (
    "btc-updown-15m-1700000000", "will-btc-go-up-or-down 9:15AM - 9:30AM", "Bitcoin Up or Down - June 3, 10:00AM-10:15AM ET", "ethereum up or down on june 3", "eth up-down", "15m_updown sol", "updown-5min", "will-it-go-up-or-down-by-2030", "election-2028", "", "sol updown", "xrp-updown", "match 10:15 – 10:30",
)


def pick(xs: tuple[str, ...], key: Column) -> Column:
    return F.get(F.array(*map(F.lit, xs)), (key % len(xs)).cast("int"))


def _pick(xs: tuple[str, ...], key: str) -> str:
    return f"([{', '.join(repr(x) for x in xs)}])[({key}) % {len(xs)} + 1]"


def category(title: Column) -> Column:
    t = F.lower(title)
    return F.when(t.rlike(SPORTS) | t.rlike(ESPORTS), "SPORTS").when(t.rlike(POLITICS), "POLITICS").when(t.rlike(CULTURE), "CULTURE").when(t.rlike(CRYPTO), "CRYPTO").otherwise("MARKET")


_CATEGORY = f"CASE WHEN regexp_matches(t, '{SPORTS}') OR regexp_matches(t, '{ESPORTS}') THEN 'SPORTS' WHEN regexp_matches(t, '{POLITICS}') THEN 'POLITICS' WHEN regexp_matches(t, '{CULTURE}') THEN 'CULTURE' WHEN regexp_matches(t, '{CRYPTO}') THEN 'CRYPTO' ELSE 'MARKET' END"
_PARTS = f"SELECT p_partkey AS market, lower({_pick(TITLES, 'p_partkey')}) AS t FROM part"


@query("F02_category", f"SELECT market, {_CATEGORY} AS category FROM ({_PARTS})")
def categories(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(c("p_partkey").alias("market"), category(pick(TITLES, c("p_partkey"))).alias("category"))


def badge(title: Column) -> Column:
    """Label and tone of a title: its own badge, or else that of its category."""
    t, own = F.lower(title), category(title)
    out = None
    for words, label, tone in BADGES:
        hit = F.struct(F.lit(label).alias("label"), F.lit(tone).alias("tone"))
        out = F.when(t.rlike(words), hit) if out is None else out.when(t.rlike(words), hit)
    named = own.isin("SPORTS", "POLITICS", "CULTURE")
    return out.otherwise(F.struct(F.when(named, own).otherwise("MARKET").alias("label"), F.when(named, F.lower(own)).otherwise("default").alias("tone")))


_LABEL = "CASE " + " ".join(f"WHEN regexp_matches(t, '{w}') THEN '{label}'" for w, label, _ in BADGES) + f" WHEN {_CATEGORY} IN ('SPORTS', 'POLITICS', 'CULTURE') THEN {_CATEGORY} ELSE 'MARKET' END"
_TONE = "CASE " + " ".join(f"WHEN regexp_matches(t, '{w}') THEN '{tone}'" for w, _, tone in BADGES) + f" WHEN {_CATEGORY} IN ('SPORTS', 'POLITICS', 'CULTURE') THEN lower({_CATEGORY}) ELSE 'default' END"


@query("F03_category_badge", f"SELECT market, {_LABEL} AS label, {_TONE} AS tone FROM ({_PARTS})")
def badges(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(c("p_partkey").alias("market"), badge(pick(TITLES, c("p_partkey"))).alias("b")).select("market", "b.*")


#: Patterns of short-term crypto markets. An asset's up-or-down market; up-or-down words, which count beside a clock range; "updown" beside minutes.
ASSET_UP_DOWN = r"btc[- ]?up[- ]?down|bitcoin up or down|eth[- ]?up[- ]?down|ethereum up or down|sol[- ]?up[- ]?down"
UP_OR_DOWN = r"up[- ]?or[- ]?down"
CLOCK_RANGE = r"\d{1,2}:\d{2}\s*(am|pm)?\s*[-–]\s*\d{1,2}:\d{2}"
UPDOWN_MINUTES = r"updown[-_]?\d+m|\d+m[-_]updown|updown[-_]?\d+min"


def ephemeral(*texts: Column) -> Column:
    """Whether slug, event slug and title, joined by spaces, name a market that settles within minutes; nulls and empty texts don't count."""
    t = F.lower(F.concat_ws(" ", *(F.nullif(x, F.lit("")) for x in texts)))
    return t.rlike(ASSET_UP_DOWN) | (t.rlike(UP_OR_DOWN) & t.rlike(CLOCK_RANGE)) | t.rlike(UPDOWN_MINUTES)


@query("P20_ephemeral", f"""SELECT market, regexp_matches(t, '{ASSET_UP_DOWN}') OR (regexp_matches(t, '{UP_OR_DOWN}') AND regexp_matches(t, '{CLOCK_RANGE}')) OR regexp_matches(t, '{UPDOWN_MINUTES}') AS ephemeral
 FROM (SELECT p_partkey AS market, lower({_pick(SLUGS, 'p_partkey')}) AS t FROM part)""")
def ephemeral_markets(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(c("p_partkey").alias("market"), ephemeral(pick(SLUGS, c("p_partkey"))).alias("ephemeral"))


#: Team codes of one venue and of the other, where they differ; other codes are the same in lower case. A parameter of the parsers.
TEAM_CODES = {"GER": "deu", "NED": "nld", "SUI": "che", "POR": "prt"}
MONTHS = ("JAN", "FEB", "MAR", "APR", "MAY", "JUN", "JUL", "AUG", "SEP", "OCT", "NOV", "DEC")
TICKERS = ("KXGAME-26JUN11GERMEX-GER", "KXGAME-26JUN111930USANED-TIE", "KXGAME-26FOO11GERMEX-GER", "KXGAME-26DEC012599ARGPOR-POR", "KXGAME-26JUL04BRASUI-XYZ", "SHORT-ONE", "", "KXGAME-26JUL04BRASUI")
GAME_SLUGS = ("fifa-mex-deu-2026-06-11-deu", "fifa-usa-nld-2026-06-11-draw", "nba-lal-bos-2026-01-02", "FIFA-BRA-CHE-2026-07-04-bra", "total-goals-2026", "epl-ars-che-2026-13-01-total", " mls-mia-atl-2026-03-05-mia ", "")


def other_code(code: Column, codes: dict[str, str] = TEAM_CODES) -> Column:
    pairs = F.create_map(*(F.lit(x) for kv in codes.items() for x in kv))
    return F.coalesce(F.element_at(pairs, code), F.lower(code))


def parse_ticker(ticker: Column) -> Column:
    """series, date, kickoff (seconds, null if unknown), both teams in the other venue's codes and the outcome, of tickers that name a game; else null."""
    part, g = F.split(ticker, "-"), r"^(\d{2})([A-Z]{3})(\d{2})(\d{4})?([A-Z]{3})([A-Z]{3})$"
    mid = F.get(part, F.lit(1))
    at = lambda k: F.regexp_extract(mid, g, k)
    month = F.array_position(F.array(*map(F.lit, MONTHS)), at(2))
    date = F.concat(F.lit("20"), at(1), F.lit("-"), F.lpad(month.cast("string"), 2, "0"), F.lit("-"), at(3))
    hour, minute = F.substring(at(4), 1, 2).try_cast("int"), F.substring(at(4), 3, 2).try_cast("int")
    start = F.when((hour <= 23) & (minute <= 59), F.unix_date(date.try_cast("date")).cast("long") * 86400 + hour * 3600 + minute * 60)
    last = F.get(part, F.lit(2))
    outcome = F.when(last == "TIE", "draw").when(last == at(5), "team_a").when(last == at(6), "team_b")
    fields = F.struct(F.get(part, F.lit(0)).alias("series"), date.alias("date"), start.alias("kickoff"), other_code(at(5)).alias("team_a"), other_code(at(6)).alias("team_b"), outcome.alias("outcome"))
    return F.when((F.size(part) >= 3) & mid.rlike(g) & (month > 0), fields)


_CODE = "CASE {0} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in TEAM_CODES.items()) + " ELSE lower({0}) END"
_G = r"'^(\d{2})([A-Z]{3})(\d{2})(\d{4})?([A-Z]{3})([A-Z]{3})$'"
_MONTH = "list_position(['" + "', '".join(MONTHS) + "'], mon)"


@query("F07_F10_ticker", f"""SELECT market, series, date, CASE WHEN try_cast(hhmm[1:2] AS INT) <= 23 AND try_cast(hhmm[3:4] AS INT) <= 59 THEN epoch(date::DATE)::BIGINT + hhmm[1:2]::INT * 3600 + hhmm[3:4]::INT * 60 END::DOUBLE AS kickoff, {_CODE.format('a')} AS team_a, {_CODE.format('b')} AS team_b,
 CASE WHEN last = 'TIE' THEN 'draw' WHEN last = a THEN 'team_a' WHEN last = b THEN 'team_b' END AS outcome FROM (SELECT *, '20' || yy || '-' || lpad({_MONTH}::VARCHAR, 2, '0') || '-' || dd AS date FROM (
 SELECT market, s[1] AS series, s[3] AS last, regexp_extract(s[2], {_G}, 1) AS yy, regexp_extract(s[2], {_G}, 2) AS mon, regexp_extract(s[2], {_G}, 3) AS dd, regexp_extract(s[2], {_G}, 4) AS hhmm, regexp_extract(s[2], {_G}, 5) AS a, regexp_extract(s[2], {_G}, 6) AS b FROM (
 SELECT p_partkey AS market, string_split({_pick(TICKERS, 'p_partkey')}, '-') AS s FROM part) WHERE len(s) >= 3 AND regexp_matches(s[2], {_G})) WHERE coalesce({_MONTH}, 0) > 0)""")
def tickers(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "part").select(c("p_partkey").alias("market"), parse_ticker(pick(TICKERS, c("p_partkey"))).alias("g"))
    return t.where("g is not null").select("market", "g.*").withColumn("kickoff", c("kickoff").cast("double"))


def parse_slug(slug: Column) -> Column:
    """league, teams, date and suffix of a game's slug, with the outcome if the suffix is a team or a draw; null for other slugs."""
    s, g = F.lower(F.trim(slug)), r"^([a-z0-9]+)-([a-z]{2,4})-([a-z]{2,4})-(\d{4}-\d{2}-\d{2})(?:-(.+))?$"
    at = lambda k: F.regexp_extract(s, g, k)
    suffix = F.nullif(at(5), F.lit(""))
    outcome = F.when(suffix == "draw", "draw").when(suffix == at(2), "team_a").when(suffix == at(3), "team_b")
    return F.when(s.rlike(g), F.struct(at(1).alias("league"), at(2).alias("team_a"), at(3).alias("team_b"), at(4).alias("date"), suffix.alias("suffix"), outcome.alias("outcome")))


_S = r"'^([a-z0-9]+)-([a-z]{2,4})-([a-z]{2,4})-(\d{4}-\d{2}-\d{2})(?:-(.+))?$'"


@query("F08_F09_slug", f"""SELECT *, CASE WHEN suffix = 'draw' THEN 'draw' WHEN suffix = team_a THEN 'team_a' WHEN suffix = team_b THEN 'team_b' END AS outcome FROM (SELECT market, regexp_extract(s, {_S}, 1) AS league, regexp_extract(s, {_S}, 2) AS team_a, regexp_extract(s, {_S}, 3) AS team_b, regexp_extract(s, {_S}, 4) AS date,
 nullif(regexp_extract(s, {_S}, 5), '') AS suffix FROM (SELECT p_partkey AS market, lower(trim({_pick(GAME_SLUGS, 'p_partkey')})) AS s FROM part) WHERE regexp_matches(s, {_S}))""")
def slugs(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "part").select(c("p_partkey").alias("market"), parse_slug(pick(GAME_SLUGS, c("p_partkey"))).alias("g"))
    return t.where("g is not null").select("market", "g.*")


@query("J06_structural_match", f"""WITH k AS (SELECT p_partkey AS k, string_split({_pick(TICKERS, 'p_partkey')}, '-') AS s FROM part), kg AS (SELECT k, '20' || regexp_extract(s[2], {_G}, 1) || '-' || lpad({_MONTH.replace('mon', f"regexp_extract(s[2], {_G}, 2)")}::VARCHAR, 2, '0') || '-' || regexp_extract(s[2], {_G}, 3) AS date,
 {_CODE.format(f"regexp_extract(s[2], {_G}, 5)")} AS a, {_CODE.format(f"regexp_extract(s[2], {_G}, 6)")} AS b, s[3] AS last, regexp_extract(s[2], {_G}, 5) AS ka, regexp_extract(s[2], {_G}, 6) AS kb FROM k WHERE len(s) >= 3 AND regexp_matches(s[2], {_G}) AND coalesce({_MONTH.replace('mon', f"regexp_extract(s[2], {_G}, 2)")}, 0) > 0),
ko AS (SELECT date, a, b, CASE WHEN last = 'TIE' THEN 'draw' WHEN last = ka THEN a WHEN last = kb THEN b END AS leg, min(k) AS kalshi, count(*) AS n_kalshi FROM kg GROUP BY ALL),
p AS (SELECT p_partkey AS p, lower(trim({_pick(GAME_SLUGS, 'p_partkey')})) AS s FROM part), po AS (SELECT regexp_extract(s, {_S}, 4) AS date, regexp_extract(s, {_S}, 2) AS a, regexp_extract(s, {_S}, 3) AS b, nullif(regexp_extract(s, {_S}, 5), '') AS leg, min(p) AS polymarket, count(*) AS n_polymarket FROM p WHERE regexp_matches(s, {_S}) GROUP BY ALL)
SELECT ko.date AS date, ko.leg AS leg, kalshi, polymarket, n_kalshi, n_polymarket FROM ko JOIN po ON ko.date = po.date AND least(ko.a, ko.b) = least(po.a, po.b) AND greatest(ko.a, ko.b) = greatest(po.a, po.b) AND ko.leg = po.leg""")
def structural_match(spark: SparkSession, d: str) -> DataFrame:
    """Contracts of two venues on the same leg of the same game, whichever team comes first: an equi-join on date, team pair and leg, one row a leg."""
    part = table(spark, d, "part")
    leg = F.when(c("g.outcome") == "team_a", c("g.team_a")).when(c("g.outcome") == "team_b", c("g.team_b")).otherwise(c("g.outcome"))
    game = lambda t: t.where("g is not null").select("id", c("g.date").alias("date"), F.least("g.team_a", "g.team_b").alias("a"), F.greatest("g.team_a", "g.team_b").alias("b"), leg.alias("leg"))
    legs = lambda t, name: game(t).where("leg is not null").groupBy("date", "a", "b", "leg").agg(F.min("id").alias(name), F.count("*").alias(f"n_{name}"))
    k = legs(part.select(c("p_partkey").alias("id"), parse_ticker(pick(TICKERS, c("p_partkey"))).alias("g")), "kalshi")
    p = legs(part.select(c("p_partkey").alias("id"), parse_slug(pick(GAME_SLUGS, c("p_partkey"))).alias("g")), "polymarket")
    return k.join(p, ["date", "a", "b", "leg"]).select("date", "leg", "kalshi", "polymarket", "n_kalshi", "n_polymarket")


SIDES = ("Bought YES Lakers", "sold no. Celtics", "Backing Mexico", "bought Real Madrid", '"Brazil"', "yes", " No ", "", "Team that is competing in the cup", "A very long label that nobody would print", "One. Two", "Wait...", "Argentina", "SOLD Draw", "true")
#: Phrases of a description that ran on into the side.
RUN_ON = "is competing|will win|to win|in a match|prediction market|according to|currently|this season"


def clean_side(raw: Column, longest: int = 30) -> Column:
    """The bare selection of a side text, null if it is a plain yes or no, too long, or a sentence."""
    s = F.trim(raw)
    for verb in (r"(?i)^(?:bought|sold)\s+(?:yes|no)\.?\s*", r"(?i)^backing\s+", r"(?i)^(?:bought|sold)\s+"):
        s = F.regexp_replace(s, verb, "")
    s = F.trim(F.regexp_replace(s, "^[\"']|[\"']$", ""))
    bad = (s == "") | s.rlike(r"(?i)^(?:yes|no|true|false)$") | (F.length(s) > longest) | s.rlike(rf"(?i)\b(?:{RUN_ON})\b") | s.rlike(r"\.\s") | s.contains("...")
    return F.when(~bad, s)


@query("F20_clean_side", rf"""SELECT market, CASE WHEN NOT (s = '' OR regexp_matches(s, '(?i)^(yes|no|true|false)$') OR length(s) > 30 OR regexp_matches(s, '(?i)\b({RUN_ON})\b') OR regexp_matches(s, '\.\s') OR contains(s, '...')) THEN s END AS side FROM (
 SELECT market, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim(r), '^(bought|sold)\s+(yes|no)\.?\s*', '', 'i'), '^backing\s+', '', 'i'), '^(bought|sold)\s+', '', 'i'), '^["'']|["'']$', '', 'g')) AS s FROM (SELECT p_partkey AS market, {_pick(SIDES, 'p_partkey')} AS r FROM part))""")
def clean_sides(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(c("p_partkey").alias("market"), clean_side(pick(SIDES, c("p_partkey"))).alias("side"))


@query("F21_direction_label", f"SELECT k, CASE WHEN condition % 3 = 0 AND trim(l) <> '' AND NOT regexp_matches(trim(l), '(?i)^(yes|no|true|false)$') THEN CASE side WHEN 'SELL' THEN 'Exiting ' WHEN 'BUY' THEN 'Backing ' END || trim(l) END AS label FROM (SELECT *, {_pick(SIDES, 'condition')} AS l FROM v_trades)")
def direction_label(spark: SparkSession, d: str) -> DataFrame:
    """Backing or exiting a named selection; trades of the other venue, and yes or no alone, have no label."""
    label = F.trim(pick(SIDES, c("condition")))
    named = (c("condition") % 3 == 0) & (label != "") & ~label.rlike("(?i)^(?:yes|no|true|false)$")
    verb = F.when(c("side") == "SELL", "Exiting ").when(c("side") == "BUY", "Backing ")
    return trades(spark, d).select("k", F.when(named, F.concat(verb, label)).alias("label"))


@query("F23_lookup_aliases", "SELECT market, unnest(list_distinct(list_filter([nullif(trim(key), ''), 'pm:' || token, 'kalshi:' || ticker, 'pair:' || token || ':' || ticker], lambda x: x IS NOT NULL))) AS alias FROM (SELECT p_partkey AS market, CASE WHEN p_partkey % 4 > 0 THEN ' pm:0xab' || p_partkey || ' ' END AS key, CASE WHEN p_partkey % 3 > 0 THEN lower('0xAB' || p_partkey) END AS token, CASE WHEN p_partkey % 5 > 0 THEN upper('kx-' || p_partkey) END AS ticker FROM part)")
def lookup_aliases(spark: SparkSession, d: str) -> DataFrame:
    """Every key under which a contract may be looked up: its own, one a venue, and one for the pair; each once."""
    m = c("p_partkey")
    key, token, ticker = F.when(m % 4 > 0, F.concat(F.lit(" pm:0xab"), m, F.lit(" "))), F.when(m % 3 > 0, F.lower(F.concat(F.lit("0xAB"), m))), F.when(m % 5 > 0, F.upper(F.concat(F.lit("kx-"), m)))
    names = F.array(F.nullif(F.trim(key), F.lit("")), F.concat(F.lit("pm:"), token), F.concat(F.lit("kalshi:"), ticker), F.concat(F.lit("pair:"), token, F.lit(":"), ticker))
    return table(spark, d, "part").select(m.alias("market"), F.explode(F.array_distinct(F.array_compact(names))).alias("alias"))


@query("F24_event_hints", "SELECT condition, count(DISTINCT asset) AS assets, count(DISTINCT ts // 31536000) AS years, min(asset) AS first_asset FROM v_trades GROUP BY condition")
def event_hints(spark: SparkSession, d: str) -> DataFrame:
    """What is known of a condition from its events; distinct values are counted, not gathered, by tasks that each have a share of the conditions."""
    t = trades(spark, d).select("condition", "asset", F.floor(c("ts") / 31_536_000).alias("year"))
    each = spread(t, "condition", 16).distinct()  # dealt once: what follows stays in its task
    new = lambda x, by: (F.row_number().over(Window.partitionBy("condition", x).orderBy(by)) == 1) & c(x).isNotNull()
    each = each.select("condition", "asset", new("asset", "year").alias("new_asset"), new("year", "asset").alias("new_year"))
    return each.groupBy("condition").agg(F.count_if("new_asset").alias("assets"), F.count_if("new_year").alias("years"), F.min("asset").alias("first_asset"))

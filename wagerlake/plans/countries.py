"""Country names as titles spell them, to the codes of one venue's slugs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wagerlake.plans.titles import pick
from wagerlake.registry import query
from wagerlake.sources.carriers import spread, table

c = F.col
#: Names and their codes, in the order in which loose matches are tried.
COUNTRIES = {
    "portugal": "prt", "colombia": "col", "france": "fra", "norway": "nor", "spain": "esp", "uruguay": "uru", "england": "eng", "germany": "ger", "brazil": "bra", "argentina": "arg", "mexico": "mex", "usa": "usa", "united states": "usa", "japan": "jpn",
    "korea": "kor", "south korea": "kor", "netherlands": "ned", "belgium": "bel", "croatia": "cro", "switzerland": "sui", "canada": "can", "australia": "aus", "ghana": "gha", "senegal": "sen", "morocco": "mar", "tunisia": "tun", "egypt": "egy", "iran": "irn",
    "saudi arabia": "ksa", "qatar": "qat", "ecuador": "ecu", "cameroon": "cmr", "poland": "pol", "serbia": "srb", "denmark": "den", "sweden": "swe", "scotland": "sco", "wales": "wal", "panama": "pan", "paraguay": "par", "chile": "chi", "austria": "aut",
    "ukraine": "ukr", "turkey": "tur", "ivory coast": "civ", "cote d'ivoire": "civ", "côte d'ivoire": "civ", "algeria": "dza", "nigeria": "nga", "new zealand": "nzl", "south africa": "rsa", "jordan": "jor", "uzbekistan": "uzb", "iraq": "irq",
    "cape verde": "cpv", "haiti": "hti", "curacao": "cuw", "curaçao": "cuw", "bolivia": "bol", "peru": "per", "costa": "crc", "costa rica": "crc", "jamaica": "jam", "honduras": "hon", "slovakia": "svk", "slovenia": "svn", "czech republic": "cze", "czechia": "cze",
}
#: Further codes and names of some countries, and words that a team's name may have beside the country's.
ALIASES = {"sui": ("che", "switzerland"), "dza": ("alg", "algeria"), "irn": ("iri", "iran"), "cpv": ("cvi", "cape verde"), "uru": ("ury", "uruguay"), "crc": ("cos", "costa rica"), "ger": ("deu", "germany")}
NOISE = "national team|men|women|fc|cf|sc|the"
NAMES = (
    "Portugal", " South  Korea ", "southkorea", "Switzerland National Team", "CHE", "sui", "The Women of Ghana", "Côte d'Ivoire", "united states of america", "Kore", "Iran women", "New Zealand FC", "IRI", "xyz", "", "  ", "Costa Rica U21", "deu", "Atlantis", None,
    "Czech Republic", "men", "Republic of Iraq", "alg", "USA",
)


def plain(name: Column) -> Column:
    return F.lower(F.regexp_replace(F.trim(F.regexp_replace(name, r"\s+", " ")), " +", " "))


def country_code(name: Column, countries: dict[str, str] = COUNTRIES, aliases: dict[str, tuple[str, ...]] = ALIASES) -> Column:
    """Code of a country's or national team's name: the name itself (spaces aside) or a code; then without the words of NOISE; then the first country of which either name holds the other; then an alias.

    Null, blank and unknown names have none.
    """
    known = F.array(*(F.struct(F.lit(n).alias("name"), F.lit(n.replace(" ", "")).alias("tight"), F.lit(code).alias("code")) for n, code in countries.items()))
    first = lambda test: F.get(F.filter(known, test), 0)["code"]

    def direct(key: Column) -> Column:
        tight = F.replace(key, F.lit(" "), F.lit(""))
        return F.coalesce(first(lambda e: e["name"] == key), first(lambda e: e["tight"] == tight), first(lambda e: e["code"] == key))

    key = plain(name)
    loose = first(lambda e: F.contains(key, e["name"]) | F.contains(e["name"], key))
    other = F.coalesce(*(F.when(F.contains(key, F.lit(a)), code) for code, names in aliases.items() for a in names))
    return F.when(key != "", F.coalesce(direct(key), direct(plain(F.regexp_replace(name, rf"(?i)\b({NOISE})\b", " "))), loose, other))


_TABLE = ", ".join("({}, '{}', '{}')".format(i, n.replace("'", "''"), code) for i, (n, code) in enumerate(COUNTRIES.items()))
_ALIAS = ", ".join(f"({i}, '{a}', '{code}')" for i, (code, names) in enumerate(ALIASES.items()) for a in names)
_PLAIN = r"lower(trim(regexp_replace({}, '\s+', ' ', 'g')))"
_SAMPLES = "([" + ", ".join("NULL" if x is None else "'" + x.replace("'", "''") + "'" for x in NAMES) + f"])[p_partkey % {len(NAMES)} + 1]"


@query("F11_country_code", f"""WITH t(i, name, code) AS (VALUES {_TABLE}), s(i, alias, code) AS (VALUES {_ALIAS}), p AS (SELECT DISTINCT n, {_PLAIN.format('n')} AS k, {_PLAIN.format(f"regexp_replace(n, '(?i)\\b({NOISE})\\b', ' ', 'g')")} AS k2 FROM (SELECT {_SAMPLES} AS n FROM part)),
 f AS (SELECT n, coalesce((SELECT arg_min(code, i) FROM t WHERE name = k), (SELECT arg_min(code, i) FROM t WHERE replace(name, ' ', '') = replace(k, ' ', '')), (SELECT any_value(code) FROM t WHERE code = k),
 (SELECT arg_min(code, i) FROM t WHERE name = k2), (SELECT arg_min(code, i) FROM t WHERE replace(name, ' ', '') = replace(k2, ' ', '')), (SELECT any_value(code) FROM t WHERE code = k2), (SELECT arg_min(code, i) FROM t WHERE contains(k, name) OR contains(name, k)), (SELECT arg_min(code, i) FROM s WHERE contains(k, alias))) AS code FROM p WHERE k <> '')
SELECT market, code FROM (SELECT p_partkey AS market, {_SAMPLES} AS n FROM part) LEFT JOIN f USING (n)""")
def country_codes(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "part").select("p_partkey"), "p_partkey").select(c("p_partkey").alias("market"), country_code(pick(NAMES, c("p_partkey"))).alias("code"))

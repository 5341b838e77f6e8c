"""Resolution of not-modified revisits: as-of join by canonical URL to the latest earlier full response."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Header fields that a not-modified answer may bring up to date; all others stay as stored.
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "vary")
#: Seconds of one cell of the as-of join: no task sees more of a URL than one cell of it.
CELL = 86_400


def canonical_url(url: Column) -> Column:
    """Host in lower case without scheme, www. and port 80 or 443; no fragment, tracking parameters, index page or end slash."""
    u = F.regexp_replace(F.trim(url), "#.*$", "")
    u = F.regexp_replace(u, "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    u = F.concat(F.lower(F.regexp_extract(u, "^[^/?]*", 0)), F.regexp_replace(u, "^[^/?]*", ""))
    u = F.regexp_replace(F.regexp_replace(u, r"^www\.", ""), r"^([^/?:]*):(80|443)(?=[/?]|$)", "$1")
    u = F.regexp_replace(u, "([?&])(utm_[a-z]+|ref|sessionid)=[^&]*", "$1")
    u = F.regexp_replace(F.regexp_replace(F.regexp_replace(u, "[?]&+", "?"), "&&+", "&"), "[?&]+$", "")
    return F.regexp_replace(F.regexp_replace(u, r"/index\.html?$", "/"), "/+$", "")


def resolve(records: DataFrame, cell: int = CELL, permitted: tuple[str, ...] = PERMITTED) -> DataFrame:
    """One row for each revisit record: record_id, url, ts, outcome, ref_id, headers, payload.

    records: record_id, kind ('response' or 'revisit'), url, ts (seconds), headers (map, names in lower case), payload.
    The latest response of the same canonical URL with a smaller ts is taken, of equal ones that with the largest record_id, of these the largest row
    key (a hash of the whole record).
    outcome: 'resolved' if the revisit's ETag (weak comparison), or without one its Last-Modified, is the response's;
    'validator_mismatch' if not; 'no_validator' if the revisit has neither; 'no_response' if there is none. Only resolved rows
    have merged headers and a payload. A null url or ts is never matched. Repeated revisits have a row each, each with its own headers, also where
    they share a record_id; other kinds and columns are ignored; an empty table gives no rows.

    A URL may hold any share of the records: its time line is cut in cells, windows run inside a cell, and between cells only each
    cell's last response is handed on.
    """
    rows = records.select("record_id", "kind", canonical_url(F.col("url")).alias("url"), "ts", "headers", "payload")
    rows = rows.withColumn("row", F.xxhash64("record_id", "kind", "url", "ts", F.to_json("headers"), "payload"))
    h = F.col("headers")
    tag = F.regexp_replace(h["etag"], "^W/", "")
    light = rows.where("kind in ('response', 'revisit')").select("record_id", "row", "url", "ts", (F.col("kind") == "response").alias("full"), tag.alias("etag"), h["last-modified"].alias("modified"), F.floor(F.col("ts") / cell).alias("cell"))
    known = light.where("url is not null and ts is not null")
    own = F.struct(F.col("record_id").alias("id"), "row", "etag", "modified")
    inside = Window.partitionBy("url", "cell").orderBy("ts", "full", "record_id", "row").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    near = known.withColumn("seen", F.last(F.when(F.col("full"), own), True).over(inside)).where("not full").select("record_id", "row", "url", "ts", "etag", "modified", "cell", "seen")
    last = known.where("full").groupBy("url", "cell").agg(F.max(F.struct("ts", F.col("record_id").alias("id"), "row", "etag", "modified")).alias("r"))
    cells = known.select("url", "cell").distinct().join(last, ["url", "cell"], "left")
    before = Window.partitionBy("url").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    carried = cells.select("url", "cell", F.last(F.when(F.col("r").isNotNull(), F.struct("r.id", "r.row", "r.etag", "r.modified")), True).over(before).alias("carried"))
    met = near.join(carried, ["url", "cell"], "left").withColumn("ref", F.coalesce("seen", "carried"))
    judged = F.when(F.col("ref").isNull(), "no_response").when(F.col("etag").isNotNull(), F.when(F.col("etag") == F.col("ref.etag"), "resolved").otherwise("validator_mismatch"))
    judged = judged.when(F.col("modified").isNotNull(), F.when(F.col("modified") == F.col("ref.modified"), "resolved").otherwise("validator_mismatch")).otherwise("no_validator")
    met = met.select("record_id", "row", "url", "ts", judged.alias("outcome"), F.col("ref.id").alias("ref_id"), F.col("ref.row").alias("ref_row"))
    none = F.lit(None)
    unknown = light.where("not full and (url is null or ts is null)").select("record_id", "row", "url", "ts", F.lit("no_response").alias("outcome"), none.cast(records.schema["record_id"].dataType).alias("ref_id"), none.cast("long").alias("ref_row"))
    met = met.unionByName(unknown)

    # rows with one key are equal in all that matters here, so any of them will do
    good = met.where("outcome = 'resolved'")
    fresh = rows.where("kind = 'revisit'").select("row", F.map_filter("headers", lambda k, _: k.isin(*permitted)).alias("fresh")).dropDuplicates(["row"])
    stored = rows.where("kind = 'response'").select(F.col("row").alias("ref_row"), F.col("headers").alias("stored"), "payload").dropDuplicates(["ref_row"])
    merged = F.map_concat(F.map_filter("stored", lambda k, _: ~F.array_contains(F.map_keys("fresh"), k)), "fresh")
    merged = F.when(F.col("stored").isNull(), F.col("fresh")).otherwise(merged)
    full = good.join(fresh, "row").join(stored, "ref_row").select("record_id", "url", "ts", "outcome", "ref_id", merged.alias("headers"), "payload")
    rest = met.where("outcome <> 'resolved'").select("record_id", "url", "ts", "outcome", "ref_id", none.cast(records.schema["headers"].dataType).alias("headers"), none.cast(records.schema["payload"].dataType).alias("payload"))
    return full.unionByName(rest)


def captures(pages: DataFrame) -> DataFrame:
    """The pages table as crawl records: each page's full response, a later revisit and one that may have no response before it.

    A null html has no ETag, so its records have no validator; a null url or page_id gives records that match nothing. Repeated rows give
    their records each; extra columns are ignored; an empty table gives none.
    """
    tag = F.concat(F.lit('"'), F.substring(F.md5("html"), 1, 16), F.lit('"'))
    minute = F.col("page_id") * 60
    date = lambda s: F.concat(F.lit("t"), s.cast("string"))
    head = lambda etag, at, length: F.create_map(F.lit("etag"), etag, F.lit("date"), date(at), F.lit("cache-control"), F.concat(F.lit("max-age="), F.pmod(at, F.lit(7)).cast("string")), F.lit("content-length"), length, F.lit("content-type"), F.lit("text/html"))
    record = lambda k, kind, at, etag, length, body: F.struct((F.col("page_id") * 3 + k).alias("record_id"), F.lit(kind).alias("kind"), at.alias("ts"), head(etag, at, length).alias("headers"), body.alias("payload"))
    none, body = F.lit(None).cast("string"), F.octet_length("html").cast("string")
    weak = F.when(F.col("page_id") % 5 == 0, F.lit('"stale"')).when(F.col("page_id") % 5 == 1, F.concat(F.lit("W/"), tag)).otherwise(tag)
    later = minute + F.col("page_id") % 11 * 40_000 + 30
    return pages.select("page_id", "url", "html").select("url", F.inline(F.array(record(0, "response", minute, tag, body, F.col("html")), record(1, "revisit", later, weak, F.lit("0"), none), record(2, "revisit", minute - 15, tag, F.lit("0"), none))))

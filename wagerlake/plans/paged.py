"""Paged lists read page by page: pages of the ledger rows of each wallet, with caps, failing pages and cursors."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wagerlake.registry import query
from wagerlake.sources import pages
from wagerlake.sources.carriers import ledger_rows
from wagerlake.sources.shared import shared_folder

c = F.col
#: Page size and caps of the query, small enough for lists of the given tables to reach them.
SIZE, ROWS, OFFSET = 16, 60, 64


def _numbered(rows: DataFrame, kind, error) -> DataFrame:
    by = Window.partitionBy("wallet", "list").orderBy("id")
    r = rows.withColumn("list", kind).withColumn("pos", F.row_number().over(by) - 1)
    return r.select("list", c("wallet").cast("string").alias("user"), "pos", F.to_json(F.struct("id", "raw_type", "asset", "shares")).alias("row"), error.alias("error"))


@query("S01_S02_paged_lists", f"""WITH r AS (SELECT CASE WHEN raw_type = 'TRADE' THEN 'trades' ELSE 'activity' END AS list, * FROM (SELECT * FROM v_rows UNION ALL SELECT * REPLACE ('other' AS raw_type) FROM v_rows)),
n AS (SELECT list, wallet, id, row_number() OVER (PARTITION BY list, wallet ORDER BY id) - 1 AS pos FROM r),
p AS (SELECT list, wallet, pos // {SIZE} AS page, list = 'trades' AND wallet % 10 = 3 AND pos // {SIZE} = 1 AS bad, count(*) AS n, sum(id) AS ids FROM n WHERE pos < {ROWS} GROUP BY ALL),
q AS (SELECT *, CASE WHEN bad THEN 0 ELSE n END AS m, coalesce(bool_or(bad) OVER (PARTITION BY list, wallet ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS over FROM p),
t AS (SELECT list, wallet, count(*) AS total FROM n GROUP BY ALL),
s AS (SELECT list, wallet, count(*) AS pages, sum(m) AS rows, max(page) * {SIZE} AS max_offset, bool_or(bad) AS bad, sum(CASE WHEN bad THEN 0 ELSE ids END) AS ids FROM q WHERE NOT over GROUP BY ALL)
SELECT list, wallet, pages + CASE WHEN NOT bad AND rows < {ROWS} AND rows % {SIZE} = 0 THEN 1 ELSE 0 END AS pages, rows::BIGINT AS rows, (max_offset + CASE WHEN NOT bad AND rows < {ROWS} AND rows % {SIZE} = 0 THEN {SIZE} ELSE 0 END)::BIGINT AS max_offset, bad OR (total >= {ROWS} AND least(total, {-(-ROWS // SIZE) * SIZE}) % {SIZE} = 0) AS truncated,
 CASE WHEN bad THEN 'HTTP 500' END AS error, ids::BIGINT AS ids FROM s JOIN t USING (list, wallet)""")
def paged_lists(spark: SparkSession, d: str) -> DataFrame:
    """What reading two paged lists of every wallet gives: each row once as an activity row, trades also as a list of their own, of which some wallets' second page fails."""
    rows = ledger_rows(spark, d)
    rows = rows.unionByName(rows.withColumn("raw_type", F.lit("other")))
    kind = F.when(c("raw_type") == "TRADE", "trades").otherwise("activity")
    bad = F.when((c("list") == "trades") & (c("wallet") % 10 == 3) & (F.floor(c("pos") / SIZE) == 1), "HTTP 500")
    root = f"{shared_folder(spark)}/pages-{uuid.uuid4().hex}"
    pages.write_pages(_numbered(rows, kind, bad), root, SIZE)
    read = pages.read_pages(spark, root, ["activity", "trades"], pageSize=SIZE, maxOffset=OFFSET, attempts=1)
    kept = pages.kept_pages(read, SIZE, ROWS, OFFSET)
    ids = pages.list_rows(kept).groupBy("list", "user").agg(F.sum(F.get_json_object("row", "$.id").cast("long")).alias("ids"))
    status = pages.list_status(kept, SIZE).join(ids, ["list", "user"])
    return status.select("list", c("user").cast("long").alias("wallet"), "pages", "rows", "max_offset", "truncated", "error", "ids")


@query("S03_position_pages", f"""WITH n AS (SELECT CASE asset % 3 WHEN 0 THEN 'CLOSED' WHEN 1 THEN 'OPEN' ELSE 'REDEEMABLE' END AS list, wallet, id, row_number() OVER (PARTITION BY wallet, asset % 3 ORDER BY id) - 1 AS pos FROM v_rows)
SELECT list, wallet, count(DISTINCT pos // {SIZE // 4}) FILTER (pos < {SIZE}) AS pages, count(*) FILTER (pos < {SIZE}) AS rows, count(*) > {SIZE} AS hit_page_cap, sum(id) FILTER (pos < {SIZE})::BIGINT AS ids FROM n GROUP BY list, wallet""")
def position_pages(spark: SparkSession, d: str) -> DataFrame:
    """Lists of three states, four pages at most of each, walked from cursor to cursor; more pages than that are said, not dropped in silence."""
    kind = F.when(c("asset") % 3 == 0, "CLOSED").when(c("asset") % 3 == 1, "OPEN").otherwise("REDEEMABLE")
    root = f"{shared_folder(spark)}/pages-{uuid.uuid4().hex}"
    pages.write_pages(_numbered(ledger_rows(spark, d), kind, F.lit(None).cast("string")), root, SIZE // 4, links=True)
    read = pages.read_pages(spark, root, ["CLOSED", "OPEN", "REDEEMABLE"], mode="cursor", maxPages=4)
    ids = read.select("list", "user", F.explode("body").alias("row")).groupBy("list", "user").agg(F.sum(F.get_json_object("row", "$.id").cast("long")).alias("ids"))
    return pages.cursor_status(read).join(ids, ["list", "user"]).select("list", c("user").cast("long").alias("wallet"), "pages", "rows", "hit_page_cap", "ids")

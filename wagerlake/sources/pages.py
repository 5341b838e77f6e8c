"""Paged lists as a Spark data source: tasks read groups of pages, and Spark decides where each list ends and whether it was cut off.

A list of a user is a sequence of pages, either at offsets or linked by cursors. The source has one row a page, with its JSON rows or its error. Offset pages are
independent, so any task may read any of them: all offsets up to the cap are asked for, and what lies behind the end of a list is empty. Cursor pages are
walked, a list in one task. How a page is got is an option, "module:function" of (root, list, user, at) that returns the page's JSON or raises;
files_page reads folders that Spark has written. Those are buckets of users, sorted by user, so that their number doesn't grow with the users: a task reads a
bucket's lines once and holds one user's pages. A folder a user, as others may have written them, is read as well.
"""

from __future__ import annotations

import heapq
import importlib
import io
import itertools
import json
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

c = F.col
#: Rows of a page, most rows of an activity list, largest offset of a trades list, attempts at a page.
PAGE, ACTIVITY_ROWS, TRADES_OFFSET, ATTEMPTS = 500, 5_500, 10_000, 3
#: Most partitions of a read, and pages or lists that one has at least; neighbours, so that a list's folder is read once.
TASKS, EACH = 2_000, 64
#: Buckets of a written list for each core.
BUCKETS = 8
SCHEMA = "list string, user string, at string, page int, n int, error string, has_more boolean, body array<string>"


class PageError(Exception):
    """A page that can't be had; retry tells whether another attempt may help."""

    def __init__(self, message: str, retry: bool = True):
        super().__init__(message)
        self.retry = retry


def _files(path: str):
    from pyarrow import fs

    system, at = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    return system, [f for f in system.get_file_info(fs.FileSelector(at, allow_not_found=True))]


def _lines(folder: str) -> Iterator[dict]:
    """The lines of a folder's files, those of one user side by side if each file is sorted by user."""
    system, found = _files(folder)

    def of(path: str) -> Iterator[dict]:
        with io.TextIOWrapper(io.BufferedReader(system.open_input_stream(path)), "utf-8", newline="\n") as f:
            yield from (json.loads(line) for line in f if line.strip())

    return heapq.merge(*(of(f.path) for f in found if f.base_name.startswith("part-")), key=lambda p: p.get("user", ""))


@lru_cache(maxsize=4)
def _pages(root: str, kind: str, user: str) -> dict[str, str]:
    names = _buckets(root, kind)
    if names:
        at = zlib.crc32(user.encode()) % len(names)
        return {p["at"]: p["page"] for p in _lines(f"{root}/list={kind}/bucket={at}-of-{len(names)}") if p["user"] == user}
    return {p["at"]: p["page"] for p in _lines(f"{root}/list={kind}/user={user}")}


@lru_cache(maxsize=16)
def _buckets(root: str, kind: str) -> range:
    """The buckets that a list was written to; empty ones have no folder."""
    found = [f.base_name for f in _files(f"{root}/list={kind}")[1] if f.base_name.startswith("bucket=")]
    return range(int(found[0].split("-of-")[1]) if found else 0)


def _said(page: str) -> str:
    said = json.loads(page)
    if isinstance(said, dict) and said.get("error"):
        raise PageError(said["error"], said.get("retry", True))
    return page


def files_page(root: str, kind: str, user: str, at: str) -> str:
    """A page from <root>/list=<list>/bucket=<n>-of-<buckets>/part-*, lines of {"user", "at", "page"} by user, or from user=<user>/part-*; none is the empty page, an object with error is a failure."""
    return _said(_pages(root, kind, user).get(at, "[]"))


@dataclass
class Pages(InputPartition):
    """(list, user, offset) of pages, or (list, user, None) of lists to walk; (list, folder) of buckets whose users are all read."""

    pages: list[tuple[str, str, int | None]]
    buckets: list[tuple[str, str]] = field(default_factory=list)


class PageReader(DataSourceReader):
    def __init__(self, options: dict):
        get = options.get
        self.root, self.lists = options["root"], get("lists", "activity").split(",")
        self.cursors, self.size = get("mode", "offset") == "cursor", int(get("pagesize", PAGE))
        self.last, self.most = int(get("maxoffset", TRADES_OFFSET)), int(get("maxpages", 2_000))
        self.attempts, self.tasks, self.getter = int(get("attempts", ATTEMPTS)), int(get("tasks", TASKS)), get("page", f"{__name__}:files_page")
        self.users = get("users")

    def _of(self, kind: str) -> list[str]:
        if self.users:
            return self.users.split(",")
        return sorted(unquote(f.base_name[5:]) for f in _files(f"{self.root}/list={kind}")[1] if f.base_name.startswith("user="))

    def _offsets(self) -> list[None] | range:
        return [None] if self.cursors else range(0, self.last + 1, self.size)

    def partitions(self) -> list[Pages]:
        cut = lambda every, n: [every[i : i + -(-len(every) // n)] for i in range(0, len(every), -(-len(every) // n))] if every else []
        stored = [] if self.users else [(kind, f"{self.root}/list={kind}/{f.base_name}") for kind in self.lists for f in _files(f"{self.root}/list={kind}")[1] if f.base_name.startswith("bucket=")]
        every = [(kind, user, at) for kind in self.lists for user in self._of(kind) for at in self._offsets()]
        parts = [Pages([], b) for b in cut(stored, self.tasks)] + [Pages(p) for p in cut(every, min(self.tasks, -(-len(every) // EACH)))]
        return parts or [Pages([])]

    def _page(self, kind: str, user: str, at: str, known: dict[str, str] | None = None) -> tuple[list | dict, str | None]:
        module, name = self.getter.split(":")
        get, said = getattr(importlib.import_module(module), name), None
        for _ in range(self.attempts):
            try:
                return json.loads(get(self.root, kind, user, at) if known is None else _said(known.get(at, "[]"))), None
            except PageError as e:
                said = str(e)
                if not e.retry:
                    break
            except (OSError, ValueError) as e:
                said = str(e)
        return [], said or "page failed"

    def read(self, partition: Pages) -> Iterator[tuple]:
        for kind, user, offset in partition.pages:
            yield from self._read(kind, user, offset)
        own = self.getter == f"{__name__}:files_page"
        for kind, folder in partition.buckets:
            for user, lines in itertools.groupby(_lines(folder), lambda p: p["user"]):
                known = {p["at"]: p["page"] for p in lines} if own else None
                for offset in self._offsets():
                    yield from self._read(kind, user, offset, known)

    def _read(self, kind: str, user: str, offset: int | None, known: dict[str, str] | None = None) -> Iterator[tuple]:
        text = lambda rows: [json.dumps(r) for r in rows]
        if offset is not None:
            rows, error = self._page(kind, user, str(offset), known)
            rows = rows if isinstance(rows, list) else []
            yield kind, user, str(offset), offset // self.size, len(rows), error, None, text(rows)
            return
        at, page = "", 0
        while at is not None and page < self.most:
            said, error = self._page(kind, user, at, known)
            said = said if isinstance(said, dict) else {}
            rows, more = said.get("data") or [], said.get("pagination") or {}
            on = more.get("next_cursor") if more.get("has_more") else None
            yield kind, user, at, page, len(rows), error, bool(on), text(rows)
            at, page = on or None, page + 1


class PagedSource(DataSource):
    """Options: root, lists, users (comma-separated; all in root without it), mode (offset, cursor), pageSize, maxOffset, maxPages, attempts, tasks, page."""

    @classmethod
    def name(cls) -> str:
        return "wagerlake_pages"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> PageReader:
        return PageReader({k.lower(): v for k, v in self.options.items()})


def read_pages(spark: SparkSession, root: str, lists: list[str], **options) -> DataFrame:
    spark.dataSource.register(PagedSource)
    return spark.read.format("wagerlake_pages").options(root=root, lists=",".join(lists), **{k: str(v) for k, v in options.items()}).load()


def kept_pages(pages: DataFrame, page_size: int = PAGE, max_rows: int = ACTIVITY_ROWS, max_offset: int = TRADES_OFFSET) -> DataFrame:
    """Offset pages up to the one that ends their list, with before (rows of earlier pages), ends and cut.

    A list ends at its first failing or short page, at the page that fills max_rows, or at the last page below max_offset; cut says that rows may be missing behind that
    end: all but the short page. Rows beyond max_rows go.
    """
    order = Window.partitionBy("list", "user").orderBy("page")
    p = pages.withColumn("before", F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    failed, short, full = c("error").isNotNull() & (c("n") == 0), c("n") < page_size, c("before") + c("n") >= max_rows
    p = p.withColumn("ends", failed | short | full | ((c("page") + 1) * page_size > max_offset)).withColumn("cut", c("ends") & (failed | ~short))
    p = p.withColumn("over", F.coalesce(F.max("ends").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(False))).where("not over").drop("over")
    return p.withColumn("body", F.slice("body", 1, F.greatest(F.lit(0), F.least(F.size("body"), max_rows - c("before"))).cast("int"))).withColumn("n", F.size("body"))


def list_rows(kept: DataFrame) -> DataFrame:
    """list, user, pos, row (JSON) of kept pages, in the order of the list."""
    return kept.select("list", "user", "before", F.posexplode("body").alias("i", "row")).select("list", "user", (c("before") + c("i")).cast("long").alias("pos"), "row")


def list_status(kept: DataFrame, page_size: int = PAGE) -> DataFrame:
    """A row for each list: pages read, rows, largest offset, whether it is truncated, and its error."""
    return kept.groupBy("list", "user").agg(
        F.count("*").alias("pages"), F.sum("n").alias("rows"), F.max(c("page") * page_size).cast("long").alias("max_offset"), F.max("cut").alias("truncated"), F.max("error").alias("error"),
    )


def cursor_status(pages: DataFrame) -> DataFrame:
    """A row for each list of cursor pages: pages, rows, whether more pages were there than maxPages, and its error."""
    return pages.groupBy("list", "user").agg(F.count("*").alias("pages"), F.sum("n").cast("long").alias("rows"), F.coalesce(F.max_by("has_more", "page"), F.lit(False)).alias("hit_page_cap"), F.max("error").alias("error"))


def write_pages(rows: DataFrame, root: str, page_size: int, links: bool = False) -> None:
    """Rows (list, user, pos, row, error) as the buckets that files_page reads; a page with an error says only that. With links, pages name the next one."""
    page = F.floor(c("pos") / page_size).cast("long")
    each = rows.groupBy("list", "user", page.alias("page")).agg(F.array_sort(F.collect_list(F.struct("pos", "row"))).alias("r"), F.max("error").alias("error"))
    body = F.concat(F.lit("["), F.array_join(F.transform("r", lambda x: x["row"]), ","), F.lit("]"))
    if links:
        last = F.max("page").over(Window.partitionBy("list", "user"))
        each = each.withColumn("last", last)
        more = F.when(c("page") < c("last"), F.concat(F.lit('{"has_more":true,"next_cursor":"'), c("page") + 1, F.lit('"}'))).otherwise('{"has_more":false}')
        body = F.concat(F.lit('{"data":'), body, F.lit(',"pagination":'), more, F.lit("}"))
    body = F.when(c("error").isNotNull(), F.to_json(F.struct("error"))).otherwise(body)
    at = F.when(F.lit(links) & (c("page") == 0), "").otherwise((c("page") * (1 if links else page_size)).cast("string"))
    n = BUCKETS * rows.sparkSession.sparkContext.defaultParallelism
    bucket = F.concat((F.crc32(c("user").cast("binary")) % n).cast("string"), F.lit(f"-of-{n}"))
    lines = each.select("list", bucket.alias("bucket"), "user", "page", F.to_json(F.struct("user", at.alias("at"), body.alias("page"))).alias("value"))
    lines.repartition("list", "bucket").sortWithinPartitions("list", "bucket", "user", "page").select("list", "bucket", "value").write.partitionBy("list", "bucket").text(root)

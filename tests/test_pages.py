"""Paged lists: where they end, what is cut, pages that fail, cursors, and pages read in parallel from files."""

import json

import pytest

from wagerlake.sources import pages


def status(spark, sizes, page_size=5, max_rows=100, max_offset=1000, errors=()):
    rows = [("activity", "u", str(i * page_size), i, n, "HTTP 500" if i in errors else None, None, [f"{i}-{k}" for k in range(n)]) for i, n in enumerate(sizes)]
    kept = pages.kept_pages(spark.createDataFrame(rows, pages.SCHEMA), page_size, max_rows, max_offset)
    s = pages.list_status(kept, page_size).first()
    return (s["pages"], s["rows"], s["max_offset"], s["truncated"], s["error"]), [r.row for r in pages.list_rows(kept).orderBy("pos").collect()]


@pytest.mark.parametrize(("sizes", "more", "want"), [
    ([5, 5, 3, 0, 0], {}, (3, 13, 10, False, None)),
    ([5, 5, 0, 0], {}, (3, 10, 10, False, None)),
    ([0, 0], {}, (1, 0, 0, False, None)),
    ([5, 5, 5, 5], {"max_rows": 15}, (3, 15, 10, True, None)),
    ([5, 5, 5, 5], {"max_rows": 12}, (3, 12, 10, True, None)),
    ([5, 5, 2], {"max_rows": 12}, (3, 12, 10, False, None)),
    ([5, 5, 5, 5], {"max_offset": 12}, (3, 15, 10, True, None)),
    ([5, 0, 5], {"errors": (1,)}, (2, 5, 5, True, "HTTP 500")),
    ([0, 5], {"errors": (0,)}, (1, 0, 0, True, "HTTP 500")),
])
def test_where_lists_end(spark, sizes, more, want):
    got, rows = status(spark, sizes, **more)
    assert got == want
    assert rows == [f"{i}-{k}" for i, n in enumerate(sizes) for k in range(n)][: want[1]]


@pytest.fixture()
def store(tmp_path):
    def add(kind, user, lines):
        at = tmp_path / f"list={kind}" / f"user={user}"
        at.mkdir(parents=True)
        (at / "part-0.txt").write_text("\n".join(json.dumps({"at": a, "page": json.dumps(p)}) for a, p in lines))

    add("activity", "a", [("0", [1, 2, 3]), ("3", [4])])
    add("activity", "b", [("0", [1, 2, 3]), ("3", {"error": "HTTP 503"}), ("6", [9])])
    add("activity", "c", [("0", {"error": "HTTP 400", "retry": False})])
    add("OPEN", "a", [("", {"data": [1, 2], "pagination": {"has_more": True, "next_cursor": "x"}}), ("x", {"data": [3], "pagination": {"has_more": True, "next_cursor": "y"}}), ("y", {"data": [4]})])
    return str(tmp_path)


def test_pages_from_files(spark, store):
    read = pages.read_pages(spark, store, ["activity"], pageSize=3, maxOffset=9)
    assert read.count() == 12
    s = {r.user: (r.pages, r.rows, r.truncated, r.error) for r in pages.list_status(pages.kept_pages(read, 3, 100, 9), 3).collect()}
    assert s == {"a": (2, 4, False, None), "b": (2, 3, True, "HTTP 503"), "c": (1, 0, True, "HTTP 400")}
    some = pages.read_pages(spark, store, ["activity"], users="a,nobody", pageSize=3, maxOffset=3)
    assert {(r.user, r.at, r.n) for r in some.collect()} == {("a", "0", 3), ("a", "3", 1), ("nobody", "0", 0), ("nobody", "3", 0)}
    assert pages.read_pages(spark, store, ["none"]).count() == 0


@pytest.mark.parametrize(("cap", "want"), [(9, (3, 4, False)), (2, (2, 3, True)), (3, (3, 4, False))])
def test_cursors_are_walked_up_to_the_cap(spark, store, cap, want):
    r = pages.cursor_status(pages.read_pages(spark, store, ["OPEN"], mode="cursor", maxPages=cap)).first()
    assert (r["pages"], r["rows"], r["hit_page_cap"]) == want


def test_pages_are_tried_again(monkeypatch):
    tries = []

    def get(root, kind, user, at):
        tries.append(at)
        if len(tries) < 3:
            raise pages.PageError("HTTP 429")
        return "[7]"

    monkeypatch.setattr(pages, "files_page", get)
    reader = pages.PageReader({"root": "r", "users": "u", "maxoffset": "0"})
    assert [r[4:6] for p in reader.partitions() for r in reader.read(p)] == [(1, None)] and len(tries) == 3


def test_partitions_are_groups_of_pages():
    reader = pages.PageReader({"root": "r", "users": ",".join(map(str, range(100))), "maxoffset": "1000", "pagesize": "500", "tasks": "3"})
    parts = reader.partitions()
    assert len(parts) == 3 and sum(len(p.pages) for p in parts) == 300 and len({x for p in parts for x in p.pages}) == 300


def test_folders_do_not_grow_with_the_users(spark, tmp_path):
    n, at = 400, str(tmp_path / "pages")
    rows = spark.range(n * 3).selectExpr("'OPEN' AS list", "concat('u/', id div 3, ' ') AS user", "id % 3 AS pos", "to_json(named_struct('id', id)) AS row", "CASE WHEN id = 4 THEN 'HTTP 500' END AS error")
    pages.write_pages(rows, at, 2, links=True)
    assert len(list((tmp_path / "pages" / "list=OPEN").iterdir())) <= pages.BUCKETS * spark.sparkContext.defaultParallelism < n
    s = pages.cursor_status(pages.read_pages(spark, at, ["OPEN"], mode="cursor", maxPages=4)).collect()
    assert len({r.user for r in s}) == n and {(r.pages, r.rows, r.error) for r in s} == {(2, 3, None), (1, 0, "HTTP 500")}
    one = pages.read_pages(spark, at, ["OPEN"], mode="cursor", users="u/7 ,nobody").orderBy("user", "page").collect()
    assert [(r.user, r.page, r.body) for r in one] == [("nobody", 0, []), ("u/7 ", 0, ['{"id": 21}', '{"id": 22}']), ("u/7 ", 1, ['{"id": 23}'])]

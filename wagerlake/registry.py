"""Every registered query with its SQL: modules of plans/ add theirs with the query decorator."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from wagerlake.sources.carriers import VIEWS

Query = Callable[[SparkSession, str], DataFrame]
PLANS = ("pricing", "ledger", "performance", "feed", "clv", "matching", "audits", "streams", "exchange", "ledger_audit", "titles", "reports", "countries", "evidence", "ledger_chain", "paged", "ledger_store", "trade_ev", "mapped_pairs", "mapping", "translate", "stored_record", "structure", "shadow_report", "anchors")
_queries: dict[str, Query] = {}
_oracles: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query; the views that its SQL names are put in front of it."""

    def add(f: Query) -> Query:
        _queries[name] = f
        if sql:
            _oracles[name] = with_views(sql)
        return f

    return add


def with_views(sql: str) -> str:
    needed: list[str] = []

    def need(text: str) -> None:
        for v, body in VIEWS.items():
            if v in text and v not in needed:
                need(body)
                needed.append(v)

    need(sql)
    views = ", ".join(f"{v} AS ({VIEWS[v]})" for v in needed)
    if not views:
        return sql
    own = sql.strip()
    if own.upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {views}, {own[14:]}"
    return f"WITH {views}, {own[5:]}" if own.upper().startswith("WITH ") else f"WITH {views} {own}"


def _load() -> None:
    for m in PLANS:
        importlib.import_module(f"wagerlake.plans.{m}")


def queries() -> dict[str, Query]:
    _load()
    return dict(_queries)


def oracles() -> dict[str, str]:
    _load()
    return dict(_oracles)

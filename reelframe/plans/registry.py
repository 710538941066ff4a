"""Registry of queries: one Spark callable and, where one exists, the SQL text giving the same rows."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from reelframe.fixtures import VIEWS, Views, view_sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(key: str, sql: str | None = None):
    """Register `fn(views) -> DataFrame` under `key`."""

    def wrap(fn):
        if key in QUERIES:
            raise ValueError(f"duplicate key {key}")
        QUERIES[key] = lambda spark, path: fn(Views(spark, path))
        if sql is not None:
            SQL[key] = sql if sql in SQL.values() else _with_views(sql)
        return fn

    return wrap


def _with_views(body: str) -> str:
    used = [v for v in VIEWS if re.search(rf"\b(?:FROM|JOIN|,)\s+{v}\b", body, re.I)]
    parts = [f"{v} AS ({view_sql(v, 'duckdb')})" for v in used]
    body = body.strip().rstrip(";")
    m = re.match(r"WITH\s+(RECURSIVE\s+)?", body, re.I)
    if not parts:
        return body
    head = "WITH RECURSIVE " + ",\n".join(parts)
    return head + (",\n" + body[m.end():] if m else "\n" + body)

"""Registration of queries with the SQL that must return the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.projection import ARTIFACTS_SQL, EVENTS_SQL, GEO_SQL, LEDGER_SQL, NOW, REPORTS_SQL

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
WINDOWS = {"{now}": f"TIMESTAMP '{NOW}'", "{d1}": "TIMESTAMP '2024-01-30 00:00:00'", "{d3}": "TIMESTAMP '2024-01-28 00:00:00'", "{d7}": "TIMESTAMP '2024-01-24 00:00:00'"}
D1, D3, D7 = "2024-01-30 00:00:00", "2024-01-28 00:00:00", "2024-01-24 00:00:00"


def counted(sql: str) -> str:
    """DuckDB's count_if is 128 bits wide; the queries return longs."""
    out, at = "", 0
    while (k := sql.find("count_if(", at)) >= 0:
        depth, i = 0, k + 8
        while True:
            depth += {"(": 1, ")": -1}.get(sql[i], 0)
            i += 1
            if not depth:
                break
        out += sql[at:k] + f"CAST({sql[k:i]} AS BIGINT)"
        at = i
    return out + sql[at:]


def sql_of(text: str, more: str = "") -> str:
    for k, v in WINDOWS.items():
        text, more = text.replace(k, v), more.replace(k, v)
    text = text.replace("{stamp}", "'%Y-%m-%d %H:%M:%S.%f'")
    more = more.replace("{stamp}", "'%Y-%m-%d %H:%M:%S.%f'")
    text, more = counted(text), counted(more)
    return f"WITH hp AS ({EVENTS_SQL}), art AS ({ARTIFACTS_SQL}), geo AS ({GEO_SQL}), led AS ({LEDGER_SQL}), rep AS ({REPORTS_SQL}){', ' + more if more else ''} {text}"


def query(name: str, sql: str = "", ctes: str = ""):
    """Registers a function of (spark, events, directory)."""

    def add(f):
        from ..sources import projection

        QUERIES[name] = lambda spark, sf_dir: f(spark, projection.events(spark, sf_dir), sf_dir)
        if sql:
            SQL[name] = sql_of(sql, ctes)
        return f

    return add

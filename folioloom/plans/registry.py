"""Named queries with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}


def _plain(sql: str) -> str:
    """count_if gives a 128-bit integer in DuckDB; a filtered count is the same as a BIGINT."""
    while (at := sql.find("count_if(")) >= 0:
        end, depth = at + 9, 1
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            end += 1
        sql = f"{sql[:at]}count(*) FILTER (WHERE {sql[at + 9 : end - 1]}){sql[end:]}"
    return sql


def query(name: str, sql: str | None = None) -> Callable:
    def add(f: Callable) -> Callable:
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = _plain(sql)
        return f

    return add

"""Helpers to write DuckDB oracle SQL over the stand-in fixtures."""

from __future__ import annotations

from ..sources.fixtures import FIXTURES, fixture_duckdb_sql


def with_ctes(ctes: list[tuple[str, str]], body: str) -> str:
    """``WITH a AS (...), b AS (...) <body>``; fixture names expand to their SQL."""
    parts = []
    for name, sql in ctes:
        parts.append(f"{name} AS (\n{sql.strip()}\n)")
    return "WITH " + ",\n".join(parts) + "\n" + body.strip()


def fx(*names: str) -> list[tuple[str, str]]:
    """CTE entries for the named fixtures, in order."""
    out = []
    for n in names:
        if n not in FIXTURES:
            raise KeyError(n)
        out.append((n, fixture_duckdb_sql(n)))
    return out


def sql(fixtures: tuple[str, ...] | list[str], body: str, extra: list[tuple[str, str]] | None = None) -> str:
    return with_ctes(fx(*fixtures) + list(extra or []), body)

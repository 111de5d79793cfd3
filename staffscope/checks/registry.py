"""Registered queries: a Spark callable and, where SQL can say it, the DuckDB text that must agree."""

from __future__ import annotations

from .inputs import oracle

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def check(name: str, sql: str | None = None):
    def add(run):
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = oracle(sql)
        return run
    return add

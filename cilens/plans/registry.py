"""Named queries, each with the DuckDB text its result is checked against."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cilens.session import ship
from cilens.views import VIEWS, Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
CTES: dict[str, str] = dict(VIEWS)


def cte(name: str, text: str) -> None:
    """A named SQL step that oracles may refer to."""
    CTES[name] = text


def with_ctes(text: str) -> str:
    """Put the named steps a text refers to, directly or not, in front of it."""
    ordered: list[str] = []

    def visit(body: str) -> None:
        for word in re.findall(r"[A-Za-z_][A-Za-z0-9_]*", body):
            if word in CTES and word not in ordered and re.search(rf"(?i)\b(from|join)\s+{word}\b", body):
                visit(CTES[word])
                if word not in ordered:
                    ordered.append(word)

    visit(text)
    own = text.strip()
    recursive = own.upper().startswith("WITH RECURSIVE")
    if recursive:
        own = own[len("WITH RECURSIVE"):].strip()
    elif own.upper().startswith("WITH "):
        own = own[len("WITH "):].strip()
    steps = [f"{name} AS ({CTES[name].strip()})" for name in ordered]
    head = "WITH RECURSIVE " if recursive else "WITH "
    if text.strip().upper().startswith("WITH "):
        return head + ",\n".join([*steps, own])
    return (head + ",\n".join(steps) + "\n" + own) if steps else own


def query(name: str, sql: str | None = None):
    """Register a builder taking Tables; ``sql`` is its independent statement for DuckDB."""

    def register(build: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        def run(spark: SparkSession, folder: str) -> DataFrame:
            ship(spark)
            return build(Tables(spark, folder))

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = with_ctes(sql)
        return build

    return register

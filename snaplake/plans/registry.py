"""The list of named queries, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Build = Callable[[SparkSession, str], DataFrame]

BUILDS: dict[str, Build] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Build], Build]:
    """Register a query.  Without ``sql`` only its rows can be looked at."""

    def add(build: Build) -> Build:
        if name in BUILDS:
            raise ValueError(f"query {name} is registered twice")
        BUILDS[name] = build
        if sql is not None:
            SQL[name] = sql
        return build

    return add

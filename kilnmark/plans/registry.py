"""Queries by name, each with the other engine's SQL where SQL can express it."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import fixture

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
_FIXTURES = {"truths": fixture.TRUTH, "texts": fixture.TEXTS, "fragments": fixture.FRAGMENTS, "rungs": fixture.RUNGS, "boxes": fixture.BOXES}


class Tables:
    """The tables of one folder, and the ones derived from them, by name."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name in _FIXTURES:
            return fixture.table(self.spark, self.dir, _FIXTURES[name])
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")


def with_fixtures(sql: str) -> str:
    used = [n for n in _FIXTURES if re.search(rf"\b{n}\b", sql)]
    ctes = ", ".join(f"{n} AS ({fixture.cte(_FIXTURES[n])})" for n in used)
    if not ctes:
        return sql
    return f"WITH {ctes}, {sql[5:]}" if sql.lstrip().startswith("WITH ") else f"WITH {ctes} {sql}"


def query(name: str, sql: str | None = None):
    """Registers ``f(tables) -> DataFrame`` under a name."""

    def add(f):
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            SQL[name] = with_fixtures(sql.strip())
        return f

    return add

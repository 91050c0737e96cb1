"""Where queries and their oracles are registered."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sheetwise.session import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Adds a query under its name, with the SQL that must give the same rows."""

    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return add


def declare(name: str, sql: str, oracle: str | None = None) -> None:
    """Adds a query that is one SQL statement over tables in braces; the oracle is the same text unless given."""
    names = sorted(set(re.findall(r"\{(\w+)\}", sql)))
    QUERIES[name] = lambda spark, sf_dir: spark.sql(sql, **{t: table(spark, sf_dir, t) for t in names})
    ORACLES[name] = re.sub(r"\{(\w+)\}", r"\1", oracle or sql)

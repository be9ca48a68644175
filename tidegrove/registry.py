"""Queries by name, each with the SQL that gives the same rows, if SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


#: Added before rounding, far below the last digit kept: sums in another order must not change which way a tie goes.
NUDGE = 1e-9


def rnd(value: Column | str, digits: int = 0) -> Column:
    return F.round((F.col(value) if isinstance(value, str) else value) + F.lit(NUDGE), digits)


def _nudged(sql: str) -> str:
    """``sql`` with the same added in each round(), and 0 to its result, which turns -0.0 into 0.0."""
    at = 0
    while (at := sql.find("round(", at)) >= 0:
        at += len("round(")
        depth, end, comma = 1, at, None
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            comma = end if sql[end] == "," and depth == 1 else comma
            end += 1
        cut = comma or end - 1
        sql = f"{sql[: at - 6]}(round(({sql[at:cut]}) + 1e-9{sql[cut:end]} + 0.0){sql[end:]}"
        at += 1
    return sql


def query(sql: str | None = None, name: str | None = None):
    """Registers a function of (spark, sf_dir) under its name."""

    def add(f):
        key = name or f.__name__
        QUERIES[key] = f
        if sql:
            ORACLE[key] = _nudged(sql)
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")

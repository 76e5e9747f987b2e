"""Named queries: each has a Spark builder ``(spark, root) -> DataFrame`` and, where the
result is SQL-expressible, an independent DuckDB statement over the raw tables."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import prepare

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
DIGITS = 6


def register(name: str, sql: str | None = None):
    """Register a query under ``name`` with its oracle SQL (None: rows-only check)."""

    def deco(fn):
        def run(spark: SparkSession, root: str) -> DataFrame:
            prepare(spark)
            return fn(spark, root)

        run.__name__ = fn.__name__
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return deco


def comparable(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    """``df`` with floating columns rounded, to be compared with the oracle statements (which
    round alike); for checkers only, the queries themselves return unrounded values."""
    out = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            out.append(F.round(F.col(f"`{f.name}`").cast("double"), digits).alias(f.name))
        elif isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, (T.DoubleType, T.FloatType)):
            out.append(F.transform(F.col(f"`{f.name}`"), lambda x: F.round(x.cast("double"), digits)).alias(f.name))
        else:
            out.append(F.col(f"`{f.name}`"))
    return df.select(*out)

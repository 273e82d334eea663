"""Registry of queries: a Spark function and, where SQL can say it, its check."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagescale.plans.views import with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def flat(df: DataFrame) -> DataFrame:
    """Whole numbers as BIGINT, so both engines give one type."""
    return df.select(*[F.col(f"`{n}`").cast("bigint").alias(n) if t in ("int", "smallint", "tinyint") else F.col(f"`{n}`")
                       for n, t in df.dtypes])


def query(name: str, sql: str | None = None, *views: str, **extra: str):
    def wrap(fn):
        assert name not in QUERIES, name
        QUERIES[name] = lambda spark, sf: flat(fn(spark, sf))
        if sql is not None:
            ORACLE[name] = with_views(sql, *views, **extra)
        return fn
    return wrap

"""Registration of the queries the driver runs, each with the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
CHECKS: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query; its result is flattened to plain columns so that engines compare alike."""
    def register(function: Query) -> Query:
        def run(spark: SparkSession, folder: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return flat(function(spark, folder))

        QUERIES[name] = run
        if sql is not None:
            CHECKS[name] = sql
        return function

    return register


def flat(df: DataFrame) -> DataFrame:
    """Times as microseconds, arrays and maps as joined text, integers as bigint."""
    return df.select(*[_flat_column(field).alias(field.name) for field in df.schema.fields])


def _flat_column(field: T.StructField) -> Column:
    column, kind = F.col(f"`{field.name}`"), field.dataType
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(column)
    if isinstance(kind, T.ArrayType):
        return F.array_join(F.transform(column, lambda v: v.cast("string")), ",")
    if isinstance(kind, (T.IntegerType, T.ShortType, T.ByteType)):
        return column.cast("bigint")
    return column

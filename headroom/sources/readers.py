"""Scans, SQL text and delimited input."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NA_TOKENS = ("NULL", "#N/A", "-", "NA")


def read_table(spark: SparkSession, folder: str, name: str, schema: str | None = None) -> DataFrame:
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.parquet(f"{folder}/{name}.parquet")


def scan_events(
    df: DataFrame, start: str, end: str, cols: Iterable[str], date_col: str = "event_date"
) -> DataFrame:
    """Closed date range plus projection; both reach the file scan."""
    return df.where(F.col(date_col).between(F.lit(start).cast("date"), F.lit(end).cast("date"))).select(
        *cols
    )


def run_sql(spark: SparkSession, text: str, tables: Mapping[str, DataFrame]) -> DataFrame:
    """Run one SQL text over named DataFrames.

    The frames are bound as parameters of this statement, so nothing is left behind
    in the session catalog and concurrent callers cannot shadow each other's views.
    """
    return spark.sql(text, **tables)


def clean_text(col: Column, na: Iterable[str] = NA_TOKENS) -> Column:
    """NA tokens (a set, where the csv reader accepts one) and blanks become NULL."""
    trimmed = F.trim(col)
    return F.when(trimmed.isin(*na) | (trimmed == ""), None).otherwise(trimmed)


def read_delimited(
    spark: SparkSession,
    path: str,
    types: Mapping[str, str],
    na: Iterable[str] = NA_TOKENS,
    sep: str = ",",
) -> DataFrame:
    """Delimited file with a header: read as text, blank the NA tokens, then type.

    Every column is read as a string with the given schema, so no pass over the data
    is spent on inference and a bad number turns into NULL instead of failing the job.
    """
    text_schema = ", ".join(f"`{name}` string" for name in types)
    raw = spark.read.csv(path, schema=text_schema, header=True, sep=sep)
    return raw.select(
        *[clean_text(F.col(f"`{name}`"), na).try_cast(kind).alias(name) for name, kind in types.items()]
    )


def coerce_numeric(df: DataFrame, cols: Iterable[str], na: Iterable[str] = NA_TOKENS) -> DataFrame:
    """Numbers that arrived as text; unreadable text becomes NULL."""
    return df.withColumns({c: clean_text(F.col(c), na).try_cast("double") for c in cols})

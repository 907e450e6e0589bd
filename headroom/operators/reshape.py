"""Column clean-up, long/wide changes and ordered display."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from headroom.functions.scalars import zero_if_missing
from headroom.operators.grouping import numeric_columns


def rename_by_map(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    return df.withColumnsRenamed(dict(names))


def rename_by_table(df: DataFrame, mapping: DataFrame, old: str, new: str) -> DataFrame:
    """Rename with a two-column table; it can only matter for as many rows as there are columns."""
    wanted = mapping.where(F.col(old).isin(*df.columns)).select(old, new).distinct()
    pairs = wanted.take(len(df.columns) + 1)
    if len({p[0] for p in pairs}) != len(pairs):
        raise ValueError("a column has two new names")
    return df.withColumnsRenamed({p[0]: p[1] for p in pairs})


def drop_by_pattern(df: DataFrame, patterns: Iterable[str], placeholder: str = "x") -> DataFrame:
    """Drop columns whose name matches a pattern or is the placeholder."""
    tests = [re.compile(p) for p in patterns]
    return df.drop(*[c for c in df.columns if c == placeholder or any(t.search(c) for t in tests)])


def derive_and_fold(df: DataFrame, target: str, parts: Iterable[str]) -> DataFrame:
    """``target`` becomes the sum of itself and the parts; the parts go."""
    parts = list(parts)
    total = F.col(target)
    for part in parts:
        total = total + F.col(part)
    return df.withColumn(target, total).drop(*parts)


def null_to_zero(df: DataFrame, cols: Iterable[str] | None = None) -> DataFrame:
    """NULL and NaN to 0 in numeric columns; keys and labels are never touched."""
    return df.withColumns({c: zero_if_missing(F.col(c)) for c in (cols or numeric_columns(df))})


def unpivot_pages(
    df: DataFrame, keys: Iterable[str], pages: Iterable[str] = ("core", "others")
) -> DataFrame:
    """Wide page columns to (pt, sessions) rows."""
    return df.unpivot(list(keys), list(pages), "pt", "sessions")


def pivot_sum(
    df: DataFrame, keys: Iterable[str], names: str, values: Iterable[str], measure: str
) -> DataFrame:
    """Long to wide with sums; the values are given, so no job runs to find them."""
    return df.groupBy(*keys).pivot(names, list(values)).agg(F.sum(measure))


def measures_long(df: DataFrame, keys: Iterable[str], measures: Iterable[str]) -> DataFrame:
    """Selected measures as (measure, value) rows."""
    typed = df.select(*keys, *[F.col(m).cast("double").alias(m) for m in measures])
    return typed.unpivot(list(keys), list(measures), "measure", "value")


def member_position(col: Column, order: Iterable[str]) -> Column:
    """Position in an explicit display order; 0 for members that are not listed."""
    return F.array_position(F.array(*[F.lit(m) for m in order]), col).cast("int")


def split_practice_areas(text: str) -> list[str]:
    return [part.strip() for part in text.split(",") if part.strip()]


def practice_area_select(df: DataFrame, text: str, col: str = "pa") -> DataFrame:
    """``all`` keeps every row, else the rows of the comma-separated practice areas."""
    if text == "all":
        return df.where(F.col(col).isNotNull())
    return df.where(F.col(col).isin(*split_practice_areas(text)))


def in_named_states(df: DataFrame, lookup: DataFrame, names: Iterable[str]) -> DataFrame:
    """Rows whose state is one of the full names, found through the state lookup."""
    wanted = lookup.where(F.col("statename").isin(*[n.lower() for n in names])).select("state")
    return df.join(wanted, "state", "left_semi")


def member_ranges(col: Column, ranges: Iterable[tuple[str, str]]) -> Column:
    """Union of closed string ranges; a single member is a range onto itself."""
    test = F.lit(False)
    for low, high in ranges:
        test = test | col.between(low, high)
    return test

"""Aggregation building blocks."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from headroom.functions.scalars import safe_ratio
from headroom.operators.quantile import column_counts, column_medians


def numeric_columns(df: DataFrame, skip: Iterable[str] = ()) -> list[str]:
    skip = set(skip)
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType) and f.name not in skip]


#: Amounts have at most so many digits behind the point; their sums fit a long up to 9 * 10**14.
AMOUNT_UNIT = 10.0**4


def exact_sum(value: Column) -> Column:
    """Sum of amounts, added as whole units: the same digits in whatever order the rows come.

    Values are rounded to the unit; use it for amounts only. NaN gives NaN, as in a plain sum.
    """
    missing = F.max(F.isnan(value))
    units = F.sum(F.round(F.when(~F.isnan(value), value) * AMOUNT_UNIT).cast("long"))
    return F.when(missing, float("nan")).otherwise(units / AMOUNT_UNIT)


def sum_then_mean(
    df: DataFrame, period: str, keys: Iterable[str], measures: Iterable[str], amounts: bool = False
) -> DataFrame:
    """Sum per period and key, then the mean over the periods that have rows. ``amounts`` are added exactly."""
    keys, measures = list(keys), list(measures)
    total = exact_sum if amounts else F.sum
    per_period = df.groupBy(period, *keys).agg(*[total(F.col(m)).alias(m) for m in measures])
    return per_period.groupBy(*keys).agg(*[(total(F.col(m)) / F.count(m)).alias(m) for m in measures])


def sum_all_numeric(df: DataFrame, keys: Iterable[str], skip: Iterable[str] = ()) -> DataFrame:
    keys = list(keys)
    return df.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in numeric_columns(df, [*keys, *skip])])


def weighted_mean(value: str, weight: str, na_as_zero: bool = True, amount: bool = False) -> Column:
    """``sum(x*w)/sum(w)``; a group without weight gives 0. The products of an ``amount`` are added as whole units.

    ``na_as_zero`` keeps the usual treatment of census tables, where a missing rate counts
    as 0 with full weight; without it a missing rate takes its weight out as well.
    """
    x, w = F.col(value), F.col(weight)
    total = exact_sum if amount else F.sum
    if na_as_zero:
        return safe_ratio(total(F.coalesce(x, F.lit(0.0)) * w), F.sum(w))
    return safe_ratio(total(x * w), F.sum(F.when(x.isNotNull(), w)))


def rollup_with_rates(
    df: DataFrame,
    keys: Iterable[str],
    sums: Iterable[str],
    rates: Mapping[str, str],
    na_as_zero: bool = True,
    amounts: Iterable[str] = (),
) -> DataFrame:
    """Additive columns summed and rates averaged by their weights, in one aggregate."""
    amounts = set(amounts)
    return df.groupBy(*keys).agg(
        *[F.sum(c).alias(c) for c in sums],
        *[weighted_mean(rate, weight, na_as_zero, rate in amounts).alias(rate) for rate, weight in rates.items()],
    )


def names_per_group(df: DataFrame, keys: Iterable[str], name: str) -> DataFrame:
    """The distinct names of each group, one row each."""
    return df.select(*keys, name).distinct()


def joined_names(names: DataFrame, keys: Iterable[str], name: str, out: str) -> DataFrame:
    """Names from ``names_per_group`` sorted and comma-joined, one row per group whatever their number.

    A display form: the row itself holds all names of its group.
    """
    return names.groupBy(*keys).agg(F.array_join(F.sort_array(F.collect_list(name)), ",").alias(out))


def change_pct(actual: Column, potential: Column) -> Column:
    return F.try_divide(potential, actual) - 1


def column_profile(df: DataFrame, cols: Iterable[str]) -> DataFrame:
    """One row per column: sum, mean, extremes, spread, count, median, sum of squares, distinct.

    The moments of all columns come from one aggregate over the rows as they are. Medians of all columns are selected
    together (``column_medians``), and for the distinct counts each task passes on a column's values once. ``df`` is read
    several times and should be a stored table.
    """
    cols = list(cols)
    wide = df.select(*[F.col(c).cast("double").alias(c) for c in cols])
    statistics = {
        "sum": F.sum,
        "avg": F.avg,
        "min": F.min,
        "max": F.max,
        "stdev": F.stddev_samp,
        "stdev_p": F.stddev_pop,
        "var": F.var_samp,
        "var_p": F.var_pop,
        "n": F.count,
        "sum_sq": lambda c: F.sum(F.col(c) * F.col(c)),
    }
    row = wide.agg(*[F.struct(*[f(c).alias(s) for s, f in statistics.items()]).alias(c) for c in cols])
    stats = row.select(F.inline(F.array(*[F.struct(F.lit(c).alias("measure"), F.col(c).alias("s")) for c in cols])))
    stats = stats.select("measure", "s.*")
    medians = column_medians(wide, cols)
    median = F.create_map(*[F.lit(x) for c in cols for x in (c, medians.get(c, float("nan")))])[F.col("measure")]
    values = column_counts(wide, cols, lambda _, value: value)
    distinct = values.groupBy(F.array(*map(F.lit, cols))[F.col("target")].alias("measure")).agg(F.count("*").alias("distinct_n"))
    out = stats.join(distinct, "measure", "left").fillna(0, ["distinct_n"])
    return out.withColumn("median", F.when(~F.isnan(median), median))

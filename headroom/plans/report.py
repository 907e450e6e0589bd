"""Cluster reports, headline figures and the BI sheets."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from headroom.functions.scalars import choropleth_bin, mark_size
from headroom.operators.clustering import cluster_centers, cluster_sizes
from headroom.operators.grouping import change_pct, joined_names, names_per_group
from headroom.operators.reshape import in_named_states, member_position, member_ranges, measures_long

ROLLED = ("sessions", "potential_sessions", "acv", "potential_acv")


def cluster_rollup(result: DataFrame) -> DataFrame:
    """Rounded totals per cluster, with the core-only totals next to them."""
    core = F.col("pt") == "core"
    return result.groupBy("cluster").agg(
        *[F.bround(F.sum(c), 0).alias(c) for c in ROLLED],
        *[F.bround(F.sum(F.when(core, F.col(c))), 0).alias(f"{c}_core") for c in ROLLED],
    )


def cluster_rollup_wide(df: DataFrame) -> DataFrame:
    """The same for the wide table, whose page types are columns."""
    totals = ("total", "core", "potential_total", "potential_core", "acv", "potential_acv")
    return df.groupBy("cluster").agg(*[F.bround(F.sum(c), 0).alias(c) for c in totals])


def region_names(result: DataFrame, lookup: DataFrame, states: Iterable[str]) -> DataFrame:
    """County names of the selected states per cluster: one row per name."""
    return names_per_group(in_named_states(result, lookup, states), ["cluster"], "county")


def region_names_concat(result: DataFrame, lookup: DataFrame, states: Iterable[str]) -> DataFrame:
    """The same as one comma-joined text per cluster."""
    return joined_names(region_names(result, lookup, states), ["cluster"], "county", "counties")


def cluster_report(
    regions: DataFrame,
    result: DataFrame,
    features: Sequence[str],
    lookup: DataFrame,
    states: Iterable[str],
) -> DataFrame:
    """Centers, sizes, totals and region names: one row per cluster."""
    return (
        cluster_centers(regions, features)
        .select("cluster", *features)
        .join(cluster_sizes(result), "cluster")
        .join(cluster_rollup(result), "cluster")
        .join(region_names_concat(result, lookup, states), "cluster", "left")
    )


def ratio_change(potential: Column, actual: Column) -> Column:
    return F.bround(F.try_divide(potential, actual) - 1, 2)


def headline_summary(rollup: DataFrame) -> DataFrame:
    """Actual, potential and change per measure, overall and for core pages, as rows."""
    rows = []
    for name in ("sessions", "acv"):
        actual, potential = name, f"potential_{name}"
        core, potential_core = f"{name}_core", f"potential_{name}_core"
        for label, a, p in ((name, actual, potential), (f"core {name}", core, potential_core)):
            rows.append((label, F.col(a), F.col(p), ratio_change(F.col(p), F.col(a))))
        rows.append((f"{name} core %", share(core, actual), share(potential_core, potential), None))
    return summary_rows(rollup, rows)


def headline_summary_wide(rollup: DataFrame) -> DataFrame:
    """Headline rows of the wide model."""
    pairs = {"total": "potential_total", "core": "potential_core", "acv": "potential_acv"}
    rows = [(a, F.col(a), F.col(p), ratio_change(F.col(p), F.col(a))) for a, p in pairs.items()]
    rows.append(("core percent", share("core", "total"), share("potential_core", "potential_total"), None))
    return summary_rows(rollup, rows)


def share(part: str, whole: str) -> Column:
    return F.bround(F.try_divide(F.col(part), F.col(whole)), 2)


def summary_rows(
    rollup: DataFrame, rows: Sequence[tuple[str, Column, Column, Column | None]]
) -> DataFrame:
    """Totals over the clusters, turned into (measure, actual, potential, change) rows."""
    totals = rollup.agg(*[F.sum(c).alias(c) for c in rollup.columns if c != "cluster"])
    matrix = F.array(
        *[
            F.struct(
                F.lit(label).alias("measure"),
                a.cast("double").alias("actual"),
                p.cast("double").alias("potential"),
                (F.lit(None) if c is None else c).cast("double").alias("change_percent"),
            )
            for label, a, p, c in rows
        ]
    )
    return totals.select(F.inline(matrix))


def row_differences(df: DataFrame) -> DataFrame:
    """Per-row BI measures."""
    return df.withColumns(
        {
            "incremental_traffic": F.col("potential_total") - F.col("total"),
            "incremental_acv": F.col("potential_acv") - F.col("acv"),
            "pct_potential_total": change_pct(F.col("total"), F.col("potential_total")),
            "pct_potential_acv": F.try_divide(F.col("potential_acv") - F.col("acv"), F.col("acv")),
        }
    )


def ratio_of_sums(diff: str, base: str) -> Column:
    return F.try_divide(F.sum(diff), F.sum(base))


def incremental_measures(df: DataFrame, by: Sequence[str], totals: bool = False) -> DataFrame:
    """Incremental traffic and revenue with their share of today's, optionally with subtotals."""
    rows = row_differences(df)
    grouped = rows.rollup(*by) if totals else rows.groupBy(*by)
    return grouped.agg(
        *([F.grouping_id().alias("level")] if totals else []),
        F.sum("incremental_acv").alias("incremental_acv"),
        ratio_of_sums("incremental_acv", "acv").alias("incremental_acv_pct"),
        F.sum("incremental_traffic").alias("incremental_traffic"),
        ratio_of_sums("incremental_traffic", "total").alias("incremental_traffic_pct"),
    )


# The summary sheet shows its measures in this order.
SUMMARY_ORDER = (
    "incremental_acv",
    "incremental_acv_pct",
    "incremental_traffic",
    "incremental_traffic_pct",
)


def bi_summary(df: DataFrame) -> DataFrame:
    """Per practice area and grand total (level 1), measures as rows in display order."""
    wide = incremental_measures(df, ["pa"], totals=True)
    long = measures_long(wide.withColumn("pa", F.coalesce("pa", F.lit("Grand Total"))), ["pa", "level"], SUMMARY_ORDER)
    return long.withColumn("position", member_position(F.col("measure"), SUMMARY_ORDER)).orderBy(
        "level", "pa", "position"
    )


def in_total_range(df: DataFrame, low: float, high: float) -> DataFrame:
    """Range on the row's own total, applied before any aggregation."""
    return df.where(F.col("total").between(low, high))


def bi_county_table(df: DataFrame, practice_area: str, low: float, high: float) -> DataFrame:
    rows = in_total_range(df.where(F.col("pa") == practice_area), low, high)
    wide = incremental_measures(rows, ["state", "county"])
    return measures_long(wide, ["state", "county"], ["incremental_acv_pct", "incremental_traffic_pct"])


def bi_map_rows(df: DataFrame, practice_area: str, low: float, high: float) -> DataFrame:
    """Map rows: current revenue, incremental share, its colour step and mark size."""
    rows = row_differences(in_total_range(df.where(F.col("pa") == practice_area), low, high))
    sums = rows.groupBy("state", "county").agg(
        F.sum("acv").alias("acv"),
        ratio_of_sums("incremental_acv", "acv").alias("incremental_acv_pct"),
        ratio_of_sums("incremental_traffic", "total").alias("incremental_traffic_pct"),
    )
    return sums.withColumns(
        {
            "color_bin": choropleth_bin(F.col("incremental_acv_pct"), 0.0, 2.0, 5),
            "mark_size": mark_size(F.col("incremental_traffic_pct"), 0.05, 2.0),
        }
    )


def bi_scatter(df: DataFrame, practice_area: str) -> DataFrame:
    """(current, incremental %) points per region for revenue and traffic."""
    rows = row_differences(df.where(F.col("pa") == practice_area))
    return rows.groupBy("state", "county").agg(
        F.sum("acv").alias("acv"),
        ratio_of_sums("incremental_acv", "acv").alias("incremental_acv_pct"),
        F.sum("total").alias("total"),
        ratio_of_sums("incremental_traffic", "total").alias("incremental_traffic_pct"),
    )


def bi_state_pages(
    df: DataFrame, mainland: Sequence[tuple[str, str]], inset: str
) -> DataFrame:
    """Mainland and inset sheets by region: summed difference and sum of per-row ratios."""
    part = (
        F.when(F.col("state") == inset, "inset")
        .when(member_ranges(F.col("state"), mainland), "mainland")
    )
    rows = row_differences(df).withColumn("sheet", part).where(F.col("sheet").isNotNull())
    return rows.groupBy("sheet", "state", "county").agg(
        F.sum("incremental_traffic").alias("diff_total"),
        F.sum("pct_potential_acv").alias("potacv_percentage"),
    )


def map_polygons(result: DataFrame, polygon: DataFrame, lookup: DataFrame, states: Iterable[str]) -> DataFrame:
    """Region to the ordered vertices of its outlines, for the chosen states, with the fill index."""
    regions = in_named_states(result, lookup, states).select("state", "county", "cluster").distinct()
    return regions.join(polygon, ["state", "county"]).withColumn("color_index", F.col("cluster") * 2 - 1)

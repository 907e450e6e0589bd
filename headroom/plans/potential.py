"""Target rates per cluster, potential sessions and potential ad revenue."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from headroom.functions.scalars import damped_potential, safe_ratio
from headroom.operators.grouping import sum_then_mean
from headroom.operators.quantile import group_quantile
from headroom.operators.reshape import practice_area_select, unpivot_pages
from headroom.sources.shared import cut_lineage

REGION = ("state", "county")
TARGET_QUANTILE = "0.7"
ACV_MEASURES = ("slimps", "daimps", "slacv", "daacv")
# Log bases of the damping, per product and for the wide (first) model.
SL_BASE, DA_BASE, WIDE_BASE = 3000.0, 4000.0, 100.0


def traffic_long(traffic: DataFrame, practice_areas: str) -> DataFrame:
    """Sessions by region and page type over the chosen practice areas."""
    chosen = practice_area_select(traffic, practice_areas)
    sums = chosen.groupBy(*REGION).agg(F.sum("core").alias("core"), F.sum("others").alias("others"))
    return unpivot_pages(sums, REGION)


def region_sessions(regions: DataFrame, sessions: DataFrame) -> DataFrame:
    """Regions (with ``cluster`` and ``pop_total``) and their sessions, kept without traffic too.

    The population always travels under its own name, whatever features were chosen.
    """
    base = regions.select(*REGION, "cluster", F.col("pop_total").alias("pop_base_count"))
    joined = base.join(sessions, list(REGION), "left")
    return joined.withColumn("sessions", F.coalesce("sessions", F.lit(0.0))).withColumn(
        "sessions_pp", safe_ratio(F.col("sessions"), F.col("pop_base_count"))
    )


def cluster_targets(df: DataFrame, rate: str, target: str, by: Iterable[str] = ("cluster", "pt")) -> DataFrame:
    """70th-percentile rate per cluster (and page type), as an existing member's rate."""
    return group_quantile(df, by, rate, TARGET_QUANTILE, target)


def lift_to_target(df: DataFrame, targets: DataFrame, rate: str, target: str, potential: str) -> DataFrame:
    """``potential`` = the better of own rate and target, times the population."""
    by = [c for c in targets.columns if c != target]
    best = F.greatest(F.col(rate), F.col(target)) * F.col("pop_base_count")
    return df.join(targets, by, "left").withColumn(potential, best)


def potential_sessions(df: DataFrame) -> DataFrame:
    """Potential sessions by region and page type; regions without traffic have no page type.

    The target search reads the regions several times, so they are written once: a row per
    region is little next to the tables it took to get there.
    """
    seen = cut_lineage(df.where(F.col("pt").isNotNull()), "region-sessions")
    targets = cluster_targets(seen, "sessions_pp", "target_sessions_pp")
    return lift_to_target(seen, targets, "sessions_pp", "target_sessions_pp", "potential_sessions")


def potential_totals_wide(regions: DataFrame, traffic: DataFrame, by: Iterable[str] = ()) -> DataFrame:
    """Total and core side by side, every region counted in its cluster's target.

    ``traffic`` has one row per region and ``by``; regions missing there have zero sessions.
    """
    by = list(by)
    zero = F.lit(0.0)
    base = regions.select(*REGION, *by, "cluster", F.col("pop_total").alias("pop_base_count"))
    df = base.join(traffic, [*REGION, *by], "left").withColumns(
        {"core": F.coalesce("core", zero), "others": F.coalesce("others", zero)}
    )
    df = df.withColumn("total", F.col("others") + F.col("core"))
    for name in ("total", "core"):
        df = df.withColumn(f"{name}_pp", safe_ratio(F.col(name), F.col("pop_base_count")))
    df = cut_lineage(df, "region-totals")
    out = df
    for name in ("total", "core"):
        targets = cluster_targets(df, f"{name}_pp", f"target_{name}_pp", ["cluster", *by])
        out = lift_to_target(out, targets, f"{name}_pp", f"target_{name}_pp", f"potential_{name}")
    return out


def monthly_acv(acv_input: DataFrame, practice_areas: str, keys: Iterable[str]) -> DataFrame:
    """Impressions and revenue per average month of the chosen practice areas."""
    return sum_then_mean(practice_area_select(acv_input, practice_areas), "month", keys, ACV_MEASURES, amounts=True)


def revenue_rates(acv: DataFrame, sessions: DataFrame, keys: Iterable[str]) -> DataFrame:
    """Impressions and revenue per session; missing parts and undefined rates are 0."""
    zero = F.lit(0.0)
    joined = acv.join(sessions, list(keys), "full_outer").withColumns(
        {c: F.coalesce(c, zero) for c in (*ACV_MEASURES, "sessions")}
    )
    per_session = {"sl_ips": "slimps", "da_ips": "daimps", "sl_aps": "slacv", "da_aps": "daacv"}
    return joined.withColumns(
        {rate: safe_ratio(F.col(total), F.col("sessions")) for rate, total in per_session.items()}
    )


def with_potential_acv(
    df: DataFrame,
    sessions: str = "sessions",
    potential: str = "potential_sessions",
    sl_base: float = SL_BASE,
    da_base: float = DA_BASE,
    sl: str = "slacv",
    da: str = "daacv",
) -> DataFrame:
    """Potential revenue per product and in total, from today's revenue and session lift."""

    def lifted(measure: str, base: float) -> Column:
        return damped_potential(F.col(measure), F.col(sessions), F.col(potential), base)

    return (
        df.withColumn("potential_sl_acv", lifted(sl, sl_base))
        .withColumn("potential_da_acv", lifted(da, da_base))
        .withColumn("acv", F.col(sl) + F.col(da))
        .withColumn("potential_acv", F.col("potential_sl_acv") + F.col("potential_da_acv"))
    )


RESULT_COLUMNS = (
    "state",
    "county",
    "cluster",
    "pt",
    "sessions",
    "pop_base_count",
    "sessions_pp",
    "target_sessions_pp",
    "potential_sessions",
    "slacv",
    "potential_sl_acv",
    "daacv",
    "potential_da_acv",
    "acv",
    "potential_acv",
    "pa",
)


def county_result(
    regions: DataFrame, traffic: DataFrame, acv_input: DataFrame, practice_areas: str, label: str | None = None
) -> DataFrame:
    """The per-region output: actual and potential sessions and revenue by page type."""
    keys = [*REGION, "pt"]
    sessions = region_sessions(regions, traffic_long(traffic, practice_areas))
    lifted = potential_sessions(sessions)
    acv = monthly_acv(acv_input, practice_areas, keys).select(*keys, "slacv", "daacv")
    zero = F.lit(0.0)
    joined = lifted.join(acv, keys, "left").withColumns(
        {"slacv": F.coalesce("slacv", zero), "daacv": F.coalesce("daacv", zero)}
    )
    return (
        with_potential_acv(joined)
        .withColumn("pa", F.lit(label or practice_areas))
        .select(*RESULT_COLUMNS)
    )


def county_clusters(regions: DataFrame, traffic: DataFrame, acv_input: DataFrame, areas: Sequence[str]) -> DataFrame:
    """The wide BI table: every region in each of the stated practice areas, actual and potential."""
    per_area = regions.select(*REGION, "cluster", "pop_total").withColumn("pa", F.explode(F.array(*map(F.lit, areas))))
    traffic, acv_input = (df.where(F.col("pa").isin(*areas)) for df in (traffic, acv_input))
    wide = potential_totals_wide(per_area, traffic, by=["pa"])
    keys = [*REGION, "pa"]
    acv = sum_then_mean(acv_input, "month", keys, ["slacv", "daacv"], amounts=True).select(
        *keys, F.col("slacv").alias("sl_acv"), F.col("daacv").alias("da_acv")
    )
    joined = wide.join(acv, keys, "left")
    return with_potential_acv(joined, "total", "potential_total", WIDE_BASE, WIDE_BASE, "sl_acv", "da_acv")


def session_conservation(
    regions: DataFrame, traffic: DataFrame, acv_input: DataFrame, practice_areas: str
) -> DataFrame:
    """Total sessions after each join; equal totals mean that no join lost or doubled rows."""
    long = traffic_long(traffic, practice_areas)
    joined = region_sessions(regions, long)
    rates = revenue_rates(monthly_acv(acv_input, practice_areas, [*REGION, "pt"]), long, [*REGION, "pt"])
    result = county_result(regions, traffic, acv_input, practice_areas)
    stages = {"1_traffic": long, "2_regions": joined, "3_rates": rates, "4_result": result}
    out = None
    for stage, df in stages.items():
        total = df.agg(F.sum("sessions").alias("sessions")).select(F.lit(stage).alias("stage"), "sessions")
        out = total if out is None else out.unionByName(total)
    return out

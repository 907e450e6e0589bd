"""Queries for cluster reports, BI sheets, reshaping and profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from headroom.functions import scalars as S
from headroom.operators import grouping as G
from headroom.operators import reshape as R
from headroom.operators.numbering import number_rows
from headroom.plans import potential as P
from headroom.plans import report
from headroom.queries.region_queries import NAMED_STATES, REGION, clusters_wide, result
from headroom.queries.registry import half_up_sql, query, rounded
from headroom.queries.warehouse import FEATURE_NAMES
from headroom.sources.shared import cut_lineage, keyed_table

LOW, HIGH = 5.0, 31137.67
MAINLAND = [("NATION_0", "NATION_14"), ("NATION_20", "NATION_9")]
INSET = "NATION_17"

ROLLUP_TWIN = """SELECT cluster, round_even(sum(sessions), 0) AS sessions,
    round_even(sum(potential_sessions), 0) AS potential_sessions, round_even(sum(acv), 0) AS acv,
    round_even(sum(potential_acv), 0) AS potential_acv,
    round_even(sum(CASE WHEN pt = 'core' THEN sessions END), 0) AS sessions_core,
    round_even(sum(CASE WHEN pt = 'core' THEN potential_sessions END), 0) AS potential_sessions_core,
    round_even(sum(CASE WHEN pt = 'core' THEN acv END), 0) AS acv_core,
    round_even(sum(CASE WHEN pt = 'core' THEN potential_acv END), 0) AS potential_acv_core
  FROM result GROUP BY cluster"""

NAMES_TWIN = """SELECT cluster, string_agg(county, ',' ORDER BY county) AS counties
  FROM (SELECT DISTINCT cluster, county FROM result
        WHERE lower(state) IN ('nation_3', 'nation_7', 'nation_11')) n
  GROUP BY cluster"""


@query("cluster_rollup", ROLLUP_TWIN)
def cluster_rollup(w):
    return report.cluster_rollup(result(w))


@query("region_names_concat", NAMES_TWIN)
def region_names_concat(w):
    return report.region_names_concat(result(w), w.state_lookup, NAMED_STATES)


@query(
    "region_names",
    """SELECT DISTINCT cluster, county FROM result
    WHERE lower(state) IN ('nation_3', 'nation_7', 'nation_11')""",
)
def region_names(w):
    return report.region_names(result(w), w.state_lookup, NAMED_STATES)


@query(
    "cluster_report",
    f"""WITH roll AS ({ROLLUP_TWIN}), names AS ({NAMES_TWIN}),
    centers AS (SELECT cluster, round(avg(age_male), 6) AS age_male,
        round(avg(emp_no_per_pop_total), 6) AS emp_no_per_pop_total,
        round(avg(hh_median_income), 6) AS hh_median_income,
        round(avg(pov_below_per_pop_total), 6) AS pov_below_per_pop_total
      FROM regions GROUP BY cluster),
    sizes AS (SELECT cluster, count(*) AS members, count(DISTINCT state || '|' || county) AS regions
      FROM result GROUP BY cluster)
    SELECT centers.*, sizes.members, sizes.regions, roll.* EXCLUDE (cluster),
      names.counties
    FROM centers JOIN sizes USING (cluster) JOIN roll USING (cluster)
    LEFT JOIN names USING (cluster)""",
)
def cluster_report(w):
    rows = cut_lineage(
        P.county_result(w.stored_regions, w.traffic, w.acv_input, "all"), "county-result"
    )
    return rounded(
        report.cluster_report(w.stored_regions, rows, FEATURE_NAMES, w.state_lookup, NAMED_STATES)
    )


@query(
    "headline_summary",
    f"""WITH roll AS ({ROLLUP_TWIN}), t AS (SELECT sum(sessions) AS s, sum(potential_sessions) AS ps,
      sum(acv) AS a, sum(potential_acv) AS pa, sum(sessions_core) AS sc,
      sum(potential_sessions_core) AS psc, sum(acv_core) AS ac, sum(potential_acv_core) AS pac
      FROM roll)
    SELECT 'sessions' AS measure, s AS actual, ps AS potential, round_even(ps / s - 1, 2)
      AS change_percent FROM t
    UNION ALL SELECT 'core sessions', sc, psc, round_even(psc / sc - 1, 2) FROM t
    UNION ALL SELECT 'sessions core %', round_even(sc / s, 2), round_even(psc / ps, 2), NULL FROM t
    UNION ALL SELECT 'acv', a, pa, round_even(pa / a - 1, 2) FROM t
    UNION ALL SELECT 'core acv', ac, pac, round_even(pac / ac - 1, 2) FROM t
    UNION ALL SELECT 'acv core %', round_even(ac / a, 2), round_even(pac / pa, 2), NULL FROM t""",
)
def headline_summary(w):
    return report.headline_summary(report.cluster_rollup(result(w)))


WIDE_ROLLUP_TWIN = """SELECT cluster, round_even(sum(total), 0) AS total,
    round_even(sum(core), 0) AS core, round_even(sum(potential_total), 0) AS potential_total,
    round_even(sum(potential_core), 0) AS potential_core, round_even(sum(acv), 0) AS acv,
    round_even(sum(potential_acv), 0) AS potential_acv FROM county_clusters GROUP BY cluster"""


@query("cluster_rollup_wide", WIDE_ROLLUP_TWIN)
def cluster_rollup_wide(w):
    return report.cluster_rollup_wide(clusters_wide(w))


@query(
    "headline_summary_wide",
    f"""WITH t AS (SELECT sum(total) AS a, sum(core) AS c, sum(potential_total) AS pa,
      sum(potential_core) AS pc, sum(acv) AS v, sum(potential_acv) AS pv FROM ({WIDE_ROLLUP_TWIN}) r)
    SELECT 'total' AS measure, a AS actual, pa AS potential, round_even(pa / a - 1, 2)
      AS change_percent FROM t
    UNION ALL SELECT 'core', c, pc, round_even(pc / c - 1, 2) FROM t
    UNION ALL SELECT 'acv', v, pv, round_even(pv / v - 1, 2) FROM t
    UNION ALL SELECT 'core percent', round_even(c / a, 2), round_even(pc / pa, 2), NULL FROM t""",
)
def headline_summary_wide(w):
    return report.headline_summary_wide(report.cluster_rollup_wide(clusters_wide(w)))


@query(
    "county_clusters",
    f"""SELECT state, county, pa, cluster, core, others, total, pop_base_count,
      {half_up_sql("total_pp")} AS total_pp, {half_up_sql("core_pp")} AS core_pp,
      {half_up_sql("target_total_pp")} AS target_total_pp,
      {half_up_sql("target_core_pp")} AS target_core_pp,
      {half_up_sql("potential_total")} AS potential_total,
      {half_up_sql("potential_core")} AS potential_core, {half_up_sql("sl_acv")} AS sl_acv,
      {half_up_sql("potential_sl_acv")} AS potential_sl_acv, {half_up_sql("da_acv")} AS da_acv,
      {half_up_sql("potential_da_acv")} AS potential_da_acv, {half_up_sql("acv")} AS acv,
      {half_up_sql("potential_acv")} AS potential_acv FROM county_clusters""",
)
def county_clusters(w):
    return rounded(clusters_wide(w), half_up=True)


@query(
    "ratio_of_sums",
    """SELECT pa, round(sum(incremental_traffic) / nullif(sum(total), 0), 6) AS traffic_pct,
      round(sum(incremental_acv) / nullif(sum(acv), 0), 6) AS acv_pct FROM bi_rows GROUP BY pa""",
)
def ratio_of_sums(w):
    rows = report.row_differences(clusters_wide(w))
    return rounded(
        rows.groupBy("pa").agg(
            report.ratio_of_sums("incremental_traffic", "total").alias("traffic_pct"),
            report.ratio_of_sums("incremental_acv", "acv").alias("acv_pct"),
        )
    )


@query(
    "sum_of_ratios",
    """SELECT pa, round(sum(pct_potential_acv), 6) AS acv_ratios,
      round(sum(pct_potential_total), 6) AS traffic_ratios FROM bi_rows GROUP BY pa""",
)
def sum_of_ratios(w):
    rows = report.row_differences(clusters_wide(w))
    return rounded(
        rows.groupBy("pa").agg(
            F.sum("pct_potential_acv").alias("acv_ratios"),
            F.sum("pct_potential_total").alias("traffic_ratios"),
        )
    )


@query(
    "count_distinct_measure",
    """SELECT pa, count(DISTINCT acv) AS acv_n, count(DISTINCT potential_acv) AS potential_acv_n
    FROM county_clusters GROUP BY pa""",
)
def count_distinct_measure(w):
    return clusters_wide(w).groupBy("pa").agg(
        F.countDistinct("acv").alias("acv_n"), F.countDistinct("potential_acv").alias("potential_acv_n")
    )


@query(
    "row_count_measure",
    """SELECT pa, cluster, count(*) AS number_of_records FROM county_clusters GROUP BY pa, cluster""",
)
def row_count_measure(w):
    return clusters_wide(w).groupBy("pa", "cluster").agg(F.count("*").alias("number_of_records"))


@query(
    "grand_total",
    """SELECT coalesce(pa, 'Grand Total') AS pa, sum(core) AS core, sum(others) AS others
    FROM traffic GROUP BY ROLLUP (pa)""",
)
def grand_total(w):
    totals = w.traffic.rollup("pa").agg(
        F.grouping_id().alias("level"), F.sum("core").alias("core"), F.sum("others").alias("others")
    )
    name = F.when(F.col("level") == 1, "Grand Total").otherwise(F.col("pa"))
    return totals.select(name.alias("pa"), "core", "others")


@query(
    "drilldown_rollup",
    """SELECT state, county, sum(core) AS core, sum(others) AS others, count(*) AS n
    FROM traffic GROUP BY ROLLUP (state, county)""",
)
def drilldown_rollup(w):
    return w.traffic.rollup("state", "county").agg(
        F.sum("core").alias("core"), F.sum("others").alias("others"), F.count("*").alias("n")
    )


PROFILED = ("total", "potential_total", "acv", "potential_acv")


PROFILE_DIGITS = {"sum": 4, "avg": 5, "min": 6, "max": 6, "stdev": 5, "stdev_p": 5, "var": 3, "var_p": 3, "sum_sq": 1, "median": 6}


@query(
    "column_profile",
    "\nUNION ALL ".join(
        f"""SELECT '{c}' AS measure, round(sum({c}), 4) AS sum, round(avg({c}), 5) AS avg,
      round(min({c}), 6) AS min, round(max({c}), 6) AS max, round(stddev_samp({c}), 5) AS stdev,
      round(stddev_pop({c}), 5) AS stdev_p, round(var_samp({c}), 3) AS var,
      round(var_pop({c}), 3) AS var_p, count({c}) AS n, round(sum({c} * {c}), 1) AS sum_sq,
      count(DISTINCT {c}) AS distinct_n, round(median({c}), 6) AS median FROM county_clusters"""
        for c in PROFILED
    ),
)
def column_profile(w):
    profile = G.column_profile(cut_lineage(clusters_wide(w).select(*PROFILED), "extract"), PROFILED)
    return profile.withColumns({c: F.round(c, d) for c, d in PROFILE_DIGITS.items()})


# --- reshape and order ------------------------------------------------------------------


@query(
    "unpivot_pagetype",
    """SELECT state, county, pa, 'core' AS pt, core AS sessions FROM traffic
    UNION ALL SELECT state, county, pa, 'others', others FROM traffic""",
)
def unpivot_pagetype(w):
    return R.unpivot_pages(w.traffic, [*REGION, "pa"])


@query(
    "pivot_sum",
    """SELECT state, county, pa, sum(CASE WHEN pt IN ('serp', 'profile') THEN pv END) AS core,
      sum(CASE WHEN pt NOT IN ('serp', 'profile') THEN pv END) AS others
    FROM ad_performance_daily GROUP BY state, county, pa""",
)
def pivot_sum(w):
    rows = w.ad_performance_daily.withColumn("pt", S.page_bucket_coarse(F.col("pt"), other="others"))
    return R.pivot_sum(rows, [*REGION, "pa"], "pt", ["core", "others"], "pv")


@query(
    "measure_names_long",
    """SELECT pa, state, 'core' AS measure, sum(core) AS value FROM traffic GROUP BY pa, state
    UNION ALL SELECT pa, state, 'others', sum(others) FROM traffic GROUP BY pa, state""",
)
def measure_names_long(w):
    sums = w.traffic.groupBy("pa", "state").agg(F.sum("core").alias("core"), F.sum("others").alias("others"))
    return R.measures_long(sums, ["pa", "state"], ["core", "others"])


MEASURE_ORDER = ["others", "core"]


@query(
    "manual_member_order",
    """SELECT pa, measure, CASE measure WHEN 'others' THEN 1 ELSE 2 END AS position, value
    FROM (SELECT pa, 'core' AS measure, sum(core) AS value FROM traffic GROUP BY pa
      UNION ALL SELECT pa, 'others', sum(others) FROM traffic GROUP BY pa) m""",
)
def manual_member_order(w):
    sums = w.traffic.groupBy("pa").agg(F.sum("core").alias("core"), F.sum("others").alias("others"))
    long = R.measures_long(sums, ["pa"], ["core", "others"])
    position = R.member_position(F.col("measure"), MEASURE_ORDER).alias("position")
    return long.select("pa", "measure", position, "value").orderBy("pa", "position")


@query(
    "keyed_order",
    """SELECT statecounty, cast(event_day AS varchar) AS event_day, count(*) AS n
    FROM ad_performance_daily GROUP BY 1, 2 ORDER BY 1, 2""",
)
def keyed_order(w):
    days = w.ad_performance_daily.groupBy("statecounty", "event_day").agg(F.count("*").alias("n"))
    return rounded(days).orderBy("statecounty", "event_day")


@query(
    "keyed_markets",
    """SELECT p.statecounty, count(*) AS n, count(DISTINCT p.event_day) AS days, round(sum(p.pv), 4) AS pv, m.markets
    FROM ad_performance_daily p JOIN (SELECT statecounty, count(DISTINCT pt || rt) AS markets FROM ad_performance_daily
      WHERE sl_acv > 0 GROUP BY 1 HAVING count(DISTINCT event_day) > 4) m USING (statecounty) GROUP BY 1, 5""",
)
def keyed_markets(w):
    """Eligible markets with their totals from a table kept by market: neither aggregate nor join moves a row."""
    cols = ["statecounty", "event_day", "pt", "rt", "pv", "sl_acv"]
    return rounded(keyed_market_totals(keyed_table(w.ad_performance_daily.select(*cols), ["statecounty"], ["event_day"])), 4)


def keyed_market_totals(keyed):
    active = keyed.where("sl_acv > 0").groupBy("statecounty").agg(
        F.size(F.collect_set("event_day")).alias("active"), F.size(F.collect_set(F.concat("pt", "rt"))).cast("long").alias("markets")
    )
    totals = keyed.groupBy("statecounty").agg(
        F.count("*").alias("n"), F.size(F.collect_set("event_day")).cast("long").alias("days"), F.sum("pv").alias("pv")
    )
    return totals.join(active.where("active > 4").drop("active"), "statecounty")


@query(
    "group_size_seq",
    """SELECT state, pa, pt, rt, statecounty, cast(event_day AS varchar) AS event_day,
      count(*) OVER (PARTITION BY state) AS ndays,
      row_number() OVER (PARTITION BY state ORDER BY event_day, statecounty, pa, pt, rt) AS num
    FROM ad_performance_daily""",
)
def group_size_seq(w):
    cols = ["state", "statecounty", "event_day", "pa", "pt", "rt"]
    rows = w.ad_performance_daily.select(*cols)
    order = ["event_day", "statecounty", "pa", "pt", "rt"]
    return rounded(number_rows(rows, ["state"], order, seq="num", size="ndays"))


@query("distinct_keys", "SELECT DISTINCT state, county, rt, pt, weekend FROM ad_performance_daily")
def distinct_keys(w):
    return w.ad_performance_daily.select(*REGION, "rt", "pt", "weekend").dropDuplicates()


# --- BI sheets --------------------------------------------------------------------------


@query(
    "choropleth_bins",
    """SELECT state, county, pa,
      CASE WHEN pct_potential_acv IS NOT NULL THEN greatest(1, least(5,
        cast(floor(pct_potential_acv / 0.4) AS integer) + 1)) END AS color_bin,
      floor((CASE WHEN pct_potential_total IS NOT NULL THEN
        (greatest(0.05, least(2.0, pct_potential_total)) - 0.05) / 1.95 END) * 1e6 + 0.5) / 1e6 AS mark_size
    FROM bi_rows""",
)
def choropleth_bins(w):
    rows = report.row_differences(clusters_wide(w))
    return rounded(
        rows.select(
            *REGION,
            "pa",
            S.choropleth_bin(F.col("pct_potential_acv"), 0.0, 2.0, 5).alias("color_bin"),
            S.mark_size(F.col("pct_potential_total"), 0.05, 2.0).alias("mark_size"),
        ), 6, half_up=True)


@query(
    "bi_summary",
    """WITH g AS (SELECT coalesce(pa, 'Grand Total') AS pa, grouping(pa) AS level,
        sum(incremental_acv) AS a, sum(incremental_acv) / nullif(sum(acv), 0) AS ap,
        sum(incremental_traffic) AS t, sum(incremental_traffic) / nullif(sum(total), 0) AS tp
      FROM bi_rows GROUP BY ROLLUP (pa))
    SELECT pa, level, 'incremental_acv' AS measure, round(a, 4) AS value, 1 AS position FROM g
    UNION ALL SELECT pa, level, 'incremental_acv_pct', round(ap, 4), 2 FROM g
    UNION ALL SELECT pa, level, 'incremental_traffic', round(t, 4), 3 FROM g
    UNION ALL SELECT pa, level, 'incremental_traffic_pct', round(tp, 4), 4 FROM g""",
)
def bi_summary(w):
    return rounded(report.bi_summary(clusters_wide(w)), 4)


@query(
    "bi_county_table",
    f"""WITH g AS (SELECT state, county, sum(incremental_acv) / nullif(sum(acv), 0) AS ap,
        sum(incremental_traffic) / nullif(sum(total), 0) AS tp FROM bi_rows
      WHERE pa = 'ECONOMY' AND total BETWEEN {LOW} AND {HIGH} GROUP BY state, county)
    SELECT state, county, 'incremental_acv_pct' AS measure, floor((ap) * 1e6 + 0.5) / 1e6 AS value FROM g
    UNION ALL SELECT state, county, 'incremental_traffic_pct', floor((tp) * 1e6 + 0.5) / 1e6 FROM g""",
)
def bi_county_table(w):
    return rounded(report.bi_county_table(clusters_wide(w), "ECONOMY", LOW, HIGH), 6, half_up=True)


@query(
    "bi_map_rows",
    f"""SELECT state, county, {half_up_sql("acv", 6)} AS acv, floor((ap) * 1e6 + 0.5) / 1e6 AS incremental_acv_pct,
      floor((tp) * 1e6 + 0.5) / 1e6 AS incremental_traffic_pct,
      CASE WHEN ap IS NOT NULL THEN greatest(1, least(5, cast(floor(ap / 0.4) AS integer) + 1)) END
        AS color_bin,
      floor((CASE WHEN tp IS NOT NULL THEN (greatest(0.05, least(2.0, tp)) - 0.05) / 1.95 END) * 1e6 + 0.5) / 1e6
        AS mark_size
    FROM (SELECT state, county, sum(acv) AS acv, sum(incremental_acv) / nullif(sum(acv), 0) AS ap,
        sum(incremental_traffic) / nullif(sum(total), 0) AS tp FROM bi_rows
      WHERE pa = 'ECONOMY' AND total BETWEEN {LOW} AND {HIGH} GROUP BY state, county) g""",
)
def bi_map_rows(w):
    return rounded(report.bi_map_rows(clusters_wide(w), "ECONOMY", LOW, HIGH), 6, half_up=True)


@query(
    "bi_scatter",
    f"""SELECT state, county, {half_up_sql("sum(acv)", 6)} AS acv,
      floor((sum(incremental_acv) / nullif(sum(acv), 0)) * 1e6 + 0.5) / 1e6 AS incremental_acv_pct,
      sum(total) AS total,
      floor((sum(incremental_traffic) / nullif(sum(total), 0)) * 1e6 + 0.5) / 1e6 AS incremental_traffic_pct
    FROM bi_rows WHERE pa = 'ECONOMY' GROUP BY state, county""",
)
def bi_scatter(w):
    return rounded(report.bi_scatter(clusters_wide(w), "ECONOMY"), 6, half_up=True)


@query(
    "bi_state_pages",
    f"""SELECT CASE WHEN state = '{INSET}' THEN 'inset' ELSE 'mainland' END AS sheet, state, county,
      floor((sum(incremental_traffic)) * 1e6 + 0.5) / 1e6 AS diff_total,
      floor((sum(pct_potential_acv)) * 1e6 + 0.5) / 1e6 AS potacv_percentage
    FROM bi_rows WHERE state = '{INSET}' OR state BETWEEN 'NATION_0' AND 'NATION_14'
      OR state BETWEEN 'NATION_20' AND 'NATION_9' GROUP BY 1, 2, 3""",
)
def bi_state_pages(w):
    return rounded(report.bi_state_pages(clusters_wide(w), MAINLAND, INSET), 6, half_up=True)

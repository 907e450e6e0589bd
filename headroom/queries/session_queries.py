"""Queries over page views, attribution and ad inventory."""

from __future__ import annotations

from pyspark.sql import functions as F

from headroom.functions import scalars as S
from headroom.operators.bitmaps import count_values, value_bitmaps
from headroom.plans import sessions as plan
from headroom.queries.registry import query, rounded
from headroom.queries.warehouse import Warehouse
from headroom.sources.readers import run_sql, scan_events
from headroom.sources.shared import cut_lineage

JANUARY = ("2024-01-01", "2024-01-31")
ALL_DAYS = ("1995-01-01", "2001-12-31")


def dimensions(w: Warehouse) -> plan.Dimensions:
    return plan.Dimensions(w.specialty_dimension, w.geography_dimension, w.ad_market_dimension)


@query(
    "scan_pageviews",
    """SELECT cast(event_date AS varchar) AS event_date, session_id, page_type, specialty_id
    FROM page_view WHERE event_date BETWEEN date '2024-01-05' AND date '2024-01-25'""",
)
def scan_pageviews(w):
    cols = ["event_date", "session_id", "page_type", "specialty_id"]
    return rounded(scan_events(w.page_view, "2024-01-05", "2024-01-25", cols))


@query(
    "warehouse_sql",
    """SELECT specialty_name, count(*) AS views, count(DISTINCT session_id) AS sessions
    FROM page_view JOIN specialty_dimension USING (specialty_id)
    WHERE event_date >= date '2024-01-01' GROUP BY specialty_name""",
)
def warehouse_sql(w):
    text = """
        SELECT specialty_name, count(*) AS views, count(DISTINCT session_id) AS sessions
        FROM {page_view} JOIN {specialty_dimension} USING (specialty_id)
        WHERE event_date >= date '2024-01-01' GROUP BY specialty_name"""
    tables = {"page_view": w.page_view, "specialty_dimension": w.specialty_dimension}
    return run_sql(w.spark, text, tables)


@query(
    "year_month_key",
    """SELECT event_id, cast(year(event_date) * 100 + month(event_date) AS integer) AS year_month
    FROM page_view""",
)
def year_month_key(w):
    return w.page_view.select("event_id", S.year_month(F.col("event_date")).alias("year_month"))


@query(
    "page_bucket",
    """SELECT event_id, bucket AS page FROM bucketed_view""",
)
def page_bucket(w):
    return w.page_view.select("event_id", S.page_bucket(F.col("page_type")).alias("page"))


@query(
    "page_bucket_coarse",
    """SELECT pt, CASE pt WHEN 'other' THEN 'noncore' ELSE 'core' END AS bucket, count(*) AS n
    FROM ad_performance_daily GROUP BY ALL""",
)
def page_bucket_coarse(w):
    bucket = S.page_bucket_coarse(F.col("pt")).alias("bucket")
    return w.ad_performance_daily.groupBy("pt", bucket).agg(F.count("*").alias("n"))


@query(
    "channel_classify",
    """SELECT source, medium, count(*) AS n FROM (
      SELECT 'views' AS source, medium FROM channel
      UNION ALL
      SELECT 'pages', CASE WHEN url LIKE '%utm_campaign=brand%' THEN 'brand'
         WHEN url LIKE '%utm_campaign=pls%' THEN 'pls'
         WHEN url LIKE '%utm_content=sgt%' THEN 'network'
         WHEN url LIKE '%utm_campaign=adblock%' THEN 'adblock' ELSE 'nonsem' END
      FROM pages) c GROUP BY source, medium""",
)
def channel_classify(w):
    views = w.page_view.select(F.lit("views").alias("source"), "url")
    pages = w.table("pages").select(F.lit("pages").alias("source"), "url")
    medium = S.channel_of(F.col("url")).alias("medium")
    return views.unionByName(pages).groupBy("source", medium).agg(F.count("*").alias("n"))


@query(
    "filter_range_in",
    """SELECT event_id, page_type, specialty_id FROM page_view
    WHERE event_date BETWEEN date '2024-01-05' AND date '2024-01-25'
      AND page_type IN ('Attorney_Search', 'Topic_Page') AND specialty_id = 3""",
)
def filter_range_in(w):
    rows = scan_events(w.page_view, "2024-01-05", "2024-01-25", ["event_id", "page_type", "specialty_id"])
    return rows.where(F.col("page_type").isin("Attorney_Search", "Topic_Page") & (F.col("specialty_id") == 3))


@query(
    "filter_valid_pageview",
    """SELECT event_id, session_id FROM page_view WHERE session_id IS NOT NULL
      AND persistent_session_id IS NOT NULL AND render_instance_guid IS NOT NULL""",
)
def filter_valid_pageview(w):
    return plan.valid_page_views(w.page_view).select("event_id", "session_id")


@query(
    "filter_market_positive",
    """SELECT event_id, ad_market_id FROM located_view
    WHERE ad_market_id > 0 AND ad_market_id IS NOT NULL""",
)
def filter_market_positive(w):
    located = plan.locate(w.page_view, dimensions(w)).select("event_id", "ad_market_id")
    return located.where(F.col("ad_market_id").isNotNull() & (F.col("ad_market_id") > 0))


@query(
    "filter_process_lag",
    """SELECT marketid, pt, cup, count(*) AS n FROM potential_acv_marketid
    WHERE channel = 'Other' AND process_date BETWEEN date '1996-06-02' AND date '2000-09-01'
      AND process_date = attribution_date + 1 GROUP BY ALL""",
)
def filter_process_lag(w):
    rows = plan.next_day_rows(w.potential_acv_marketid, "1996-06-02", "2000-09-01", "Other")
    return rows.groupBy("marketid", "pt", "cup").agg(F.count("*").alias("n"))


@query(
    "filter_medium_not",
    """SELECT ad_market_id, session_id, lpv_medium FROM attribution_v3_all
    WHERE lpv_medium <> 'network'""",
)
def filter_medium_not(w):
    cols = ["ad_market_id", "session_id", "lpv_medium"]
    return w.attribution_v3_all.where(F.col("lpv_medium") != "network").select(*cols)


@query(
    "join_dims_left",
    """SELECT event_id, specialty_name, ad_market_id, state, county, region, block_flag
    FROM located_view""",
)
def join_dims_left(w):
    cols = ["event_id", "specialty_name", "ad_market_id", "state", "county", "region", "block_flag"]
    return plan.locate(w.page_view, dimensions(w)).select(*cols)


@query(
    "join_first_touch",
    """SELECT p.event_id, p.session_id, f.medium FROM page_view p JOIN first_touch f
      ON f.event_date = p.event_date AND f.session_id = p.session_id""",
)
def join_first_touch(w):
    touches = plan.first_touch(w.page_view, *JANUARY)
    views = w.page_view.select("event_id", "event_date", "session_id")
    return views.join(touches, ["event_date", "session_id"]).select("event_id", "session_id", "medium")


def inventory_sum(measure: str, kind: str, name: str) -> str:
    return f"coalesce(sum({measure}) FILTER (WHERE ad_inventory_type = '{kind}'), 0) AS {name}"


INVENTORY_TWIN = f"""SELECT ad_market_id, specialty_name, cast(sl AS bigint) AS sl, cast(da AS bigint) AS da,
    round(sl_price, 2) AS sl_price, round(da_price, 2) AS da_price
  FROM (SELECT ad_market_id, pa AS specialty_name,
          {inventory_sum("sellable_count", "Sponsored Listing", "sl")},
          {inventory_sum("sellable_count", "Display", "da")},
          {inventory_sum("list_price", "Sponsored Listing", "sl_price")},
          {inventory_sum("list_price", "Display", "da_price")}
        FROM ad_inventory JOIN market_names USING (specialty_id)
        WHERE active AND ad_market_id = ad_target_id GROUP BY ALL) sums"""


@query(
    "join_cte_two_key",
    f"""WITH a AS (SELECT ad_market_id, specialty_name, count(DISTINCT session_id) AS sessions
      FROM located_view GROUP BY 1, 2), b AS ({INVENTORY_TWIN})
    SELECT ad_market_id, specialty_name, sessions, sl, da
    FROM a JOIN b USING (ad_market_id, specialty_name)""",
)
def join_cte_two_key(w):
    keys = ["ad_market_id", "specialty_name"]
    views = w.page_view.select("session_id", "specialty_id", "location_id").distinct()
    a = plan.locate(views, dimensions(w)).groupBy(*keys).agg(
        F.countDistinct("session_id").alias("sessions")
    )
    b = plan.market_inventory(w.ad_inventory, w.ad_market_dimension).select(*keys, "sl", "da")
    return a.join(b, keys)


@query(
    "join_on_filter",
    """SELECT ad_market_id, region, count(*) AS n
    FROM ad_inventory JOIN (SELECT * FROM market_names WHERE active) live USING (specialty_id)
    WHERE ad_target_id = ad_market_id GROUP BY ALL""",
)
def join_on_filter(w):
    a, b = w.ad_inventory.alias("a"), w.ad_market_dimension.alias("b")
    on = (
        (F.col("b.specialty_id") == F.col("a.specialty_id"))
        & (F.col("a.ad_target_id") == F.col("b.ad_market_id"))
        & (F.col("b.ad_market_active_flag") == "Y")
    )
    return (
        a.join(b, on)
        .groupBy("b.ad_market_id", F.col("b.ad_market_region_name").alias("region"))
        .agg(F.count("*").alias("n"))
    )


@query(
    "count_distinct_sessions",
    """SELECT specialty_id, page_type, count(DISTINCT session_id) AS sessions,
      count(DISTINCT render_instance_guid) AS renders FROM page_view GROUP BY 1, 2""",
)
def count_distinct_sessions(w):
    return w.page_view.groupBy("specialty_id", "page_type").agg(
        F.countDistinct("session_id").alias("sessions"),
        F.countDistinct("render_instance_guid").alias("renders"),
    )


SESSION_GROUPINGS = (("specialty_id", "page_type", "event_date"), ("specialty_id", "page_type"), ("page_type", "event_date"), ("specialty_id",), ())


@query(
    "distinct_sessions_rollup",
    "\nUNION ALL ".join(
        f"""SELECT {i} AS "grouping", {", ".join(
            (f"cast({c} AS varchar)" if c == "event_date" else c) + f" AS {c}" if c in keys else f"NULL AS {c}" for c in SESSION_GROUPINGS[0])},
      count(DISTINCT session_id) AS sessions FROM page_view WHERE session_id IS NOT NULL {"GROUP BY " + ", ".join(keys) if keys else ""}"""
        for i, keys in enumerate(SESSION_GROUPINGS)
    ),
)
def distinct_sessions_rollup(w):
    """Sessions by five groupings, all from one stored table of bitmaps."""
    bitmaps = cut_lineage(value_bitmaps(w.page_view, SESSION_GROUPINGS[0], "session_id"), "bitmaps")
    return rounded(count_values(bitmaps, SESSION_GROUPINGS, "sessions"))


@query(
    "sum_by_group",
    """SELECT ad_page_type, ad_market_id, round(sum(sl_adimpression), 6) AS v3_slimps,
      round(sum(page_view), 6) AS v3_pv FROM webanalytics_v3 GROUP BY 1, 2""",
)
def sum_by_group(w):
    return rounded(
        w.webanalytics_v3.groupBy("ad_page_type", "ad_market_id").agg(
            F.sum("sl_adimpression").alias("v3_slimps"), F.sum("page_view").alias("v3_pv")
        )
    )


@query("conditional_sums", INVENTORY_TWIN)
def conditional_sums(w):
    return rounded(plan.market_inventory(w.ad_inventory, w.ad_market_dimension), 2)


@query(
    "first_touch_channel",
    """SELECT session_id, cast(event_date AS varchar) AS event_date, medium FROM first_touch
    WHERE medium <> 'network'""",
)
def first_touch_channel(w):
    return rounded(plan.first_touch(w.page_view, *JANUARY).where(F.col("medium") != "network"))


@query(
    "ordered_market_report",
    """SELECT ad_market_specialty_name AS pa, ad_page_type AS pt,
      round(sum(sl_adimpression), 6) AS v3_slimps FROM webanalytics_v3
    JOIN ad_market_dimension USING (ad_market_id) GROUP BY 1, 2 ORDER BY 1, 2""",
)
def ordered_market_report(w):
    names = w.ad_market_dimension.select("ad_market_id", F.col("ad_market_specialty_name").alias("pa"))
    return rounded(
        w.webanalytics_v3.join(names, "ad_market_id")
        .groupBy("pa", F.col("ad_page_type").alias("pt"))
        .agg(F.sum("sl_adimpression").alias("v3_slimps"))
    ).orderBy("pa", "pt")


def sessions_twin(page: str, touch: str, extra: str = "") -> str:
    return f"""SELECT cast(strftime(event_date, '%Y%m') AS integer) AS year_month, ad_market_id, state,
      county, region, specialty_name, parent_specialty_name, block_flag, {page} AS page{extra},
      count(DISTINCT session_id) AS sessions
    FROM bucketed_view JOIN first_touch USING (event_date, session_id)
    WHERE {touch} AND ad_market_id > 0 GROUP BY ALL"""


@query(
    "sessions_by_market",
    sessions_twin("bucket", "medium <> 'network'"),
)
def sessions_by_market(w):
    return plan.sessions_by_market(w.page_view, dimensions(w), *JANUARY)


@query(
    "internal_traffic",
    f"""WITH visits AS ({sessions_twin("page_type", "medium = 'nonsem'", ", medium")}),
      stock AS ({INVENTORY_TWIN})
    SELECT * FROM visits JOIN stock USING (ad_market_id, specialty_name)""",
)
def internal_traffic(w):
    return rounded(
        plan.internal_traffic(w.page_view, dimensions(w), w.ad_inventory, *JANUARY, "nonsem"), 2
    )


@query(
    "v3_sessions",
    """SELECT ad_market_id, ad_specialty AS pa, county, state, count(DISTINCT session_id) AS sessions
    FROM attribution_v3_all JOIN market_names USING (ad_market_id)
    WHERE lpv_medium <> 'network' AND event_date >= date '2024-01-01' AND event_date < date '2024-02-01'
    GROUP BY ALL""",
)
def v3_sessions(w):
    return plan.v3_sessions(w.attribution_v3_all, w.ad_market_dimension, *JANUARY, "network")


@query(
    "pv_vs_attribution",
    """WITH seen AS (SELECT bucket AS pt, specialty_name AS pa,
        count(DISTINCT render_instance_guid) AS count_pv
      FROM bucketed_view WHERE specialty_name = 'HOUSEHOLD' GROUP BY ALL),
    attributed AS (SELECT CASE ad_page_type WHEN 'other' THEN 'others' ELSE 'core' END AS pt, pa,
        sum(sl_adimpression) AS imps, sum(page_view) AS views
      FROM webanalytics_v3 JOIN market_names USING (ad_market_id)
      WHERE pa IN ('BUILDING', 'HOUSEHOLD', 'MACHINERY') GROUP BY ALL)
    SELECT pt, pa, count_pv, round(imps, 6) AS v3_slimps, round(views, 6) AS v3_pv
    FROM seen JOIN attributed USING (pt, pa)""",
)
def pv_vs_attribution(w):
    return rounded(
        plan.pv_vs_attribution(
            w.page_view,
            w.webanalytics_v3,
            dimensions(w),
            JANUARY,
            ALL_DAYS,
            "HOUSEHOLD",
            ["BUILDING", "HOUSEHOLD", "MACHINERY"],
        )
    )


@query(
    "potential_acv_daily",
    "SELECT cast(attribution_date AS varchar) AS attribution_date, marketid, "
    "CASE WHEN pt IN ('serp', 'profile') THEN 'core' ELSE 'noncore' END AS pt, cup, "
    + ", ".join(f"round(sum({m}), 6) AS {m}" for m in plan.ACV_MEASURES)
    + """ FROM potential_acv_marketid
    WHERE channel = 'Other' AND process_date = attribution_date + 1
      AND process_date >= date '1995-01-01' AND process_date < date '2002-01-01' GROUP BY ALL""",
)
def potential_acv_daily(w):
    return rounded(plan.potential_acv_daily(w.potential_acv_marketid, *ALL_DAYS, "Other"))

"""From page views to first-touch sessions per ad market, and the reports beside them."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from headroom.functions.scalars import (
    channel_code,
    channel_name,
    page_bucket,
    page_bucket_coarse,
    year_month,
)
from headroom.sources.readers import scan_events

MARKET_COLUMNS = (
    "ad_market_id",
    "state",
    "county",
    "region",
    "specialty_name",
    "parent_specialty_name",
    "block_flag",
)
# Room for the channel below a packed timestamp; at least the number of channels.
CHANNEL_SLOTS = 8


@dataclass(frozen=True)
class Dimensions:
    """The three dimensions a page view is located with.

    None of them is broadcast by hint: geography grows with the visitors, and Spark
    broadcasts whichever side its statistics prove small.
    """

    specialty: DataFrame
    geography: DataFrame
    market: DataFrame


def valid_page_views(page_view: DataFrame) -> DataFrame:
    """Views with a session, a persistent session and a render id."""
    return page_view.where(
        F.col("session_id").isNotNull()
        & F.col("persistent_session_id").isNotNull()
        & F.col("render_instance_guid").isNotNull()
    )


def first_touch(page_view: DataFrame, start: str, end: str) -> DataFrame:
    """Day and channel of each session's earliest valid view.

    An aggregate instead of a row_number window: every task reduces its own views to one
    row per session before the shuffle, so a session holding a large share of all views
    costs one row per task. Time and channel are packed into one long, which keeps the
    buffers fixed-width and the aggregate hash-based, and settles equal times by channel.
    """
    cols = ["session_id", "persistent_session_id", "render_instance_guid", "event_date"]
    views = valid_page_views(scan_events(page_view, start, end, [*cols, "gmt_timestamp", "url"]))
    micros = F.unix_micros(F.col("gmt_timestamp").cast("timestamp"))
    position = micros * CHANNEL_SLOTS + channel_code(F.col("url"))
    return (
        views.select("session_id", "event_date", position.alias("position"))
        .groupBy("session_id")
        .agg(F.min_by("event_date", "position").alias("event_date"), F.min("position").alias("position"))
        .select(
            "session_id",
            "event_date",
            channel_name(F.pmod("position", F.lit(CHANNEL_SLOTS))).alias("medium"),
        )
    )


def located_dimensions(dims: Dimensions) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Specialty, geography and market with the column names that views join on."""
    specialty = dims.specialty.select("specialty_id", "specialty_name", "parent_specialty_name")
    geography = dims.geography.select(F.col("geo_id").alias("location_id"), "sales_region_id")
    market = dims.market.select(
        "specialty_id",
        F.col("ad_region_id").alias("sales_region_id"),
        "ad_market_id",
        F.col("ad_market_state_name").alias("state"),
        F.col("ad_market_county_name").alias("county"),
        F.col("ad_market_region_name").alias("region"),
        F.col("ad_market_block_flag").alias("block_flag"),
    )
    return specialty, geography, market


def locate(page_view: DataFrame, dims: Dimensions) -> DataFrame:
    """Left joins to the dimensions; the market key needs geography's region."""
    specialty, geography, market = located_dimensions(dims)
    return (
        page_view.join(specialty, "specialty_id", "left")
        .join(geography, "location_id", "left")
        .join(market, ["specialty_id", "sales_region_id"], "left")
    )


def market_sessions(
    page_view: DataFrame,
    dims: Dimensions,
    start: str,
    end: str,
    page: Column,
    extra: Iterable[str] = (),
) -> DataFrame:
    """Distinct sessions by month, market, page (and ``extra`` columns of the first touch).

    A view counts when it happened on the day of its session's first touch and that touch
    did not come from the network channel. Views are reduced to the distinct (session, day,
    page, specialty, sales region) in every task before they meet the first touches, so a
    session with a large share of all views moves few rows; names of market and specialty
    follow after that.
    """
    specialty, geography, market = located_dimensions(dims)
    views = (
        scan_events(
            page_view, start, end, ["session_id", "event_date", "page_type", "specialty_id", "location_id"]
        )
        .join(geography, "location_id")
        .select("session_id", "event_date", page.alias("page"), "specialty_id", "sales_region_id")
        .distinct()
    )
    touches = first_touch(page_view, start, end).where(F.col("medium") != "network")
    located = (
        views.join(touches, ["event_date", "session_id"])
        .join(market.where(F.col("ad_market_id") > 0), ["specialty_id", "sales_region_id"])
        .join(specialty, "specialty_id", "left")
    )
    return located.groupBy(
        year_month(F.col("event_date")).alias("year_month"), *MARKET_COLUMNS, "page", *extra
    ).agg(F.countDistinct("session_id").alias("sessions"))


def sessions_by_market(page_view: DataFrame, dims: Dimensions, start: str, end: str) -> DataFrame:
    return market_sessions(page_view, dims, start, end, page_bucket(F.col("page_type")))


def market_inventory(inventory: DataFrame, market: DataFrame) -> DataFrame:
    """Sponsored-listing and display inventory of the active markets."""
    active = market.where(F.col("ad_market_active_flag") == "Y").select(
        "specialty_id",
        F.col("ad_market_id").alias("ad_target_id"),
        F.col("ad_market_specialty_name").alias("specialty_name"),
    )
    sl = F.col("ad_inventory_type") == "Sponsored Listing"
    da = F.col("ad_inventory_type") == "Display"
    # Summed per target first: the join then sees one row per market, however large one
    # market's share of the inventory is.
    per_target = inventory.groupBy("ad_target_id", "specialty_id").agg(
        F.sum(F.when(sl, F.col("sellable_count")).otherwise(0)).alias("sl"),
        F.sum(F.when(da, F.col("sellable_count")).otherwise(0)).alias("da"),
        F.sum(F.when(sl, F.col("list_price")).otherwise(0.0)).alias("sl_price"),
        F.sum(F.when(da, F.col("list_price")).otherwise(0.0)).alias("da_price"),
    )
    return per_target.join(active, ["specialty_id", "ad_target_id"]).select(
        F.col("ad_target_id").alias("ad_market_id"), "specialty_name", "sl", "da", "sl_price", "da_price"
    )


def internal_traffic(
    page_view: DataFrame, dims: Dimensions, inventory: DataFrame, start: str, end: str, medium: str
) -> DataFrame:
    """Sessions by raw page type and channel next to the market's inventory."""
    sessions = market_sessions(page_view, dims, start, end, F.col("page_type"), extra=["medium"])
    return sessions.where(F.col("medium") == medium).join(
        market_inventory(inventory, dims.market), ["ad_market_id", "specialty_name"]
    )


def v3_sessions(
    attribution: DataFrame, market: DataFrame, start: str, end: str, excluded_medium: str
) -> DataFrame:
    """Sessions by market from the attribution table; a missing medium is dropped too."""
    rows = scan_events(
        attribution.where(F.col("lpv_medium") != excluded_medium),
        start,
        end,
        ["ad_market_id", "ad_specialty", "session_id"],
    )
    places = market.select(
        "ad_market_id",
        F.col("ad_market_county_name").alias("county"),
        F.col("ad_market_state_name").alias("state"),
    )
    return (
        rows.join(places, "ad_market_id")
        .groupBy("ad_market_id", F.col("ad_specialty").alias("pa"), "county", "state")
        .agg(F.countDistinct("session_id").alias("sessions"))
    )


def pv_vs_attribution(
    page_view: DataFrame,
    attribution: DataFrame,
    dims: Dimensions,
    view_range: tuple[str, str],
    attribution_range: tuple[str, str],
    practice_area: str,
    attribution_areas: Iterable[str],
) -> DataFrame:
    """Distinct page views next to attributed impressions by page bucket and practice area."""
    counted = (
        locate(
            scan_events(
                page_view,
                *view_range,
                ["page_type", "specialty_id", "location_id", "render_instance_guid"],
            ),
            dims,
        )
        .where(F.col("specialty_name") == practice_area)
        .groupBy(page_bucket(F.col("page_type")).alias("pt"), F.col("specialty_name").alias("pa"))
        .agg(F.countDistinct("render_instance_guid").alias("count_pv"))
    )
    return counted.join(
        attributed_impressions(attribution, dims.market, *attribution_range, attribution_areas), ["pt", "pa"]
    )


def attributed_impressions(
    attribution: DataFrame, market: DataFrame, start: str, end: str, areas: Iterable[str]
) -> DataFrame:
    names = market.select("ad_market_id", F.col("ad_market_specialty_name").alias("pa"))
    rows = scan_events(
        attribution, start, end, ["ad_market_id", "ad_page_type", "sl_adimpression", "page_view"]
    )
    return (
        rows.join(names.where(F.col("pa").isin(*areas)), "ad_market_id")
        .groupBy(page_bucket_coarse(F.col("ad_page_type"), other="others").alias("pt"), "pa")
        .agg(F.sum("sl_adimpression").alias("v3_slimps"), F.sum("page_view").alias("v3_pv"))
    )


ACV_MEASURES = (
    "sl_acv",
    "da_acv",
    "potential_sl_acv",
    "potential_da_acv",
    "sl_imps",
    "da_imps",
    "potential_sl_imps",
    "potential_da_imps",
)


def next_day_rows(df: DataFrame, start: str, end: str, channel: str) -> DataFrame:
    """Rows processed the day after the day they describe."""
    return df.where(
        (F.col("attribution_date") == F.date_add("process_date", -1))
        & F.col("process_date").between(F.lit(start).cast("date"), F.lit(end).cast("date"))
        & (F.col("channel") == channel)
    )


def potential_acv_daily(df: DataFrame, start: str, end: str, channel: str) -> DataFrame:
    """Revenue and impressions, actual and potential, by day, market, bucket and device."""
    return (
        next_day_rows(df, start, end, channel)
        .groupBy("attribution_date", "marketid", page_bucket_coarse(F.col("pt")).alias("pt"), "cup")
        .agg(*[F.sum(m).alias(m) for m in ACV_MEASURES])
    )

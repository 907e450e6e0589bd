"""Lookups between market names and census regions, and the packaged traffic table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from headroom.functions.scalars import city_suffixed
from headroom.operators.joins import keep_both


def county_lookup(counties: DataFrame, states: DataFrame, mapping: DataFrame, equivalents: DataFrame) -> DataFrame:
    """Census counties with their state's names and the market side's county name.

    ``counties``: statefip, county, area_class, fip; ``states``: statefip, statename;
    ``mapping``: one row per ZIP with statename and state code; ``equivalents``: state,
    county, marketcounty. Every join keeps both sides, so gaps stay visible. Lookups are
    made distinct first: the ZIP-level mapping must not multiply counties.
    """
    named = counties.select(
        "statefip", F.lower(city_suffixed(F.col("county"), F.col("area_class"))).alias("county"), "fip"
    ).distinct()
    codes = mapping.select(F.lower("statename").alias("statename"), "state").distinct()
    market_names = equivalents.withColumn("marketcounty", F.lower("marketcounty"))
    with_state = keep_both(named, states.select("statefip", "statename").distinct(), ["statefip"])
    with_code = keep_both(with_state, codes, ["statename"])
    return with_code.join(market_names, ["state", "county"], "full_outer")


def packaged_traffic(sessions: DataFrame, lookup: DataFrame, months: int = 3) -> DataFrame:
    """Market sessions as an average month per practice area and census county.

    ``sessions``: pa, county, state (full name), sessions over ``months`` months.
    ``lookup`` maps the market side's state and county names to the census names.
    """
    visits = sessions.select(
        "pa", F.lower("state").alias("statename"), F.lower("county").alias("marketcounty"), "sessions"
    )
    places = lookup.select("statename", "state", "marketcounty", "county").distinct()
    joined = visits.join(places, ["statename", "marketcounty"])
    return (
        joined.groupBy("pa", "county", "state", "statename")
        .agg(F.sum("sessions").alias("visits"))
        .withColumn("sessions", F.col("visits") / months)
    )

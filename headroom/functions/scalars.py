"""Column expressions of the domain; all of them stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Page types that count as core pages.
CORE_PAGE_TYPES = (
    "Attorney_Directory_Browse",
    "Attorney_Search",
    "Attorney_Profile",
    "Attorney_Profile_Aboutme",
    "Attorney_Profile_Contact",
    "Attorney_Profile_Endorsement",
)

# Url pattern -> channel, the first match wins. The underscore is a LIKE
# wildcard here and has to stay one.
CHANNEL_PATTERNS = (
    ("%utm_campaign=brand%", "brand"),
    ("%utm_campaign=pls%", "pls"),
    ("%utm_content=sgt%", "network"),
    ("%utm_campaign=adblock%", "adblock"),
)
DEFAULT_CHANNEL = "nonsem"

# City counties that share their name with a regular county.
AMBIGUOUS_CITIES = ("baltimore", "st. louis", "franklin", "richmond", "roanoke")


CHANNELS = (*[channel for _, channel in CHANNEL_PATTERNS], DEFAULT_CHANNEL)


def channel_code(url: Column) -> Column:
    """Position in CHANNELS of a landing url's traffic channel; no url is the default one."""
    chain = F
    for code, (pattern, _) in enumerate(CHANNEL_PATTERNS):
        chain = chain.when(url.like(pattern), code)
    return chain.otherwise(len(CHANNEL_PATTERNS))


def channel_name(code: Column) -> Column:
    return F.element_at(F.array(*[F.lit(c) for c in CHANNELS]), (code + 1).cast("int"))


def channel_of(url: Column) -> Column:
    return channel_name(channel_code(url))


def page_bucket(page_type: Column) -> Column:
    return F.when(page_type.isin(*CORE_PAGE_TYPES), "core").otherwise("others")


def page_bucket_coarse(page_type: Column, other: str = "noncore") -> Column:
    return F.when(page_type.isin("serp", "profile"), "core").otherwise(other)


def year_month(day: Column) -> Column:
    return (F.year(day) * 100 + F.month(day)).cast("int")


def month_text(day: Column) -> Column:
    return F.lpad(F.month(day).cast("string"), 2, "0")


def market_key(state: Column, county: Column) -> Column:
    return F.concat_ws(" | ", state, county)


def zip5(zip_text: Column) -> Column:
    """Left-pad with two zeros and keep the last five characters."""
    return F.right(F.concat(F.lit("00"), zip_text), F.lit(5))


def county_name(name: Column) -> Column:
    """Lower case without the literal ' County'."""
    return F.lower(F.replace(name, F.lit(" County"), F.lit("")))


def city_suffixed(name: Column, area_class: Column) -> Column:
    """Append the class to independent cities whose name is also a county's."""
    ambiguous = F.lower(name).isin(*AMBIGUOUS_CITIES) & (area_class == "city")
    return F.when(ambiguous, F.concat_ws(" ", name, area_class)).otherwise(name)


def recode(col: Column, mapping: dict[str, str]) -> Column:
    """Replace listed values and leave every other value alone."""
    out = col
    for old, new in mapping.items():
        out = F.when(col == old, new).otherwise(out)
    return out


def safe_ratio(num: Column, den: Column) -> Column:
    """Ratio with an undefined result (missing parts or zero denominator) set to 0."""
    return F.coalesce(F.try_divide(num, den), F.lit(0.0))


def zero_if_missing(col: Column) -> Column:
    """NULL and NaN become 0."""
    return F.coalesce(F.nanvl(col.cast("double"), F.lit(0.0)), F.lit(0.0))


def floor_at_zero(col: Column) -> Column:
    return F.greatest(col, F.lit(0.0))


def root_feature(col: Column, power: float = 0.3) -> Column:
    return F.pow(col, F.lit(power))


def damped_potential(
    actual: Column, sessions: Column, potential_sessions: Column, base: float, min_sessions: float = 30
) -> Column:
    """Revenue at the potential visit count, damped by how far it is from today's.

    Up to ``min_sessions`` sessions the rate is too noisy and today's revenue is kept.
    """
    growth = F.try_divide(potential_sessions, sessions)
    rate = safe_ratio(actual, sessions)
    damped = potential_sessions * rate * (1 - F.log(base, growth))
    return F.when(sessions > min_sessions, damped).otherwise(actual)


def choropleth_bin(value: Column, low: float, high: float, steps: int) -> Column:
    """1..steps, with values outside the scale clamped to its end bins."""
    raw = F.floor((value - F.lit(low)) / F.lit((high - low) / steps)).cast("int") + 1
    return F.when(value.isNotNull(), F.greatest(F.lit(1), F.least(F.lit(steps), raw)))


def mark_size(value: Column, low: float, high: float) -> Column:
    """Linear 0..1 position on a scale clamped at both ends."""
    clamped = F.greatest(F.lit(low), F.least(F.lit(high), value))
    return F.when(value.isNotNull(), (clamped - F.lit(low)) / F.lit(high - low))

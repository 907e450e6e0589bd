"""Potential ad contacts per market from grouped regressions with fallbacks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from headroom.functions.scalars import floor_at_zero, market_key, month_text, root_feature, safe_ratio
from headroom.operators.clustering import split_groups
from headroom.operators.grouping import exact_sum, sum_then_mean
from headroom.operators.quantile import group_median
from headroom.operators.regression import MODELS, grouped_ols
from headroom.sources.shared import bucket_count, cut_lineage, keyed_name, keyed_table, keys_together


@dataclass(frozen=True)
class Product:
    """Columns of one ad product."""

    contacts: str
    imps: str
    potential_imps: str
    acv: str
    potential: str


SL = Product("sl_contacts", "sl_imps", "potential_sl_imps", "sl_acv", "potential_sl_contacts")
DA = Product("da_contacts", "da_imps", "potential_da_imps", "da_acv", "potential_da_contacts")

# A market can carry its own model with this many active days, page types
# and devices.
MIN_DAYS, MIN_PAGE_TYPES, MIN_DEVICES = 5, 2, 2


def active_days(df: DataFrame, metric: str, market: str = "statecounty", day: str = "event_day") -> DataFrame:
    """Days with any positive value per market, for the markets that have enough of them."""
    per_day = df.groupBy(market, day).agg(F.max((F.col(metric) > 0).cast("int")).alias("_any"))
    days = per_day.groupBy(market).agg(F.sum("_any").alias("active_days"))
    return days.where(F.col("active_days") >= MIN_DAYS)


def market_counts(df: DataFrame, metrics: Mapping[str, str], market: str, day: str) -> DataFrame:
    """Page types and devices of every market, and its days with a positive value of each metric (name -> column), in one pass."""
    cells = df.groupBy(market, day, "pt", "rt").agg(*[F.max((F.col(c) > 0).cast("int")).alias(f"_{n}") for n, c in metrics.items()])
    sizes = {"page_types": F.col("pt"), "devices": F.col("rt")}
    sizes |= {n: F.when(F.col(f"_{n}") > 0, F.col(day)) for n in metrics}
    return cells.groupBy(market).agg(*[F.size(F.collect_set(c)).cast("long").alias(n) for n, c in sizes.items()])


def enough(days: str) -> Column:
    """Whether a market can carry its own model."""
    return (F.col(days) >= MIN_DAYS) & (F.col("page_types") >= MIN_PAGE_TYPES) & (F.col("devices") >= MIN_DEVICES)


def market_eligibility(
    df: DataFrame, metric: str, market: str = "statecounty", day: str = "event_day"
) -> DataFrame:
    """Markets with enough active days, page types and devices.

    Rows are reduced to a market's days, page types and devices first; the sets gathered then are
    bounded by the calendar and by the levels of the two factors.
    """
    counts = market_counts(df, {"active_days": metric}, market, day).where(enough("active_days"))
    return counts.select(market, "active_days", "page_types", "devices")


def with_roots(df: DataFrame, product: Product, pv: str = "pv") -> DataFrame:
    """Power features of page views and impressions."""
    return df.withColumns(
        {
            "pv_root": root_feature(F.col(pv)),
            "imps_root": root_feature(F.col(product.imps)),
            "potential_imps_root": root_feature(F.col(product.potential_imps)),
        }
    )


ROOTS = ("pv_root", "imps_root", "potential_imps_root")


def ratio_extrapolate(product: Product, factor: float = 0.6, min_imps: float = 20) -> Column:
    """Contacts scaled with impressions, where there are enough of them; otherwise 0."""
    ratio = F.try_divide(F.col(product.potential_imps), F.col(product.imps))
    enough = (F.col(product.imps) > 0) & (F.col(product.potential_imps) > min_imps)
    return F.when(enough, F.coalesce(ratio * F.col(product.contacts) * factor, F.lit(0.0))).otherwise(0.0)


def choose_model(
    df: DataFrame,
    product: Product,
    predictions: Sequence[str] = ("m1", "m2", "m3"),
    by: Sequence[str] = ("month", "statecounty"),
    together: bool = False,
) -> DataFrame:
    """One model per month and market: the first whose predictions do not sum below zero.

    Without any (``use`` = 0) contacts are extrapolated from the impressions. ``together`` says that the rows of any
    month and market fit a task: they are then summed where they lie and not joined with their sums.
    """
    use, chosen = F, F
    for number, p in enumerate(predictions, start=1):
        use = use.when(F.col(f"_{p}") >= 0, number)
        chosen = chosen.when(F.col("use") == number, F.col(p))
    chosen = F.coalesce(chosen.otherwise(ratio_extrapolate(product)), F.lit(0.0))
    if together:
        own = Window.partitionBy(*by)
        summed = df.withColumns({f"_{p}": F.sum(p).over(own) for p in predictions})
        # A null matches nothing, as in the join.
        known = reduce(and_, [F.col(c).isNotNull() for c in by])
        out = summed.withColumn("use", F.when(known, use.otherwise(0))).drop(*[f"_{p}" for p in predictions])
    else:
        totals = df.groupBy(*by).agg(*[F.sum(p).alias(f"_{p}") for p in predictions])
        out = df.join(totals.select(*by, use.otherwise(0).alias("use")), list(by), "left")
    return out.withColumn(product.potential, chosen)


def pool_markets(
    df: DataFrame, product: Product, pools: int, market: str = "statecounty", min_members: int = 4
) -> DataFrame:
    """Low-traffic markets grouped into pools of similar size, for one model per pool.

    Pooling by splits at the medians of page views, impressions and contacts is this library's choice. The result
    has one row per market with its pool as ``cluster``; a pool has ``min_members`` markets at least, if there are
    as many.
    """
    measures = ["pv", product.imps, product.contacts]
    totals = df.groupBy(market).agg(*[exact_sum(F.col(c)).alias(c) for c in measures])
    return split_groups(totals, [market], measures, pools, min_members).select(market, "cluster")


def undershooting(df: DataFrame, product: Product, market: str = "statecounty") -> DataFrame:
    """Markets whose contacts exceed their pooled prediction, with enough data of their own."""
    totals = df.groupBy(market).agg(
        F.sum(product.contacts).alias("contacts"),
        F.sum(product.potential).alias("predicted"),
        F.countDistinct("rt").alias("devices"),
    )
    return totals.where(
        (F.col("contacts") > 1.1 * F.col("predicted")) & (F.col("contacts") > 20) & (F.col("devices") > 1)
    )


def refit_low(df: DataFrame, product: Product, market: str = "statecounty", model: Sequence[str] = MODELS["m1"]) -> DataFrame:
    """Undershooting markets get a model of their own; the others keep the pooled one."""
    again = undershooting(df, product, market).select(market)
    one = {"m1": model}
    refitted = grouped_ols(
        df.join(again, market, "left_semi"), [market], product.contacts, *ROOTS, models=one
    )
    refitted = refitted.withColumn(product.potential, F.col("m1")).drop("m1")
    return df.join(again, market, "left_anti").unionByName(refitted)


def union_high_low(high: DataFrame, low: DataFrame) -> DataFrame:
    return high.unionByName(low, allowMissingColumns=True)


def last_days(df: DataFrame, as_of: str, days: int = 28, day: str = "event_day") -> DataFrame:
    end = F.lit(as_of).cast("date")
    return df.where(F.col(day).between(F.date_sub(end, days - 1), end))


def outlier_markets(df: DataFrame, product: Product, as_of: str, market: str = "statecounty") -> DataFrame:
    """Markets whose potential contacts outgrew their potential impressions lately.

    The growth rules are compared as products, which also decides markets without contacts.
    """
    recent = last_days(df, as_of).groupBy(market).agg(
        F.sum(product.contacts).alias("v1"),
        F.sum(product.potential).alias("v2"),
        F.sum(product.imps).alias("v3"),
        F.sum(product.potential_imps).alias("v4"),
    )
    v1, v2, v3, v4 = (F.col(f"v{i}") for i in range(1, 5))
    jump = (v2 > 2 * v1) & (v4 < 2 * v3) & (v1 > 10)
    faster = (v3 > 0) & (v2 * v3 > 1.25 * v1 * v4) & (v2 > 5)
    triple = (v2 > 3 * v1) & (v2 > 5)
    return recent.where(jump | faster | triple)


def alternate_rate(df: DataFrame, product: Product, market: str = "statecounty") -> DataFrame:
    """Median contacts per impression of each market (this library's choice of estimate)."""
    seen = df.where(F.col(product.imps) > 0).select(
        market, F.try_divide(F.col(product.contacts), F.col(product.imps)).alias("_rate")
    )
    # Read once a round.
    return group_median(cut_lineage(seen, "rates"), [market], "_rate", "alternate_rate")


def redo_outliers(df: DataFrame, product: Product, as_of: str, market: str = "statecounty") -> DataFrame:
    """Outlier markets: contacts scaled with impressions, or the market's median rate.

    Rows without impressions take the median rate even where they have contacts: a ratio of
    impressions, which the original rule would use there, does not exist. ``df`` is read three times
    and should be a stored table; its rows meet the flagged markets in one join.
    """
    flagged = outlier_markets(df, product, as_of, market).select(market)
    rates = alternate_rate(df.join(flagged, market, "left_semi"), product, market)
    flags = flagged.join(rates, market, "left").withColumn("_redo", F.lit(True))
    scaled = safe_ratio(F.col(product.potential_imps), F.col(product.imps)) * F.col(product.contacts) * 0.7
    alternate = F.coalesce(F.col("alternate_rate") * F.col(product.potential_imps), F.lit(0.0))
    redone = F.when(F.col(product.imps) > 0, scaled).otherwise(alternate)
    return (
        df.join(flags, market, "left")
        .withColumn(product.potential, F.when(F.col("_redo"), redone).otherwise(F.col(product.potential)))
        .drop("alternate_rate", "_redo")
    )


def estimate_contacts(
    df: DataFrame,
    product: Product,
    fit_by: Sequence[str] = ("statecounty",),
    pools: int = 5,
    market: str = "statecounty",
    redo_as_of: str | None = None,
    eligible: DataFrame | None = None,
    kept: bool = False,
) -> DataFrame:
    """Potential contacts of one product per row of ``df``, which should be a stored table.

    Eligible markets (``eligible``, if known already) are fitted with three models per ``fit_by`` group and a per-month
    choice; the others share models per pool, refitted alone where those undershoot. ``kept`` says that ``df`` is kept
    by market (``keyed_table``) and that any market's rows fit a task: eligible markets then stay where they are, and so does the result.
    """
    together = kept and market in fit_by
    rows = with_roots(df, product)
    if eligible is None:
        eligible = cut_lineage(market_eligibility(df, product.acv, market).select(market), "eligible")
    high = grouped_ols(rows.join(eligible, market, "left_semi"), list(fit_by), product.contacts, *ROOTS, together=together).drop(*ROOTS)
    # Predictions are summed per month and meet their rows again: fitted once.
    high = keyed_table(high, [market], dealt=True) if together else cut_lineage(high, "high-contacts")
    high = choose_model(high, product, by=("month", market), together=together).drop(*MODELS, "use")
    high = high.withColumn("cluster", F.lit(None).cast("int"))
    low = cut_lineage(rows.join(eligible, market, "left_anti"), "low-rows")
    pooled = low.join(pool_markets(low, product, pools, market), market)
    fitted = grouped_ols(pooled, ["cluster"], product.contacts, *ROOTS, models={"m1": MODELS["m1"]})
    # The pooled predictions decide what is refitted and are kept for the rest.
    fitted = cut_lineage(fitted.withColumn(product.potential, F.col("m1")).drop("m1"), "pooled-contacts")
    low = refit_low(fitted, product, market).drop(*ROOTS)
    out = union_high_low(high, keyed_table(low, [market]) if together else low)
    out = out.withColumn(product.potential, floor_at_zero(F.col(product.potential)))
    if together:
        out = keyed_table(out, [market], dealt=True)
    if redo_as_of:
        out = redo_outliers(out if together else cut_lineage(out, "contacts"), product, redo_as_of, market)
    return out


def forecast_input(history: DataFrame, day: str) -> DataFrame:
    """Daily rows with the forecast day stacked below them, by market, ready for the estimates.

    Practice areas are added up: one row per day, market, page type, device and kind of day. A
    market's potential impressions of the forecast day are its average day's. The rows are dealt by market once and kept
    by it (``statecounty``), where the calendar bounds them: days, sums and shapes of a market need no shuffle, and the forecast is added
    to what is kept.
    """
    shape = [c for c in FIT_COLUMNS if c in FIT_KEYS]
    place = ["statecounty", "state", "county"]
    history = history.withColumn("statecounty", market_key(F.col("state"), F.col("county")))
    history = history.repartition(bucket_count(history.sparkSession), "statecounty").groupBy("statecounty", *shape)
    name = keyed_name()
    history = keyed_table(history.agg(*[F.sum(c).alias(c) for c in FIT_COLUMNS if c not in FIT_KEYS]), ["statecounty"], dealt=True, name=name)
    potentials = ("potential_sl_imps", "potential_da_imps")
    per_day = history.groupBy(*place).agg(
        F.countDistinct("event_day").alias("_days"), *[F.sum(c).alias(c) for c in potentials]
    )
    per_day = per_day.withColumns({c: F.col(c) / F.col("_days") for c in potentials})
    stacked = with_forecast(history, per_day.drop("_days"), day, ("statecounty", *FIT_COLUMNS), place, name)
    return stacked.withColumn("month", month_text(F.col("event_day")))


def contacts_pipeline(
    df: DataFrame,
    keys: Sequence[str] = ("event_day", "statecounty", "pt", "rt"),
    redo_as_of: str | None = None,
    keep: Sequence[str] | None = None,
    kept: bool = False,
    **options,
) -> DataFrame:
    """Both products over the daily rows, side by side; DA outliers are redone.

    ``keep`` names the columns of ``df`` that the result has besides the keys; all, if not given. Tables under way
    hold these and what a product's estimate reads. ``kept`` says that ``df`` is kept by market already.
    """
    market = options.get("market", "statecounty")
    shown = list(dict.fromkeys([*keys, *(df.columns if keep is None else keep)]))
    fits = [c for c in options.get("fit_by", ()) if c not in shown]
    reads = {
        p: list(dict.fromkeys([*shape, market, "month", "event_day", "pt", "rt", "weekend", "pv", p.imps, p.potential_imps, p.contacts, *fits]))
        for p, shape in ((SL, shown), (DA, list(keys)))
    }
    # Kept by market, where the calendar bounds them: counts, choices of markets and predictions need no shuffle.
    rows = df if kept else keyed_table(df.select(*dict.fromkeys([*reads[SL], *reads[DA], SL.acv, DA.acv])), [market])
    counts = keyed_table(market_counts(rows, {"sl": SL.acv, "da": DA.acv}, market, "event_day"), [market], dealt=True)
    own = {n: counts.where(enough(n)).select(market) for n in ("sl", "da")}
    sl = estimate_contacts(rows.select(*reads[SL]), SL, eligible=own["sl"], kept=True, **options)
    da = estimate_contacts(rows.select(*reads[DA]), DA, redo_as_of=redo_as_of, eligible=own["da"], kept=True, **options)
    both = combine_products(sl if keep is None else sl.select(*shown, SL.potential), da, keys)
    # Both are kept by market, one of the keys.
    with keys_together(df.sparkSession):
        return cut_lineage(both, "both-products")


def combine_products(
    sl: DataFrame, da: DataFrame, keys: Sequence[str] = ("event_day", "statecounty", "pt", "rt")
) -> DataFrame:
    """SL rows with the DA potential of the same day, market, page type and device."""
    return sl.join(da.select(*keys, DA.potential), list(keys))


def forecast_rows(history: DataFrame, potentials: DataFrame, day: str, place: Sequence[str] = ("state", "county")) -> DataFrame:
    """Synthetic rows of one future day: no actuals, page views from potential impressions.

    ``potentials`` has a row for each ``place``.
    """
    zero = F.lit(0.0)
    shapes = history.select(*place, "rt", "pt", "weekend").distinct()
    actuals = ("sl_imps", "da_imps", "sl_contacts", "da_contacts", "sl_acv", "da_acv")
    return shapes.join(potentials, list(place)).withColumns(
        {
            "event_day": F.lit(day).cast("date"),
            "pv": F.col("potential_sl_imps") / 3,
            **{c: zero for c in actuals},
        }
    )


FIT_KEYS = ("event_day", "state", "county", "pt", "rt", "weekend")
FIT_COLUMNS = (
    "event_day",
    "state",
    "county",
    "pt",
    "rt",
    "weekend",
    "pv",
    "sl_imps",
    "da_imps",
    "sl_contacts",
    "da_contacts",
    "sl_acv",
    "da_acv",
    "potential_sl_imps",
    "potential_da_imps",
)


def with_forecast(
    history: DataFrame,
    potentials: DataFrame,
    day: str,
    columns: Sequence[str] = FIT_COLUMNS,
    place: Sequence[str] = ("state", "county"),
    kept: str | None = None,
) -> DataFrame:
    """History stacked with the forecast rows, on one set of columns.

    A history that is the table ``kept`` by the first column of ``place`` gets the forecast rows added to it.
    """
    forecast = forecast_rows(history, potentials, day, place).select(*columns)
    if kept:
        return keyed_table(forecast, place[:1], dealt=True, name=kept).select(*columns)
    return history.select(*columns).unionByName(forecast)


def potential_contacts(daily: DataFrame, lifted: DataFrame) -> DataFrame:
    """Contacts per session of the average month, times the potential sessions."""
    keys = ["state", "county", "pa"]
    monthly = sum_then_mean(daily, "month", keys, ["sl_contacts", "da_contacts"], amounts=True)
    joined = lifted.select(*keys, "total", "potential_total").join(monthly, keys, "left")
    out = joined
    for name in ("sl", "da"):
        per_session = safe_ratio(F.coalesce(f"{name}_contacts", F.lit(0.0)), F.col("total"))
        out = out.withColumn(f"{name}_cps", per_session).withColumn(
            f"potential_{name}_contacts", F.col(f"{name}_cps") * F.col("potential_total")
        )
    return out.drop("sl_contacts", "da_contacts")

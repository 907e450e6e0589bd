"""Queries of the contact estimation."""

from __future__ import annotations

from pyspark.sql import functions as F

from headroom.functions import scalars as S
from headroom.operators import regression as OLS
from headroom.plans import contacts as plan
from headroom.plans import potential as P
from headroom.queries.cluster_twins import split_sql
from headroom.queries.region_queries import REGION, clusters_wide
from headroom.queries.registry import query, rounded
from headroom.queries.warehouse import PRACTICE_AREAS
from headroom.sources.shared import cut_lineage, keyed_table

AS_OF = "2001-10-20"
RECENT_TWIN = f"""event_day BETWEEN date '{AS_OF}' - 27 AND date '{AS_OF}'"""


@query(
    "filter_cutoff",
    f"""SELECT state, count(*) AS upto,
      sum(CASE WHEN {RECENT_TWIN} THEN 1 ELSE 0 END)::bigint AS recent
    FROM ad_performance_daily WHERE event_day <= date '{AS_OF}' GROUP BY state""",
)
def filter_cutoff(w):
    rows = w.ad_performance_daily.where(F.col("event_day") <= F.lit(AS_OF).cast("date"))
    upto = rows.groupBy("state").agg(F.count("*").alias("upto"))
    recent = plan.last_days(rows, AS_OF).groupBy("state").agg(F.count("*").alias("recent"))
    return upto.join(recent, "state", "left").fillna(0, ["recent"])


@query(
    "distinct_per_group",
    """SELECT statecounty, count(DISTINCT pt) AS page_types, count(DISTINCT rt) AS devices
    FROM ad_performance_daily GROUP BY statecounty""",
)
def distinct_per_group(w):
    return w.ad_performance_daily.groupBy("statecounty").agg(
        F.countDistinct("pt").alias("page_types"), F.countDistinct("rt").alias("devices")
    )


ACTIVE_TWIN = """SELECT statecounty, pa, count(DISTINCT CASE WHEN sl_acv > 0 THEN event_day END)
    AS active_days FROM ad_performance_daily GROUP BY statecounty, pa"""


@query(
    "active_days",
    """SELECT statecounty, cast(sum(CASE WHEN n > 0 THEN 1 ELSE 0 END) AS bigint) AS active_days
    FROM (SELECT statecounty, event_day, sum(CASE WHEN sl_acv > 0 THEN 1 ELSE 0 END) AS n
      FROM ad_performance_daily GROUP BY 1, 2) d GROUP BY statecounty
    HAVING sum(CASE WHEN n > 0 THEN 1 ELSE 0 END) > 4""",
)
def active_days(w):
    return plan.active_days(w.ad_performance_daily, "sl_acv")


ELIGIBLE_TWIN = """SELECT pa, statecounty,
    count(DISTINCT CASE WHEN sl_acv > 0 THEN event_day END) AS active_days,
    count(DISTINCT pt) AS page_types, count(DISTINCT rt) AS devices
  FROM ad_performance_daily GROUP BY pa, statecounty
  HAVING count(DISTINCT CASE WHEN sl_acv > 0 THEN event_day END) > 4
    AND count(DISTINCT pt) >= 2 AND count(DISTINCT rt) >= 2"""


def per_area(w):
    """Daily rows with one market per practice area and county."""
    market = F.concat_ws(" | ", "pa", "statecounty")
    return w.ad_performance_daily.withColumn("statecounty", market)


def stored_per_area(w, *cols):
    """Columns of ``per_area`` kept by market, for plans that read it more than once."""
    return keyed_table(per_area(w).select("statecounty", "event_day", "pt", "rt", "sl_acv", *cols), ["statecounty"])


@query(
    "market_eligibility",
    f"""SELECT pa || ' | ' || statecounty AS statecounty, active_days, page_types, devices
    FROM ({ELIGIBLE_TWIN}) e""",
)
def market_eligibility(w):
    return plan.market_eligibility(per_area(w), "sl_acv")


@query(
    "semi_in_set",
    f"""SELECT p.pa || ' | ' || p.statecounty AS statecounty, p.pt, p.rt, count(*) AS n
    FROM ad_performance_daily p JOIN ({ELIGIBLE_TWIN}) e
      ON e.pa = p.pa AND e.statecounty = p.statecounty GROUP BY 1, 2, 3""",
)
def semi_in_set(w):
    rows = stored_per_area(w)
    kept = rows.join(plan.market_eligibility(rows, "sl_acv"), "statecounty", "left_semi")
    return kept.groupBy("statecounty", "pt", "rt").agg(F.count("*").alias("n"))


@query(
    "anti_not_in_set",
    f"""SELECT p.pa || ' | ' || p.statecounty AS statecounty, p.pt, p.rt, count(*) AS n
    FROM ad_performance_daily p LEFT JOIN ({ELIGIBLE_TWIN}) e
      ON e.pa = p.pa AND e.statecounty = p.statecounty WHERE e.pa IS NULL GROUP BY 1, 2, 3""",
)
def anti_not_in_set(w):
    rows = stored_per_area(w)
    kept = rows.join(plan.market_eligibility(rows, "sl_acv"), "statecounty", "left_anti")
    return kept.groupBy("statecounty", "pt", "rt").agg(F.count("*").alias("n"))


@query(
    "intersect_keys",
    """SELECT statecounty FROM ad_performance_daily GROUP BY 1
      HAVING count(DISTINCT CASE WHEN da_acv > 0 THEN event_day END) > 4
    INTERSECT SELECT statecounty FROM ad_performance_daily GROUP BY 1 HAVING count(DISTINCT pt) >= 2
    INTERSECT SELECT statecounty FROM ad_performance_daily GROUP BY 1 HAVING count(DISTINCT rt) >= 2""",
)
def intersect_keys(w):
    """Markets in all three sets, whose conditions one aggregate decides."""
    counts = plan.market_counts(w.ad_performance_daily, {"active_days": "da_acv"}, "statecounty", "event_day")
    return counts.where("active_days > 4 AND page_types >= 2 AND devices >= 2").select("statecounty")


@query(
    "union_actual_forecast",
    """WITH pot AS (SELECT state, county, sum(potential_sl_imps) AS potential_sl_imps,
        sum(potential_da_imps) AS potential_da_imps FROM ad_performance_daily GROUP BY 1, 2),
    stacked AS (SELECT event_day, state, county, pt, rt, weekend, pv, sl_imps, sl_contacts,
        potential_sl_imps FROM ad_performance_daily
      UNION ALL SELECT date '2001-12-01', s.state, s.county, s.pt, s.rt, s.weekend,
        pot.potential_sl_imps / 3, 0, 0, pot.potential_sl_imps
      FROM (SELECT DISTINCT state, county, rt, pt, weekend FROM ad_performance_daily) s
      JOIN pot ON pot.state = s.state AND pot.county = s.county)
    SELECT cast(event_day AS varchar) AS event_day, state, pt, rt, weekend, count(*) AS n,
      round(sum(pv), 4) AS pv, round(sum(sl_imps), 4) AS sl_imps, sum(sl_contacts) AS sl_contacts,
      round(sum(potential_sl_imps), 4) AS potential_sl_imps
    FROM stacked GROUP BY ALL""",
)
def union_actual_forecast(w):
    shown = ("event_day", *REGION, "pt", "rt", "weekend", "pv", "sl_imps", "sl_contacts", "potential_sl_imps")
    history = w.stored_daily(*shown)
    potentials = history.groupBy(*REGION).agg(
        F.sum("potential_sl_imps").alias("potential_sl_imps"),
    )
    stacked = plan.with_forecast(history, potentials, "2001-12-01", shown)
    return rounded(
        stacked.groupBy("event_day", "state", "pt", "rt", "weekend").agg(
            F.count("*").alias("n"),
            *[F.sum(c).alias(c) for c in ("pv", "sl_imps", "sl_contacts", "potential_sl_imps")],
        ),
        4,
    )


@query(
    "union_high_low",
    f"""SELECT class, pa, count(*) AS n, sum(pool)::bigint AS pools FROM (
      SELECT CASE WHEN e.pa IS NULL THEN 'low' ELSE 'high' END AS class, p.pa,
        CASE WHEN e.pa IS NULL THEN 1 END AS pool
      FROM ad_performance_daily p LEFT JOIN ({ELIGIBLE_TWIN}) e
        ON e.pa = p.pa AND e.statecounty = p.statecounty) u GROUP BY class, pa""",
)
def union_high_low(w):
    rows = stored_per_area(w, "pa")
    eligible = plan.market_eligibility(rows, "sl_acv").select("statecounty")
    high = rows.join(eligible, "statecounty", "left_semi").withColumn("class", F.lit("high"))
    low = rows.join(eligible, "statecounty", "left_anti").withColumns(
        {"class": F.lit("low"), "pool": F.lit(1)}
    )
    both = plan.union_high_low(high, low)
    return both.groupBy("class", "pa").agg(F.count("*").alias("n"), F.sum("pool").alias("pools"))


# --- regression -------------------------------------------------------------------------

ROOTS_TWIN = """SELECT *, pow(pv, 0.3) AS a, pow(sl_imps, 0.3) AS b, pow(potential_sl_imps, 0.3) AS bp
    FROM ad_performance_daily"""


@query(
    "power_features",
    """SELECT statecounty, pa, cast(event_day AS varchar) AS event_day, pt, rt,
      round(pow(pv, 0.3), 6) AS pv_root, round(pow(sl_imps, 0.3), 6) AS imps_root,
      round(pow(potential_sl_imps, 0.3), 6) AS potential_imps_root FROM ad_performance_daily""",
)
def power_features(w):
    cols = ["statecounty", "pa", "event_day", "pt", "rt", *plan.ROOTS]
    return rounded(plan.with_roots(w.ad_performance_daily, plan.SL).select(*cols))


#: What the fits of a product's contacts read, besides their groups and factors.
FITTED = ("weekend", "pv", plan.SL.imps, plan.SL.potential_imps, plan.SL.contacts)
LEVELS = {"pt": ["other", "profile", "serp"], "rt": ["desktop", "mobile"]}


def design_twin() -> str:
    base = {"one": "1.0", "a": "a", "b": "b", "w": "weekend", "a_w": "a * weekend", "b_w": "b * weekend"}
    out = dict(base)
    for factor, level in (("pt", "profile"), ("pt", "serp"), ("rt", "mobile")):
        for name, text in base.items():
            out[f"{factor}_{level}_{name}"] = f"CASE WHEN {factor} = '{level}' THEN {text} ELSE 0 END"
    sums = ", ".join(f"round(cast(sum({text}) AS double), 4) AS {name}" for name, text in out.items())
    return f"SELECT state, {sums} FROM ({ROOTS_TWIN}) r GROUP BY state"


@query("design_matrix", design_twin())
def design_matrix(w):
    """The 24 columns of the first model, summed per state."""
    columns = OLS.design_columns("pv_root", "imps_root", "weekend", LEVELS, OLS.MODELS["m1"])
    rows = plan.with_roots(w.ad_performance_daily, plan.SL).select(
        "state", *[col.alias(name) for name, col in columns.items()]
    )
    return rounded(rows.groupBy("state").agg(*[F.sum(c).alias(c) for c in columns]), 4)


def closed_form(alias: str, cells: str) -> str:
    """Two-regressor least squares per cell, written with covariances."""
    return f"""{alias}s AS (SELECT {cells}, avg(y) AS my, avg(a) AS ma, avg(b) AS mb,
        var_pop(a) AS vaa, var_pop(b) AS vbb, covar_pop(a, b) AS vab, covar_pop(a, y) AS vay,
        covar_pop(b, y) AS vby FROM rows GROUP BY {cells}),
    {alias}c AS (SELECT *, (vay * vbb - vby * vab) / (vaa * vbb - vab * vab) AS ka,
        (vby * vaa - vay * vab) / (vaa * vbb - vab * vab) AS kb FROM {alias}s),
    {alias} AS (SELECT {cells}, ka, kb, my - ka * ma - kb * mb AS k0 FROM {alias}c)"""


@query(
    "grouped_ols",
    f"""WITH rows AS (SELECT state, pt, weekend, sl_contacts AS y, a, b, bp FROM ({ROOTS_TWIN}) r),
    {closed_form("m2", "state, pt, weekend")}, {closed_form("m3", "state, weekend")}
    SELECT r.state, r.pt, r.weekend, count(*) AS n,
      round(sum(m2.k0 + m2.ka * a + m2.kb * bp), 3) AS m2,
      round(sum(m3.k0 + m3.ka * a + m3.kb * bp), 3) AS m3,
      round(sum(m2.k0 + m2.ka * a + m2.kb * b), 3) AS m2_fitted,
      round(sum(m3.k0 + m3.ka * a + m3.kb * b), 3) AS m3_fitted
    FROM rows r JOIN m2 ON m2.state = r.state AND m2.pt = r.pt AND m2.weekend = r.weekend
    JOIN m3 ON m3.state = r.state AND m3.weekend = r.weekend GROUP BY r.state, r.pt, r.weekend""",
)
def grouped_ols(w):
    rows = plan.with_roots(w.stored_daily("state", "pt", *FITTED), plan.SL)
    models = {m: OLS.MODELS[m] for m in ("m2", "m3")}
    out = OLS.grouped_ols(rows, ["state"], "sl_contacts", *plan.ROOTS, models=models, fitted=True)
    return rounded(
        out.groupBy("state", "pt", "weekend").agg(
            F.count("*").alias("n"),
            *[F.sum(c).alias(c) for c in ("m2", "m3", "m2_fitted", "m3_fitted")],
        ),
        3,
    )


LEAST_ROWS = 8


@query(
    "market_ols",
    f"""WITH rows AS (SELECT statecounty, weekend, sl_contacts AS y, a, b, bp FROM ({ROOTS_TWIN}) r),
    {closed_form("m3", "statecounty, weekend")},
    n AS (SELECT statecounty, weekend, count(*) AS n FROM rows GROUP BY 1, 2),
    enough AS (SELECT statecounty FROM n GROUP BY 1 HAVING min(n) >= {LEAST_ROWS})
    SELECT r.statecounty, r.weekend, count(*) AS n, round(sum(m3.k0 + m3.ka * a + m3.kb * bp), 3) AS m3,
      round(sum(m3.k0 + m3.ka * a + m3.kb * b), 3) AS m3_fitted
    FROM rows r JOIN m3 USING (statecounty, weekend) JOIN enough USING (statecounty) GROUP BY 1, 2""",
)
def market_ols(w):
    """Every market's own regression; shown where both kinds of day have the rows that determine it."""
    rows = plan.with_roots(w.stored_daily("statecounty", *FITTED), plan.SL)
    out = OLS.grouped_ols(rows, ["statecounty"], "sl_contacts", *plan.ROOTS, models={"m3": ()}, fitted=True)
    cells = out.groupBy("statecounty", "weekend").agg(F.count("*").alias("n"), F.sum("m3").alias("m3"), F.sum("m3_fitted").alias("m3_fitted"))
    enough = cells.groupBy("statecounty").agg(F.min("n").alias("least")).where(F.col("least") >= LEAST_ROWS)
    return rounded(cells.join(enough, "statecounty", "left_semi"), 3)


@query(
    "ols_normal_equations",
    f"""WITH rows AS (SELECT state, pt, rt, weekend, sl_contacts AS y, a, b FROM ({ROOTS_TWIN}) r)
    SELECT 'pt' AS factor, state, pt AS level, weekend, round(sum(y), 3) AS y,
      round(sum(a * y), 3) AS ay, round(sum(b * y), 3) AS by_ FROM rows GROUP BY state, pt, weekend
    UNION ALL SELECT 'rt', state, rt, weekend, round(sum(y), 3), round(sum(a * y), 3),
      round(sum(b * y), 3) FROM rows GROUP BY state, rt, weekend""",
)
def ols_normal_equations(w):
    """Fitted values of the additive model meet the same cross products as the data.

    Least squares is characterised by these equations: they hold for the fit and no other.
    """
    rows = plan.with_roots(w.stored_daily("state", "pt", "rt", *FITTED), plan.SL)
    models = {"m1": OLS.MODELS["m1"]}
    fit = OLS.grouped_ols(rows, ["state"], "sl_contacts", *plan.ROOTS, models=models, fitted=True)
    y = F.col("m1_fitted")
    products = {"y": y, "ay": F.col("pv_root") * y, "by_": F.col("imps_root") * y}
    per_cell = fit.groupBy("state", "pt", "rt", "weekend").agg(
        *[F.sum(p).alias(name) for name, p in products.items()]
    )
    parts = [
        per_cell.groupBy(F.lit(f).alias("factor"), "state", F.col(f).alias("level"), "weekend").agg(
            *[F.sum(name).alias(name) for name in products]
        )
        for f in ("pt", "rt")
    ]
    return rounded(parts[0].unionByName(parts[1]), 3)


FALLBACK_SQL = """SELECT p.*, 3 * sl_contacts - 2 AS m1, 1 - sl_contacts - weekend AS m2,
      2 * da_contacts - 2 + weekend AS m3 FROM ad_performance_daily p"""
EXTRAPOLATE_SQL = """CASE WHEN sl_imps > 0 AND potential_sl_imps > 20
    THEN potential_sl_imps / sl_imps * sl_contacts * 0.6 ELSE 0 END"""


def given_predictions(w):
    return w.ad_performance_daily.withColumns(
        {
            "m1": 3 * F.col("sl_contacts") - 2,
            "m2": 1 - F.col("sl_contacts") - F.col("weekend"),
            "m3": 2 * F.col("da_contacts") - 2 + F.col("weekend"),
        }
    )


@query(
    "model_fallback",
    f"""WITH p AS ({FALLBACK_SQL}), t AS (SELECT month, statecounty, sum(m1) AS v1, sum(m2) AS v2,
        sum(m3) AS v3 FROM p GROUP BY 1, 2),
    u AS (SELECT month, statecounty, CASE WHEN v1 >= 0 THEN 1 WHEN v2 >= 0 THEN 2
        WHEN v3 >= 0 THEN 3 ELSE 0 END AS use FROM t)
    SELECT p.month, p.statecounty, u.use, count(*) AS n, round(sum(CASE u.use WHEN 1 THEN m1
        WHEN 2 THEN m2 WHEN 3 THEN m3 ELSE {EXTRAPOLATE_SQL} END), 6) AS potential_sl_contacts
    FROM p JOIN u ON u.month = p.month AND u.statecounty = p.statecounty GROUP BY 1, 2, 3""",
)
def model_fallback(w):
    chosen = plan.choose_model(given_predictions(w), plan.SL)
    return rounded(
        chosen.groupBy("month", "statecounty", "use").agg(
            F.count("*").alias("n"), F.sum(plan.SL.potential).alias(plan.SL.potential)
        )
    )


@query(
    "ratio_extrapolate",
    f"""SELECT state, pt, rt, count(*) AS n, round(sum({EXTRAPOLATE_SQL}), 6) AS contacts
    FROM ad_performance_daily GROUP BY state, pt, rt""",
)
def ratio_extrapolate(w):
    value = plan.ratio_extrapolate(plan.SL)
    return rounded(
        w.ad_performance_daily.groupBy("state", "pt", "rt").agg(
            F.count("*").alias("n"), F.sum(value).alias("contacts")
        )
    )


POOL_MEASURES = ("pv", "sl_imps", "sl_contacts")
MARKET_TOTALS = "SELECT statecounty, " + ", ".join(
    f"cast(sum(cast({c} AS decimal(28,4))) AS double) AS {c}" for c in POOL_MEASURES
) + " FROM ad_performance_daily GROUP BY 1"


def refit_twin() -> str:
    pools = split_sql(MARKET_TOTALS, "statecounty", POOL_MEASURES, levels=3, least=4)
    predicted = "{m}.k0 + {m}.ka * a + {m}.kb * bp"
    return f"""WITH pools AS ({pools}),
    rows AS (SELECT r.statecounty, cluster, weekend, rt, sl_contacts AS y, a, b, bp FROM ({ROOTS_TWIN}) r JOIN pools USING (statecounty)),
    {closed_form("pooled", "cluster, weekend")}, {closed_form("own", "statecounty, weekend")},
    n AS (SELECT statecounty, min(n) AS least FROM (SELECT statecounty, weekend, count(*) AS n FROM rows GROUP BY 1, 2) c GROUP BY 1),
    again AS (SELECT statecounty FROM rows JOIN pooled USING (cluster, weekend) GROUP BY 1
      HAVING sum(y) > 1.1 * sum({predicted.format(m="pooled")}) AND sum(y) > 20 AND count(DISTINCT rt) > 1)
    SELECT r.statecounty, a.statecounty IS NOT NULL AS refitted, count(*) AS n, sum(y) AS sl_contacts,
      round(sum(CASE WHEN a.statecounty IS NULL THEN {predicted.format(m="pooled")} ELSE {predicted.format(m="own")} END), 3) AS potential_sl_contacts
    FROM rows r JOIN pooled USING (cluster, weekend) JOIN own ON own.statecounty = r.statecounty AND own.weekend = r.weekend
    JOIN n ON n.statecounty = r.statecounty AND least >= {LEAST_ROWS} LEFT JOIN again a ON a.statecounty = r.statecounty GROUP BY 1, 2"""


@query("low_market_refit", refit_twin())
def low_market_refit(w):
    """Contacts of pooled markets, those that undershoot with a model of their own, by the model without factors.

    Shown where a market's own model is determined by its rows.
    """
    daily = w.stored_daily("statecounty", "rt", *FITTED)
    pooled = plan.with_roots(daily.join(plan.pool_markets(daily, plan.SL, pools=5), "statecounty"), plan.SL)
    fitted = OLS.grouped_ols(pooled, ["cluster"], plan.SL.contacts, *plan.ROOTS, models={"m1": ()})
    fitted = cut_lineage(fitted.withColumnRenamed("m1", plan.SL.potential), "pooled-contacts")
    again = plan.undershooting(fitted, plan.SL).select("statecounty", F.lit(True).alias("refitted"))
    done = plan.refit_low(fitted, plan.SL, model=())
    cells = done.groupBy("statecounty", "weekend").agg(F.count("*").alias("n"), *[F.sum(c).alias(c) for c in (plan.SL.contacts, plan.SL.potential)])
    markets = cells.groupBy("statecounty").agg(F.min("n").alias("least"), *[F.sum(c).alias(c) for c in ("n", plan.SL.contacts, plan.SL.potential)])
    return rounded(markets.where(F.col("least") >= LEAST_ROWS).drop("least").join(again, "statecounty", "left").fillna(False, ["refitted"]), 3)


OUTLIER_INPUT = "SELECT p.*, da_contacts * (1 + weekend * 2) AS pot FROM ad_performance_daily p"
OUTLIER_TWIN = f"""SELECT state FROM (SELECT state, sum(da_contacts) AS v1, sum(pot) AS v2,
      sum(da_imps) AS v3, sum(potential_da_imps) AS v4 FROM ({OUTLIER_INPUT}) r
    WHERE {RECENT_TWIN} GROUP BY state) t
  WHERE (v2 > 2 * v1 AND v4 < 2 * v3 AND v1 > 10) OR (v3 > 0 AND v2 * v3 > 1.25 * v1 * v4 AND v2 > 5)
    OR (v2 > 3 * v1 AND v2 > 5)"""


def outlier_input(w):
    lifted = F.col("da_contacts") * (1 + F.col("weekend") * 2)
    return w.ad_performance_daily.withColumn(plan.DA.potential, lifted)


@query(
    "outlier_redo",
    f"""WITH p AS ({OUTLIER_INPUT}), flagged AS ({OUTLIER_TWIN}),
    rate AS (SELECT state, median(da_contacts / da_imps) AS r FROM p
      WHERE da_imps > 0 AND state IN (SELECT state FROM flagged) GROUP BY state)
    SELECT p.state, r.state IS NOT NULL AS redone, count(*) AS n,
      round(sum(CASE WHEN r.state IS NULL THEN pot
        WHEN da_imps > 0 THEN potential_da_imps / da_imps * da_contacts * 0.7
        ELSE r.r * potential_da_imps END), 4) AS potential_da_contacts
    FROM p LEFT JOIN rate r ON r.state = p.state GROUP BY 1, 2""",
)
def outlier_redo(w):
    rows = cut_lineage(outlier_input(w), "outlier-rows")
    done = plan.redo_outliers(rows, plan.DA, AS_OF, market="state")
    flagged = plan.outlier_markets(rows, plan.DA, AS_OF, market="state").select(
        "state", F.lit(True).alias("redone")
    )
    return rounded(
        done.groupBy("state")
        .agg(F.count("*").alias("n"), F.sum(plan.DA.potential).alias(plan.DA.potential))
        .join(flagged, "state", "left")
        .fillna(False, ["redone"]),
        4,
    )


@query(
    "quantile_alternate",
    """SELECT statecounty, round(median(da_contacts / da_imps), 6) AS alternate_rate
    FROM ad_performance_daily WHERE da_imps > 0 GROUP BY statecounty""",
)
def quantile_alternate(w):
    return rounded(plan.alternate_rate(w.ad_performance_daily, plan.DA))


@query(
    "combine_sl_da",
    """SELECT s.statecounty, s.pa, cast(s.event_day AS varchar) AS event_day, s.pt, s.rt,
      s.sl_contacts * 1.25 AS potential_sl_contacts, d.da_contacts * 1.25 AS potential_da_contacts
    FROM ad_performance_daily s JOIN ad_performance_daily d
      ON d.event_day = s.event_day AND d.statecounty = s.statecounty AND d.pa = s.pa
      AND d.pt = s.pt AND d.rt = s.rt""",
)
def combine_sl_da(w):
    keys = ["event_day", "statecounty", "pa", "pt", "rt"]
    rows = w.ad_performance_daily
    sl = rows.select(*keys, (F.col("sl_contacts") * 1.25).alias(plan.SL.potential))
    da = rows.select(*keys, (F.col("da_contacts") * 1.25).alias(plan.DA.potential))
    return rounded(plan.combine_products(sl, da, keys))


LOW_TWIN = f"""SELECT p.pa || ' | ' || p.statecounty AS statecounty, cast(sum(cast(p.pv AS decimal(28,4))) AS double) AS pv,
      cast(sum(cast(p.sl_imps AS decimal(28,4))) AS double) AS sl_imps, cast(sum(cast(p.sl_contacts AS decimal(28,4))) AS double) AS sl_contacts
    FROM ad_performance_daily p LEFT JOIN ({ELIGIBLE_TWIN}) e ON e.pa = p.pa AND e.statecounty = p.statecounty
    WHERE e.pa IS NULL GROUP BY 1"""


@query("cluster_low_markets", split_sql(LOW_TWIN, "statecounty", ("pv", "sl_imps", "sl_contacts"), levels=3, least=4))
def cluster_low_markets(w):
    rows = stored_per_area(w, "pv", plan.SL.imps, plan.SL.contacts)
    eligible = plan.market_eligibility(rows, "sl_acv").select("statecounty")
    return plan.pool_markets(rows.join(eligible, "statecounty", "left_anti"), plan.SL, pools=5)


FORECAST_DAY = "2001-12-01"


def pipeline_rows(w):
    """History and forecast day through both products; the forecast has a row for each kind of day."""
    keys = ("event_day", "statecounty", "pt", "rt", "weekend")
    return plan.contacts_pipeline(plan.forecast_input(w.ad_performance_daily, FORECAST_DAY), keys, redo_as_of=AS_OF, keep=(), kept=True)


@query("contacts_pipeline")
def contacts_pipeline(w):
    """Both products end to end over history and forecast: eligible markets fitted each, the others per pool."""
    cols = ["statecounty", "event_day", "pt", "rt", plan.SL.potential, plan.DA.potential]
    return rounded(pipeline_rows(w).select(*cols), 4)


@query(
    "contacts_pipeline_check",
    f"""WITH m AS (SELECT DISTINCT state, county, statecounty FROM ad_performance_daily),
    shapes AS (SELECT DISTINCT state, county, rt, pt, weekend FROM ad_performance_daily)
    SELECT statecounty, cast(event_day AS varchar) AS event_day, count(*) AS n, true AS no_negatives
    FROM (SELECT statecounty, event_day
          FROM (SELECT DISTINCT statecounty, event_day, pt, rt, weekend FROM ad_performance_daily) d
          UNION ALL SELECT statecounty, date '{FORECAST_DAY}' FROM shapes JOIN m USING (state, county)) r
    GROUP BY 1, 2""",
)
def contacts_pipeline_check(w):
    """Every market and day keeps its rows, the forecast day included, and no contacts are negative."""
    least = F.min(F.least(plan.SL.potential, plan.DA.potential))
    rows = pipeline_rows(w).groupBy("statecounty", "event_day").agg(F.count("*").alias("n"), (least >= 0).alias("no_negatives"))
    return rounded(rows)


@query(
    "potential_contacts",
    """WITH m AS (SELECT state, county, pa, avg(s) AS s, avg(d) AS d FROM (
        SELECT month, state, county, pa, sum(sl_contacts) AS s, sum(da_contacts) AS d
        FROM ad_performance_daily GROUP BY 1, 2, 3, 4) x GROUP BY 1, 2, 3)
    SELECT l.state, l.county, l.pa, l.total, floor((l.potential_total) * 1e6 + 0.5) / 1e6 AS potential_total,
      floor((coalesce(m.s / nullif(l.total, 0), 0)) * 1e6 + 0.5) / 1e6 AS sl_cps,
      floor((coalesce(m.d / nullif(l.total, 0), 0)) * 1e6 + 0.5) / 1e6 AS da_cps,
      floor((coalesce(m.s / nullif(l.total, 0), 0) * l.potential_total) * 1e6 + 0.5) / 1e6 AS potential_sl_contacts,
      floor((coalesce(m.d / nullif(l.total, 0), 0) * l.potential_total) * 1e6 + 0.5) / 1e6 AS potential_da_contacts
    FROM area_lifted l LEFT JOIN m ON m.state = l.state AND m.county = l.county AND m.pa = l.pa""",
)
def potential_contacts(w):
    areas = F.array(*map(F.lit, PRACTICE_AREAS))
    regions = w.regions.select(*REGION, "cluster", "pop_total").withColumn("pa", F.explode(areas))
    lifted = P.potential_totals_wide(regions, w.stored_traffic, by=["pa"])
    return rounded(plan.potential_contacts(w.ad_performance_daily, lifted), 6, half_up=True)

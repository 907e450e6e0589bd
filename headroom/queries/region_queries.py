"""Queries over census areas, regions, clusters and potential."""

from __future__ import annotations

from pyspark.sql import functions as F

from headroom.functions import features as feat
from headroom.functions import scalars as S
from headroom.operators import clustering as C
from headroom.operators import grouping as G
from headroom.operators import quantile as Q
from headroom.operators import reshape as R
from headroom.plans import county as county_plan
from headroom.plans import geography
from headroom.plans import potential as P
from headroom.plans import report
from headroom.queries.cluster_twins import kmeans_sql, linkage_sql
from headroom.queries.registry import half_up_sql, query, rounded
from headroom.queries.warehouse import AMOUNT_RATES, CENTERS, COUNTY_RATES, FEATURE_NAMES, PRACTICE_AREAS
from headroom.sources.shared import cut_lineage

REGION = ["state", "county"]
NAMED_STATES = ["nation_3", "nation_7", "nation_11"]

# --- cleaning and derived columns -------------------------------------------------------


@query(
    "rename_by_map",
    """SELECT zcta, state, county, pop_total AS pop_base_count, hh_total AS hh_base_count
    FROM census_zcta""",
)
def rename_by_map(w):
    cols = w.census_zcta.select("zcta", *REGION, "pop_total", "hh_total")
    mapping = w.spark.createDataFrame(
        [("pop_total", "pop_base_count"), ("hh_total", "households")], "column_name string, new_name string"
    )
    first = R.rename_by_table(cols, mapping, "column_name", "new_name")
    return R.rename_by_map(first, {"households": "hh_base_count"})


@query(
    "drop_by_pattern",
    """SELECT zcta, state, county, emp_no, cit_not_citizen, round(age_male, 6) AS age_male
    FROM census_zcta""",
)
def drop_by_pattern(w):
    return rounded(R.drop_by_pattern(w.census_zcta.withColumn("x", F.lit(1)), ["^pop_", "^hh_", "^pov_"]))


@query(
    "zip_pad",
    """SELECT c_custkey, right('00' || cast(100 + c_custkey AS varchar), 5) AS zip FROM customer""",
)
def zip_pad(w):
    zip_text = (100 + F.col("c_custkey")).cast("string")
    return w.table("customer").select("c_custkey", S.zip5(zip_text).alias("zip"))


@query(
    "normalize_geo",
    """SELECT c_custkey, lower(replace(c_name || ' County', ' County', '')) AS county,
      CASE WHEN n_name = 'NATION_4' THEN 'Nation of 4' ELSE n_name END AS state,
      CASE WHEN lower(r_name) IN ('baltimore', 'st. louis', 'franklin', 'richmond', 'roanoke')
        THEN r_name || ' city' ELSE r_name END AS area
    FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
)
def normalize_geo(w):
    joined = (
        w.table("customer")
        .join(w.table("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(w.table("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    )
    return joined.select(
        "c_custkey",
        S.county_name(F.concat("c_name", F.lit(" County"))).alias("county"),
        S.recode(F.col("n_name"), {"NATION_4": "Nation of 4"}).alias("state"),
        S.city_suffixed(F.col("r_name"), F.lit("city")).alias("area"),
    )


@query(
    "derive_and_fold",
    """SELECT zcta, pop_male + pop_female + emp_no AS pop_male, pop_total FROM census_zcta""",
)
def derive_and_fold(w):
    cols = w.census_zcta.select("zcta", "pop_male", "pop_female", "emp_no", "pop_total")
    return R.derive_and_fold(cols, "pop_male", ["pop_female", "emp_no"])


@query(
    "null_to_zero",
    """SELECT c_custkey, coalesce(n, 0) AS n, coalesce(spend, 0) AS spend, priority FROM customer
    LEFT JOIN (SELECT o_custkey, cast(count(*) AS double) AS n,
        round(sum(o_totalprice), 2) AS spend, max(o_orderpriority) AS priority
      FROM orders GROUP BY 1) o ON o_custkey = c_custkey""",
)
def null_to_zero(w):
    spend = w.table("orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.count("*").cast("double").alias("n"),
        F.sum("o_totalprice").alias("spend"),
        F.max("o_orderpriority").alias("priority"),
    )
    joined = w.table("customer").select("c_custkey").join(spend, "c_custkey", "left")
    return rounded(R.null_to_zero(joined, ["n", "spend"]), 2)


@query(
    "feature_expressions",
    """SELECT state, county, pop_male + pop_female AS pop_male_plus_pop_female,
      round(emp_no / nullif(pop_total, 0), 6) AS emp_no_per_pop_total,
      round((emp_no + pov_below) / nullif(pop_male - pop_female, 0) * 2, 6)
        AS emp_no_plus_pov_below_per_pop_male_minus_pop_female_times_2
    FROM county_features""",
)
def feature_expressions(w):
    text = "(pop.male+pop.female),emp.no/pop.total,(emp.no+pov.below)/(pop.male-pop.female)*2"
    return rounded(feat.feature_expressions(w.county_features, text, REGION))


# Census columns that the presets name and the line items don't have: a share of the population each.
STAND_INS = sorted(
    {feat.plain_name(n) for p in feat.PRESETS.values() for n in feat.names_in(p.features)}
    - {"age_male", "cit_not_citizen", "emp_no", "hh_median_income", "pov_below"}
)


def preset_frame(w):
    """County features with every column that a preset names."""
    stand_ins = {c: F.floor(F.col("pop_total") * (i + 1) / (len(STAND_INS) + 1)) for i, c in enumerate(STAND_INS)}
    return w.county_features.withColumns(stand_ins)


STAND_IN_TWIN = "SELECT *, " + ", ".join(
    f"floor(pop_total * {i + 1} / {len(STAND_INS) + 1}) AS {c}" for i, c in enumerate(STAND_INS)
) + " FROM county_features"


def preset_twin(name, preset):
    values = []
    for text in feat.split_features(preset.features):
        plain = feat.plain_name(text)
        top, _, below = plain.partition("/")
        value = f"coalesce({top} / nullif({below}, 0), 0)" if below else plain
        values.append(
            f"""SELECT '{name}' AS preset, '{preset.practice_area}' AS pa, {preset.clusters} AS clusters,
      state, county, '{feat.feature_name(text)}' AS feature, {half_up_sql(value)} AS value FROM columns_named"""
        )
    return "\nUNION ALL ".join(values)


@query(
    "feature_presets",
    f"WITH columns_named AS ({STAND_IN_TWIN})\n"
    + "\nUNION ALL ".join(preset_twin(name, preset) for name, preset in feat.PRESETS.items()),
)
def feature_presets(w):
    """All presets: their features per county, one row each."""
    columns, out = preset_frame(w), None
    for name, preset in feat.PRESETS.items():
        rows = R.null_to_zero(feat.feature_expressions(columns, preset.features, REGION))
        names = [c for c in rows.columns if c not in REGION]
        labels = (F.lit(name).alias("preset"), F.lit(preset.practice_area).alias("pa"), F.lit(preset.clusters).alias("clusters"))
        rows = rows.unpivot(REGION, names, "feature", "value").select(*labels, *REGION, "feature", "value")
        out = rows if out is None else out.unionByName(rows)
    return rounded(out, half_up=["value"])


CATALOG = (
    "age_male",
    "cit_not_citizen",
    "emp_no",
    "hh_median_income",
    "hh_total",
    "pop_female",
    "pop_male",
    "pop_total",
    "pov_below",
)


@query(
    "feature_catalog",
    "\nUNION ALL ".join(
        f"""SELECT '{c}' AS measure, 'double' AS type, {half_up_sql(f"min({c})")} AS low,
      {half_up_sql(f"max({c})")} AS high FROM county_features"""
        for c in CATALOG
    ),
)
def feature_catalog(w):
    """Names and types of the columns on offer, each with its range over the whole table."""
    catalog = feat.feature_catalog(w.county_features, REGION)
    names = [name for name, _ in catalog]
    types = F.create_map(*[F.lit(part) for pair in catalog for part in pair])
    return rounded(
        R.measures_long(w.county_features, REGION, names)
        .groupBy("measure")
        .agg(F.min("value").alias("low"), F.max("value").alias("high"))
        .withColumn("type", types[F.col("measure")]),
        half_up=True,
    )


@query(
    "practice_area_select",
    """SELECT 'all' AS choice, pa, sum(core) AS core FROM traffic GROUP BY pa
    UNION ALL SELECT 'two', pa, sum(core) FROM traffic WHERE pa IN ('ECONOMY', 'PROMO') GROUP BY pa""",
)
def practice_area_select(w):
    parts = {"all": "all", "two": "ECONOMY, PROMO"}
    frames = [
        R.practice_area_select(w.traffic, text)
        .groupBy(F.lit(name).alias("choice"), "pa")
        .agg(F.sum("core").alias("core"))
        for name, text in parts.items()
    ]
    return frames[0].unionByName(frames[1])


@query(
    "month_and_key",
    """SELECT month, statecounty, count(*) AS n FROM ad_performance_daily GROUP BY 1, 2""",
)
def month_and_key(w):
    return (
        w.ad_performance_daily.select(
            S.month_text(F.col("event_day")).alias("month"),
            S.market_key(F.col("state"), F.col("county")).alias("statecounty"),
        )
        .groupBy("month", "statecounty")
        .agg(F.count("*").alias("n"))
    )


@query(
    "monthly_normalize",
    """SELECT state, county, pa, round((core + others) / 3, 6) AS sessions FROM traffic""",
)
def monthly_normalize(w):
    monthly = ((F.col("core") + F.col("others")) / 3).alias("sessions")
    return rounded(w.traffic.select(*REGION, "pa", monthly))


@query(
    "literal_tag",
    """SELECT state, county, cluster, 'ECONOMY' AS pa FROM regions""",
)
def literal_tag(w):
    return w.regions.select(*REGION, "cluster").withColumn("pa", F.lit("ECONOMY"))


@query(
    "floor_at_zero",
    """SELECT s_suppkey, greatest(s_acctbal, 0) AS balance FROM supplier
    UNION ALL SELECT c_custkey, greatest(c_acctbal, 0) FROM customer""",
)
def floor_at_zero(w):
    supplier = w.table("supplier").select("s_suppkey", S.floor_at_zero(F.col("s_acctbal")).alias("balance"))
    customer = w.table("customer").select("c_custkey", S.floor_at_zero(F.col("c_acctbal")))
    return supplier.union(customer)


@query(
    "row_diff_pct",
    """SELECT state, county, pa, floor((incremental_traffic) * 1e4 + 0.5) / 1e4 AS incremental_traffic,
      floor((incremental_acv) * 1e4 + 0.5) / 1e4 AS incremental_acv,
      floor((pct_potential_total) * 1e4 + 0.5) / 1e4 AS pct_potential_total,
      floor((pct_potential_acv) * 1e4 + 0.5) / 1e4 AS pct_potential_acv FROM bi_rows""",
)
def row_diff_pct(w):
    rows = report.row_differences(clusters_wide(w))
    cols = ["incremental_traffic", "incremental_acv", "pct_potential_total", "pct_potential_acv"]
    return rounded(rows.select(*REGION, "pa", *cols), half_up=True)


@query(
    "filter_state_names",
    """SELECT state, county, cluster FROM regions WHERE state IN (SELECT state FROM state_lookup
      WHERE statename IN ('nation_3', 'nation_7', 'nation_11'))""",
)
def filter_state_names(w):
    return R.in_named_states(w.regions, w.state_lookup, NAMED_STATES).select(*REGION, "cluster")


@query(
    "filter_member_range",
    """SELECT state, county, pa, core FROM traffic
    WHERE (state BETWEEN 'NATION_0' AND 'NATION_14' OR state BETWEEN 'NATION_20' AND 'NATION_9')
      AND pa = 'ECONOMY'""",
)
def filter_member_range(w):
    mainland = [("NATION_0", "NATION_14"), ("NATION_20", "NATION_9")]
    chosen = R.member_ranges(F.col("state"), mainland) & R.member_ranges(F.col("pa"), [("ECONOMY", "ECONOMY")])
    return w.traffic.where(chosen).select(*REGION, "pa", "core")


@query(
    "filter_measure_range",
    """SELECT pa, count(*) AS n, sum(core + others) AS total FROM traffic
    WHERE core + others BETWEEN 5 AND 31137.67 GROUP BY pa""",
)
def filter_measure_range(w):
    rows = w.traffic.withColumn("total", F.col("core") + F.col("others"))
    return report.in_total_range(rows, 5, 31137.67).groupBy("pa").agg(
        F.count("*").alias("n"), F.sum("total").alias("total")
    )


@query(
    "drop_unmatched",
    """SELECT state, county, pt, sessions FROM region_sessions WHERE pt IS NOT NULL""",
)
def drop_unmatched(w):
    rows = P.region_sessions(w.regions, P.traffic_long(w.traffic, "all"))
    return rows.where(F.col("pt").isNotNull()).select(*REGION, "pt", "sessions")


# --- joins ------------------------------------------------------------------------------


@query(
    "join_full_outer",
    """SELECT state, county, pt, slimps IS NULL AS no_acv, sessions FROM acv_month
    FULL OUTER JOIN traffic_long USING (state, county, pt)""",
)
def join_full_outer(w):
    keys = [*REGION, "pt"]
    joined = P.monthly_acv(w.acv_input, "all", keys).join(P.traffic_long(w.traffic, "all"), keys, "full_outer")
    return joined.select(*keys, F.col("slimps").isNull().alias("no_acv"), "sessions")


@query(
    "join_left_keep",
    """SELECT c.state, c.county, t.pt, t.sessions FROM county_dim c
    LEFT JOIN traffic_long t ON t.state = c.state AND t.county = c.county""",
)
def join_left_keep(w):
    return w.county.select(*REGION).join(P.traffic_long(w.traffic, "all"), REGION, "left").select(
        *REGION, "pt", "sessions"
    )


@query(
    "join_lookup_distinct",
    """SELECT t.state, t.county, t.pa, t.core, l.segment FROM traffic t
    JOIN (SELECT DISTINCT state, county, segment FROM line_fact) l
      ON l.state = t.state AND l.county = t.county""",
)
def join_lookup_distinct(w):
    lookup = w.ad_performance_daily.select(*REGION, "segment").dropDuplicates()
    return w.traffic.join(lookup, REGION).select(*REGION, "pa", "core", "segment")


@query(
    "join_market_attributes",
    """SELECT ad_market_state_name AS state, ad_market_county_name AS county,
      ad_market_specialty_name AS pa, count(*) AS n, round(sum(sl_adimpression), 6) AS sl_imps
    FROM webanalytics_v3 JOIN ad_market_dimension USING (ad_market_id) GROUP BY 1, 2, 3""",
)
def join_market_attributes(w):
    market = w.ad_market_dimension.select(
        "ad_market_id",
        F.col("ad_market_state_name").alias("state"),
        F.col("ad_market_county_name").alias("county"),
        F.col("ad_market_specialty_name").alias("pa"),
    )
    return rounded(
        w.webanalytics_v3.join(market, "ad_market_id")
        .groupBy(*REGION, "pa")
        .agg(F.count("*").alias("n"), F.sum("sl_adimpression").alias("sl_imps"))
    )


@query(
    "join_rename_keys",
    """SELECT t.state, t.county, t.pa, s.state_code FROM traffic t
    JOIN state_lookup s ON lower(t.state) = s.statename""",
)
def join_rename_keys(w):
    lookup = w.state_lookup.select("statename", "state_code")
    t = w.traffic
    return t.join(lookup, F.lower(t.state) == lookup.statename).select(*REGION, "pa", "state_code")


@query(
    "join_fanout_polygon",
    """SELECT r.state, r.county, r.cluster, p."group", p.seq, p.long, p.lat,
      r.cluster * 2 - 1 AS color_index
    FROM regions r JOIN polygon p ON p.state = r.state AND p.county = r.county
    WHERE lower(r.state) IN ('nation_3', 'nation_7', 'nation_11')""",
)
def join_fanout_polygon(w):
    return report.map_polygons(w.regions, w.polygon, w.state_lookup, NAMED_STATES)


LOOKUP_TWIN = """SELECT s.statename, coalesce(e.state, s.state) AS state, s.statefip, s.fip,
      coalesce(e.county, s.county) AS county, e.marketcounty
    FROM (SELECT coalesce(n.statename, m.statename) AS statename, m.state, n.statefip, n.county, n.fip
        FROM (SELECT coalesce(c.statefip, t.statefip) AS statefip, c.county, c.fip, t.statename
            FROM (SELECT DISTINCT c_nationkey AS statefip, lower(c_name) AS county, c_custkey AS fip
                FROM customer) c
            FULL JOIN (SELECT n_nationkey AS statefip, lower(n_name) AS statename FROM nation) t
              ON t.statefip = c.statefip) n
        FULL JOIN (SELECT DISTINCT statename, state_code AS state FROM state_lookup) m
          ON m.statename = n.statename) s
    FULL JOIN (SELECT DISTINCT l.state_code AS state, t.county, 'mkt ' || t.county AS marketcounty
        FROM traffic t JOIN state_lookup l ON l.state = t.state) e
      ON e.state = s.state AND e.county = s.county"""


def county_lookup_frame(w):
    counties = w.table("customer").select(
        F.col("c_nationkey").alias("statefip"),
        F.col("c_name").alias("county"),
        F.lit("county").alias("area_class"),
        F.col("c_custkey").alias("fip"),
    )
    states = w.table("nation").select(
        F.col("n_nationkey").alias("statefip"), F.lower("n_name").alias("statename")
    )
    mapping = w.state_lookup.select(F.upper("statename").alias("statename"), F.col("state_code").alias("state"))
    equivalents = (
        w.traffic.select("state", "county").distinct()
        .join(w.state_lookup.select("state", "state_code"), "state")
        .select(
            F.col("state_code").alias("state"),
            "county",
            F.concat(F.lit("MKT "), F.col("county")).alias("marketcounty"),
        )
    )
    return geography.county_lookup(counties, states, mapping, equivalents)


@query("county_lookup", LOOKUP_TWIN)
def county_lookup(w):
    return county_lookup_frame(w)


@query(
    "packaged_traffic",
    f"""SELECT t.pa, l.county, l.state, l.statename, sum(t.core + t.others) AS visits,
      floor((sum(t.core + t.others) / 3) * 1e6 + 0.5) / 1e6 AS sessions
    FROM traffic t JOIN (SELECT DISTINCT statename, state, marketcounty, county FROM ({LOOKUP_TWIN}) x)
      l ON l.statename = lower(t.state) AND l.marketcounty = 'mkt ' || t.county
    GROUP BY t.pa, l.county, l.state, l.statename""",
)
def packaged_traffic(w):
    sessions = w.traffic.select(
        "pa",
        "state",
        F.concat(F.lit("Mkt "), F.col("county")).alias("county"),
        (F.col("core") + F.col("others")).alias("sessions"),
    )
    return rounded(geography.packaged_traffic(sessions, county_lookup_frame(w)), 6, half_up=True)


# --- aggregation ------------------------------------------------------------------------


@query(
    "sum_then_mean",
    """SELECT state, county, pt, round(slimps, 7) AS slimps, round(daimps, 7) AS daimps,
      round(slacv, 7) AS slacv, round(daacv, 7) AS daacv FROM acv_month""",
)
def sum_then_mean(w):
    return rounded(P.monthly_acv(w.acv_input, "all", [*REGION, "pt"]), 7)


@query(
    "sum_all_numeric",
    """SELECT state, county, sum(pop_total) AS pop_total, sum(pop_male) AS pop_male,
      sum(pop_female) AS pop_female, sum(hh_total) AS hh_total, sum(emp_no) AS emp_no,
      sum(cit_not_citizen) AS cit_not_citizen, sum(pov_below) AS pov_below
    FROM census_zcta GROUP BY state, county""",
)
def sum_all_numeric(w):
    return G.sum_all_numeric(w.census_zcta, REGION, skip=list(COUNTY_RATES))


RATES = {feat.plain_name(rate): feat.plain_name(weight) for rate, weight in county_plan.CENSUS_RATES.items()}
# Rates that the line items don't give: a whole percentage from the area's number.
DERIVED_RATES = [r for r in RATES if r not in COUNTY_RATES]


def added(rate, weight):
    product = f"{rate} * {weight}"
    return f"cast(sum(cast({product} AS decimal(28,4))) AS double)" if rate in AMOUNT_RATES else f"sum({product})"


@query(
    "weighted_means",
    "SELECT state, county, "
    + ", ".join(f"{half_up_sql(f'coalesce({added(r, w)} / nullif(sum({w}), 0), 0)')} AS {r}" for r, w in RATES.items())
    + " FROM (SELECT *, "
    + ", ".join(f"cast(cast(zcta AS bigint) * {i + 3} % 101 AS double) AS {r}" for i, r in enumerate(DERIVED_RATES))
    + " FROM census_zcta) c GROUP BY state, county",
)
def weighted_means(w):
    """All census rates, each averaged by its own count."""
    area = F.col("zcta").cast("long")
    derived = {r: (area * (i + 3) % 101).cast("double") for i, r in enumerate(DERIVED_RATES)}
    return rounded(G.rollup_with_rates(w.census_zcta.withColumns(derived), REGION, [], RATES, amounts=AMOUNT_RATES), half_up=RATES)


COUNTY_TWIN = f"""SELECT state, county, pop_total, pop_male, pop_female, hh_total, emp_no,
    cit_not_citizen, pov_below, {half_up_sql("hh_median_income")} AS hh_median_income,
    {half_up_sql("age_male")} AS age_male FROM county_features"""


@query("zip_to_county_rollup", COUNTY_TWIN)
def zip_to_county_rollup(w):
    sums = ["pop_total", "pop_male", "pop_female", "hh_total", "emp_no", "cit_not_citizen", "pov_below"]
    return rounded(
        G.rollup_with_rates(w.census_zcta, REGION, sums, COUNTY_RATES, amounts=AMOUNT_RATES), half_up=COUNTY_RATES
    )


@query("county_features", COUNTY_TWIN)
def county_features(w):
    census = w.census_zcta
    people = census.select("zcta", *REGION, "pop_total", "pop_male", "pop_female", "age_male")
    homes = census.select("zcta", "hh_total", "hh_median_income")
    social = census.select("zcta", "emp_no", "cit_not_citizen", "pov_below")
    return rounded(
        county_plan.county_features(people, [homes, social], COUNTY_RATES, amounts=AMOUNT_RATES), half_up=COUNTY_RATES
    )


# --- clustering -------------------------------------------------------------------------


@query(
    "standardize_features",
    """SELECT state, county, round(z1, 6) AS age_male, round(z2, 6) AS emp_no_per_pop_total,
      round(z3, 6) AS hh_median_income, round(z4, 6) AS pov_below_per_pop_total FROM zscores""",
)
def standardize_features(w):
    return rounded(C.standardize(w.features, FEATURE_NAMES).drop("pop_total"))


@query("kmeans_regions", kmeans_sql(k=8))
def kmeans_regions(w):
    rows, _ = C.cluster_regions(w.features, REGION, FEATURE_NAMES, k=8)
    return rounded(rows, half_up=True)


CLUSTERS_TWIN = """SELECT state, county, 1 AS n, true AS enough_members, true AS center_is_mean
    FROM features"""


def cluster_check(rows, least):
    """Each region once, in a cluster of at least ``least`` members whose centers are the members' means."""
    sizes = C.cluster_sizes(rows).where(F.col("regions") >= least).select("cluster", F.lit(True).alias("enough_members"))
    per_region = rows.groupBy(*REGION, "cluster").agg(F.count("*").cast("int").alias("n"))
    return per_region.join(sizes, "cluster", "left").fillna(False, ["enough_members"])


@query("kmeans_regions_check", CLUSTERS_TWIN)
def kmeans_regions_check(w):
    rows, centers = C.cluster_regions(w.features, REGION, FEATURE_NAMES, k=8)
    means = rows.groupBy("cluster").agg(*[F.avg(f).alias(f"{f}_mean") for f in FEATURE_NAMES])
    near = [F.abs(F.col(f) - F.col(f"{f}_mean")) <= 1e-9 * (1 + F.abs(F.col(f))) for f in FEATURE_NAMES]
    same = centers.join(means, "cluster").select("cluster", F.least(*[n.cast("int") for n in near]).cast("boolean").alias("center_is_mean"))
    return cluster_check(rows, 4).join(same, "cluster").drop("cluster")


@query("hierarchical_regions_check", "SELECT state, county, 1 AS n, true AS enough_members FROM features")
def hierarchical_regions_check(w):
    return cluster_check(C.hierarchical_regions(w.features, FEATURE_NAMES, k=8), 1).drop("cluster")


@query("hierarchical_merges", linkage_sql())
def hierarchical_merges(w):
    """The states' dendrogram, by their counties' mean features."""
    means = w.features.groupBy("state").agg(*[F.avg(f).alias(f) for f in FEATURE_NAMES])
    return rounded(C.hierarchical_merges(means, F.col("state"), FEATURE_NAMES))


@query("hierarchical_regions")
def hierarchical_regions(w):
    return rounded(C.hierarchical_regions(w.features, FEATURE_NAMES, k=8))


@query("assign_nearest_center", "SELECT state, county, cluster FROM regions")
def assign_nearest_center(w):
    scaled = C.standardize(w.features, FEATURE_NAMES)
    return C.assign_nearest(scaled, FEATURE_NAMES, CENTERS).select(*REGION, "cluster")


@query(
    "cluster_centers_unscaled",
    """SELECT cluster, round(a, 6) AS age_male, round(b, 6) AS emp_no_per_pop_total,
      round(c, 6) AS hh_median_income, round(d, 6) AS pov_below_per_pop_total,
      round(a / (a + b + c + d), 6) AS age_male_share,
      round(b / (a + b + c + d), 6) AS emp_no_per_pop_total_share,
      round(c / (a + b + c + d), 6) AS hh_median_income_share,
      round(d / (a + b + c + d), 6) AS pov_below_per_pop_total_share
    FROM (SELECT cluster, avg(age_male) AS a, avg(emp_no_per_pop_total) AS b,
      avg(hh_median_income) AS c, avg(pov_below_per_pop_total) AS d FROM regions GROUP BY 1) m""",
)
def cluster_centers_unscaled(w):
    return rounded(C.cluster_centers(w.regions, FEATURE_NAMES))


@query(
    "cluster_sizes",
    """SELECT cluster, count(*) AS members, count(DISTINCT state || '|' || county) AS regions
    FROM lifted GROUP BY cluster""",
)
def cluster_sizes(w):
    return C.cluster_sizes(lifted(w))


# --- potential --------------------------------------------------------------------------


def lifted(w):
    return P.potential_sessions(P.region_sessions(w.regions, P.traffic_long(w.traffic, "all")))


def result(w):
    return P.county_result(w.regions, w.traffic, w.acv_input, "all")


def clusters_wide(w):
    """The BI extract: written once for a session's input files, and read by every sheet from then on."""

    def build():
        lines = w.with_stored_lines()
        return P.county_clusters(w.regions, lines.stored_traffic, lines.acv_input, PRACTICE_AREAS)

    return w.extract("county-clusters", "pa", PRACTICE_AREAS, build)


@query(
    "sessions_per_person",
    """SELECT state, county, pt, sessions, floor((sessions_pp) * 1e8 + 0.5) / 1e8 AS sessions_pp
    FROM region_sessions""",
)
def sessions_per_person(w):
    rows = P.region_sessions(w.regions, P.traffic_long(w.traffic, "all"))
    return rounded(rows.select(*REGION, "pt", "sessions", "sessions_pp"), 8, half_up=True)


@query(
    "cluster_target_rate",
    """SELECT l.state, l.county, l.cluster, l.pt, floor((l.target_sessions_pp) * 1e8 + 0.5) / 1e8
      AS target_sessions_pp FROM lifted l""",
)
def cluster_target_rate(w):
    rows = P.region_sessions(w.regions, P.traffic_long(w.traffic, "all")).where(F.col("pt").isNotNull())
    rows = cut_lineage(rows, "region-sessions")
    targets = Q.group_quantile(rows, ["cluster", "pt"], "sessions_pp", "0.7", "target_sessions_pp")
    members = rows.select(*REGION, "cluster", "pt")
    return rounded(members.join(targets, ["cluster", "pt"]), 8, half_up=True)


@query(
    "group_max_floor",
    """SELECT state, county, pt, floor((greatest(sessions_pp, target_sessions_pp)) * 1e8 + 0.5) / 1e8 AS best_pp
    FROM lifted""",
)
def group_max_floor(w):
    best = F.greatest("sessions_pp", "target_sessions_pp").alias("best_pp")
    return rounded(lifted(w).select(*REGION, "pt", best), 8, half_up=True)


@query(
    "potential_sessions",
    """SELECT state, county, cluster, pt, sessions, pop_base_count,
      floor((sessions_pp) * 1e6 + 0.5) / 1e6 AS sessions_pp, floor((target_sessions_pp) * 1e6 + 0.5) / 1e6 AS target_sessions_pp,
      floor((potential_sessions) * 1e6 + 0.5) / 1e6 AS potential_sessions FROM lifted""",
)
def potential_sessions(w):
    return rounded(lifted(w), 6, half_up=True)


@query(
    "potential_totals_wide",
    """SELECT state, county, pa, cluster, total, core, round(target_total_pp, 8) AS target_total_pp,
      round(target_core_pp, 8) AS target_core_pp, round(potential_total, 6) AS potential_total,
      round(potential_core, 6) AS potential_core FROM area_lifted WHERE pa = 'ECONOMY'""",
)
def potential_totals_wide(w):
    chosen = R.practice_area_select(w.traffic, "ECONOMY").drop("pa")
    wide = P.potential_totals_wide(w.regions, chosen).withColumn("pa", F.lit("ECONOMY"))
    targets = [F.round(f"target_{n}_pp", 8).alias(f"target_{n}_pp") for n in ("total", "core")]
    lifts = [F.round(f"potential_{n}", 6).alias(f"potential_{n}") for n in ("total", "core")]
    return wide.select(*REGION, "pa", "cluster", "total", "core", *targets, *lifts)


@query(
    "revenue_rates",
    f"""SELECT state, county, pt, sessions, {half_up_sql("slimps")} AS slimps,
      {half_up_sql("daimps")} AS daimps, {half_up_sql("slacv")} AS slacv,
      {half_up_sql("daacv")} AS daacv, {half_up_sql("sl_ips")} AS sl_ips,
      {half_up_sql("da_ips")} AS da_ips, {half_up_sql("sl_aps")} AS sl_aps,
      {half_up_sql("da_aps")} AS da_aps FROM rates""",
)
def revenue_rates(w):
    keys = [*REGION, "pt"]
    acv = P.monthly_acv(w.acv_input, "all", keys)
    rates = ["sl_ips", "da_ips", "sl_aps", "da_aps"]
    out = P.revenue_rates(acv, P.traffic_long(w.traffic, "all"), keys)
    return rounded(out, half_up=[*P.ACV_MEASURES, *rates])


@query(
    "potential_acv",
    """SELECT state, county, pt, floor((acv) * 1e4 + 0.5) / 1e4 AS acv, floor((potential_sl_acv) * 1e4 + 0.5) / 1e4 AS potential_sl_acv,
      floor((potential_da_acv) * 1e4 + 0.5) / 1e4 AS potential_da_acv, floor((potential_acv) * 1e4 + 0.5) / 1e4 AS potential_acv
    FROM result""",
)
def potential_acv(w):
    cols = ["acv", "potential_sl_acv", "potential_da_acv", "potential_acv"]
    return rounded(result(w).select(*REGION, "pt", *cols), half_up=True)


RESULT_TWIN = """SELECT state, county, cluster, pt, sessions, pop_base_count, floor((sessions_pp) * 1e4 + 0.5) / 1e4 AS sessions_pp,
      floor((target_sessions_pp) * 1e4 + 0.5) / 1e4 AS target_sessions_pp,
      floor((potential_sessions) * 1e4 + 0.5) / 1e4 AS potential_sessions, floor((slacv) * 1e4 + 0.5) / 1e4 AS slacv,
      floor((potential_sl_acv) * 1e4 + 0.5) / 1e4 AS potential_sl_acv, floor((daacv) * 1e4 + 0.5) / 1e4 AS daacv,
      floor((potential_da_acv) * 1e4 + 0.5) / 1e4 AS potential_da_acv, floor((acv) * 1e4 + 0.5) / 1e4 AS acv,
      floor((potential_acv) * 1e4 + 0.5) / 1e4 AS potential_acv, pa FROM result"""


@query("county_result", RESULT_TWIN)
def county_result(w):
    return rounded(result(w), half_up=True)


@query(
    "session_conservation",
    """SELECT '1_traffic' AS stage, sum(sessions) AS sessions FROM traffic_long
    UNION ALL SELECT '2_regions', sum(sessions) FROM region_sessions
    UNION ALL SELECT '3_rates', sum(sessions) FROM rates
    UNION ALL SELECT '4_result', sum(sessions) FROM result""",
)
def session_conservation(w):
    return P.session_conservation(w.stored_regions, w.stored_traffic, w.acv_input, "all")

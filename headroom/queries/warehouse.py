"""The tables every registered query starts from, derived from the given parquet files.

FIXTURES.md states each derivation. Facts are lazy plans, pruned to the columns a query
needs. The two small derived dimensions are stored as tables, like their originals: Spark
then knows their true size, which a plan over the customers could not tell it, and decides
on broadcasting them from that.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import cached_property

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from headroom.functions.features import feature_expressions
from headroom.functions.scalars import channel_of, market_key, month_text, page_bucket_coarse
from headroom.operators.clustering import assign_nearest, standardize
from headroom.operators.grouping import exact_sum
from headroom.operators.reshape import null_to_zero
from headroom.plans.county import county_features
from headroom.sources.readers import read_table
from headroom.sources.shared import cut_lineage, shared_dir
from headroom.sources.writers import read_extract, read_manifest, save_extract

FIRST_MONDAY = "1995-01-02"
# The part types that stand for practice areas.
#: Tables that the BI extract is derived from.
EXTRACT_TABLES = ("lineitem", "orders", "customer", "nation", "part")
#: What of a line is summed up or tells its cell.
LINE_MEASURES = ("l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")
PRACTICE_AREAS = ("STANDARD", "SMALL", "MEDIUM", "LARGE", "ECONOMY", "PROMO")
COUNTY_RATES = {"hh_median_income": "hh_total", "age_male": "pop_male"}
AMOUNT_RATES = ("hh_median_income",)
FEATURES = "age_male,emp_no/pop_total,hh_median_income,pov_below/pop_total"
FEATURE_NAMES = ("age_male", "emp_no_per_pop_total", "hh_median_income", "pov_below_per_pop_total")
# Centers in standardised units; fixed, so that the check engine can assign to them too.
CENTERS = ((-1, -1, 0, 0), (-1, 1, 0, 0), (0, 0, -1, 0), (0, 0, 1, 0), (1, -1, 0, 0), (1, 1, 0, 0))


# Declared, so that no job reads file footers before the query starts.
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, "
    "p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, "
    "l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
    "l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, "
    "props string",
    "pages": "page_id bigint, url string, html string",
}


class Warehouse:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder
        self._tables: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        if name not in self._tables:
            self._tables[name] = read_table(self.spark, self.folder, name, SCHEMAS[name])
        return self._tables[name]

    def with_stored_lines(self) -> Warehouse:
        """The same tables over lines that are joined once and stored, for plans that sum them up in several ways."""
        out = Warehouse(self.spark, self.folder)
        out._lines = cut_lineage(self._lines.select("c_custkey", "pa", *LINE_MEASURES), "lines")
        return out

    def extract(self, name: str, by: str, parts: Sequence[str], build: Callable[[], DataFrame]) -> DataFrame:
        """The extract ``name`` of this folder's files, built unless the session has it for just these files.

        Names, sizes and times of the files tell; they are added up by tasks. A missing manifest means that there is none.
        """
        files = self.spark.read.format("binaryFile").option("recursiveFileLookup", True).load([f"{self.folder}/{t}.parquet" for t in EXTRACT_TABLES])
        seen = files.agg(F.count("*").alias("n"), F.sum(F.xxhash64("path", "length", "modificationTime").cast("decimal(20,0)")).alias("files")).first()
        path = f"{shared_dir(self.spark)}/{name}-{self.spark.sparkContext.applicationId}-{seen['n']}-{seen['files']}"
        try:
            read_manifest(self.spark, path)
        except AnalysisException:
            save_extract(build(), path, by, parts)
        return read_extract(self.spark, path)

    # --- warehouse side -------------------------------------------------------------

    @cached_property
    def specialty_dimension(self) -> DataFrame:
        names = self.table("customer").select(F.col("c_mktsegment").alias("specialty_name")).distinct()
        numbered = names.select(
            F.row_number().over(Window.orderBy("specialty_name")).alias("specialty_id"),
            "specialty_name",
            F.left("specialty_name", F.lit(1)).alias("parent_specialty_name"),
        )
        return cut_lineage(numbered, "specialty")

    @cached_property
    def geography_dimension(self) -> DataFrame:
        return self.table("customer").select(
            F.col("c_custkey").alias("geo_id"), F.col("c_nationkey").alias("sales_region_id")
        )

    @cached_property
    def ad_market_dimension(self) -> DataFrame:
        """One market per nation and specialty, numbered from 0."""
        specialty = self.specialty_dimension
        last = specialty.agg(F.max("specialty_id")).scalar()
        nation = self.table("nation").join(
            self.table("region"), F.col("n_regionkey") == F.col("r_regionkey")
        )
        per_specialty = nation.withColumn("specialty_id", F.explode(F.sequence(F.lit(1), last)))
        market_id = F.col("n_nationkey") * 5 + F.col("specialty_id") - 1
        markets = per_specialty.join(specialty, "specialty_id").select(
            market_id.alias("ad_market_id"),
            "specialty_id",
            F.col("n_nationkey").alias("ad_region_id"),
            F.col("r_name").alias("ad_market_state_name"),
            F.col("n_name").alias("ad_market_county_name"),
            F.col("n_name").alias("ad_market_region_name"),
            F.col("specialty_name").alias("ad_market_specialty_name"),
            F.when(F.col("n_nationkey") < 5, "Y").otherwise("N").alias("ad_market_block_flag"),
            F.when(market_id % 10 == 9, "N").otherwise("Y").alias("ad_market_active_flag"),
        )
        return cut_lineage(markets, "ad-market")

    @cached_property
    def page_view(self) -> DataFrame:
        event_id = F.col("event_id")
        kind = F.col("event_type")
        tag = event_id % 5
        return self.table("events").select(
            event_id,
            F.col("ts").cast("timestamp").alias("gmt_timestamp"),
            F.col("ts").cast("date").alias("event_date"),
            F.when(event_id % 23 != 0, event_id.cast("string")).alias("render_instance_guid"),
            F.when(event_id % 29 != 0, F.col("user_id").cast("string")).alias("persistent_session_id"),
            F.concat_ws(
                ".", F.col("user_id").cast("string"), F.floor(F.dayofmonth("ts") / 2).cast("string")
            ).alias("session_id"),
            F.when(kind == "view", "Attorney_Search")
            .when(kind == "click", "Attorney_Profile")
            .when(kind == "signup", "Attorney_Profile_Contact")
            .when(kind == "purchase", "Topic_Page")
            .otherwise("Error_Page")
            .alias("page_type"),
            (1 + event_id % 6).cast("int").alias("specialty_id"),
            F.when(event_id % 17 != 0, F.col("user_id")).alias("location_id"),
            F.concat(
                F.lit("https://x.example/?"),
                F.when(tag == 0, "utm_campaign=brand")
                .when(tag == 1, "utm_campaign=pls")
                .when(tag == 2, "utm_content=sgt")
                .when(tag == 3, "utm_campaign=adblock")
                .otherwise("ref=none"),
            ).alias("url"),
        )

    @cached_property
    def ad_inventory(self) -> DataFrame:
        customer = self.table("customer").join(
            self.specialty_dimension, F.col("c_mktsegment") == F.col("specialty_name")
        )
        orders = self.table("orders").join(customer, F.col("o_custkey") == F.col("c_custkey"))
        return (
            self.table("lineitem")
            .join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
            .select(
                (F.col("c_nationkey") * 5 + F.col("specialty_id") - 1).alias("ad_target_id"),
                "specialty_id",
                F.when(F.col("l_returnflag") == "A", "Sponsored Listing")
                .when(F.col("l_returnflag") == "N", "Display")
                .otherwise("Other")
                .alias("ad_inventory_type"),
                F.col("l_quantity").cast("long").alias("sellable_count"),
                F.col("l_extendedprice").alias("list_price"),
            )
        )

    @cached_property
    def attribution_v3_all(self) -> DataFrame:
        market = self.ad_market_dimension
        geography = self.geography_dimension
        pv = self.page_view
        medium = channel_of(F.col("url"))
        return (
            pv.join(geography, F.col("location_id") == F.col("geo_id"))
            .join(
                market.select(
                    "ad_market_id",
                    F.col("specialty_id").alias("m_specialty_id"),
                    "ad_region_id",
                    "ad_market_specialty_name",
                ),
                (F.col("specialty_id") == F.col("m_specialty_id"))
                & (F.col("sales_region_id") == F.col("ad_region_id")),
            )
            .select(
                "ad_market_id",
                F.col("ad_market_specialty_name").alias("ad_specialty"),
                "session_id",
                "event_date",
                F.when(F.col("event_id") % 19 == 0, None)
                .when(medium.isin("brand", "network"), medium)
                .otherwise("nonsem")
                .alias("lpv_medium"),
            )
        )

    @cached_property
    def _performance_by_market(self) -> DataFrame:
        market = self.ad_market_dimension.select(
            "ad_market_id", "ad_market_county_name", "ad_market_specialty_name"
        )
        perf = self.ad_performance_daily
        return perf.join(
            market,
            (perf.state == market.ad_market_county_name)
            & (perf.segment == market.ad_market_specialty_name),
        )

    @cached_property
    def webanalytics_v3(self) -> DataFrame:
        return self._performance_by_market.select(
            "ad_market_id",
            F.col("pt").alias("ad_page_type"),
            F.col("event_day").alias("event_date"),
            F.col("sl_imps").alias("sl_adimpression"),
            F.col("pv").alias("page_view"),
        )

    @cached_property
    def potential_acv_marketid(self) -> DataFrame:
        return self._performance_by_market.select(
            F.col("event_day").alias("attribution_date"),
            F.date_add("event_day", 1).alias("process_date"),
            F.when(F.col("rt") == "mobile", "Other").otherwise("SEM").alias("channel"),
            F.col("ad_market_id").alias("marketid"),
            "pt",
            F.col("rt").alias("cup"),
            "sl_acv",
            "da_acv",
            (F.col("sl_acv") * 1.25).alias("potential_sl_acv"),
            (F.col("da_acv") * 1.25).alias("potential_da_acv"),
            "sl_imps",
            "da_imps",
            "potential_sl_imps",
            "potential_da_imps",
        )

    # --- region side ----------------------------------------------------------------

    @cached_property
    def county(self) -> DataFrame:
        """Customer as county inside nation as state."""
        return (
            self.table("customer")
            .join(self.table("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
            .select(
                "c_custkey",
                F.col("n_name").alias("state"),
                F.lower("c_name").alias("county"),
                F.col("c_mktsegment").alias("segment"),
            )
        )

    @cached_property
    def census_zcta(self) -> DataFrame:
        """Line items are reduced to one row per order before any join."""
        qty = F.col("l_quantity")
        per_order = (
            self.table("lineitem")
            .groupBy("l_orderkey")
            .agg(
                F.sum(qty).alias("pop_total"),
                F.sum(F.when(F.col("l_linestatus") == "F", qty).otherwise(0.0)).alias("pop_male"),
                F.sum(F.when(F.col("l_linestatus") == "O", qty).otherwise(0.0)).alias("pop_female"),
                F.count("*").cast("double").alias("hh_total"),
                (20 + F.avg("l_tax") * 500).alias("age_male"),
                F.sum(F.when(F.col("l_returnflag") == "R", qty).otherwise(0.0)).alias("emp_no"),
                F.sum(F.when(F.col("l_discount") < 0.03, qty).otherwise(0.0)).alias("cit_not_citizen"),
                F.sum(F.when(F.col("l_tax") > 0.04, qty).otherwise(0.0)).alias("pov_below"),
            )
        )
        orders = self.table("orders").select("o_orderkey", "o_custkey", "o_totalprice")
        return (
            per_order.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
            .join(self.county, F.col("o_custkey") == F.col("c_custkey"))
            .select(
                F.lpad(F.col("o_orderkey").cast("string"), 9, "0").alias("zcta"),
                "state",
                "county",
                "pop_total",
                "pop_male",
                "pop_female",
                "hh_total",
                F.col("o_totalprice").alias("hh_median_income"),
                "age_male",
                "emp_no",
                "cit_not_citizen",
                "pov_below",
            )
        )

    @cached_property
    def _lines(self) -> DataFrame:
        """Lines with practice area and customer; names follow after the aggregation."""
        return (
            self.table("lineitem")
            .join(
                self.table("part").select("p_partkey", F.col("p_type").alias("pa")),
                F.col("l_partkey") == F.col("p_partkey"),
            )
            .join(
                self.table("orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey")),
                F.col("l_orderkey") == F.col("o_orderkey"),
            )
        )

    @cached_property
    def traffic(self) -> DataFrame:
        core = F.col("l_returnflag") != "R"
        counts = self._lines.groupBy("c_custkey", "pa").agg(
            F.count(F.when(core, 1)).cast("double").alias("core"),
            F.count(F.when(~core, 1)).cast("double").alias("others"),
        )
        return counts.join(self.county, "c_custkey").select("state", "county", "pa", "core", "others")

    @cached_property
    def ad_performance_daily(self) -> DataFrame:
        """Lines are dealt by customer once: sums and names need no further shuffle, and what one customer has stays together.

        A customer's sums are bounded by the calendar and the levels of its factors.
        """
        qty, price = F.col("l_quantity"), F.col("l_extendedprice")
        discount, tax = F.col("l_discount"), F.col("l_tax")
        sums = (
            self._lines.repartition("c_custkey")
            .groupBy(
                F.col("l_shipdate").cast("date").alias("event_day"),
                "c_custkey",
                "pa",
                F.when(F.col("l_returnflag") == "A", "serp")
                .when(F.col("l_returnflag") == "N", "profile")
                .otherwise("other")
                .alias("pt"),
                F.when(F.col("l_linestatus") == "F", "desktop").otherwise("mobile").alias("rt"),
            )
            .agg(
                F.sum(qty).alias("pv"),
                exact_sum(qty * (1 - discount)).alias("sl_imps"),
                exact_sum(qty * discount).alias("da_imps"),
                F.count(F.when(tax > 0.03, 1)).cast("double").alias("sl_contacts"),
                F.count(F.when(tax <= 0.03, 1)).cast("double").alias("da_contacts"),
                exact_sum(price * discount).alias("sl_acv"),
                exact_sum(price * tax).alias("da_acv"),
            )
            .join(self.county, "c_custkey")
        )
        day_no = F.date_diff(F.col("event_day"), F.lit(FIRST_MONDAY).cast("date"))
        return sums.select(
            "event_day",
            month_text(F.col("event_day")).alias("month"),
            "state",
            "county",
            market_key(F.col("state"), F.col("county")).alias("statecounty"),
            "pa",
            "segment",
            "pt",
            "rt",
            F.when(F.pmod(day_no, F.lit(7)).isin(5, 6), 1).otherwise(0).alias("weekend"),
            "pv",
            "sl_imps",
            "da_imps",
            "sl_contacts",
            "da_contacts",
            "sl_acv",
            "da_acv",
            (F.col("sl_imps") * 1.25).alias("potential_sl_imps"),
            (F.col("da_imps") * 1.25).alias("potential_da_imps"),
        )

    def stored_daily(self, *cols: str) -> DataFrame:
        """Columns of the daily performance, for plans that read them more than once."""
        return cut_lineage(self.ad_performance_daily.select(*cols), "daily")

    @cached_property
    def acv_input(self) -> DataFrame:
        """Daily performance with the page type in the two buckets traffic uses."""
        return self.ad_performance_daily.select(
            "month",
            "state",
            "county",
            "pa",
            page_bucket_coarse(F.col("pt"), other="others").alias("pt"),
            F.col("sl_imps").alias("slimps"),
            F.col("da_imps").alias("daimps"),
            F.col("sl_acv").alias("slacv"),
            F.col("da_acv").alias("daacv"),
        )

    @cached_property
    def county_features(self) -> DataFrame:
        return county_features(self.census_zcta, [], COUNTY_RATES, amounts=AMOUNT_RATES)

    @cached_property
    def features(self) -> DataFrame:
        """The clustering features per county, with the population under its own name."""
        raw = feature_expressions(self.county_features, FEATURES, ["state", "county", "pop_total"])
        return null_to_zero(raw, FEATURE_NAMES)

    @cached_property
    def regions(self) -> DataFrame:
        """Counties with their features and the nearest fixed center as cluster."""
        scaled = [f"{name}_z" for name in FEATURE_NAMES]
        return assign_nearest(standardize(self.features, FEATURE_NAMES, "_z"), scaled, CENTERS).drop(*scaled)

    @cached_property
    def stored_traffic(self) -> DataFrame:
        """Traffic as the packaged table it is, for plans that read it more than once."""
        return cut_lineage(self.traffic, "traffic")

    @cached_property
    def stored_regions(self) -> DataFrame:
        return cut_lineage(self.regions, "regions")

    @cached_property
    def state_lookup(self) -> DataFrame:
        """Full lower-case state name and its short code, one row per nation."""
        return self.table("nation").select(
            F.lower("n_name").alias("statename"),
            F.concat(F.lit("N"), F.lpad(F.col("n_nationkey").cast("string"), 2, "0")).alias("state_code"),
            F.col("n_name").alias("state"),
        )

    @cached_property
    def polygon(self) -> DataFrame:
        """Four boundary vertices per county; ``group`` numbers a county's outline."""
        key = F.col("c_custkey").cast("double")
        corner = F.col("seq")
        return (
            self.county.withColumn("seq", F.explode(F.sequence(F.lit(1), F.lit(4))))
            .select(
                "state",
                "county",
                F.col("c_custkey").alias("group"),
                "seq",
                (key + F.when(corner.isin(2, 3), 1.0).otherwise(0.0)).alias("long"),
                (key * 2 + F.when(corner >= 3, 1.0).otherwise(0.0)).alias("lat"),
            )
        )

"""Queries that read and write files."""

from __future__ import annotations

from pyspark.sql import functions as F

from headroom.queries.region_queries import REGION, RESULT_TWIN, clusters_wide, result
from headroom.queries.registry import half_up_sql, query, rounded
from headroom.queries.warehouse import FEATURE_NAMES, PRACTICE_AREAS
from headroom.sources.readers import coerce_numeric, read_delimited
from headroom.sources.shared import cut_lineage, new_path
from headroom.sources.writers import export_csv, read_extract, save_extract

TEXT_SQL = """SELECT o_orderkey, CASE o_orderkey % 7 WHEN 0 THEN NULL WHEN 1 THEN NULL
      WHEN 2 THEN NULL ELSE o_totalprice END AS o_totalprice"""


def price_text(w):
    """Orders with the price as text and three kinds of NA marker."""
    tag = F.col("o_orderkey") % 7
    price = (
        F.when(tag == 0, "NULL")
        .when(tag == 1, "#N/A")
        .when(tag == 2, "-")
        .otherwise(F.col("o_totalprice").cast("decimal(18,2)").cast("string"))
    )
    return w.table("orders").select("o_orderkey", price.alias("o_totalprice"), "o_orderstatus")


@query("read_na_tokens", f"{TEXT_SQL}, o_orderstatus FROM orders")
def read_na_tokens(w):
    path = new_path(w.spark, "orders-text")
    price_text(w).write.option("header", True).csv(path)
    types = {"o_orderkey": "bigint", "o_totalprice": "double", "o_orderstatus": "string"}
    return read_delimited(w.spark, path, types)


@query("repair_types", f"{TEXT_SQL} FROM orders")
def repair_types(w):
    return coerce_numeric(price_text(w).select("o_orderkey", "o_totalprice"), ["o_totalprice"])


def result_with_features(w):
    """The result with the features that its clusters were made from."""
    return result(w).join(w.regions.select(*REGION, *FEATURE_NAMES), REGION, "left")


def read_back(w, path, rows):
    types = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    return read_delimited(w.spark, path, types, na=())


FEATURES_TWIN = ", ".join(f"{half_up_sql(f)} AS {f}" for f in FEATURE_NAMES)


@query(
    "export_county_csv",
    f"""SELECT r.*, {FEATURES_TWIN} FROM ({RESULT_TWIN}) r LEFT JOIN features f
      ON f.state = r.state AND f.county = r.county""",
)
def export_county_csv(w):
    """Written as CSV, unrounded, and read back with the same types."""
    rows = result_with_features(w)
    path = export_csv(rows, new_path(w.spark, "export"), "all")
    return rounded(read_back(w, path, rows), half_up=True)


@query("export_without_features", RESULT_TWIN)
def export_without_features(w):
    """The same rows less the chosen features."""
    rows = result_with_features(w)
    path = export_csv(rows, new_path(w.spark, "export"), "DUI & DWI", drop=FEATURE_NAMES)
    return rounded(read_back(w, path, rows.drop(*FEATURE_NAMES)), half_up=True)


@query(
    "materialize_extract",
    f"""SELECT state, county, pa, cluster, total, {half_up_sql("potential_total")} AS potential_total,
      {half_up_sql("acv")} AS acv FROM county_clusters""",
)
def materialize_extract(w):
    """Written once and read back through its manifest."""
    path = new_path(w.spark, "county-clusters")
    save_extract(clusters_wide(w), path, "pa", PRACTICE_AREAS)
    cols = [*REGION, "pa", "cluster", "total", "potential_total", "acv"]
    return rounded(read_extract(w.spark, path).select(*cols), half_up=True)


@query(
    "extract_manifest",
    f"""SELECT pa, count(*) AS n, {half_up_sql("sum(total)")} AS total, {half_up_sql("sum(acv)", 2)} AS acv
    FROM county_clusters GROUP BY pa""",
)
def extract_manifest(w):
    """Rows and sums of each practice area, counted while the extract is written; one area is written twice."""
    path, measures = new_path(w.spark, "county-clusters"), ["total", "acv"]
    rows = cut_lineage(clusters_wide(w).select("state", "county", "pa", *measures), "extract-rows")
    first = PRACTICE_AREAS[0]
    save_extract(rows.where(F.col("pa") == first).limit(1), path, "pa", [first], measures)
    manifest = save_extract(rows, path, "pa", PRACTICE_AREAS, measures)
    total = F.floor(F.col("total") * 1e4 + 0.5) / 1e4
    return manifest.select("pa", "n", total.alias("total"), (F.floor(F.col("acv") * 100 + 0.5) / 100).alias("acv"))

"""Tables that are stored for several readers: bitmaps, tables kept by key, extracts with a manifest."""

import time

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from headroom.operators import bitmaps as B
from headroom.operators import joins as J
from headroom.plans import contacts as K
from headroom.queries import region_queries
from headroom.queries.report_queries import keyed_market_totals
from headroom.queries.warehouse import Warehouse
from headroom.sources import shared, writers


def visits(spark, n=40_000):
    """A value with a third of the rows, a group with a third of them, nulls, and gaps in the values."""
    i = F.col("id")
    value = F.when(i % 3 == 0, "hot").when(i % 101 == 0, F.lit(None)).otherwise(F.concat(F.lit("v"), F.pmod(F.xxhash64("id"), F.lit(9000))))
    return spark.range(n).select(
        F.when(i % 3 == 1, "big").otherwise(F.concat(F.lit("g"), i % 17)).alias("g"), (i % 5).alias("d"), value.alias("s")
    )


def test_bitmaps_count_what_count_distinct_counts(spark):
    df = visits(spark)
    groupings = (["g", "d"], ["g"], ["d"], [])
    bitmaps = shared.cut_lineage(B.value_bitmaps(df, ["g", "d"], "s"), "test-bitmaps")
    got = {(r.grouping, r.g, r.d): r.n for r in B.count_values(bitmaps, groupings, "n").collect()}
    want = {}
    for i, keys in enumerate(groupings):
        for r in df.groupBy(*keys).agg(F.countDistinct("s").alias("n")).collect():
            want[i, r.g if "g" in keys else None, r.d if "d" in keys else None] = r.n
    assert got == want


def test_values_are_numbered_densely_over_parts(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = B.dense_numbers(visits(spark, 5_000), "s").orderBy("number").collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert [r.number for r in rows] == list(range(len(rows))) and [r.s for r in rows] == sorted(r.s for r in rows)
    assert B.count_values(B.value_bitmaps(visits(spark, 0), ["g"], "s"), [["g"]], "n").count() == 0


def test_join_split_is_a_join(spark):
    left = visits(spark, 5_000)
    right = left.where("s IS NOT NULL").groupBy("s").agg(F.count("*").alias("times"), F.max("d").alias("m"))
    right = shared.cut_lineage(right.where("s <> 'v7'"), "test-join")
    got = sorted(map(tuple, J.join_split(left, right, "s", "times").select("s", "g", "d", "m").collect()))
    assert got == sorted(map(tuple, left.join(right.drop("times"), "s").select("s", "g", "d", "m").collect()))


def exchanges(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_keyed_tables_need_no_exchange_on_their_key(spark, folder):
    cols = ["statecounty", "event_day", "pt", "rt", "pv", "sl_acv", "da_acv"]
    rows = Warehouse(spark, folder).ad_performance_daily.select(*cols)
    keyed = shared.keyed_table(rows, ["statecounty"], ["event_day"])
    assert exchanges(keyed_market_totals(keyed)) == 0
    eligible = K.market_eligibility(keyed, "sl_acv")
    kept = keyed.join(eligible, "statecounty", "left_semi")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = kept.groupBy("statecounty").agg(F.count("*").alias("n"))
        # Only the cells below a market's days are dealt by more than the market.
        assert exchanges(plan) <= 1
        pair = keyed.alias("a").join(keyed.alias("b").groupBy("statecounty").agg(F.max("pv").alias("most")), "statecounty")
        assert exchanges(pair) == 0
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    want = sorted(map(tuple, rows.groupBy("statecounty").count().collect()))
    assert sorted(map(tuple, keyed.groupBy("statecounty").count().collect())) == want


def extract_rows(spark, rows):
    return spark.createDataFrame(rows, "area string, x double, name string")


def test_a_second_run_replaces_only_its_parts(spark):
    path = shared.new_path(spark, "test-extract")
    first = extract_rows(spark, [("a", 1.0, "p"), ("a", 2.0, "q"), ("b c/d", 5.0, "r")])
    manifest = writers.save_extract(first, path, "area", ["a", "b c/d", "none"], ["x"])
    assert {r.area: (r.n, r.x) for r in manifest.collect()} == {"a": (2, 3.0), "b c/d": (1, 5.0), "none": (0, None)}
    assert sorted(map(tuple, writers.read_extract(spark, path).collect())) == sorted(map(tuple, first.collect()))
    manifest = writers.save_extract(extract_rows(spark, [("a", 7.0, "new")]), path, "area", ["a"], ["x"])
    assert {r.area: r.n for r in manifest.collect()} == {"a": 1, "b c/d": 1, "none": 0}
    assert sorted(map(tuple, writers.read_extract(spark, path).collect())) == [("a", 7.0, "new"), ("b c/d", 5.0, "r")]


def test_a_failed_run_leaves_what_was_there(spark):
    path = shared.new_path(spark, "test-extract")
    rows = extract_rows(spark, [("a", 1.0, "p")])
    writers.save_extract(rows, path, "area", ["a"])
    with pytest.raises(ValueError):
        writers.save_extract(extract_rows(spark, [("a", 2.0, "p"), ("zz", 1.0, "p")]), path, "area", ["a"])
    assert writers.read_extract(spark, path).collect() == rows.collect()


def test_sheets_read_one_extract(spark, folder, monkeypatch):
    built = []
    original = region_queries.P.county_clusters
    monkeypatch.setattr(region_queries.P, "county_clusters", lambda *a: built.append(1) or original(*a))
    one = region_queries.clusters_wide(Warehouse(spark, folder))
    two = region_queries.clusters_wide(Warehouse(spark, folder))
    assert len(built) <= 1 and one.columns == two.columns
    assert sorted(map(str, one.collect())) == sorted(map(str, two.collect()))


def test_exact_sums_keep_nan_and_general_sums_keep_digits(spark):
    from headroom.operators import grouping as G

    df = spark.createDataFrame([("m", "a", 0.00004)] * 1000 + [("m", "b", float("nan")), ("m", "b", 1.0), ("m", "c", None)], "p string, k string, v double")
    got = {r.k: r.v for r in G.sum_then_mean(df, "p", ["k"], ["v"]).collect()}
    assert got["a"] == pytest.approx(0.04) and got["b"] != got["b"] and got["c"] is None
    exact = {r.k: r.v for r in df.groupBy("k").agg(G.exact_sum(F.col("v") * 1e4).alias("v")).collect()}
    assert exact["a"] == 400.0 and exact["b"] != exact["b"] and exact["c"] is None


def shuffle_files(spark):
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {str(files.apply(i)) for i in range(files.size()) if "shuffle_" in str(files.apply(i))}


def test_shuffles_of_a_stored_table_are_dropped(spark):
    before, conf = shuffle_files(spark), spark.conf.get(shared.CLEANUP_CONF, None)
    rows = shared.cut_lineage(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count())
    keyed = shared.keyed_table(spark.range(1000).withColumn("k", F.col("id") % 7), ["k"], buckets=3)
    until = time.time() + 20
    while shuffle_files(spark) - before and time.time() < until:
        time.sleep(0.2)
    assert not shuffle_files(spark) - before
    assert sorted(rows.agg(F.sum("count")).first()) == [1000] and keyed.where("k = 3").count() == 143
    assert spark.conf.get(shared.CLEANUP_CONF, None) == conf


@pytest.mark.parametrize("name", ["semi_in_set", "anti_not_in_set", "union_actual_forecast", "cluster_low_markets", "grouped_ols", "ols_normal_equations", "low_market_refit"])
def test_daily_rows_are_derived_once(spark, folder, name):
    plan = entry.queries()[name](spark, folder)._jdf.queryExecution().optimizedPlan().toString()
    assert "l_orderkey" not in plan


def test_lines_are_dealt_by_customer_once(spark, folder):
    plan = Warehouse(spark, folder).ad_performance_daily._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(c_custkey") <= 2 and "Exchange hashpartitioning(_groupingexpression" not in plan

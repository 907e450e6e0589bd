import pytest
from pyspark.sql import functions as F

from headroom.functions import features as feat
from headroom.functions import scalars as S


def values(spark, rows, schema, *cols):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*cols).collect()]


def test_channel_edges(spark):
    urls = [
        (None,),
        ("https://a/?utm_campaign=brand&utm_campaign=pls",),
        ("https://a/?utm_campaign=pls",),
        ("https://a/?utm_content=sgt",),
        ("https://a/?utmXcampaign=brand",),
        ("https://a/?utm_campaign=adblock",),
        ("",),
    ]
    got = [r[0] for r in values(spark, urls, "u string", S.channel_of(F.col("u")))]
    assert got == ["nonsem", "brand", "pls", "network", "brand", "adblock", "nonsem"]


def test_page_buckets(spark):
    rows = [("Attorney_Profile",), ("Topic_Page",), (None,), ("serp",), ("profile",)]
    got = values(spark, rows, "p string", S.page_bucket(F.col("p")), S.page_bucket_coarse(F.col("p")))
    assert [g[0] for g in got] == ["core", "others", "others", "others", "others"]
    assert [g[1] for g in got] == ["noncore", "noncore", "noncore", "core", "core"]


def test_zip_and_names(spark):
    assert values(spark, [("501",), ("98101",)], "z string", S.zip5(F.col("z"))) == [("00501",), ("98101",)]
    rows = [("King County", "county"), ("Richmond", "city"), ("Seattle", "city")]
    got = values(
        spark, rows, "n string, c string", S.county_name(F.col("n")), S.city_suffixed(F.col("n"), F.col("c"))
    )
    assert got == [("king", "King County"), ("richmond", "Richmond city"), ("seattle", "Seattle")]
    names = values(
        spark, [("Dist. of Columbia",), ("Ohio",)], "s string",
        S.recode(F.col("s"), {"Dist. of Columbia": "District of Columbia"}),
    )
    assert names == [("District of Columbia",), ("Ohio",)]


def test_undefined_ratios_are_zero(spark):
    rows = [(1.0, 0.0), (0.0, 0.0), (None, 2.0), (3.0, 2.0)]
    got = values(spark, rows, "a double, b double", S.safe_ratio(F.col("a"), F.col("b")))
    assert [g[0] for g in got] == [0.0, 0.0, 0.0, 1.5]
    nan = values(spark, [(float("nan"),), (None,), (2.0,)], "a double", S.zero_if_missing(F.col("a")))
    assert [g[0] for g in nan] == [0.0, 0.0, 2.0]


def test_damped_potential(spark):
    rows = [(300.0, 30.0, 60.0), (310.0, 31.0, 62.0), (5.0, 0.0, 10.0), (310.0, 31.0, 31.0)]
    col = S.damped_potential(F.col("acv"), F.col("s"), F.col("p"), 100.0)
    got = [g[0] for g in values(spark, rows, "acv double, s double, p double", col)]
    assert got[0] == 300.0
    assert got[1] == pytest.approx(62 * 10 * (1 - 0.150514997831990))
    assert got[2] == 5.0
    assert got[3] == pytest.approx(310.0)


def test_bins(spark):
    rows = [(-1.0,), (0.0,), (0.39,), (0.4,), (1.99,), (9.0,), (None,)]
    got = values(
        spark, rows, "v double", S.choropleth_bin(F.col("v"), 0.0, 2.0, 5), S.mark_size(F.col("v"), 0.05, 2.0)
    )
    assert [g[0] for g in got] == [1, 1, 1, 2, 5, 5, None]
    assert got[0][1] == 0.0 and got[5][1] == 1.0 and got[6][1] is None


def test_feature_expressions(spark):
    df = feat.plain_columns(spark.createDataFrame([(2.0, 4.0, 0.0)], "`emp.no` double, `pop.total` double, z double"))
    text = "emp.no/pop.total, (emp.no+pop.total)*2 ,emp.no/z,emp.no/(z-z),-emp.no/pop.total/2"
    row = feat.feature_expressions(df.withColumn("k", F.lit(1)), text, ["k"]).collect()[0]
    assert list(row) == [1, 0.5, 12.0, None, None, -0.25]
    assert row.asDict()["emp_no_per_pop_total"] == 0.5


@pytest.mark.parametrize(
    "text", ["unknown", "a; drop", "current_date()", "a'", "system(a)", "`a`", "a/(a", "a as b", "a a", "a(a)", "2 a"]
)
def test_feature_expressions_reject(spark, text):
    df = spark.createDataFrame([(1.0,)], "a double")
    with pytest.raises(Exception):
        feat.feature_expressions(df, text, []).collect()


def test_presets_parse():
    assert set(feat.PRESETS) >= {"Immigration", "DUI & DWI", "Others"}
    for preset in feat.PRESETS.values():
        assert preset.clusters in feat.CLUSTER_CHOICES
        assert all(feat.feature_name(e) for e in feat.split_features(preset.features))

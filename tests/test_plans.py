import datetime as dt

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from headroom.plans import contacts as K
from headroom.plans import potential as P
from headroom.plans import sessions as S
from headroom.queries.warehouse import Warehouse
from headroom.sources import readers, shared, writers

TS = dt.datetime(2024, 1, 5, 12)


def views(spark, rows):
    schema = (
        "event_id long, gmt_timestamp timestamp, event_date date, render_instance_guid string, "
        "persistent_session_id string, session_id string, page_type string, specialty_id int, "
        "location_id long, url string"
    )
    full = []
    for i, r in enumerate(rows):
        ts = TS + dt.timedelta(minutes=r.get("minute", i), days=r.get("day", 0))
        full.append(
            (
                i, ts, ts.date(), r.get("guid", "g"), r.get("persistent", "p"), r.get("session", "s"),
                r.get("page", "Attorney_Profile"), r.get("specialty", 1), r.get("location", 7),
                r.get("url", "https://a"),
            )
        )
    return spark.createDataFrame(full, schema)


def dims(spark):
    market = (
        "ad_market_id int, specialty_id int, ad_region_id int, ad_market_state_name string, "
        "ad_market_county_name string, ad_market_region_name string, ad_market_specialty_name string, "
        "ad_market_block_flag string, ad_market_active_flag string"
    )
    return S.Dimensions(
        spark.createDataFrame([(1, "Tax", "T")], "specialty_id int, specialty_name string, parent_specialty_name string"),
        spark.createDataFrame([(7, 3)], "geo_id long, sales_region_id int"),
        spark.createDataFrame([(5, 1, 3, "WA", "king", "Seattle", "Tax", "N", "Y")], market),
    )


JAN = ("2024-01-01", "2024-01-31")


def count_sessions(spark, rows):
    got = S.sessions_by_market(views(spark, rows), dims(spark), *JAN).collect()
    return {r.page: r.sessions for r in got}


def test_sessions_are_distinct(spark):
    rows = [{"session": "a"}, {"session": "a"}, {"session": "b"}, {"session": "b", "page": "Topic_Page"}]
    assert count_sessions(spark, rows) == {"core": 2, "others": 1}


def test_network_first_touch_drops_the_session(spark):
    rows = [{"url": "https://a/?utm_content=sgt"}, {"url": "https://a"}]
    assert count_sessions(spark, rows) == {}
    assert count_sessions(spark, list(reversed(rows))) == {"core": 1}


def test_view_on_another_day_is_dropped(spark):
    rows = [{"page": "Topic_Page"}, {"day": 1}]
    assert count_sessions(spark, rows) == {"others": 1}


def test_invalid_views_do_not_start_a_session_but_count(spark):
    rows = [{"guid": None, "url": "https://a/?utm_content=sgt", "page": "Topic_Page"}, {}]
    assert count_sessions(spark, rows) == {"core": 1, "others": 1}
    assert count_sessions(spark, [{"persistent": None}]) == {}


def test_unlocated_views_are_dropped(spark):
    assert count_sessions(spark, [{"location": None}, {"specialty": 6}, {"location": 99}]) == {}


def test_equal_times_are_settled_by_channel(spark):
    rows = [{"minute": 0, "url": "https://a"}, {"minute": 0, "url": "https://a/?utm_campaign=pls"}]
    for order in (rows, rows[::-1]):
        assert [r.medium for r in S.first_touch(views(spark, order), *JAN).collect()] == ["pls"]


# --- potential --------------------------------------------------------------------------


def regions(spark, rows):
    return spark.createDataFrame(rows, "state string, county string, cluster int, pop_total double")


def test_potential_sessions_edges(spark):
    base = regions(spark, [("a", str(i), 1, 100.0) for i in range(5)] + [("a", "none", 1, 100.0), ("a", "zero", 2, 0.0)])
    traffic = spark.createDataFrame(
        [("a", str(i), "x", 10.0 * i, 0.0) for i in range(5)] + [("a", "zero", "x", 3.0, 1.0)],
        "state string, county string, pa string, core double, others double",
    )
    joined = P.region_sessions(base, P.traffic_long(traffic, "all"))
    assert joined.where("county = 'none'").collect()[0].pt is None
    got = {(r.county, r.pt): r for r in P.potential_sessions(joined).collect()}
    assert ("none", None) not in got and len(got) == 12
    # five members: the fourth smallest rate (30 / 100) is the target
    assert got[("0", "core")].target_sessions_pp == pytest.approx(0.3)
    assert got[("0", "core")].potential_sessions == pytest.approx(30)
    assert got[("4", "core")].potential_sessions == pytest.approx(40)
    assert got[("zero", "core")].sessions_pp == 0.0


def test_properties_of_the_result(spark, folder):
    result = entry.queries()["county_result"](spark, folder).toPandas()
    assert (result.potential_sessions >= result.sessions - 1e-6).all()
    low = result[result.sessions <= 30]
    assert ((low.potential_acv - low.acv).abs() < 1e-6).all()
    targets = result.groupby(["cluster", "pt"])
    for _, part in targets:
        assert part.target_sessions_pp.nunique() == 1
        assert (part.sessions_pp - part.target_sessions_pp.iloc[0]).abs().min() < 1e-6
    totals = entry.queries()["session_conservation"](spark, folder).toPandas().sessions
    assert totals.nunique() == 1


# --- contacts ---------------------------------------------------------------------------


def test_choose_model_cascade(spark):
    cols = "month string, statecounty string, m1 double, m2 double, m3 double, sl_imps double, " \
        "potential_sl_imps double, sl_contacts double"
    rows = [
        ("01", "first", 1.0, 9.0, 9.0, 1.0, 2.0, 1.0),
        ("01", "second", -1.0, 2.0, 9.0, 1.0, 2.0, 1.0),
        ("01", "third", -1.0, -1.0, 3.0, 1.0, 2.0, 1.0),
        ("01", "ratio", -1.0, -1.0, -1.0, 20.0, 25.0, 4.0),
        ("01", "few", -1.0, -1.0, -1.0, 10.0, 12.0, 4.0),
        ("01", "none", -1.0, -1.0, -1.0, 0.0, 25.0, 4.0),
        ("01", "summed", -1.0, 9.0, 9.0, 1.0, 2.0, 1.0),
        ("01", "summed", 1.5, 9.0, 9.0, 1.0, 2.0, 1.0),
    ]
    out = K.choose_model(spark.createDataFrame(rows, cols), K.SL).collect()
    got = {}
    for r in out:
        got[r.statecounty] = got.get(r.statecounty, 0) + r.potential_sl_contacts
    assert got == pytest.approx(
        {"first": 1, "second": 2, "third": 3, "ratio": 25 / 20 * 4 * 0.6, "few": 0, "none": 0, "summed": 0.5}
    )


def market(name, days, pts, rts):
    return [(name, dt.date(2024, 1, 1 + d), pts[d % len(pts)], rts[d % len(rts)], 1.0) for d in range(days)]


def test_eligibility_thresholds(spark):
    rows = (
        market("ok", 5, ["a", "b"], ["d", "m"])
        + market("few_days", 4, ["a", "b"], ["d", "m"])
        + market("one_page", 6, ["a"], ["d", "m"])
        + market("one_device", 6, ["a", "b"], ["d"])
    )
    df = spark.createDataFrame(rows, "statecounty string, event_day date, pt string, rt string, sl_acv double")
    assert [r.statecounty for r in K.market_eligibility(df, "sl_acv").collect()] == ["ok"]
    assert {r.statecounty for r in K.active_days(df, "sl_acv").collect()} == {"ok", "one_page", "one_device"}


def test_outlier_rules(spark):
    day = dt.date(2024, 1, 28)
    cols = "statecounty string, event_day date, da_contacts double, potential_da_contacts double, " \
        "da_imps double, potential_da_imps double"
    rows = [
        ("jump", day, 11.0, 23.0, 10.0, 19.0),
        ("faster", day, 4.0, 6.0, 10.0, 11.0),
        ("triple", day, 0.0, 6.0, 0.0, 5.0),
        ("calm", day, 10.0, 11.0, 10.0, 12.0),
        ("small", day, 1.0, 4.0, 10.0, 10.0),
        ("old", day - dt.timedelta(days=28), 0.0, 60.0, 1.0, 1.0),
    ]
    df = spark.createDataFrame(rows, cols)
    flagged = {r.statecounty for r in K.outlier_markets(df, K.DA, "2024-01-28").collect()}
    assert flagged == {"jump", "faster", "triple"}
    redone = {r.statecounty: r.potential_da_contacts for r in K.redo_outliers(df, K.DA, "2024-01-28").collect()}
    assert redone["jump"] == pytest.approx(19 / 10 * 11 * 0.7)
    assert redone["triple"] == 0.0 and redone["calm"] == 11.0 and len(redone) == 6


def test_forecast_rows(spark):
    history = spark.createDataFrame(
        [("a", "x", "d", "serp", 0, dt.date(2024, 1, 1))] * 2,
        "state string, county string, rt string, pt string, weekend int, event_day date",
    )
    potentials = spark.createDataFrame(
        [("a", "x", 30.0, 9.0)], "state string, county string, potential_sl_imps double, potential_da_imps double"
    )
    got = K.forecast_rows(history, potentials, "2024-02-01").collect()
    assert len(got) == 1 and got[0].pv == 10.0 and got[0].sl_imps == 0.0


# --- sources ----------------------------------------------------------------------------


def test_na_tokens(spark):
    path = shared.new_path(spark, "na")
    rows = [("1", "2.5"), ("2", "NULL"), ("3", "#N/A"), ("4", "-"), ("5", "junk"), ("6", " 7 "), ("7", "-3")]
    spark.createDataFrame(rows, "k string, v string").write.option("header", True).csv(path)
    got = readers.read_delimited(spark, path, {"k": "int", "v": "double"}).orderBy("k").collect()
    assert [r.v for r in got] == [2.5, None, None, None, None, 7.0, -3.0]


def test_export_is_headered_and_unquoted(spark):
    df = spark.createDataFrame([("a b", 'say "x"', 1)], "n string, q string, f int")
    path = writers.export_csv(df, shared.new_path(spark, "out"), "Real Estate", drop=["f"])
    assert path.endswith("/Real_Estate_counties.csv")
    lines = [r.value for r in spark.read.text(path).collect()]
    # every part file has the header
    assert set(lines) == {"n,q", 'a b,say "x"'} and lines.count('a b,say "x"') == 1


def test_shared_folder_comes_from_the_session():
    """The cluster's setting, and without one the warehouse: never a folder of this machine's own choice."""

    class Conf(dict):
        def get(self, key, default=None):
            return super().get(key, default)

    class Context:
        def __init__(self, conf):
            self.conf = conf

        def getConf(self):
            return self.conf

        def getCheckpointDir(self):
            return None

    class Session:
        def __init__(self, **settings):
            self.conf = Conf({k.replace("_", "."): v for k, v in settings.items()})
            self.sparkContext = Context(self.conf)

    warehouse = "hdfs://x/warehouse"
    both = Session(spark_checkpoint_dir="hdfs://x/check/", spark_sql_warehouse_dir=warehouse)
    assert shared.shared_dir(both) == "hdfs://x/check"
    assert shared.shared_dir(Session(spark_sql_warehouse_dir=warehouse)) == warehouse


# --- plan shapes ------------------------------------------------------------------------


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_scan_is_pruned_and_pushed_down(spark, folder):
    text = plan_of(entry.queries()["scan_pageviews"](spark, folder))
    assert "PushedFilters: [IsNotNull(ts)" in text and "GreaterThanOrEqual(ts" in text
    assert "value" not in text.split("ReadSchema")[1]


def test_dimensions_are_broadcast_and_first_touch_is_hashed(spark, folder):
    text = plan_of(entry.queries()["sessions_by_market"](spark, folder))
    assert text.count("BroadcastHashJoin") >= 3
    assert "SortAggregate" not in text and "Window" not in text


def test_standardizing_reuses_the_shuffle(spark, folder):
    df = Warehouse(spark, folder).regions
    df.collect()
    assert "ReusedExchange" in plan_of(df)

import statistics
from decimal import ROUND_HALF_EVEN, Decimal

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from headroom.operators import clustering as C
from headroom.operators import grouping as G
from headroom.operators import joins as J
from headroom.operators import numbering as N
from headroom.operators import quantile as Q
from headroom.operators import regression as R
from headroom.operators import reshape as RS


def nearest(values, p="0.7"):
    """Nearest order statistic, ties to the even rank, at least the first."""
    rank = int((Decimal(len(values)) * Decimal(p)).quantize(Decimal(1), ROUND_HALF_EVEN))
    return sorted(values)[max(rank, 1) - 1]


def test_quantile_of_small_groups(spark):
    rng = np.random.default_rng(1)
    data = {n: [float(v) for v in rng.integers(0, 30, n)] for n in range(1, 41)}
    rows = [(n, v) for n, vs in data.items() for v in vs] + [(7, None), (7, float("nan"))]
    df = spark.createDataFrame(rows, "g int, v double")
    got = {r.g: r.q for r in Q.group_quantile(df, ["g"], "v", "0.7", "q").collect()}
    assert got == {n: nearest(vs) for n, vs in data.items()}


def test_rank_examples(spark):
    rows = [(n,) for n in (1, 2, 5, 15)]
    got = spark.createDataFrame(rows, "n long").select(Q.nearest_rank(F.col("n"), "0.7")).collect()
    assert [r[0] for r in got] == [1, 1, 4, 10]


def test_quantile_of_large_skewed_groups(spark):
    """One group holds most rows, another is one value, a third has long tails and ties."""
    n = 120_000
    df = spark.range(n).select(
        F.when(F.col("id") % 10 < 7, "hot").when(F.col("id") % 10 == 7, "same").otherwise("tail").alias("g"),
        F.when(F.col("id") % 10 < 7, F.pmod(F.xxhash64("id"), F.lit(1_000_003)) / 7.0)
        .when(F.col("id") % 10 == 7, 5.0)
        .otherwise(F.pow(F.lit(10.0), F.pmod(F.xxhash64("id"), F.lit(9))))
        .alias("v"),
    )
    pdf = df.toPandas()
    q = Q.group_quantile(df, ["g"], "v", "0.7", "q").toPandas().set_index("g")["q"]
    m = Q.group_median(df, ["g"], "v", "m").toPandas().set_index("g")["m"]
    for g, part in pdf.groupby("g"):
        assert q[g] == nearest(list(part.v))
        assert m[g] == pytest.approx(statistics.median(part.v))


def test_quantile_over_many_parts(spark):
    """A group dealt over several parts, with a value that holds a third of its rows."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        v = F.when(F.col("id") % 3 == 0, 777.0).otherwise(F.pmod(F.xxhash64("id"), F.lit(5000)) / 3.0)
        df = spark.range(30_000).select(F.lit(1).alias("g"), v.alias("v"))
        values = sorted(r.v for r in df.collect())
        for rank in (1, 10, 9_000, 15_000, 29_999, 30_000):
            at = F.lit(rank).cast("long")
            assert Q.order_statistic(df, ["g"], "v", at, at, "q").first().q == values[rank - 1]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_numbers_within_groups_over_many_parts(spark):
    """A group and a single day of it hold most rows, and many rows are equal: all of them lie in several parts."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = [("hot", min(d, 3), i % 7) for d in range(30) for i in range(20)] + [("b", 1, 1), ("b", 0, 9), (None, 5, 5), (None, None, 1)]
        df = spark.createDataFrame(rows, "g string, d int, i int").repartition(5)
        got = N.number_rows(df, ["g"], ["d", "i"], "num", "size")
        assert got.columns == ["g", "d", "i", "num", "size"]
        by: dict = {}
        for r in got.collect():
            by.setdefault(r.g, []).append((r.num, r.d is not None, r.d or 0, r.i, r["size"]))
        for g, found in by.items():
            found.sort()
            assert [x[0] for x in found] == list(range(1, len(found) + 1)) and {x[4] for x in found} == {len(found)}
            assert [x[1:4] for x in found] == sorted(x[1:4] for x in found)
            assert len(found) == sum(r[0] == g for r in rows)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_hot_group_is_numbered_in_parts(spark):
    """No task of the plan sees more than a part of the group that holds a third of the rows, nor of its one hot day."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.range(60_000).select(F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id") % 500).alias("g"), F.lit(1).alias("d"))
        parts = N.in_parts(df, ["g"], ["d"]).groupBy(N.PART).agg(F.count("*").alias("n"), F.count_if(F.col("g") == -1).alias("hot")).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sum(r.n for r in parts) == 60_000 and sum(r.hot > 0 for r in parts) > 1
    assert max(r.n for r in parts) < 60_000 / 3


def test_quantile_of_extreme_values(spark):
    values = [0.0, -0.0, 5e-324, -5e-324, 1e-310, 1.0, 1.0 + 2**-52, 1.0 - 2**-53, -1.0, 1e300, 1.7e308, -1.7e308, 2.0**980, 2.0**981, float("inf"), float("-inf")]
    rng = np.random.default_rng(2)
    values += (rng.standard_normal(300) * 10.0 ** rng.integers(-300, 300, 300)).tolist() + [3.3] * 50
    values += [float(np.nextafter(7.0, x)) for x in (0, 7, 8)]
    df = spark.createDataFrame([(1, v) for v in values], "g int, v double").repartition(4)
    want = sorted(v + 0.0 for v in values)
    for rank in range(1, len(want) + 1, 11):
        at = F.lit(rank).cast("long")
        assert Q.order_statistic(df, ["g"], "v", at, at, "q").first().q == want[rank - 1]
    assert Q.column_medians(df, ["v"])["v"] == pytest.approx(float(np.median(want)), rel=1e-15)
    split = np.array(Q.split_array(np.array(want)))
    assert [Q.whole(x) for x in split.T.tolist()] == want
    both = df.select(*[c.alias(n) for n, c in Q.digits(F.col("v")).items()], "v").collect()
    by_digits = [r.v for r in sorted((r for r in both if abs(r.v) < np.inf), key=lambda r: (r._d1, r._d2, r._d3))]
    assert by_digits == sorted(by_digits)
    for r in both:
        assert [r._d1, r._d2] == [x.tolist()[0] for x in Q.split_array(np.array([r.v]))[:2]]


def test_quantile_counts_rows_by_times_and_deals_nothing_by_range(spark):
    df = spark.createDataFrame([("a", 1.0, 5), ("a", 2.0, 4), ("b", 9.0, 1), (None, 1.0, 3)], "g string, v double, c int")
    got = Q.group_median(df, ["g"], "v", "m", times="c")
    assert {r.g: r.m for r in got.collect()} == {"a": 1.0, "b": 9.0}
    plan = got._jdf.queryExecution().toString()
    assert "rangepartitioning" not in plan.lower()


@pytest.mark.parametrize("n", [10, 5000])
def test_names_are_one_row_per_group(spark, n):
    names = [f"c{i:04d}" for i in range(n)]
    df = spark.createDataFrame([(1, x) for x in names] * 2 + [(2, "only")], "cluster int, county string")
    long = G.names_per_group(df, ["cluster"], "county")
    assert long.count() == n + 1
    got = {r.cluster: r.counties for r in G.joined_names(long, ["cluster"], "county", "counties").collect()}
    assert got == {1: ",".join(names), 2: "only"}


def test_weighted_mean_switch(spark):
    df = spark.createDataFrame([(1, 10.0, 1.0), (1, None, 3.0), (2, 5.0, 0.0)], "g int, x double, w double")
    zero = G.rollup_with_rates(df, ["g"], ["w"], {"x": "w"}).orderBy("g").collect()
    skip = G.rollup_with_rates(df, ["g"], ["w"], {"x": "w"}, na_as_zero=False).orderBy("g").collect()
    assert [r.x for r in zero] == [2.5, 0.0] and [r.x for r in skip] == [10.0, 0.0]


def test_column_profile(spark):
    pdf = pd.DataFrame({"a": [1.0, 2.0, 2.0, None], "b": [4.0, 4.0, 4.0, 4.0]})
    df = spark.createDataFrame([(1.0, 4.0), (2.0, 4.0), (2.0, 4.0), (None, 4.0)], "a double, b double")
    got = G.column_profile(df, ["a", "b"]).toPandas().set_index("measure")
    for c in "ab":
        assert got.loc[c, "sum"] == pdf[c].sum() and got.loc[c, "median"] == pdf[c].median()
        assert got.loc[c, "var"] == pytest.approx(pdf[c].var())
        assert got.loc[c, "n"] == pdf[c].count() and got.loc[c, "distinct_n"] == pdf[c].nunique()


def test_sum_then_mean_uses_existing_months(spark):
    df = spark.createDataFrame([("01", "a", 1.0), ("01", "a", 2.0), ("03", "a", 6.0)], "m string, k string, v double")
    assert [tuple(r) for r in G.sum_then_mean(df, "m", ["k"], ["v"]).collect()] == [("a", 4.5)]


def test_rename_table_and_patterns(spark):
    df = spark.createDataFrame([(1, 2, 3)], "a int, anc_x int, x int")
    table = spark.createDataFrame([("a", "b"), ("zz", "q")], "old string, new string")
    assert RS.rename_by_table(df, table, "old", "new").columns == ["b", "anc_x", "x"]
    assert RS.drop_by_pattern(df, ["^anc"]).columns == ["a"]
    twice = spark.createDataFrame([("a", "b"), ("a", "c")], "old string, new string")
    with pytest.raises(ValueError):
        RS.rename_by_table(df, twice, "old", "new")


def test_keep_both_is_a_full_outer_join(spark):
    many = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (None, "d")], "k int, x string")
    one = spark.createDataFrame([(1, "one"), (3, "three"), (None, "none")], "k int, y string")
    got = sorted(map(tuple, J.keep_both(many, one, ["k"]).select("k", "x", "y").collect()), key=str)
    want = sorted(map(tuple, many.join(one, "k", "full_outer").select("k", "x", "y").collect()), key=str)
    assert got == want


# --- clustering -------------------------------------------------------------------------


def blobs(spark):
    rng = np.random.default_rng(3)
    rows = []
    for c, (x, y) in enumerate([(0, 0), (50, 0), (0, 50)]):
        rows += [(f"s{c}", f"c{c}_{i}", float(x + rng.normal()), float(y + rng.normal())) for i in range(30)]
    rows += [("s9", "far1", 900.0, 900.0), ("s9", "far2", 905.0, 905.0)]
    return spark.createDataFrame(rows, "state string, county string, x double, y double")


def test_kmeans_gives_up_tiny_clusters(spark):
    df = blobs(spark)
    rows, centers = C.cluster_regions(df, ["state", "county"], ["x", "y"], k=4, min_members=4)
    sizes = {r.cluster: r.regions for r in C.cluster_sizes(rows).collect()}
    assert rows.count() == 92 and min(sizes.values()) >= 4
    assert sorted(sizes) == list(range(1, len(sizes) + 1))
    assert centers.count() == len(sizes)
    again, _ = C.cluster_regions(df, ["state", "county"], ["x", "y"], k=4, min_members=4)
    assert rows.select("county", "cluster").exceptAll(again.select("county", "cluster")).count() == 0


def test_assign_ties_and_limits(spark):
    df = spark.createDataFrame([(0.0,), (9.0,)], "x double")
    got = C.assign_nearest(df, ["x"], [[-1.0], [1.0], [8.0]]).orderBy("x").collect()
    assert [r.cluster for r in got] == [1, 3]
    with pytest.raises(ValueError):
        C.assign_nearest(df, ["x"], [])


def test_standardize_constant_feature(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "a double, b double")
    got = sorted(tuple(r) for r in C.standardize(df, ["a", "b"]).collect())
    assert got == [(pytest.approx(-(0.5**0.5)), 0.0), (pytest.approx(0.5**0.5), 0.0)]


def test_kmeans_does_not_depend_on_partitions(spark):
    df = blobs(spark)
    found = [C.cluster_regions(x, ["state", "county"], ["x", "y"], k=5)[0].select("county", "cluster") for x in (df, df.repartition(7), df.orderBy(F.desc("x")))]
    rows = [sorted(map(tuple, f.collect())) for f in found]
    assert rows[0] == rows[1] == rows[2]


def test_kmeans_lowers_the_cost_of_its_seeds(spark):
    points, cols = C.scaled_points(blobs(spark), ["x", "y"])
    text = F.concat_ws("|", "state", "county")
    seeds = C.seeded_centers(points, text, cols, 4, 3, 1)
    assert [len({tuple(c) for c in s}) for s in seeds] == [4, 4, 4]
    at = np.array([[r[c] for c in cols] for r in points.collect()])
    cost = lambda centers: ((at[:, None] - np.array(centers)) ** 2).sum(axis=2).min(axis=1).sum()
    before = min(cost(s) for s in seeds)
    centers, sizes = C.lloyd(points, cols, [list(s) for s in seeds], 20)
    assert cost(centers) <= before and sum(sizes.values()) == len(at)
    near = ((at[:, None] - np.array(centers)) ** 2).sum(axis=2).argmin(axis=1)
    for i, center in enumerate(centers):
        np.testing.assert_allclose(at[near == i].mean(axis=0), center, atol=1e-9)


def plain_linkage(points):
    """Complete linkage by its definition: in each step the closest pair of clusters."""
    distance = np.sqrt(((points[:, None] - points[None]) ** 2).sum(axis=2))
    clusters, out = {i: [i] for i in range(len(points))}, []
    while len(clusters) > 1:
        height, a, b = min((distance[np.ix_(clusters[a], clusters[b])].max(), a, b) for a in clusters for b in clusters if a < b)
        clusters[a] += clusters.pop(b)
        out.append((a, b, height))
    return out


@pytest.mark.parametrize("n", [1, 2, 3, 40])
def test_complete_linkage_is_that_of_closest_pairs(n):
    points = np.random.default_rng(n).standard_normal((n, 3))
    got, want = C.complete_linkage(points), plain_linkage(points)
    assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in want]
    np.testing.assert_allclose([h for *_, h in got], [h for *_, h in want])


def test_hierarchical_separates_blobs_at_any_resolution(spark):
    df = blobs(spark).where("state <> 's9'")
    for most in (C.MICRO, 30):
        got = C.hierarchical_regions(df, ["x", "y"], k=3, most=most).toPandas()
        assert len(got) == 90 and got.groupby("state").cluster.nunique().max() == 1 and got.cluster.nunique() == 3
    merges = C.hierarchical_merges(df, F.col("county"), ["x", "y"]).orderBy("step").collect()
    assert len(merges) == 89 and merges[-1].members == 90
    assert [m.height for m in merges] == sorted(m.height for m in merges)
    points, cols = C.scaled_points(df, ["x", "y"])
    cell, cells, means = C.micro_clusters(points, cols, 30)
    assert 3 <= len(cells) <= 30 and sum(c["n"] for c in cells) == 90
    by_cell = points.groupBy(cell.alias("c")).agg(*[F.avg(c).alias(c) for c in cols]).collect()
    np.testing.assert_allclose(sorted([r[c] for c in cols] for r in by_cell), sorted(means.tolist()), atol=1e-9)


def test_split_groups_keep_their_least_size(spark):
    rng = np.random.default_rng(8)
    rows = [(f"m{i:03d}", float(rng.integers(0, 6)), float(rng.normal()), None) for i in range(101)]
    df = spark.createDataFrame(rows, "m string, a double, b double, c double")
    got = C.split_groups(df, ["m"], ["a", "b", "c"], 8, 4).toPandas()
    sizes = got.groupby("cluster").size()
    assert sorted(got.m) == [r[0] for r in rows] and sizes.min() >= 4 and sorted(sizes.index) == list(range(1, len(sizes) + 1))
    assert 4 <= len(sizes) <= 8
    few = C.split_groups(df.limit(3), ["m"], ["a"], 8, 4).collect()
    assert [r.cluster for r in few] == [1, 1, 1] and C.split_groups(df.limit(0), ["m"], ["a"], 8, 4).count() == 0


# --- regression -------------------------------------------------------------------------


def daily(n=400, seed=5):
    rng = np.random.default_rng(seed)
    pv = rng.uniform(5, 60, n)
    return pd.DataFrame(
        {
            "g": rng.choice(["u", "v"], n, p=[0.8, 0.2]),
            "pt": rng.choice(["serp", "profile", "other"], n),
            "rt": rng.choice(["desktop", "mobile"], n),
            "weekend": rng.integers(0, 2, n),
            "a": pv**0.3,
            "b": (pv * rng.uniform(0.9, 1, n)) ** 0.3,
            "y": rng.poisson(2, n).astype(float),
        }
    ).assign(bp=lambda d: d.b * 1.069)


def dense_design(d, b, factors, levels):
    a, bb, w = d.a.to_numpy(), d[b].to_numpy(), d.weekend.to_numpy()
    base = np.stack([np.ones(len(d)), a, bb, w, a * w, bb * w], axis=1)
    parts = [base]
    for f in factors:
        for level in sorted(levels[f])[1:]:
            parts.append(base * (d[f] == level).to_numpy()[:, None])
    return np.concatenate(parts, axis=1)


def test_grouped_ols_matches_dense_least_squares(spark):
    pdf = daily()
    out = R.grouped_ols(spark.createDataFrame(pdf), ["g"], "y", "a", "b", "bp", fitted=True).toPandas()
    for model, factors in R.MODELS.items():
        for _, part in out.groupby("g"):
            levels = {f: part[f].unique() for f in factors}
            x, xp = (dense_design(part, b, factors, levels) for b in ("b", "bp"))
            beta = np.linalg.lstsq(x, part.y, rcond=None)[0]
            np.testing.assert_allclose(part[f"{model}_fitted"], x @ beta, atol=1e-6)
            np.testing.assert_allclose(part[model], xp @ beta, atol=1e-6)
            assert abs((part.y - part[f"{model}_fitted"]).sum()) < 1e-6


def test_grouped_ols_rank_deficient(spark):
    """One device, one page type, and a market with two rows: still finite, mean kept."""
    pdf = daily(60).assign(rt="mobile", pt="serp")
    two = daily(2, seed=8).assign(g="tiny", rt="mobile", pt="serp", weekend=0)
    df = spark.createDataFrame(pd.concat([pdf, two]))
    out = R.grouped_ols(df, ["g"], "y", "a", "b", "bp", fitted=True).toPandas()
    assert len(out) == 62 and np.isfinite(out[["m1", "m2", "m3"]].to_numpy()).all()
    gaps = (out.y - out.m1_fitted).groupby(out.g).sum().abs()
    assert gaps.max() < 1e-5


def test_predictions_of_small_markets_are_those_of_minimum_norm(spark):
    """Markets of 7 rows have fewer rows than terms: the fit and the predictions equal a dense lstsq."""
    parts = [daily(7, seed=s).assign(g=f"m{s:03d}") for s in range(40)] + [daily(60, seed=99).assign(g="wide")]
    parts += [daily(7, seed=s).assign(g=f"one{s}", rt="mobile", weekend=0) for s in range(5)]
    pdf = pd.concat(parts)
    out = R.grouped_ols(spark.createDataFrame(pdf), ["g"], "y", "a", "b", "bp", fitted=True).toPandas()
    for model, factors in R.MODELS.items():
        for _, part in out.groupby("g"):
            levels = {f: part[f].unique() for f in factors}
            x, xp = (dense_design(part, b, factors, levels) for b in ("b", "bp"))
            beta = np.linalg.lstsq(x, part.y, rcond=1e-6)[0]
            np.testing.assert_allclose(part[f"{model}_fitted"], x @ beta, atol=1e-6)
            np.testing.assert_allclose(part[model], xp @ beta, atol=1e-6)


def test_factors_merge_in_any_order():
    """Factors of parts, merged in any grouping, have the cross products of all rows, and nothing is squared on the way."""
    rng = np.random.default_rng(6)
    rows = rng.standard_normal((700, 4)) * [1, 1e6, 1e-4, 3]
    codes = rng.integers(0, 40, 700)
    once = R.merge_factors(codes, rows[:, None, :])
    parts = [R.merge_factors(codes[i::7], rows[i::7][:, None, :]) for i in range(7)]
    again = R.merge_factors(np.concatenate([c for c, _ in parts]), np.concatenate([f for _, f in parts]))
    assert once[0].tolist() == again[0].tolist() == sorted(set(codes.tolist()))
    for code, one, two in zip(once[0], once[1], again[1], strict=True):
        cross = rows[codes == code].T @ rows[codes == code]
        for factor in (one, two):
            np.testing.assert_allclose(factor.T @ factor, cross, rtol=1e-10, atol=1e-10 * np.sqrt(np.outer(cross.diagonal(), cross.diagonal())).max())
            assert np.allclose(factor, np.triu(factor))


def test_nearly_collinear_markets_keep_their_digits(spark):
    """A design with condition 1e5: normal equations would leave six digits of the slopes, factors leave ten."""
    rng = np.random.default_rng(7)
    a = rng.uniform(1, 2, 500)
    pdf = pd.DataFrame({"g": "u", "pt": "serp", "rt": "mobile", "weekend": 0, "a": a, "b": a + 1e-5 * rng.standard_normal(500)})
    pdf["y"], pdf["bp"] = 3 + 2 * pdf.a - 5 * pdf.b, pdf.b + 1.0
    out = R.grouped_ols(spark.createDataFrame(pdf).repartition(6), ["g"], "y", "a", "b", "bp", models={"m3": ()}).toPandas()
    np.testing.assert_allclose(out.m3, 3 + 2 * out.a - 5 * out.bp, atol=1e-7)


def test_functions_travel_without_the_package(spark, tmp_path):
    """A session started elsewhere, whose workers can't import the package, still fits."""
    import subprocess
    import sys
    from pathlib import Path

    root = str(Path(R.__file__).resolve().parents[2])
    code = f"""
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
from headroom.operators import regression as R
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
rows = [("g", "p", "r", i % 2, float(i), float(i * i), float(3 * i + 1)) for i in range(20)]
df = spark.createDataFrame(rows, "g string, pt string, rt string, weekend int, a double, b double, y double")
print("rows", R.grouped_ols(df, ["g"], "y", "a", "b", "b").count(), R.grouped_ols(df, ["g"], "y", "a", "b", "b").agg({{"m3": "sum"}}).first()[0] is not None)
"""
    env = {k: v for k, v in __import__("os").environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=240)
    assert "rows 20 True" in done.stdout, done.stderr[-2000:]


def test_design_columns_count(spark):
    levels = {"pt": ["a", "b", "c"], "rt": ["d", "m"]}
    assert len(R.design_columns("a", "b", "w", levels, R.MODELS["m1"])) == 24
    assert len(R.design_columns("a", "b", "w", levels, R.MODELS["m2"])) == 18
    assert len(R.design_columns("a", "b", "w", levels, R.MODELS["m3"])) == 6

import numpy as np
import pytest
from pyspark.sql import functions as F

from headroom.llm import nearest as R


def brute(rows, k, asked):
    rows = sorted({(i, tuple(v)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)})
    best = {}
    for q, a in rows:
        if asked(q):
            found = best.setdefault(q, {})
            for i, b in rows:
                if i != q and len(b) == len(a):
                    found[i] = max(found.get(i, -np.inf), float(np.dot(a, b)))
    return {q: [(i, -s) for s, i in sorted((-s, i) for i, s in found.items())[:k]] for q, found in best.items()}


def search(spark, rows, k=R.K, every=4):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {}
    for r in R.search(df, F.col("vec_id") % every == 0, k).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(got[r.query_id])
    return got


def test_recall_and_order_against_all_pairs(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").collect()]
    got = search(spark, rows, every=20)
    want = brute(rows, R.K, lambda q: q % 20 == 0)
    assert got.keys() == want.keys()
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits >= 0.99 * R.K * len(want)


def test_ties_repeats_nulls_and_dimensions(spark):
    rng = np.random.default_rng(1)
    base = rng.standard_normal(8).astype(np.float32).tolist()
    rows = [(i, base) for i in range(40)] + [(i, rng.standard_normal(8).astype(np.float32).tolist()) for i in range(40, 90)]
    rows += [(5, base), (100, None), (104, [0.0] * 8), (108, [1.0, None] + [0.0] * 6), (112, [float("nan")] * 8), (116, [float("inf")] * 8), (None, base)]
    rows += [(120, [1.0, 2.0]), (121, [2.0, 1.0]), (124, [3.0])]
    got, want = search(spark, rows, k=5), brute(rows, 5, lambda q: q % 4 == 0)
    want = {q: near for q, near in want.items() if near}
    assert {q: [i for i, _ in near] for q, near in got.items()} == {q: [i for i, _ in near] for q, near in want.items()}
    assert all(np.allclose([s for _, s in got[q]], [s for _, s in want[q]], rtol=1e-12) for q in want)


def test_ids_with_several_vectors(spark):
    rng = np.random.default_rng(4)
    rows = [(i % 30, rng.standard_normal(6).tolist()) for i in range(90)] + [(i, rng.standard_normal(4).tolist()) for i in range(12)]
    got, want = search(spark, rows, k=7, every=3), brute(rows, 7, lambda q: q % 3 == 0)
    assert {q: [i for i, _ in near] for q, near in got.items()} == {q: [i for i, _ in near] for q, near in want.items()}
    assert all(len({i for i, _ in near}) == 7 for near in got.values())


def test_clashing_columns_and_a_long_vector(spark):
    rng = np.random.default_rng(5)
    rows = [(i, rng.standard_normal(300).tolist()) for i in range(12)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    names = ("vector", "block", "dimension", "raw", "code", "length", "scale", "query_id", "rank", "score", "pair", "asked", "place")
    wide = df.withColumns({n: F.lit("x") for n in names})
    want = sorted(map(tuple, R.search(df, F.col("vec_id") % 4 == 0, 3).collect()))
    assert len(want) == 9 and sorted(map(tuple, R.search(wide, F.col("vec_id") % 4 == 0, 3).collect())) == want


def test_few_candidates_and_empty(spark):
    assert search(spark, [(0, [1.0, 0.0]), (1, [0.5, 1.0])]) == {0: [(1, 0.5)]}
    assert search(spark, []) == {}


@pytest.mark.parametrize("dimension", [3, 64, 700])
def test_bounds_hold_for_nearly_all(dimension):
    rng = np.random.default_rng(dimension)
    data, asked = rng.standard_normal((400, dimension)), rng.standard_normal((30, dimension))
    turn = R.rotations(dimension)
    assert np.allclose(turn[:, :dimension].T @ turn[:, :dimension], np.eye(dimension))
    estimate, off = R.bounds(*R.encode(data, turn), asked, turn)
    assert (np.abs(estimate - asked @ data.T) <= off).mean() > 0.98

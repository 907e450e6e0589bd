import numpy as np
import pytest

from headroom.llm import whitening as W
from headroom.llm.queries import QUERIES

SCHEMA = "vec_id long, embedding array<double>"


def brute(vectors):
    """Whole numbers, deviations, eigenvalues and whitened values by dense algebra in Python integers."""
    x = [[int(np.floor(256 * c)) for c in v] for v in vectors]
    fit = sorted(set(map(tuple, x)))
    n, sums = len(fit), [sum(column) for column in zip(*fit, strict=True)]
    deviation = [sum((n * a - s) ** 2 for a, s in zip(v, sums, strict=True)) for v in x]
    mean = np.array([s / n for s in sums])
    centred = np.array(fit) - mean
    values, columns = np.linalg.eigh(centred.T @ centred / n)
    values, columns = values[::-1], columns[:, ::-1]
    return n, deviation, values, (np.array(x) - mean) @ columns[:, :4] / np.sqrt(values[:4])


def test_the_whole_table_against_dense_algebra(spark):
    folder = "/root/testdata/sf0.01"
    table = spark.read.parquet(f"{folder}/embeddings.parquet").orderBy("vec_id").toPandas()
    n, deviation, values, whitened = brute(table.embedding)
    got = QUERIES["op13_whitening"](spark, folder).orderBy("vec_id", "component").toPandas()
    assert len(got) == 4 * len(table) and (got.n == n).all()
    assert got.deviation.tolist() == np.repeat(deviation, 4).tolist()
    own = got.whitened.to_numpy().reshape(-1, 4)
    np.testing.assert_allclose(own * np.sign((own * whitened).sum(axis=0)), whitened, atol=1e-9)
    np.testing.assert_allclose(got.explained[:4], values[:4] / values.sum(), rtol=1e-10)
    assert got.identity_error.nunique() == 1 and got.identity_error[0] < 1e-10


@pytest.mark.parametrize(
    "spectrum",
    [
        np.r_[9.0, 7, 7, 7, 7, 3, 1, 0.5, 0.1, 0],
        np.ones(12),
        np.r_[1e9, 1, 1e-3, np.zeros(20)],
        np.linspace(1, 2, 60),
        np.r_[5.0, 4, 3, 2, 2 - 1e-9, np.full(30, 1.999)],
        np.r_[3.0, 1],
        np.zeros(5),
    ],
)
def test_components_of_given_spectra(spectrum):
    d = len(spectrum)
    turn = np.linalg.qr(np.random.default_rng(d).standard_normal((d, d)))[0]
    matrix = (turn * spectrum) @ turn.T
    matrix = (matrix + matrix.T) / 2
    values, vectors = W.leading(matrix, 4)
    want = np.sort(spectrum)[::-1][: min(4, d)]
    np.testing.assert_allclose(values, want, atol=1e-13 * max(spectrum.max(), 1))
    np.testing.assert_allclose(vectors.T @ vectors, np.eye(len(want)), atol=1e-12)
    np.testing.assert_allclose(matrix @ vectors, vectors * values, atol=1e-12 * max(spectrum.max(), 1))


def test_inertia_counts(spark):
    rng = np.random.default_rng(3)
    for d in (1, 2, 5, 30):
        for _ in range(20):
            matrix = rng.standard_normal((d, d))
            matrix = matrix + matrix.T
            if rng.random() < 0.5:
                np.fill_diagonal(matrix, 0)
            values = np.linalg.eigvalsh(matrix)
            for shift in rng.uniform(-8, 8, 5):
                assert W.eigenvalues_above(matrix, shift) == (values > shift).sum()


def test_nulls_repeats_lengths_and_low_rank(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.5, 1.0, 0.0, -0.5, 2.0]), (1, [0.5, 1.0, 0.0, -0.5, 2.0]), (None, [1.0, 0.0, 0.25, 0.5, 1.0]), (3, [0.501, 1.0, 0.0, -0.5, 2.0])]
    rows += [(4, None), (5, [1.0, None, 0.0, 0.0, 0.0]), (6, [nan] * 5), (7, [inf] * 5), (8, []), (9, [0.5, 1.0]), (10, [1.5])]
    rows += [(11, [0.0, 0.0, 0.0, 0.0, 0.0])]
    got = W.whiten(spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as x", "2 as n", "3 as whitened")).toPandas()
    five = got[got.vec_id.isin([1, 3, 11]) | got.vec_id.isna()]
    n, deviation, values, _ = brute([r[1] for r in rows if r[0] in (1, 3, 11, None)])
    assert n == 3 and (five.n == n).all() and len(five) == 4 * 5
    assert sorted(set(five.deviation)) == sorted(set(deviation))
    # Three distinct vectors span two dimensions.
    assert five[five.component > 2].whitened.isna().all() and (five[five.component > 2].explained == 0).all()
    assert five[five.component <= 2].whitened.notna().all()
    assert got[got.vec_id == 9].component.tolist() == [1, 2] and got[got.vec_id == 10].explained.isna().all()
    assert not got.vec_id.isin([4, 5, 6, 7, 8]).any()
    assert got.identity_error.max() < 1e-10


def test_values_beyond_64_bits(spark):
    rows = [(1, [1e12, 0.0]), (2, [-1e12, 3.0]), (3, [1e300, 0.5])]
    got = W.whiten(spark.createDataFrame(rows[:2], SCHEMA)).toPandas()
    assert got.deviation.isna().all() and got[got.component == 1].whitened.abs().round(6).tolist() == [1.0, 1.0]
    assert len(W.whiten(spark.createDataFrame(rows, SCHEMA)).collect()) == 6


def test_empty(spark):
    assert W.whiten(spark.createDataFrame([], SCHEMA)).count() == 0
    assert W.whiten(spark.createDataFrame([(1, None)], SCHEMA)).count() == 0

"""Contacts over rows that are kept by market: the same results, without shuffles of the rows."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from headroom.operators import regression as R
from headroom.plans import contacts as K
from headroom.sources import shared

SCHEMA = "statecounty string, month string, event_day date, pt string, rt string, weekend int, pv double, sl_imps double, potential_sl_imps double, sl_contacts double"


def daily(spark, n=400, markets=9, seed=3):
    """Rows of a few markets, with nulls in every column and a market of a single row."""
    rng, rows = random.Random(seed), []
    for i in range(n):
        day = dt.date(2001, rng.randint(1, 3), rng.randint(1, 28))
        row = [f"m{rng.randrange(markets)}", f"{day.month:02d}", day, rng.choice("abc"), rng.choice("de"), int(day.weekday() > 4)]
        row += [rng.gammavariate(2, 9), rng.gammavariate(2, 30), rng.gammavariate(2, 40), float(rng.randrange(6))]
        if i % 7 == 0:
            row[rng.randrange(len(row))] = None
        rows.append(tuple(row))
    rows.append(("alone", "01", dt.date(2001, 1, 2), "a", "d", 0, 4.0, 30.0, 40.0, 2.0))
    return spark.createDataFrame(rows, SCHEMA)


def values(df):
    keys = df.columns
    return sorted((tuple(r[c] for c in keys) for r in df.collect()), key=lambda r: tuple((v is not None, str(v)) for v in r[:10]))


def same(got, want):
    assert len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        assert a[:10] == b[:10]
        for x, y in zip(a[10:], b[10:], strict=True):
            assert x == y if x is None or y is None or isinstance(x, int) else x == pytest.approx(y, rel=1e-7, abs=1e-7)


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange")


def test_groups_fitted_where_they_lie_have_the_same_predictions(spark, monkeypatch):
    monkeypatch.setattr(R, "HELD", 60)
    rows = K.with_roots(daily(spark), K.SL)
    kept = shared.keyed_table(rows, ["statecounty"], buckets=3)
    args = (["statecounty"], "sl_contacts", *K.ROOTS)
    got = R.grouped_ols(kept, *args, fitted=True, together=True)
    assert exchanges(got) == 0
    want = R.grouped_ols(rows, *args, fitted=True)
    assert got.columns == want.columns
    keys = [*rows.columns[:10], *got.columns[len(rows.columns) :]]
    same(values(got.select(*keys)), values(want.select(*keys)))


def test_models_are_chosen_the_same_way_where_rows_lie(spark):
    rows = daily(spark).withColumns({"m1": F.col("sl_contacts") - 3, "m2": 2 - F.col("pv") / 20, "m3": F.lit(-1.0)})
    kept = shared.keyed_table(rows, ["statecounty"], buckets=3)
    got, want = K.choose_model(kept, K.SL, together=True), K.choose_model(rows, K.SL)
    assert exchanges(got) == 0 and {r.use for r in want.select("use").distinct().collect()} > {1, 2}
    same(values(got.select(want.columns)), values(want))


def test_halves_of_a_design_give_the_solution_of_the_whole():
    """Full and deficient ranks, missing cells, and groups without a kind of day."""
    rng = np.random.default_rng(11)
    cells = [(p, r, w) for p in "abc" for r in "de" for w in (0, 1)]
    for turn in range(24):
        keep = [c for c in cells if rng.random() < 0.8 and (turn % 6 or c[2] == turn // 6 % 2)] or cells
        stacks = np.zeros((10, len(keep), 9, 4))
        for each in stacks.reshape(-1, 9, 4):
            n = int(rng.integers(0, 7))
            each[:n] = np.stack([np.ones(n), rng.gamma(2, 1, n), rng.integers(0, 2, n) if turn % 2 else rng.gamma(2, 3, n), rng.poisson(2, n)], axis=1)
        factored = np.linalg.qr(stacks, mode="r")
        week = np.array([c[2] for c in keep], dtype=float)
        for use in ((0, 1), (0,), ()):
            factors = {f: [c[f] for c in keep] for f in use}
            main = np.concatenate([np.ones((len(keep), 1)), *[R._dummies(factors[f]) for f in use]], axis=1)
            want = R.solve_whole(factored, week, main)
            assert np.allclose(R.solve_cells(factored, week, factors, use), want, rtol=1e-6, atol=1e-7 * np.abs(want).max())


def test_rows_added_to_a_kept_table_stay_kept(spark):
    name, rows = shared.keyed_name(), spark.range(100).withColumn("k", F.col("id") % 7)
    shared.keyed_table(rows, ["k"], buckets=3, name=name)
    both = shared.keyed_table(rows.where("id < 10"), ["k"], buckets=3, name=name).groupBy("k").agg(F.count("*").alias("n"))
    assert exchanges(both) == 0
    assert {r.k: r.n for r in both.collect()} == {k: sum(1 + (i < 10) for i in range(100) if i % 7 == k) for k in range(7)}


def test_the_pipeline_moves_its_rows_no_more_than_twice(spark, folder, monkeypatch):
    """By customer and by market; what follows is done where the rows of a market lie."""
    from headroom.queries.contact_queries import pipeline_rows
    from headroom.queries.warehouse import Warehouse

    stored = []
    monkeypatch.setattr(K, "keyed_table", lambda df, *a, **k: stored.append((k.get("dealt", False), df.columns)) or shared.keyed_table(df, *a, **k))
    both = pipeline_rows(Warehouse(spark, folder))
    # What is stored with a shuffle is the pooled markets' rows alone.
    assert [c for dealt, c in stored if not dealt] == [c for dealt, c in stored if not dealt and "cluster" in c]
    assert len([dealt for dealt, _ in stored if dealt]) == 7 and both.count() > 0

import numpy as np

from headroom.llm import toxicity as T


def test_severity_tells_toxic_documents(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    known = labels.where("doc_id % 4 <> 1")
    found = T.predict(docs, T.learn(docs, known)).toPandas()
    held = labels.where("doc_id % 4 = 1").toPandas().merge(found, on="doc_id", suffixes=("_label", ""))
    bad = held.toxic_label == 1
    assert held[bad].severity.mean() > held[~bad].severity.mean() + 0.5
    assert held[~bad].toxic.mean() < 0.03


def test_fit_finds_shared_weights_and_ordered_thresholds():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 2, (3000, 2)).astype(float)
    z = x @ np.array([2.0, -1.0])
    noise = rng.logistic(size=3000)
    grades = ((z + noise) > 0.5).astype(int) + ((z + noise) > 2.5)
    rows, columns = np.nonzero(x)
    weights, thresholds = T.fit(rows, columns, x[rows, columns], grades, 2, steps=1500)
    assert np.allclose(weights, [2, -1], atol=0.3) and np.allclose(thresholds, [0.5, 2.5], atol=0.3)
    assert thresholds[0] < thresholds[1]


def test_nulls_repeats_and_no_labels(spark, make_docs, clash):
    rows = make_docs([(1, None), (2, ""), (3, "bad bad words"), (3, "bad bad words"), (None, "x" * 100_000)])
    schema = "doc_id long, quality int, toxic int"
    for labels in ([], [(1, 1, 0)], [(1, 1, None), (None, 1, 1), (2, 0, 1), (2, 0, 0)]):
        model = T.learn(rows, spark.createDataFrame(labels, schema))
        got = T.predict(clash(rows), model).collect()
        assert len(got) == 5 and {(r.severity, r.grade, r.toxic) for r in got} == {(0.0, 0, False)}
    good = [(i, f"calm text number{i} about weather") for i in range(40)]
    bad = [(100 + i, f"calm text number{i} horrid fool") for i in range(40)]
    docs = make_docs(good + bad + [(500, None), (501, "")])
    labels = spark.createDataFrame([(i, 1, int(i >= 100)) for i, _ in good + bad] * 2, schema)
    found = {r.doc_id: r for r in T.predict(docs, T.learn(docs, labels)).collect()}
    assert all(found[i].toxic == (i >= 100) for i, _ in good + bad)
    assert found[500].severity == found[501].severity < 0.5
    assert T.predict(make_docs([]), T.Ordinal(np.zeros(0, np.int64), np.zeros(0), np.zeros(0))).count() == 0


def plain_severity(model, text):
    """Expected grade of one text, word by word."""
    import re

    import pyarrow as pa

    from headroom.llm.words import words_of

    weight = dict(zip(model.buckets.tolist(), model.weights.tolist(), strict=True))
    times = {}
    for word in re.findall(r"[0-9a-z\x80-￿]+", (text or "").lower()):
        raw = word.encode()
        names = [T.buckets_of(words_of(pa.array([word])).hashes)[0]]
        for size in T.STEMS:
            if len(raw) > size:
                names.append(T.buckets_of(~T.hash_spans(np.frombuffer(raw, np.uint8), np.array([0]), np.array([size])))[0])
        for bucket in names:
            times[int(bucket)] = times.get(int(bucket), 0) + 1
    score = sum((1 + np.log(n)) * weight[b] for b, n in times.items() if b in weight)
    return sum(1 / (1 + np.exp(-(score - t))) for t in model.thresholds)


def test_severity_against_a_plain_sum_over_words(spark):
    folder = "/root/testdata/sf0.001"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    model = T.learn(docs, labels)
    assert len(model.thresholds) == 2 and model.thresholds[0] < model.thresholds[1]
    rows = [(r.doc_id, r.text) for r in docs.limit(60).collect()]
    found = {r.doc_id: r.severity for r in T.predict(docs, model).collect()}
    for doc_id, text in rows:
        assert abs(found[doc_id] - plain_severity(model, text)) < 1e-9


def test_fit_ends_where_the_likelihood_does_not_rise():
    """Ties at the median, and a penalised likelihood that no small step raises."""
    rng = np.random.default_rng(5)
    x = rng.integers(0, 3, (400, 3)).astype(float)
    grades = np.clip((x @ np.array([1.0, 0.5, -1.0]) + rng.logistic(size=400)).round().astype(int), 0, 2)
    rows, columns = np.nonzero(x)
    weights, thresholds = T.fit(rows, columns, x[rows, columns], grades, 3, steps=3000)

    def value(w, t):
        tail = 1 / (1 + np.exp(-((x @ w)[:, None] - t)))
        edge = np.concatenate([np.ones((400, 1)), tail, np.zeros((400, 1))], axis=1)
        return np.log(edge[np.arange(400), grades] - edge[np.arange(400), grades + 1]).mean() - T.RIDGE / 2 * (w**2).sum()

    best = value(weights, thresholds)
    for i in range(3):
        for step in (-0.05, 0.05):
            assert value(weights + step * (np.arange(3) == i), thresholds) < best + 1e-6
    for i in range(2):
        for step in (-0.05, 0.05):
            assert value(weights, thresholds + step * (np.arange(2) == i)) < best + 1e-6

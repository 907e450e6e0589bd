from collections import Counter, defaultdict

from headroom.llm import mixing as M


def test_targets_share_all_words_by_weight(spark):
    sizes = {"a": 10, "b": 500, "c": 40, None: 1000, "d": 0, "é": 300}
    rows = spark.createDataFrame([(k, v) for k, v in sizes.items()], "source string, size long")
    rows = rows.withColumn("source_key", M.source_key(rows.source))
    got = {r.source_key: r.target for r in M.targets(rows).collect()}
    order = sorted(k for k in sizes if k is not None) + [None]
    weight = {k: (5, 2, 1)[i % 3] for i, k in enumerate(order)}
    # Rounds of the definition: cap what is above, share the rest again.
    total, capped = sum(sizes.values()), {}
    while True:
        rest = total - sum(capped.values())
        heavy = sum(w for k, w in weight.items() if k not in capped)
        share = {k: rest * w / heavy for k, w in weight.items() if k not in capped}
        over = [k for k in share if share[k] > 3 * sizes[k]]
        if not over:
            break
        capped |= {k: 3 * sizes[k] for k in over}
    want = capped | share
    for k, v in want.items():
        assert abs(got["null" if k is None else "=" + k] - v) < 1e-9


def test_taken_words_come_near_targets(documents):
    rows = M.mix(documents).collect()
    again = M.mix(documents).collect()
    assert sorted(rows) == sorted(again)
    by = defaultdict(list)
    for r in rows:
        assert 0 <= r.taken <= 3 * r.size and r.taken == r.copies * r.size
        by[r.source].append(r)
    for group in by.values():
        assert group[0].source_size == sum(r.size for r in group)
        assert abs(sum(r.taken for r in group) - group[0].target) <= max(r.size for r in group)


def test_more_budget_keeps_every_document(make_docs):
    rows = [(i, "w " * (1 + i % 7), "en", "ab"[i % 2]) for i in range(200)]
    small = {r.doc_id: r.copies for r in M.mix(make_docs(rows), weights=(1, 3)).collect() if r.source == "a"}
    large = {r.doc_id: r.copies for r in M.mix(make_docs(rows), weights=(1, 2)).collect() if r.source == "a"}
    assert all(large[k] >= n for k, n in small.items()) and sum(large.values()) > sum(small.values())


def test_nulls_repeats_and_empty(make_docs, clash):
    rows = make_docs([(1, None, "en", None), (2, "", "en", "a"), (3, "x  y\tz", "en", "a"), (3, "x  y\tz", "en", "a"), (None, "q", "en", None)])
    got = M.mix(clash(rows)).collect()
    assert Counter(r.size for r in got) == {0: 2, 3: 2, 1: 1}
    assert len({r.copies for r in got if r.doc_id == 3}) == 1
    kept = M.keep_mixed(clash(rows))
    assert kept.columns == clash(rows).columns + ["copies"]
    assert M.mix(make_docs([])).count() == 0 and M.keep_mixed(make_docs([])).count() == 0
    assert M.mix(make_docs([(1, None), (2, "")])).count() == 2


def test_no_document_is_taken_more_often_than_the_cap(spark, make_docs):
    """A source at its cap of three passes, half of it without words: none is taken a fourth time, some not at all elsewhere."""
    rows = [(i, "" if i % 2 else f"word{i} and more", "en", "a") for i in range(200)]
    rows += [(1000 + i, f"text {i} of many words " * 40, "en", "b") for i in range(200)]
    docs = make_docs(rows)
    got = {r.doc_id: r.copies for r in M.keep_mixed(docs).collect()}
    assert max(got.values()) <= M.MAX_COPIES
    assert {got[i] for i in range(200)} == {3}
    want = {r.doc_id: r.copies for r in M.mix(docs).collect() if r.copies}
    assert got == want

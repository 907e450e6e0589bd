import random
from collections import defaultdict

import numpy as np
import pyarrow as pa

from headroom.llm import near_duplicates as N
from headroom.llm.components import components
from tests.llm.test_decontaminate import prose


def brute(texts, known):
    """Classes by exact similarity of all pairs; equal texts are together."""
    shingles, times, bounds = N.weighted(pa.array(texts))
    weights = times * known.inverse(shingles)
    bags = [dict(zip(shingles[a:b].tolist(), weights[a:b].tolist(), strict=True)) for a, b in zip(bounds, bounds[1:], strict=False)]
    parent = list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            shared = sum(min(w, bags[j][s]) for s, w in bags[i].items() if s in bags[j])
            total = sum(bags[i].values()) + sum(bags[j].values()) - shared
            if total and shared / total >= N.SIMILARITY:
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    groups = defaultdict(list)
    for i in range(len(texts)):
        groups[root(i)].append(i)
    return sorted(groups.values())


def corpus():
    rng = random.Random(11)
    texts = []
    for _ in range(40):
        base = prose(rng.randint(8, 200), rng)
        texts.append(base)
        for _ in range(rng.choice([0, 0, 1, 3, 8])):
            copy = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 4])):
                copy[rng.randrange(len(copy))] = rng.choice(["new", "other", "words"])
            texts.append(copy)
    passage = prose(30, rng)
    texts += [passage + prose(25, rng) for _ in range(30)]  # a passage alone makes no duplicates
    return [" ".join(t) for t in texts]


def test_classes_equal_those_of_all_pairs(make_docs, clash):
    texts = corpus()
    rows = clash(make_docs(list(enumerate(texts))))
    got = defaultdict(list)
    for r in N.near_duplicates(rows).collect():
        got[r.class_id].append(r.doc_id)
    assert all(c == min(m) for c, m in got.items())
    assert sorted(map(sorted, got.values())) == brute(texts, N.frequencies(rows))
    kept = N.keep_one(rows)
    assert kept.columns == rows.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(got)


def test_nulls_repeats_and_empty(make_docs):
    rows = make_docs([(1, None), (2, None), (3, ""), (4, "..."), (5, "a b"), (6, "a b"), (6, "a b"), (None, "a b"), (7, "c d e f g h"), (None, "q r s t u v")])
    got = sorted(((r.doc_id or 0, r.class_id, r.members) for r in N.near_duplicates(rows).collect()), key=str)
    assert got == sorted([(0, None, 1), (0, 5, 4), (1, 1, 1), (2, 2, 1), (3, 3, 1), (4, 4, 1), (5, 5, 4), (6, 5, 4), (6, 5, 4), (7, 7, 1)], key=str)
    kept = sorted((r.doc_id or 0, r.text) for r in N.keep_one(rows).collect() if r.text)
    assert kept == [(0, "q r s t u v"), (4, "..."), (5, "a b"), (7, "c d e f g h")]
    assert N.near_duplicates(make_docs([])).count() == 0
    same = N.keep_one(make_docs([(1, "a b c"), (1, "a b c"), (1, "a b c")]))
    assert same.count() == 1


def test_samples_agree_as_often_as_sets_are_similar():
    rng = np.random.default_rng(0)
    agree = 0
    for _ in range(200):
        ids = rng.integers(0, 1 << 63, 60, dtype=np.uint64)
        a, b = np.sort(ids[:50]), np.sort(ids[10:])
        out = [N.samples(x, np.ones(len(x)), np.array([0, len(x)]))[0] for x in (a, b)]
        agree += (out[0] == out[1]).mean()
    expected = (40 / 60) ** N.ROWS
    assert abs(agree / 200 - expected) < 0.05


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(30)] + [(100, k) for k in range(101, 160)] + [(rng.randint(200, 260), rng.randint(200, 260)) for _ in range(50)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    label = {n: n for e in edges if e[0] != e[1] for n in e}
    for _ in label:
        for u, v in edges:
            if u != v:
                label[u] = label[v] = min(label[u], label[v])
    assert got == label
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0

import random
from collections import Counter

import numpy as np
import pytest

from headroom.llm import decontaminate as D
from tests.llm.test_words import split

RNG = random.Random(3)
VOCABULARY = ["".join(RNG.choice("abcdefghij") for _ in range(RNG.randint(2, 9))) for _ in range(400)]


def prose(n, rng):
    return [rng.choice(VOCABULARY) for _ in range(n)]


def bag(words):
    n = len(words)
    rows = [tuple(words[i : i + 5]) for i in range(max(1, n - 4))] if n else []
    return Counter(rows)


def similarity(a, b):
    a, b = bag(a), bag(b)
    weigh = lambda c: sum(n * sum(len(w.encode()) for w in s) for s, n in c.items())
    shared = weigh(a & b)
    return shared / (weigh(a) + weigh(b) - shared)


def brute(words, items):
    """The items for which some window of their length is similar enough; short ones match short texts only."""
    out = {i for i, item in items.items() if 0 < len(item) < 5 and item == words}
    for i, item in items.items():
        n = len(item)
        if n >= 5 and words and any(similarity(words[k : k + n], item) >= D.SIMILARITY for k in range(max(1, len(words) - n + 1))):
            out.add(i)
    return out


def test_items_are_those_of_all_windows(spark, make_docs, clash):
    rng = random.Random(5)
    items = {i: prose(rng.randint(5, 59), rng) for i in range(25)}
    items[90], items[91] = ["solo"], ["two", "words"]
    docs = []
    for i in range(60):
        words = prose(rng.randint(0, 120), rng)
        for item in rng.sample(sorted(items), rng.choice([0, 1, 1, 2])):
            part = list(items[item])
            if rng.random() < 0.6 and len(part) > 6:
                for _ in range(rng.randint(1, 3)):
                    part[rng.randrange(len(part))] = rng.choice(VOCABULARY)
            at = rng.randint(0, len(words))
            words[at:at] = part[: rng.choice([len(part), len(part), len(part) - 2])]
        docs.append((i, words))
    docs += [(100, ["solo"]), (101, items[3][:-1]), (102, items[4] * 3)]
    benchmark = spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()] * 2 + [(None, None), (95, "")], "item_id long, text string")
    rows = make_docs([(i, " ".join(w)) for i, w in docs] + [(200, None), (201, "")])
    got = {r.doc_id: {m.item_id for m in r["_matches"]} for r in D.find_items(clash(rows), benchmark).collect()}
    for i, words in docs:
        assert got[i] == brute(words, items), i
    assert got[200] == got[201] == set()
    sliced = D.find_items(rows, benchmark, slice_bytes=800)
    assert {r.doc_id: {m.item_id for m in r.matches} for r in sliced.collect()} == got


def test_blocks_reach_every_fingerprint_within_the_radius():
    rng = np.random.default_rng(1)
    item = rng.integers(0, 1 << 63, 1, dtype=np.uint64)
    values = (D.blocks_of(item)[0][:, None] ^ D.near_values()).astype(int)
    for _ in range(300):
        bits = rng.choice(64, D.RADIUS, replace=False)
        other = item ^ np.bitwise_or.reduce(np.uint64(1) << bits.astype(np.uint64))
        cells = D.blocks_of(other)[0].astype(int)
        assert any(c in v for c, v in zip(cells, values, strict=True))


def test_fingerprint_is_the_sign_of_sums():
    rng = np.random.default_rng(2)
    hashes = rng.integers(0, 1 << 63, 50, dtype=np.uint64)
    got = D.fingerprints(hashes, np.array([3, 10, 40]), np.array([9, 30, 41]))
    for print_, (a, b) in zip(got.tolist(), [(3, 9), (10, 30), (40, 41)], strict=True):
        bits = np.unpackbits(hashes[a:b].view(np.uint8).reshape(-1, 8), axis=1).astype(int) * 2 - 1
        assert print_ == np.packbits(bits.sum(axis=0) > 0).view(np.uint64)[0]


@pytest.mark.parametrize("side", ["docs", "benchmark"])
def test_empty_tables(spark, make_docs, side):
    none = spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    rows = make_docs([] if side == "docs" else [(1, "a b c d e f")])
    found = D.find_items(rows, some if side == "docs" else none)
    assert all(r.matches == [] for r in found.collect())


def test_clean_drops_contaminated_rows_only(spark, make_docs):
    item = " ".join(VOCABULARY[:30])
    rows = make_docs([(1, "x " * 30 + item + " y"), (2, "x " * 30), (3, None), (3, None)])
    kept = D.clean(rows, spark.createDataFrame([(7, item)], "item_id long, text string"))
    assert sorted(r.doc_id for r in kept.collect()) == [2, 3, 3] and kept.columns == rows.columns
    assert split("A b") == ["a", "b"]


@pytest.mark.parametrize("n", [300, 5_000])
def test_similarity_of_long_items_and_of_many_repeats(n):
    """Shared weights of all windows, by running sums, against bags of every near window."""
    rng = random.Random(n)
    items = {0: prose(n, rng), 1: (prose(7, rng) * n)[:n]}
    index = D.index_items(list(items), [" ".join(w) for w in items.values()])
    changed = list(items[0])
    for _ in range(n // 60):
        changed[rng.randrange(n)] = "zzz"
    texts = [prose(20, rng) + changed + prose(9, rng) + items[1] + prose(5, rng), items[1] * 2, items[0][n // 20 :]]
    found = D.match(index, __import__("pyarrow").array([" ".join(t) for t in texts]), D.SIMILARITY)
    assert [sorted(m["item_id"] for m in row) for row in found] == [[0, 1], [1], [0]]
    for words, row in zip(texts, found, strict=True):
        for m in row:
            window = words[m["start"] : m["end"]]
            assert m["similarity"] == pytest.approx(similarity(window, items[m["item_id"]]), rel=1e-12)
            if n == 300:
                size = len(items[m["item_id"]])
                best = max(similarity(words[k : k + size], items[m["item_id"]]) for k in range(max(1, len(words) - size + 1)))
                assert m["similarity"] == pytest.approx(best, rel=1e-12)


def test_items_beyond_16_bits_of_words(spark, make_docs):
    """Copies of very long items are found, in memory that grows with the words and not with their square."""
    import resource

    rng = random.Random(9)
    long = [f"{rng.choice(VOCABULARY)}{rng.randrange(50)}" for _ in range(70_000)]
    index = D.index_items([1], [" ".join(long)])
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    found = D.match(index, __import__("pyarrow").array([" ".join(prose(50, rng) + long + prose(40, rng)), " ".join(long[:-9_000])]), D.SIMILARITY)
    assert [[m["item_id"] for m in row] for row in found] == [[1], [1]] and found[0][0]["similarity"] == 1.0
    assert found[0][0]["start"] == 50 and found[0][0]["end"] == 70_050
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 400_000  # KB


def test_texts_of_nothing_but_items_take_bounded_memory(monkeypatch):
    """Memory does not grow with the windows of every length, and blocks of any size give the same matches."""
    import tracemalloc

    import pyarrow as pa

    rng = random.Random(12)
    stem = prose(6, rng)
    items = {i: [w for _ in range(4) for w in stem + prose(rng.randint(1, 8), rng)] for i in range(200)}
    index = D.index_items(list(items), [" ".join(w) for w in items.values()])
    texts = [" ".join(w for _ in range(25) for w in items[rng.randrange(200)]) for _ in range(2)]
    tracemalloc.start()
    found = D.match(index, pa.array(texts), D.SIMILARITY)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert all(found) and peak < 150e6
    monkeypatch.setattr(D, "BLOCK_ROWS", 20_000)
    assert D.match(index, pa.array(texts), D.SIMILARITY) == found

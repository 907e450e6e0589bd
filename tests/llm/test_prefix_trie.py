import hashlib
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from headroom.llm import prefix_trie as T
from headroom.llm.queries import QUERIES, TWINS
from tests.oracle import connect, differences

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows, graft=False):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, t) for _, _, r, t in sorted(found, key=lambda x: x[:2])] for c, found in own.items()}
    whole = {}
    for c, found in own.items():
        h = zlib.crc32(str(c).encode()) % 4 if graft else 0
        whole[c] = own.get(c - c % 20, [])[:h] + found[h:]
    members = defaultdict(list)
    for c, found in whole.items():
        for d in range(len(found) + 1):
            members[tuple(found[:d])].append(c)
    children, saved, leaves = defaultdict(int), defaultdict(int), defaultdict(int)
    for node in members:
        if node:
            children[node[:-1]] += 1
    for node, own_members in members.items():
        tokens = (len(own_members) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", node[-1][1])) if node else 0
        for d in range(len(node) + 1):
            saved[node[:d]] += tokens
            leaves[node[:d]] += not children[node]
    out = []
    for node, own_members in members.items():
        ends = ",".join(str(c) for c in sorted(own_members) if len(whole[c]) == len(node))
        parent = min(members[node[:-1]]) if node else None
        out.append((min(own_members), len(node), parent, len(own_members), children[node], leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=lambda r: r[:2])


def trie(spark, rows, **kw):
    return sorted((tuple(r) for r in T.prefix_trie(spark.createDataFrame(rows, SCHEMA), **kw).collect()), key=lambda r: r[:2])


def graft():
    c = F.col("conv_id")
    return {"base": c - c % 20, "length": F.crc32(c.cast("string")) % 4, "most": 3}


def test_the_whole_table_against_both(spark):
    folder = "/root/testdata/sf0.01"
    got = QUERIES["op12_prefix_trie"](spark, folder)
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert sorted((tuple(r) for r in got.collect()), key=lambda r: r[:2]) == brute(rows, graft=True)
    assert differences(got.toPandas(), connect(folder).execute(TWINS["op12_prefix_trie"]).df()) is None


def test_shared_turns_and_depths_of_many_bands(spark):
    rows = [(c, t, "user", f"line {t} of {c % 3 if t > 20 else 0}") for c in range(12) for t in range(3 + 13 * c)]
    rows += [(c, t, None, "same  words here") for c in range(100, 160) for t in range(2 + c % 3)]
    rows += [(200, t, "user", "deep") for t in range(700)] + [(201, t, "user", "deep") for t in range(650)]
    assert trie(spark, rows) == brute(rows)
    assert trie(spark, rows, **graft()) == brute(rows, graft=True)


def test_long_conversations_lie_in_several_parts(spark):
    """With many small parts, places and keys are put together from offsets."""
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        rows = [(c, t, "user", f"{t}") for c in (20, 21, 22, 40) for t in range(300)] + [(30, 0, "user", "0"), (30, 1, "user", "1")]
        assert trie(spark, rows, **graft()) == brute(rows, graft=True)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)


def test_nulls_repeats_turnless_and_clashes(spark):
    rows = [(1, None, None, None), (1, 0, "", ""), (1, 0, "", ""), (2, 5, "a", "b c"), (3, 5, "ab", " c"), (None, 1, "u", "x"), (-5, 0, "u", None)]
    rows += [(c, 0, "user", "only one") for c in range(60, 100)]  # shorter than what is cut off: some have no turns left
    assert trie(spark, rows) == brute(rows)
    positive = [r for r in rows if r[0] is None or r[0] >= 0]
    assert trie(spark, positive, **graft()) == brute(positive, graft=True)
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' as depth", "1 as k1", "2 as a", "3 as _part", "4 as words")
    assert sorted((tuple(r) for r in T.prefix_trie(df).collect()), key=lambda r: r[:2]) == brute(rows)


@pytest.mark.parametrize("rows", [[], [(None, 0, "u", "x")]])
def test_empty(spark, rows):
    assert trie(spark, rows) == []


def test_very_long_texts(spark):
    rows = [(c, t, "user", "word " * 200_000 + str(c * t)) for c in (0, 1) for t in (0, 1)]
    assert trie(spark, rows) == brute(rows)

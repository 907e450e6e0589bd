"""Prefix trie over conversations, with subtree totals by a depth-band rollup.

A node is a distinct sequence of first d turns (role, text). Its key is the exclusive-or, in two lanes of
64 bits, of hashes of each turn's place and content; keys of long conversations are put together
from parts, so no task orders or holds a whole conversation. A node's own facts are one aggregate over the
rows (conversation, depth, key), which a node with very many members combines before shuffling.

Subtree totals: depths are cut into bands of ``BAND`` levels. Every node adds its facts to its
ancestors in its own band only, at most ``BAND`` of them, found at its smallest member. The totals of the
bands' top nodes form a trie ``BAND`` times as low, which is rolled up in the same way; its completed
totals are then handed to the ancestors one band up. A trie of depth n takes log(n) / log(BAND) rounds.

Turns are ordered by ``turn``, null first; equal turns by a digest of role and text. A null role or text counts as
empty, rows without conv_id are left out, repeated rows are turns of their own. A conversation of no turns
is a member of the root alone. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from headroom.llm.arrow import narrow
from headroom.llm.mixing import size_of
from headroom.operators.numbering import PART, ROW, in_parts, part_totals
from headroom.sources.shared import cut_lineage

#: Levels of a band: bounds the rows that one node is exploded to.
BAND = 8
#: Parents with more than this share of all nodes as children are broadcast; there are fewer than its inverse.
HOT_SHARE = 0.001
KEY = ["k1", "k2"]


def turns(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, a, b (120 bits of a digest of role and text), words."""
    rows = narrow(conversations, conv_id="long", turn="long", role="string", text="string").where("conv_id IS NOT NULL")
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text), 256)
    rows = rows.select("conv_id", "turn", digest.alias("digest"), size_of(text).alias("words"))
    part = [F.conv(F.substring("digest", at, 15), 16, 10).cast("long") for at in (1, 16)]
    return rows.select("conv_id", "turn", part[0].alias("a"), part[1].alias("b"), "words")


def lanes(depth: Column, a: Column, b: Column) -> tuple[Column, Column]:
    """Two hashes of a turn at its place."""
    return F.xxhash64(depth.cast("long"), a, b), F.xxhash64(b, depth.cast("long"), a, F.lit(1))


def heads(parts: DataFrame, most: int) -> DataFrame:
    """base, head: a conversation's first turns, ``most`` at most, in order. Each task passes on no more of them."""
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "a", "b", ROW))
    first = parts.withColumn("place", place).where(F.col("place") <= most)
    head = F.sort_array(F.collect_list(F.struct("place", "a", "b", "words")))
    return first.groupBy(F.col("conv_id").alias("base")).agg(head.alias("head"))


def paths(conversations: DataFrame, base: Column, length: Column, most: int) -> DataFrame:
    """conv_id, depth, k1, k2, f1, f2 (the last turn's part of the key), words, is_end: one row for each prefix."""
    parts = in_parts(turns(conversations), ["conv_id"], ["turn", "a", "b"], "turns")
    sizes = part_totals(parts, ["conv_id"], n=F.count("*"))
    convs = sizes.groupBy("conv_id").agg(F.sum("n").alias("n_turns")).withColumns({"base": base, "cut": length})
    convs = convs.join(heads(parts, most), "base", "left")
    prefix = F.slice(F.coalesce("head", F.array().cast("array<struct<place:int,a:bigint,b:bigint,words:bigint>>")), F.lit(1), F.col("cut").cast("int"))
    convs = convs.select("conv_id", "n_turns", "cut", prefix.alias("prefix"))
    convs = convs.withColumn("length", F.size("prefix") + F.greatest(F.col("n_turns") - F.col("cut"), F.lit(0)))
    convs = cut_lineage(convs, "conversations")

    def hashes(lane: int) -> Column:
        return F.transform("prefix", lambda t: lanes(t["place"], t["a"], t["b"])[lane])

    def joined(array: Column) -> Column:
        return F.aggregate(array, F.lit(0).cast("long"), lambda x, y: x.bitwiseXOR(y))

    convs = convs.withColumns({"h1": hashes(0), "h2": hashes(1)}).withColumns({"c1": joined(F.col("h1")), "c2": joined(F.col("h2"))})
    zero = F.lit(0).cast("long")
    roots = convs.select("conv_id", zero.alias("depth"), *[zero.alias(c) for c in ("k1", "k2", "f1", "f2", "words")], (F.col("length") == 0).alias("is_end"))
    grafted = convs.select("conv_id", "length", "prefix", "h1", "h2", F.posexplode("prefix").alias("i", "t")).select(
        "conv_id",
        (F.col("i") + 1).cast("long").alias("depth"),
        *[joined(F.slice(h, F.lit(1), F.col("i") + 1)).alias(k) for h, k in (("h1", "k1"), ("h2", "k2"))],
        *[F.element_at(h, F.col("i") + 1).alias(f) for h, f in (("h1", "f1"), ("h2", "f2"))],
        F.col("t.words").alias("words"),
        (F.col("length") == F.col("i") + 1).alias("is_end"),
    )
    return roots.unionByName(grafted).unionByName(own_turns(parts, sizes, convs))


def own_turns(parts: DataFrame, sizes: DataFrame, convs: DataFrame) -> DataFrame:
    """The rows of ``paths`` from a conversation's own turns behind the first ``cut``.

    Keys are joined inside a part first; what a conversation has in earlier parts follows as an offset.
    """
    shift = F.size("prefix") - F.col("cut")
    about = sizes.join(convs, "conv_id").select("conv_id", PART, "before_n", "cut", "length", shift.alias("shift"), "c1", "c2")
    inside = Window.partitionBy(PART, "conv_id").orderBy("turn", "a", "b", ROW)
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    rows = parts.join(about, [PART, "conv_id"]).withColumn("place", F.row_number().over(inside) + F.col("before_n"))
    rows = rows.withColumn("depth", (F.col("place") + F.col("shift")).cast("long"))
    own = F.col("place") > F.col("cut")
    f1, f2 = lanes(F.col("depth"), F.col("a"), F.col("b"))
    rows = rows.withColumns({"f1": F.when(own, f1).otherwise(F.lit(0)), "f2": F.when(own, f2).otherwise(F.lit(0))})
    rows = rows.withColumns({k: F.col(c).bitwiseXOR(F.bit_xor(f).over(upto)) for k, c, f in (("k1", "c1", "f1"), ("k2", "c2", "f2"))})
    rows = rows.where(own).select("conv_id", PART, "depth", "k1", "k2", "f1", "f2", "words", (F.col("depth") == F.col("length")).alias("is_end"))
    rows = cut_lineage(rows, "own-turns")
    # Only conversations that lie in several parts, so one row for each part at most.
    many = rows.groupBy("conv_id", PART).agg(F.bit_xor("f1").alias("x1"), F.bit_xor("f2").alias("x2"))
    earlier = Window.partitionBy("conv_id").orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    before = many.select("conv_id", PART, *[F.bit_xor(x).over(earlier).alias(x) for x in ("x1", "x2")]).where("x1 IS NOT NULL")
    rows = rows.join(before, ["conv_id", PART], "left").drop(PART)
    return rows.withColumns({k: F.col(k).bitwiseXOR(F.coalesce(x, F.lit(0))) for k, x in (("k1", "x1"), ("k2", "x2"))}).drop("x1", "x2")


def ancestors(prefixes: DataFrame, unit: int) -> DataFrame:
    """member, band, above: the keys on a conversation's path in each band, at depths that ``unit`` divides; ``BAND`` at most."""
    tops = prefixes.where(F.col("depth") % unit == 0)
    band = F.floor(F.col("depth") / (unit * BAND)).alias("band")
    return tops.groupBy(F.col("conv_id").alias("member"), band).agg(F.collect_list(F.struct("depth", *KEY)).alias("above"))


def summed(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*KEY).agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))


def rollup(prefixes: DataFrame, items: DataFrame, deepest: int, unit: int = 1) -> DataFrame:
    """k1, k2, leaves, saved summed over the subtrees of ``items``, the nodes at depths that ``unit`` divides.

    Each level of the recursion has ``BAND`` times fewer bands.
    """
    height = unit * BAND
    lists = ancestors(prefixes, unit)
    here = items.withColumnsRenamed({"conv_id": "member"}).withColumn("band", F.floor(F.col("depth") / height))
    near = here.join(lists, ["member", "band"])
    up = F.explode(F.filter("above", lambda x: x["depth"] <= F.col("depth"))).alias("x")
    totals = summed(near.select(up, "leaves", "saved").select("x.k1", "x.k2", "leaves", "saved"))
    if deepest < height:
        return totals
    totals = cut_lineage(totals, "band-totals")
    tops = items.where(F.col("depth") % height == 0).drop("leaves", "saved").join(totals, KEY)
    done = cut_lineage(rollup(prefixes, tops, deepest, height), "band-roots")
    handed = tops.where("depth > 0").drop("leaves", "saved").join(done, KEY)
    handed = handed.withColumnsRenamed({"conv_id": "member"}).withColumn("band", F.floor(F.col("depth") / height) - 1)
    handed = handed.join(lists, ["member", "band"]).select(F.explode("above").alias("x"), "leaves", "saved")
    return summed(totals.unionByName(handed.select("x.k1", "x.k2", "leaves", "saved")))


def end_hashes(prefixes: DataFrame) -> DataFrame:
    """k1, k2, ends: SHA-256 of the ids of the conversations that end at a node, ascending, comma-joined.

    Ids are sorted in ranges of (node, id); each range passes on joined pieces of text, and one
    task hashes the pieces of a node one after the other without keeping them.
    """

    def runs(batch: pa.RecordBatch) -> Iterator[tuple[int, int]]:
        k1, k2 = (batch.column(k).to_numpy() for k in KEY)
        edges = np.flatnonzero((k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])) + 1
        bounds = [0, *edges.tolist(), batch.num_rows]
        return zip(bounds[:-1], bounds[1:], strict=True)

    def join_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                ids, at = batch.column("conv_id"), list(runs(batch))
                texts = [",".join(map(str, ids[i:j].to_pylist())) for i, j in at]
                first = pa.array([i for i, _ in at])
                columns = [batch.column(k).take(first) for k in KEY]
                yield pa.RecordBatch.from_arrays([*columns, ids.take(first), pa.array(texts)], [*KEY, "first", "ids"])

    def hash_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, hashlib.sha256()
        for batch in batches:
            found = []
            for k1, k2, ids in zip(*(batch.column(c).to_pylist() for c in (*KEY, "ids")), strict=True):
                if (k1, k2) == key:
                    state.update(b",")
                else:
                    if key is not None:
                        found.append((*key, state.hexdigest()))
                    key, state = (k1, k2), hashlib.sha256()
                state.update(ids.encode())
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*found, strict=True)], [*KEY, "ends"])
        if key is not None:
            yield pa.RecordBatch.from_arrays([pa.array([key[0]]), pa.array([key[1]]), pa.array([state.hexdigest()])], [*KEY, "ends"])

    ends = prefixes.where("is_end").select(*KEY, "conv_id")
    pieces = ends.repartitionByRange(*KEY, "conv_id").sortWithinPartitions(*KEY, "conv_id").mapInArrow(join_ids, "k1 long, k2 long, first long, ids string")
    return pieces.repartition(*KEY).sortWithinPartitions(*KEY, "first").mapInArrow(hash_ids, "k1 long, k2 long, ends string")


def with_parents(nodes: DataFrame) -> DataFrame:
    """Adds parent_conv_id. Parents of very many nodes are broadcast, fewer than 1 / HOT_SHARE; the rest meet by shuffle."""
    n = nodes.count()
    parents = nodes.where("n_children > 0").select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent_conv_id"), "n_children")
    hot = F.col("n_children") > HOT_SHARE * n
    few = parents.where(hot).drop("n_children").withColumnRenamed("parent_conv_id", "hot_conv_id")
    marked = nodes.join(F.broadcast(few), ["p1", "p2"], "left")
    near = marked.where("hot_conv_id IS NOT NULL OR depth = 0").withColumn("parent_conv_id", F.when(F.col("depth") > 0, F.col("hot_conv_id")))
    rest = marked.where("hot_conv_id IS NULL AND depth > 0").join(parents.where(~hot).drop("n_children"), ["p1", "p2"], "left")
    return near.unionByName(rest).drop("hot_conv_id")


def prefix_trie(conversations: DataFrame, base: Column | None = None, length: Column | None = None, most: int = 0) -> DataFrame:
    """One row for each node: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    With ``base`` and ``length`` (columns over conv_id; at most ``most``) a conversation's first ``length`` turns are
    replaced by those of conversation ``base``, as many as that has. ``saved_tokens`` sums (members - 1) x words
    of the node's last turn over its subtree: what computing shared prefixes once saves.
    """
    zero = F.lit(0).cast("long")
    prefixes = paths(conversations, zero if base is None else base, zero if length is None else length, most)
    prefixes = cut_lineage(prefixes, "prefixes")
    nodes = prefixes.groupBy(*KEY).agg(
        F.count("*").alias("n_convs"),
        F.min("conv_id").alias("conv_id"),
        F.max("depth").alias("depth"),
        F.max("words").alias("words"),
        F.max("f1").alias("f1"),
        F.max("f2").alias("f2"),
        F.count_if("is_end").alias("n_ends"),
    )
    parent = {"p1": F.col("k1").bitwiseXOR(F.col("f1")), "p2": F.col("k2").bitwiseXOR(F.col("f2"))}
    nodes = cut_lineage(nodes.withColumns(parent).drop("f1", "f2"), "nodes")
    items = nodes.select(
        *KEY,
        "conv_id",
        "depth",
        (F.col("n_ends") == F.col("n_convs")).cast("long").alias("leaves"),
        ((F.col("n_convs") - 1) * F.col("words")).alias("saved"),
    )
    deepest = nodes.agg(F.max("depth")).first()[0] or 0
    totals = rollup(prefixes, items, deepest)
    children = nodes.where("depth > 0").groupBy(F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(F.count("*").alias("n_children"))
    whole = nodes.join(children, KEY, "left").join(totals, KEY).join(end_hashes(prefixes), KEY, "left")
    whole = cut_lineage(whole.withColumn("n_children", F.coalesce("n_children", zero)).drop("words", "n_ends"), "trie")
    return with_parents(whole).select(
        "conv_id",
        "depth",
        "parent_conv_id",
        "n_convs",
        "n_children",
        F.col("leaves").alias("n_leaves"),
        F.col("saved").alias("saved_tokens"),
        F.coalesce("ends", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"),
    )


def trie_sql(every: int = 20) -> str:
    """DuckDB SQL for the trie of ``conversations`` rebuilt from conversation c - c % every, CRC-32 of c modulo 4 turns of it."""
    return f"""
WITH RECURSIVE
ids AS (SELECT DISTINCT conv_id AS c, CAST(conv_id AS VARCHAR) AS s FROM conversations WHERE conv_id IS NOT NULL),
crc AS (
  SELECT c, s, 0 AS i, CAST(4294967295 AS BIGINT) AS v FROM ids
  UNION ALL
  SELECT c, s, i + 1, CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END
  FROM (SELECT c, s, i, CASE WHEN i % 8 = 0 THEN xor(v, CAST(ord(substr(s, i // 8 + 1, 1)) AS BIGINT)) ELSE v END AS x FROM crc WHERE i < 8 * length(s))
),
cuts AS (SELECT c, xor(v, 4294967295) % 4 AS h FROM crc WHERE i = 8 * length(s)),
own AS (
  SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS place,
    {{'role': coalesce(role, ''), 'text': coalesce(text, '')}} AS t
  FROM conversations WHERE conv_id IS NOT NULL
),
rebuilt AS (
  SELECT c, row_number() OVER (PARTITION BY c ORDER BY side, place) AS depth, t FROM (
    SELECT cuts.c, 0 AS side, place, t FROM cuts JOIN own ON own.c = cuts.c - cuts.c % {every} AND place <= h
    UNION ALL SELECT own.c, 1, place, t FROM own JOIN cuts ON own.c = cuts.c AND place > h)
),
prefixes AS (
  SELECT c, depth, md5(CAST(list(t) OVER (PARTITION BY c ORDER BY depth) AS VARCHAR)) AS node, t.text AS last FROM rebuilt
  UNION ALL SELECT c, 0, 'root', '' FROM ids
),
ended AS (SELECT c, max(depth) AS depth FROM prefixes GROUP BY c),
nodes AS (
  SELECT p.node, min(p.c) AS conv_id, any_value(p.depth) AS depth, count(*) AS n_convs,
    (count(*) - 1) * any_value(len(regexp_extract_all(last, '[^\\x20\\x09-\\x0D]+'))) AS saved,
    sha256(coalesce(string_agg(CAST(p.c AS VARCHAR), ',' ORDER BY p.c) FILTER (e.c IS NOT NULL), '')) AS ends_sha256
  FROM prefixes p LEFT JOIN ended e ON e.c = p.c AND e.depth = p.depth GROUP BY p.node
),
children AS (
  SELECT a.node, count(*) AS n_children FROM nodes n JOIN prefixes a ON a.c = n.conv_id AND a.depth = n.depth - 1 GROUP BY a.node
),
totals AS (
  SELECT a.node, CAST(sum(n.saved) AS BIGINT) AS saved_tokens, count(*) FILTER (k.node IS NULL) AS n_leaves
  FROM nodes n LEFT JOIN children k ON k.node = n.node JOIN prefixes a ON a.c = n.conv_id AND a.depth <= n.depth GROUP BY a.node
)
SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, up.conv_id AS parent_conv_id, n.n_convs,
  coalesce(k.n_children, 0) AS n_children, t.n_leaves, t.saved_tokens, n.ends_sha256
FROM nodes n JOIN totals t ON t.node = n.node LEFT JOIN children k ON k.node = n.node
LEFT JOIN prefixes a ON a.c = n.conv_id AND a.depth = n.depth - 1 LEFT JOIN nodes up ON up.node = a.node
"""

"""Near-duplicates by improved consistent weighted sampling over TF-IDF shingles.

A text is a weighted set: its five-word shingles, each with its count times an inverse document
frequency between 1 (in every document) and 1.5 (in one). Two texts are near-duplicates if the
weighted Jaccard similarity of these sets is at least ``SIMILARITY``.

1. Document frequencies of all documents go into a sketch of fixed size (two rows of counters, the
   smaller one less the row's median load); a shingle that does not stand out of the load counts as
   rare. The sketch has the same size for any corpus and is what tasks hold to weigh shingles.
2. Improved consistent weighted sampling gives ``BANDS * ROWS`` samples per text; a pair agrees in a
   sample with the probability of its similarity. Texts that agree in all samples of a band share a bucket.
3. Every text is compared with a leader of each of its buckets (the text with the most bucket
   neighbours), by exact similarity, and components are formed.
4. For texts that share a bucket with another component, the weight of shingles that no other such text
   has is added up. A pair can't be more similar than what either has in common with anyone allows; texts
   and pairs below the bound are done with.
5. Of the rest, texts of different components that share a bucket are compared: first with the text that
   has least of its own, then with a hashed few, then 32 times as many, until all such pairs have been. Pairs inside a component are never listed, and none that can be similar is left out.

Equal texts are one node, whatever their number; a class has the id of its smallest doc_id. Null and
wordless texts are classes of their own, under their doc_id. A text of fewer than five words has
one shingle. Rows with a null doc_id take part; a class of only such rows has a null id. An empty
table gives no rows. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from headroom.llm.arrow import free_name, map_pieces, narrow, pieces, send
from headroom.llm.components import components
from headroom.llm.words import ODD, mix, owner, shingles_of, words_of
from headroom.sources.shared import cut_lineage

SIMILARITY = 0.8
#: A pair at the similarity bound misses all buckets with probability (1 - 0.8**4)**12, or 0.2 %.
BANDS, ROWS = 12, 4
SKETCH_BITS = 18
SKETCH_PART = 1 << 14
#: Parts of so many tasks are added at once, in so many rounds: enough for 16 million tasks.
ADD_AT_ONCE, ADD_ROUNDS = 256, 3
#: A level at which no text is drawn.
NO_DRAW = 64
#: What a shingle of one document weighs more than one of all. With a larger share the copies of a large group
#: would be held apart by their few own shingles.
RARITY = 0.5
#: Counters within so many standard deviations of the load count as rare shingles.
STANDS_OUT = 4.0
#: Arrays of a small piece stay in the processor's cache while all samples are drawn.
PIECE = 1 << 18


@dataclass
class Frequencies:
    """How many documents hold a shingle, about; counters are less the load of rare ones."""

    documents: int
    counters: np.ndarray  # 2 x 2**SKETCH_BITS
    floor: float

    def inverse(self, shingles: np.ndarray) -> np.ndarray:
        if self.documents < 2:
            return np.ones(len(shingles))
        first, second = sketch_places(shingles)
        seen = np.minimum(self.counters[0][first], self.counters[1][second])
        seen = np.clip(np.where(seen > self.floor, seen, 1), 1, self.documents)
        return 1 + RARITY * np.log(self.documents / seen) / np.log(self.documents)


def sketch_places(shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    first = shingles >> np.uint64(64 - SKETCH_BITS)
    second = shingles * ODD[2] >> np.uint64(64 - SKETCH_BITS)
    return first.astype(np.int64), second.astype(np.int64)


def weighted(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text, ascending, how often each occurs, and the texts' bounds."""
    shingles, bounds = shingles_of(words_of(texts))
    text = owner(bounds)
    order = np.lexsort((shingles, text))
    shingles, text = shingles[order], text[order]
    new = np.ones(len(text), bool)
    new[1:] = (shingles[1:] != shingles[:-1]) | (text[1:] != text[:-1])
    heads = np.flatnonzero(new)
    times = np.diff(np.append(heads, len(text)))
    return shingles[heads], times, np.searchsorted(text[heads], np.arange(len(texts) + 1))


def frequencies(docs: DataFrame) -> Frequencies:
    """The sketch over all documents: each task adds up its own, then the parts are added."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters, documents = np.zeros((2, 1 << SKETCH_BITS), np.int32), 0
        for batch in batches:
            texts = batch.column("text")
            for at, to in pieces(texts, PIECE):
                shingles, _, bounds = weighted(texts.slice(at, to - at))
                documents += int((np.diff(bounds) > 0).sum())
                for row, places in zip(counters, sketch_places(shingles), strict=True):
                    row += np.bincount(places, minlength=len(row)).astype(np.int32)
        parts = counters.reshape(-1, SKETCH_PART)
        used = np.flatnonzero(parts.any(axis=1))
        task = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([-1, *used.tolist()], pa.int32()),
                pa.array([task] * (len(used) + 1), pa.int32()),
                pa.array([np.int64(documents).tobytes(), *(parts[k].astype(np.int64).tobytes() for k in used)], pa.binary()),
            ],
            ["part", "task", "counters"],
        )

    def add(found: pa.Table) -> pa.Table:
        part = found["part"][0].as_py()
        total = np.zeros(1 if part < 0 else SKETCH_PART, np.int64)
        for x in found["counters"]:
            total += np.frombuffer(x.as_py(), np.int64)
        row = {"part": pa.array([part], pa.int32()), "task": found["task"].combine_chunks()[:1], "counters": pa.array([total.tobytes()], pa.binary())}
        return pa.table(row)

    schema = "part int, task int, counters binary"
    parts = narrow(docs, text="string").mapInArrow(count, schema)
    # In rounds, so that no group grows with the number of tasks.
    for _ in range(ADD_ROUNDS):
        parts = parts.withColumn("task", F.floor(F.col("task") / ADD_AT_ONCE).cast("int")).groupBy("part", "task").applyInArrow(add, schema)
    counters, documents = np.zeros((2 << SKETCH_BITS) // SKETCH_PART * SKETCH_PART, np.int64).reshape(-1, SKETCH_PART), 0
    for row in parts.collect():
        values = np.frombuffer(row["counters"], np.int64)
        if row["part"] < 0:
            documents += int(values[0])
        else:
            counters[row["part"]] += values
    counters = counters.reshape(2, -1)
    load = np.median(counters, axis=1)
    floor = STANDS_OUT * float(np.sqrt(max(load.max(), 1.0)))
    return Frequencies(documents, (counters - load[:, None]).astype(np.float32), floor)


def unit(bits: np.ndarray) -> np.ndarray:
    """24 bits as a number strictly between 0 and 1."""
    return (bits.astype(np.float32) + np.float32(0.5)) * np.float32(2.0**-24)


def samples(shingles: np.ndarray, weights: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Band signatures of texts that all have shingles: one row per text."""
    starts, text = bounds[:-1], owner(bounds)
    log_weight = np.log(weights).astype(np.float32)
    low = np.uint64((1 << 24) - 1)
    out = np.zeros((len(starts), BANDS), np.uint64)
    for j in range(BANDS * ROWS):
        one = mix(shingles ^ mix(np.array([j + 1], np.uint64) * ODD[0]))
        two = mix(one ^ ODD[3])
        step = -np.log(unit(one >> np.uint64(40)) * unit(one >> np.uint64(16) & low))
        log_c = np.log(-np.log(unit(two >> np.uint64(40)) * unit(two >> np.uint64(16) & low)))
        shift = (one & np.uint64(0xFFFF)).astype(np.float32) * np.float32(2.0**-16)
        level = np.floor(log_weight / step + shift)
        score = log_c - step * (level - shift) - step
        least = np.minimum.reduceat(score, starts)
        at = np.flatnonzero(score == least[text])
        best = np.zeros(len(starts), np.int64)
        best[text[at[::-1]]] = at[::-1]
        chosen = mix(shingles[best] ^ level[best].astype(np.int64).view(np.uint64) * ODD[1])
        out[:, j // ROWS] = (out[:, j // ROWS] ^ chosen) * ODD[j % ROWS] + np.uint64(j + 1)
    return mix(out)


def signatures(docs: DataFrame, known: Frequencies) -> DataFrame:
    """doc_id, node (digest of the text), bands (null without words), weight (of all its shingles)."""
    sent = send(docs.sparkSession, known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, to in pieces(batch.column("text"), PIECE):
                piece = batch.slice(at, to - at)
                shingles, times, bounds = weighted(piece.column("text"))
                full = np.flatnonzero(np.diff(bounds))
                rows: list = [None] * piece.num_rows
                weights = times * sent().inverse(shingles)
                total = np.bincount(owner(bounds), weights, piece.num_rows).astype(float)
                if len(full):
                    found = samples(shingles, weights, bounds[np.append(full, len(bounds) - 1)])
                    for i, bands in zip(full.tolist(), found.view(np.int64).tolist(), strict=True):
                        rows[i] = bands
                yield pa.RecordBatch.from_arrays(
                    [piece.column("doc_id"), piece.column("node"), pa.array(rows, pa.list_(pa.int64())), pa.array(total)],
                    ["doc_id", "node", "bands", "weight"],
                )

    rows = narrow(docs, doc_id="long", text="string").withColumn("node", F.unhex(F.md5("text")))
    return rows.mapInArrow(run, "doc_id long, node binary, bands array<long>, weight double")


def similarities(left: pa.Array, right: pa.Array, known: Frequencies) -> np.ndarray:
    """Weighted Jaccard similarity of each pair of texts."""
    pair, shingle, weight = [], [], []
    for texts in (left, right):
        # A leader's text comes again and again: it is read once.
        coded = texts.dictionary_encode()
        s, times, bounds = weighted(coded.dictionary)
        w = times * known.inverse(s)
        which = coded.indices.to_numpy()
        counts = np.diff(bounds)[which]
        first = np.concatenate([[0], np.cumsum(counts)])[:-1]
        at = np.arange(counts.sum()) - np.repeat(first - bounds[:-1][which], counts)
        pair.append(np.repeat(np.arange(len(texts)), counts))
        shingle.append(s[at])
        weight.append(w[at])
    pair, shingle, weight = map(np.concatenate, (pair, shingle, weight))
    order = np.lexsort((shingle, pair))
    pair, shingle, weight = pair[order], shingle[order], weight[order]
    same = np.flatnonzero((pair[1:] == pair[:-1]) & (shingle[1:] == shingle[:-1]))
    shared = np.bincount(pair[same], np.minimum(weight[same], weight[same + 1]), len(left))
    return shared / np.maximum(np.bincount(pair, weight, len(left)) - shared, 1e-300)


def verified(pairs: DataFrame, texts: DataFrame, known: Frequencies, similarity: float) -> DataFrame:
    """u, v of the pairs that are similar enough; texts: node, text."""
    sent = send(pairs.sparkSession, known)

    def helper(batch: pa.RecordBatch) -> pa.RecordBatch:
        score = similarities(batch.column("text"), batch.column("other"), sent())
        return batch.select(["u", "v"]).filter(pa.array(score >= similarity))

    both = pairs.join(texts.select(F.col("node").alias("u"), "text"), "u")
    both = both.join(texts.select(F.col("node").alias("v"), F.col("text").alias("other")), "v")
    return map_pieces(both.select("u", "v", "text", "other"), helper, "u binary, v binary", limit=PIECE)


def ordered(a: str, b: str) -> list:
    return [F.least(a, b).alias("u"), F.greatest(a, b).alias("v")]


def own_weights(texts: DataFrame, known: Frequencies) -> DataFrame:
    """node, own: the weight of a text's shingles that no other text here has; nodes without any have no row."""
    sent = send(texts.sparkSession, known)

    def helper(batch: pa.RecordBatch) -> pa.RecordBatch:
        shingles, times, bounds = weighted(batch.column("text"))
        nodes = batch.column("node").take(pa.array(owner(bounds)))
        weights = times * sent().inverse(shingles)
        return pa.RecordBatch.from_arrays([nodes, pa.array(shingles.view(np.int64)), pa.array(weights)], ["node", "shingle", "weight"])

    rows = map_pieces(texts.select("node", "text"), helper, "node binary, shingle long, weight double", limit=PIECE)
    single = rows.groupBy("shingle").agg(F.count("*").alias("n"), F.min("node").alias("node"), F.min("weight").alias("weight")).where("n = 1")
    return single.groupBy("node").agg(F.sum("weight").alias("own"))


def merge(found: DataFrame, links: DataFrame) -> DataFrame:
    """``found`` (node, component) after joining the components of linked nodes u, v."""
    links = cut_lineage(links, "links")
    if links.isEmpty():
        return found
    for side in ("u", "v"):
        named = found.select(F.col("node").alias(side), F.col("component").alias(f"c{side}"))
        links = links.join(named, side, "left")
    merged = components(links.select(F.coalesce("cu", "u").alias("u"), F.coalesce("cv", "v").alias("v")))
    grown = found.join(merged.select(F.col("node").alias("component"), F.col("component").alias("into")), "component", "left")
    grown = grown.select("node", F.coalesce("into", "component").alias("component"))
    fresh = merged.join(found.select("node"), "node", "left_anti")
    return cut_lineage(grown.unionByName(fresh.select("node", "component")), "components")


def drawn(node: str, level: int) -> Column:
    """Whether a text is among the 2**-level of its bucket that all others are compared with; lower levels hold higher ones."""
    return F.lit(False) if level == NO_DRAW else F.pmod(F.xxhash64(node, "bucket"), F.lit(1 << level)) == 0


def still_open(rows: DataFrame, found: DataFrame) -> DataFrame:
    """The rows (bucket, node, ...) of buckets that hold several components, with component and n (rows of the bucket)."""
    rows = rows.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    spans = rows.groupBy("bucket").agg(F.min("component").alias("a"), F.max("component").alias("b"), F.count("*").alias("n"))
    return cut_lineage(rows.join(spans.where("a <> b").select("bucket", "n"), "bucket"), "open")


def classes(docs: DataFrame, signed: DataFrame, known: Frequencies, similarity: float = SIMILARITY) -> DataFrame:
    """node, component for every node that is near another one."""
    nodes = signed.where("bands is not null").dropDuplicates(["node"])
    members = cut_lineage(nodes.select("node", F.explode("bands").alias("bucket")), "members")
    sizes = members.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1")
    crowded = cut_lineage(members.join(sizes, "bucket"), "crowded")
    wanted = crowded.select("node").distinct()
    texts = narrow(docs, text="string").select(F.unhex(F.md5("text")).alias("node"), "text")
    texts = cut_lineage(texts.join(wanted, "node").dropDuplicates(["node"]), "texts")

    near = crowded.groupBy("node").agg(F.sum("size").alias("near"))
    leaders = crowded.join(near, "node").groupBy("bucket").agg(F.max(F.struct("near", "node"))["node"].alias("leader"))
    pairs = crowded.join(leaders, "bucket").where("node <> leader").select(*ordered("node", "leader")).distinct()
    tested = cut_lineage(pairs, "pairs")
    nothing = tested.select(F.col("u").alias("node"), F.col("v").alias("component")).where(F.lit(False))
    found = merge(nothing, verified(tested, texts, known, similarity))

    rows = still_open(crowded.select("bucket", "node"), found)
    own = own_weights(texts.join(rows.select("node").distinct(), "node"), known)
    signs = [f"b{i}" for i in range(BANDS)]
    each = nodes.select("node", "weight", *[F.element_at("bands", i + 1).alias(b) for i, b in enumerate(signs)])
    rows = rows.select("bucket", "node").join(each, "node")
    rows = rows.join(own, "node", "left").fillna(0.0, ["own"])
    # What a text shares with anyone is its weight less its own; slack for the order of sums.
    rows = cut_lineage(rows.where(F.col("weight") - F.col("own") >= similarity * F.col("weight") * (1 - 1e-9)), "shared")
    level = None
    while True:
        now = still_open(rows, found)
        most = now.agg(F.max("n").alias("n")).first()["n"]
        if most is None or level == 0:
            return found
        if level is None:
            level = NO_DRAW
            share = F.struct(-F.col("own") / F.col("weight"), F.col("node"))
            first = now.groupBy("bucket").agg(F.max(share)["node"].alias("node"))
            few, rest, once = now.join(first, ["bucket", "node"], "left_semi"), now, F.lit(True)
        else:
            # About 32 texts of the largest bucket first, then 32 times as many, at last all.
            before, level = level, max(0, min(level, int(most).bit_length()) - 5)
            rest = now.where(~drawn("node", before))
            few = rest.where(drawn("node", level))
            # A pair counts in its first common bucket, and from one side if both are drawn.
            once = F.coalesce(*[F.when(F.col(b) == F.col(f"other_{b}"), F.col(b)) for b in signs]) == F.col("bucket")
            once &= ~drawn("node", level) | (F.col("node") < F.col("other_node"))
        few = few.select(F.col("bucket").alias("same"), *[F.col(c).alias(f"other_{c}") for c in ("node", "component", "weight", "own", *signs)])
        shared = F.least(F.col("weight") - F.col("own"), F.col("other_weight") - F.col("other_own"))
        whole = F.greatest(F.col("weight") + F.col("other_own"), F.col("other_weight") + F.col("own"))
        able = (shared >= similarity * whole * (1 - 1e-9)) & (F.col("component") != F.col("other_component"))
        pairs = rest.join(few, (F.col("bucket") == F.col("same")) & able & once).select(*ordered("node", "other_node")).distinct()
        pairs = cut_lineage(pairs.join(tested, ["u", "v"], "left_anti"), "pairs")
        tested = tested.unionByName(pairs)
        found = merge(found, verified(pairs, texts, known, similarity))


def assign(docs: DataFrame, similarity: float = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """(doc_id, node, component) for every row, and (component, class_id, members)."""
    known = frequencies(docs)
    signed = cut_lineage(signatures(docs, known), "signatures")
    near = classes(docs, signed, known, similarity)
    rows = signed.where("bands is not null").select("doc_id", "node").join(near, "node", "left")
    rows = cut_lineage(rows.select("doc_id", "node", F.coalesce("component", "node").alias("component")), "assigned")
    ids = rows.groupBy("component").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("members"))
    alone = signed.where("bands is null").select("doc_id", "node", F.lit(None).cast("binary").alias("component"))
    return rows.unionByName(alone), ids


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, class_id (smallest doc_id of its class), members (rows of the class): one row per document."""
    rows, ids = assign(docs, similarity)
    return rows.join(ids, "component", "left").select(
        "doc_id",
        F.when(F.col("component").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("members", F.lit(1)).alias("members"),
    )


def keep_one(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs`` less all but one of each class; null and wordless texts stay."""
    rows, ids = assign(docs, similarity)
    node, own, key, times = (free_name(docs, n) for n in ("text_digest", "kept_digest", "kept_id", "kept_times"))
    # Of the rows with the class's id the smallest text, and of repeated rows one.
    kept = rows.where("component is not null").join(ids, "component").where(F.col("doc_id").eqNullSafe(F.col("class_id")))
    kept = kept.groupBy("component").agg(F.min("node").alias(own), F.first("class_id").alias(key), F.count("*").alias(times))
    kept = cut_lineage(kept.drop("component"), "kept")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    signed = docs.withColumn(node, F.unhex(F.md5("text")))
    same = F.col(node).eqNullSafe(F.col(own)) & F.col("doc_id").cast("long").eqNullSafe(F.col(key))
    out = signed.join(kept, same)
    if not kept.where(F.col(times) > 1).isEmpty():
        out = out.where(F.col(times) == 1).unionByName(out.where(F.col(times) > 1).dropDuplicates([node]))
    out = out.select(*columns)
    wordless = rows.where("component is null").select(F.col("doc_id").alias(key), F.col("node").alias(own)).distinct()
    if not wordless.isEmpty():
        out = out.unionByName(signed.join(wordless, same, "left_semi").select(*columns))
    return out

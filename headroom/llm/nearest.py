"""Approximate nearest neighbours by inner product: randomly rotated one-bit codes with error bounds.

A vector is scaled to length one and turned by ``ROTATIONS_BITS // dimension`` (at least one) random
rotations; the signs are its packed code. With s = <signs / sqrt(bits), rotated vector> as correction
scalar, <signs, rotated query> / s estimates the inner product, and its error stays below
``BOUND`` / sqrt(bits - 1) * sqrt(1 - s^2) / s times both lengths but for a chance that falls like
exp(-BOUND^2 / 2). Vectors whose upper bound reaches the k-th largest lower bound are scored exactly,
in double precision, on the original vectors.

The queries are a stated share of the rows and run against all rows in blocks: a task sees one block
of queries and one block of vectors, keeps its best k, and a last step ranks those. Of equal vectors
only the k + 1 smallest ids can be in a result, so only those are coded; that is exact, and a
vector that a third of all rows share is no hot group.

Vectors that are null, zero, or hold null or non-finite components take no part, nor do rows without
an id; repeated rows count once. Of an id with several vectors, on either side, the largest inner product counts, and
it has one place in a list. Queries are answered from vectors of their own dimension. Ties go
to the smaller id. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from headroom.llm.arrow import narrow

K = 20
CODE_BITS = 512
BOUND = 3.0
SEED = 20_240_101
#: Vectors and queries that one task holds at once.
VECTOR_BLOCK, QUERY_BLOCK = 1 << 14, 1 << 11
#: Blocks at least, so that small tables too are spread over tasks.
LEAST_BLOCKS = 24


def rotations(dimension: int, seed: int = SEED) -> np.ndarray:
    """Random orthogonal matrices side by side: dimension x bits."""
    rng = np.random.default_rng([seed, dimension])
    turns = max(1, -(-CODE_BITS // dimension))
    return np.concatenate([np.linalg.qr(rng.standard_normal((dimension, dimension)))[0] for _ in range(turns)], axis=1)


def encode(vectors: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed codes, lengths and correction scalars."""
    lengths = np.sqrt((vectors**2).sum(axis=1))
    turned = (vectors / lengths[:, None]) @ turn
    bits = turned > 0
    # The turns of a unit vector have length sqrt(number of rotations); the codes are scaled alike.
    scale = np.abs(turned).sum(axis=1) / np.sqrt(turn.shape[1] * (turn.shape[1] / turn.shape[0]))
    return np.packbits(bits, axis=1), lengths, scale


def bounds(codes: np.ndarray, lengths: np.ndarray, scale: np.ndarray, queries: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Estimated inner products (queries x vectors) and how far off they may be."""
    n_bits, n_turns = turn.shape[1], turn.shape[1] / turn.shape[0]
    signs = np.unpackbits(codes, axis=1, count=n_bits).astype(np.float32) * 2 - 1
    turned = (queries @ turn).astype(np.float32)
    inner = turned @ signs.T / np.float32(np.sqrt(n_bits * n_turns))
    estimate = inner * (lengths / scale).astype(np.float32)
    spread = np.sqrt(np.maximum(1 - scale**2, 0)) / scale / np.sqrt(max(n_bits - 1, 1)) * lengths
    return estimate, BOUND * spread[None, :] * np.sqrt((queries**2).sum(axis=1))[:, None]


def valid(embeddings: DataFrame) -> DataFrame:
    """vec_id, vector (array of doubles): the rows that take part, each once."""
    rows = narrow(embeddings, vec_id="long", embedding="array<double>")
    good = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    some = F.exists("embedding", lambda x: x != 0)
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).where(good & some)
    return rows.select("vec_id", F.col("embedding").alias("vector")).distinct()


def coded(vectors: DataFrame, blocks: int) -> DataFrame:
    """block, dimension, vec_id, raw (the vector's bytes), code, length, scale: every vector's code."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turns: dict[int, np.ndarray] = {}
        for batch in batches:
            column = batch.column("vector")
            sizes = pa.compute.list_value_length(column).to_numpy()
            flat, at = pa.compute.list_flatten(column).to_numpy(), np.concatenate([[0], np.cumsum(sizes)])
            for size in np.unique(sizes).tolist():
                rows = np.flatnonzero(sizes == size)
                data = flat[at[rows][:, None] + np.arange(size)]
                if size not in turns:
                    turns[size] = rotations(size)
                codes, lengths, scale = encode(data, turns[size])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("vec_id").take(pa.array(rows)),
                        batch.column("block").take(pa.array(rows)),
                        pa.array(np.full(len(rows), size, np.int32)),
                        pa.array([x.tobytes() for x in data], pa.binary()),
                        pa.array([x.tobytes() for x in codes], pa.binary()),
                        pa.array(lengths),
                        pa.array(scale),
                    ],
                    ["vec_id", "block", "dimension", "raw", "code", "length", "scale"],
                )

    dealt = vectors.select("vec_id", "vector", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias("block"))
    return dealt.mapInArrow(run, "vec_id long, block int, dimension int, raw binary, code binary, length double, scale double")


def matrix(column: pa.ChunkedArray | pa.Array, kind: type) -> np.ndarray:
    parts = column.to_pylist()
    return np.frombuffer(b"".join(parts), kind).reshape(len(parts), -1)


def best_of(queries: pa.Table, vectors: pa.Table, k: int) -> pa.Table:
    """The k best ids of one block for each query id of another, exactly scored. All vectors of an id lie in one block."""
    asked, own = matrix(queries["raw"], np.float64), queries["query_id"].to_numpy()
    data, ids = matrix(vectors["raw"], np.float64), vectors["vec_id"].to_numpy()
    estimate, off = bounds(matrix(vectors["code"], np.uint8), vectors["length"].to_numpy(), vectors["scale"].to_numpy(), asked, rotations(asked.shape[1]))
    same = own[:, None] == ids[None, :]
    low = np.where(same, -np.inf, estimate - off)
    order = np.argsort(ids, kind="stable")
    heads = np.flatnonzero(np.append(True, ids[order][1:] != ids[order][:-1]))
    by_id = low if len(heads) == len(ids) else np.maximum.reduceat(low[:, order], heads, axis=1)
    below = by_id.shape[1] - min(k, by_id.shape[1])
    reach = np.partition(by_id, below, axis=1)[:, below]
    # Less than k others in the block: -inf, and all of them are scored.
    q, v = np.nonzero((estimate + off >= reach[:, None]) & ~same)
    score = np.concatenate([np.einsum("ij,ij->i", asked[q[i : i + 65536]], data[v[i : i + 65536]]) for i in range(0, len(q), 65536)] or [np.zeros(0)])
    asker, found = own[q], ids[v]
    order = np.lexsort((-score, found, asker))
    asker, found, score = asker[order], found[order], score[order]
    best = np.ones(len(asker), bool)
    best[1:] = (asker[1:] != asker[:-1]) | (found[1:] != found[:-1])
    asker, found, score = asker[best], found[best], score[best]
    order = np.lexsort((found, -score, asker))
    asker, found, score = asker[order], found[order], score[order]
    top = np.arange(len(asker)) - np.searchsorted(asker, asker) < k
    return pa.table({"query_id": asker[top], "vec_id": found[top], "score": score[top]})


def search(embeddings: DataFrame, is_query: Column, k: int = K) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for each row with ``is_query`` its k nearest others by inner product."""
    rows = valid(embeddings)
    n = rows.count()
    blocks = max(LEAST_BLOCKS, -(-n // VECTOR_BLOCK))
    groups = max(1, -(-rows.where(is_query).count() // QUERY_BLOCK))
    # Of equal vectors the smallest ids win every tie: one more than k, as one may be the query itself.
    place = F.row_number().over(Window.partitionBy("vector").orderBy("vec_id"))
    vectors = coded(rows.withColumn("place", place).where(F.col("place") <= k + 1).drop("place"), blocks)
    pairs = F.concat_ws("-", F.col("dimension"), F.col("block"), F.col("asked"))
    right = vectors.withColumn("asked", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).withColumn("pair", pairs)
    queries = rows.where(is_query).select(
        F.col("vec_id").alias("query_id"),
        F.size("vector").alias("dimension"),
        "vector",
        F.pmod(F.xxhash64(F.col("vec_id"), F.lit(1)), F.lit(groups)).cast("int").alias("asked"),
    )
    left = packed(queries).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumn("pair", pairs)

    def run(asked: pa.Table, found: pa.Table) -> pa.Table:
        empty = pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        return best_of(asked, found, k) if asked.num_rows and found.num_rows else empty

    near = left.groupBy("pair").cogroup(right.groupBy("pair")).applyInArrow(run, "query_id long, vec_id long, score double")
    # Ids with vectors of several dimensions meet in several groups.
    near = near.repartition("query_id").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    ranked = near.withColumn("rank", rank).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def packed(queries: DataFrame) -> DataFrame:
    """query_id, dimension, asked, raw: vectors as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = pa.array([np.asarray(x.values, np.float64).tobytes() for x in batch.column("vector")], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("query_id", "dimension", "asked")] + [raw], ["query_id", "dimension", "asked", "raw"])

    return queries.mapInArrow(run, "query_id long, dimension int, asked int, raw binary")

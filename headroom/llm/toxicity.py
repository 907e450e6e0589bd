"""Toxicity as cumulative-link ordinal regression over sparse text features.

P(grade > j) = sigmoid(w . x - threshold_j): one weight vector shared by ordered thresholds. The
result is the expected severity, the sum of P(grade > j).

Features are the words of the whole text and their beginnings, hashed to 2**BUCKET_BITS buckets. A text is read as a bag of its
marked words: x_b = 1 + log(occurrences of bucket b), for buckets that tell the labelled classes
apart. Labels only say toxic or not, so grades come from both: 0 is not toxic, and the toxic texts
of the sample are split at the median of their marked words per text into 1 and 2. The model is
fitted on a bounded sample of labelled rows, picked by hash, with at most ``MARKED`` buckets.

Null and wordless texts have no features and get the severity of an empty text. Without labels
of both kinds every severity is 0. Labels that are null, or whose doc_id is null or has other
labels that disagree, are left out. Equal texts get equal results; an empty table gives no rows.
Columns but those named are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from headroom.llm.arrow import map_pieces, narrow, pieces, send
from headroom.llm.words import hash_spans, mix, owner, words_of

BUCKET_BITS = 20
#: Bytes of a word's beginnings that count as features beside the word; longer words only.
STEMS = (4, 5, 6)
#: Labelled texts to fit on, about, and buckets with a weight, at most.
TRAIN_ROWS, MARKED = 12_000, 2_048
#: A bucket must hold a word of at least so many toxic texts of the sample, and have this log odds.
LEAST_TEXTS, LEAST_ODDS = 5, 1.5
STEPS = 500
RIDGE = 1e-4


@dataclass
class Ordinal:
    buckets: np.ndarray  # ascending
    weights: np.ndarray
    thresholds: np.ndarray  # ascending


def buckets_of(hashes: np.ndarray) -> np.ndarray:
    return (mix(hashes.copy()) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


def bags(texts: pa.Array, buckets: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """text, bucket (or its place in ``buckets``) and times, ascending."""
    words = words_of(texts)
    texts_of = owner(words.bounds)
    found, text = [buckets_of(words.hashes)], [texts_of]
    for size in STEMS:
        longer = np.flatnonzero(words.ends - words.starts > size)
        starts = words.starts[longer]
        found.append(buckets_of(~hash_spans(words.raw, starts, starts + size)))
        text.append(texts_of[longer])
    found, text = np.concatenate(found), np.concatenate(text)
    if buckets is not None:
        place = np.full(1 << BUCKET_BITS, -1, np.int32)
        place[buckets] = np.arange(len(buckets))
        found = place[found]
        text, found = text[found >= 0], found[found >= 0]
    keys, times = np.unique(text << BUCKET_BITS | found, return_counts=True)
    return keys >> BUCKET_BITS, keys & ((1 << BUCKET_BITS) - 1), times


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def fit(rows: np.ndarray, columns: np.ndarray, values: np.ndarray, grades: np.ndarray, n_features: int, steps: int = STEPS) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds that maximise the ridge-penalised likelihood, by Adam on all rows.

    Thresholds are the first one plus exponentials, so they stay in order.
    """
    n, top = len(grades), int(grades.max())
    above = grades[:, None] > np.arange(top)
    share = np.clip(above.mean(axis=0), 1e-6, 1 - 1e-6)
    start = -np.log(share / (1 - share))
    free = np.concatenate([np.zeros(n_features), start[:1], np.log(np.maximum(np.diff(start), 1e-2))])
    first, second = np.zeros_like(free), np.zeros_like(free)
    for step in range(1, steps + 1):
        weights, gaps = free[:n_features], np.exp(free[n_features + 1 :])
        thresholds = free[n_features] + np.concatenate([[0.0], np.cumsum(gaps)])
        score = np.bincount(rows, values * weights[columns], n)
        tail = sigmoid(score[:, None] - thresholds)
        # P(grade) is the difference of neighbouring tails; its log's derivative by each tail.
        edge = np.concatenate([np.ones((n, 1)), tail, np.zeros((n, 1))], axis=1)
        chance = np.maximum(edge[np.arange(n), grades] - edge[np.arange(n), grades + 1], 1e-12)
        by_tail = np.zeros((n, top + 2))
        by_tail[np.arange(n), grades] += 1 / chance
        by_tail[np.arange(n), grades + 1] -= 1 / chance
        by_score = by_tail[:, 1:-1] * tail * (1 - tail)
        by_threshold = -by_score.sum(axis=0) / n
        gradient = np.concatenate([
            np.bincount(columns, values * by_score.sum(axis=1)[rows], n_features) / n - RIDGE * weights,
            [by_threshold.sum()],
            np.cumsum(by_threshold[::-1])[::-1][1:] * gaps,
        ])
        first = 0.9 * first + 0.1 * gradient
        second = 0.999 * second + 0.001 * gradient**2
        free = free + 0.1 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    gaps = np.exp(free[n_features + 1 :])
    return free[:n_features], free[n_features] + np.concatenate([[0.0], np.cumsum(gaps)])


def labelled(docs: DataFrame, labels: DataFrame, train_rows: int) -> DataFrame:
    """text, toxic of about ``train_rows`` labelled documents."""
    known = narrow(labels, doc_id="long", toxic="int").where("doc_id is not null and toxic is not null")
    known = known.groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("most")).where("toxic = most")
    share = min(1.0, train_rows / max(1, known.count()))
    draw = F.shiftrightunsigned(F.xxhash64("doc_id"), 11) / float(1 << 53)
    texts = narrow(docs, doc_id="long", text="string").where(F.col("text").isNotNull() & (draw < share))
    return texts.join(known.where(draw < share).select("doc_id", "toxic"), "doc_id").select("text", "toxic")


def learn(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> Ordinal:
    sample = labelled(docs, labels, train_rows)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, to in pieces(batch.column("text")):
                toxic = batch.column("toxic").slice(at, to - at).to_numpy(zero_copy_only=False) > 0
                text, bucket, _ = bags(batch.column("text").slice(at, to - at))
                found, where = np.unique(bucket, return_inverse=True)
                marked = np.bincount(where, toxic[text], len(found)).astype(np.int64)
                every = np.bincount(where, minlength=len(found)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(marked), pa.array(every)], ["bucket", "toxic", "texts"])

    sizes = sample.agg(F.count(F.when(F.col("toxic") > 0, 1)).alias("toxic"), F.count("*").alias("texts")).first()
    bad, good = sizes["toxic"], sizes["texts"] - sizes["toxic"]
    none = Ordinal(np.zeros(0, np.int64), np.zeros(0), np.zeros(0))
    if not bad or not good:
        return none
    counts = sample.mapInArrow(count, "bucket long, toxic long, texts long").groupBy("bucket").agg(F.sum("toxic").alias("toxic"), F.sum("texts").alias("texts"))
    odds = F.log((F.col("toxic") + 0.5) / (bad + 1) / ((F.col("texts") - F.col("toxic") + 0.5) / (good + 1)))
    least = max(2, min(LEAST_TEXTS, bad // 10))
    chosen = counts.where((F.col("toxic") >= least) & (odds >= LEAST_ODDS))
    chosen = chosen.orderBy((odds * F.col("toxic")).desc(), "bucket").limit(MARKED).select("bucket").toArrow()
    buckets = np.sort(chosen["bucket"].to_numpy())
    if not len(buckets):
        return none

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, to in pieces(batch.column("text")):
                text, place, times = bags(batch.column("text").slice(at, to - at), buckets)
                bounds = np.searchsorted(text, np.arange(to - at + 1))
                lists = [pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(x.astype(np.int32))) for x in (place, times)]
                yield pa.RecordBatch.from_arrays([batch.column("toxic").slice(at, to - at), *lists], ["toxic", "places", "times"])

    bag = sample.mapInArrow(collect, "toxic int, places array<int>, times array<int>").orderBy("toxic", "places", "times").toArrow().combine_chunks()
    toxic = bag["toxic"].to_numpy() > 0
    lengths = pa.compute.list_value_length(bag["places"]).to_numpy()
    rows = np.repeat(np.arange(len(toxic)), lengths)
    columns, times = (pa.compute.list_flatten(bag[c]).to_numpy() for c in ("places", "times"))
    marks = np.bincount(rows, times, len(toxic))
    grades = np.where(toxic, 1 + (marks > np.median(marks[toxic])), 0)
    if grades.max() == 1:
        grades[np.flatnonzero(toxic)[marks[toxic].argmax()]] = 2
    return Ordinal(buckets, *fit(rows, columns, 1 + np.log(times), grades, len(buckets)))


def predict(docs: DataFrame, model: Ordinal) -> DataFrame:
    """doc_id, severity (expected grade), grade (the likeliest), toxic (grade above 0 is likelier than not)."""
    sent = send(docs.sparkSession, model)

    def helper(batch: pa.RecordBatch) -> pa.RecordBatch:
        model, n = sent(), batch.num_rows
        text, place, times = bags(batch.column("text"), model.buckets)
        score = np.zeros(n) if not len(model.weights) else np.bincount(text, (1 + np.log(times)) * model.weights[place], n)
        tail = sigmoid(score[:, None] - model.thresholds)
        edge = np.concatenate([np.ones((n, 1)), tail, np.zeros((n, 1))], axis=1)
        grade = (edge[:, :-1] - edge[:, 1:]).argmax(axis=1).astype(np.int32)
        severe = tail.sum(axis=1)
        toxic = tail[:, 0] >= 0.5 if tail.shape[1] else np.zeros(n, bool)
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(severe), pa.array(grade), pa.array(toxic)], ["doc_id", "severity", "grade", "toxic"])

    return map_pieces(narrow(docs, doc_id="long", text="string"), helper, "doc_id long, severity double, grade int, toxic boolean")

"""Benchmark decontamination: SimHash fingerprints of item-sized windows, verified exactly.

For an item of n words every n-word window of every document is a candidate. A window that can
verify has at least the wanted share of its weight in shingles of the benchmark; running sums find
those windows, and only they are fingerprinted. Fingerprints have 64 bits, each the sign of a sum
over the window's words. They are looked up by multi-index Hamming blocks: of ``BLOCKS`` blocks at
least one differs in at most ``RADIUS // BLOCKS`` bits if two fingerprints differ in at most
``RADIUS``, so entering each item under the values near each of its blocks finds every fingerprint
within the radius. Pairs are then verified by the weighted Jaccard similarity of their five-word
shingles (counted with multiplicity, weighted by the bytes of their words). Windows are made, looked
up and verified in blocks of bounded size, so that memory grows with the text and not with its matches.

The benchmark is read in slices of bounded size, each held by every task in turn; a larger benchmark
means more slices. Texts of fewer than five words have one shingle of all their words, so shorter
items match only documents that consist of them. Null and wordless documents match nothing, as do
null and wordless items; repeated items are one. An empty table on either side gives no matches.
Rows keep all their columns and are never joined, so repeated or clashing ids do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from headroom.llm.arrow import free_name, map_pieces, narrow, send
from headroom.llm.words import SHINGLE, Words, mix, shingles_of, words_of

SIMILARITY = 0.8
RADIUS = 15
BLOCKS = 8
BLOCK_BITS = 64 // BLOCKS
#: Bytes of benchmark text that one pass holds in every task.
SLICE_BYTES = 8 << 20
SIEVE_BITS = 22
#: Windows, or items looked up for them, that are held at once; what one shingle or window needs is never split.
BLOCK_ROWS = 1 << 18
MATCHES = "array<struct<item_id:bigint,similarity:double,start:int,end:int>>"


@dataclass
class Items:
    ids: list[int | None]
    lengths: np.ndarray  # words per item
    prints: np.ndarray
    weights: np.ndarray
    sieve: np.ndarray  # bitmap of the shingles' leading bits
    shingles: np.ndarray  # distinct shingles, ascending
    shingle_lengths: tuple[np.ndarray, np.ndarray]  # item lengths by shingle: bounds, values
    pair_keys: np.ndarray  # (item, shingle), ascending by key
    pair_counts: np.ndarray
    near: tuple[np.ndarray, np.ndarray]  # items by (block, value): bounds, values


def ranges(bounds: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row the positions bounds[row]:bounds[row + 1], and which row each belongs to."""
    counts = bounds[rows + 1] - bounds[rows]
    which = np.repeat(np.arange(len(rows)), counts)
    first = np.concatenate([[0], np.cumsum(counts)])[:-1]
    return np.arange(len(which)) - first[which] + bounds[rows][which], which


def runs(counts: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Row ranges whose counts add up to at most ``limit``; a larger single row is a range of its own."""
    ends = np.cumsum(counts)
    at = 0
    while at < len(counts):
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + limit, side="right")))
        yield at, to
        at = to


def grouped(keys: np.ndarray, values: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    return np.searchsorted(keys[order], np.arange(n + 1)), values[order]


def shingle_weights(words: Words, bounds: np.ndarray) -> np.ndarray:
    """Bytes of the words in each shingle."""
    size = np.concatenate([[0], np.cumsum(words.ends - words.starts)])
    counts = np.diff(bounds)
    at = np.arange(bounds[-1]) + np.repeat(words.bounds[:-1] - bounds[:-1], counts)
    return size[np.minimum(at + SHINGLE, np.repeat(words.bounds[1:], counts))] - size[at]


def fingerprints(hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """SimHash of the words starts[i]:ends[i]; sums are taken over the words that some window needs."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    steps = np.bincount(starts, minlength=len(hashes) + 1) - np.bincount(ends, minlength=len(hashes) + 1)
    needed = np.flatnonzero(np.cumsum(steps[:-1]) > 0)
    own, first = hashes[needed], np.searchsorted(needed, starts)
    last = first + (ends - starts)
    out = np.zeros(len(starts), np.uint64)
    # Bit by bit: memory stays within a few numbers a word, however long a matched stretch is.
    for bit in range(64):
        signs = (own >> np.uint64(bit) & np.uint64(1)).astype(np.int64) * 2 - 1
        sums = np.concatenate([[0], np.cumsum(signs)])
        out |= (sums[last] > sums[first]).astype(np.uint64) << np.uint64(bit)
    return out


def pair_key(item: np.ndarray, shingle: np.ndarray) -> np.ndarray:
    return mix(shingle ^ (item.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))


def near_values() -> np.ndarray:
    """What to flip in a block to reach every value within its share of the radius."""
    flips = np.arange(1 << BLOCK_BITS, dtype=np.uint64)
    return flips[np.bitwise_count(flips) <= RADIUS // BLOCKS]


def blocks_of(prints: np.ndarray) -> np.ndarray:
    shifts = np.arange(BLOCKS, dtype=np.uint64) * np.uint64(BLOCK_BITS)
    return prints[:, None] >> shifts & np.uint64((1 << BLOCK_BITS) - 1)


def index_items(ids: list[int | None], texts: list[str]) -> Items:
    words = words_of(pa.array(texts, pa.string()))
    shingles, bounds = shingles_of(words)
    item = np.repeat(np.arange(len(ids)), np.diff(bounds))
    weights = shingle_weights(words, bounds)
    lengths = np.diff(words.bounds)
    distinct, where = np.unique(shingles, return_inverse=True)
    base = int(lengths.max(initial=0)) + 1
    pairs = np.unique(where * base + lengths[item]) if len(where) else np.zeros(0, np.int64)
    sieve = np.zeros(1 << SIEVE_BITS, bool)
    sieve[distinct >> np.uint64(64 - SIEVE_BITS)] = True
    keys, counts = np.unique(pair_key(item, shingles), return_counts=True)
    prints = fingerprints(words.hashes, words.bounds[:-1], words.bounds[1:])
    flips = near_values()
    cells = (blocks_of(prints)[:, :, None] ^ flips).astype(np.int64) + (np.arange(BLOCKS) << BLOCK_BITS)[:, None]
    owners = np.broadcast_to(np.arange(len(ids))[:, None, None], cells.shape)
    return Items(
        ids,
        lengths,
        prints,
        np.bincount(item, weights, len(ids)),
        sieve,
        distinct,
        (np.searchsorted(pairs // base, np.arange(len(distinct) + 1)), pairs % base),
        keys,
        counts,
        grouped(cells.ravel(), owners.ravel(), BLOCKS << BLOCK_BITS),
    )


def windows(items: Items, words: Words, shingles: np.ndarray, bounds: np.ndarray, weights: np.ndarray, similarity: float):
    """Item-sized windows that can verify, in blocks, some twice: first word, end, text and item length of each."""
    hits = np.flatnonzero(items.sieve[shingles >> np.uint64(64 - SIEVE_BITS)])
    place = np.minimum(np.searchsorted(items.shingles, shingles[hits]), max(len(items.shingles) - 1, 0))
    real = items.shingles[place] == shingles[hits]
    hits, place = hits[real], place[real]
    text = np.searchsorted(bounds, hits, side="right") - 1
    upto = np.concatenate([[0], np.cumsum(weights)])
    known = np.zeros(len(weights), np.int64)
    known[hits] = weights[hits]
    known = np.concatenate([[0], np.cumsum(known)])
    for begin, end in runs(np.diff(items.shingle_lengths[0])[place], BLOCK_ROWS):
        at, which = ranges(items.shingle_lengths[0], place[begin:end])
        which += begin
        order = np.argsort(items.shingle_lengths[1][at], kind="stable")
        sizes, which = items.shingle_lengths[1][at][order], which[order]
        heads = np.flatnonzero(np.append(True, sizes[1:] != sizes[:-1]))
        for head, tail in zip(heads, np.append(heads[1:], len(sizes)), strict=True):
            size, hit = sizes[head], which[head:tail]
            span = max(1, size - SHINGLE + 1)
            first = bounds[:-1][text[hit]]
            last = np.maximum(first, bounds[1:][text[hit]] - span)
            low, high = np.clip(hits[hit] - span + 1, first, last), np.clip(hits[hit], first, last)
            # Both ends ascend with the hits, so each range begins behind the one before it.
            low[1:] = np.maximum(low[1:], high[:-1] + 1)
            counts = high - low + 1
            starts = np.arange(counts.sum()) + np.repeat(low - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts)
            owner = np.searchsorted(bounds, starts, side="right") - 1
            ends = np.minimum(starts + span, bounds[1:][owner])
            able = known[ends] - known[starts] >= similarity * (upto[ends] - upto[starts]) * (1 - 1e-12)
            able &= known[ends] > known[starts]
            yield starts[able], ends[able], owner[able], np.full(able.sum(), size)


def gathered(found: Iterator[tuple[np.ndarray, ...]], limit: int) -> Iterator[tuple[np.ndarray, ...]]:
    """The same rows of ``found`` in blocks of about ``limit``: small ones joined, large ones cut."""
    held, n = [], 0
    for block in found:
        for at in range(0, len(block[0]), limit):
            held.append(tuple(x[at : at + limit] for x in block))
            n += len(held[-1][0])
            if n >= limit:
                yield tuple(np.concatenate(x) for x in zip(*held, strict=True))
                held, n = [], 0
    if held:
        yield tuple(np.concatenate(x) for x in zip(*held, strict=True))


def shared_weights(items: Items, shingles: np.ndarray, weights: np.ndarray, starts: np.ndarray, ends: np.ndarray, item: np.ndarray) -> np.ndarray:
    """The weight that each window shares with its item, with multiplicity; windows ascend by item and start.

    Overlapping windows of an item are read as one stretch. A shingle's occurrence counts in the windows that reach it
    and begin behind the occurrence that is as many before it as the item has: a range of windows, and
    running sums over all ranges give every window's share, without reading a window again.
    """
    if not len(starts):
        return np.zeros(0)
    new = np.ones(len(starts), bool)
    furthest = np.maximum.accumulate(ends + item * (len(shingles) + 1))
    new[1:] = starts[1:] + item[1:] * (len(shingles) + 1) >= furthest[:-1]
    heads = np.flatnonzero(new)
    stretch = np.cumsum(new) - 1
    first, last = starts[heads], starts[np.append(heads[1:], len(starts)) - 1]
    limits = np.stack([first, np.maximum.reduceat(ends, heads)], axis=1).ravel()
    at, which = ranges(limits, np.arange(len(heads)) * 2)
    keys = pair_key(item[heads][which], shingles[at])
    place = np.minimum(np.searchsorted(items.pair_keys, keys), len(items.pair_keys) - 1)
    real = np.flatnonzero(items.pair_keys[place] == keys)
    real = real[np.lexsort((at[real], keys[real], which[real]))]
    at, which, keys, allowed = at[real], which[real], keys[real], items.pair_counts[place[real]]
    begins = np.ones(len(at), bool)
    begins[1:] = (keys[1:] != keys[:-1]) | (which[1:] != which[:-1])
    group = np.maximum.accumulate(np.where(begins, np.arange(len(at)), 0))
    earlier = np.arange(len(at)) - allowed
    behind = np.where(earlier >= group, at[np.maximum(earlier, 0)] + 1, 0)
    span = (ends - starts)[heads][which]
    low = np.maximum(np.maximum(at - span + 1, behind), first[which])
    high = np.minimum(at, last[which])
    good = low <= high
    # One place for each start of a stretch and one behind, where its ranges are closed.
    offset = np.concatenate([[0], np.cumsum(last - first + 2)])
    change = np.zeros(offset[-1], np.int64)
    np.add.at(change, offset[which[good]] + low[good] - first[which[good]], weights[at[good]])
    np.add.at(change, offset[which[good]] + high[good] + 1 - first[which[good]], -weights[at[good]])
    return np.cumsum(change)[offset[stretch] + starts - first[stretch]].astype(float)


def first_of_each(text: np.ndarray, item: np.ndarray, score: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of each text and item the window with the highest score, at last the earliest; ascending."""
    order = np.lexsort((first, -score, item, text))
    new = np.ones(len(order), bool)
    new[1:] = (text[order][1:] != text[order][:-1]) | (item[order][1:] != item[order][:-1])
    return tuple(x[order[new]] for x in (text, item, score, first, last))


def match(items: Items, texts: pa.Array, similarity: float) -> list[list[dict]]:
    """For each text the items found in it, each with its best window (word positions)."""
    out: list[list[dict]] = [[] for _ in range(len(texts))]
    words = words_of(texts)
    shingles, bounds = shingles_of(words)
    if not len(shingles) or not len(items.shingles):
        return out
    weights = shingle_weights(words, bounds)
    upto = np.concatenate([[0], np.cumsum(weights)])
    best = tuple(np.zeros(0, kind) for kind in (np.int64, np.int64, float, np.int64, np.int64))
    for starts, ends, text, size in gathered(windows(items, words, shingles, bounds, weights, similarity), BLOCK_ROWS // BLOCKS):
        first = starts - bounds[text] + words.bounds[text]
        last = np.minimum(first + size, words.bounds[text + 1])
        prints = fingerprints(words.hashes, first, last)
        cells = blocks_of(prints).astype(np.int64) + (np.arange(BLOCKS) << BLOCK_BITS)
        for begin, end in runs(np.diff(items.near[0])[cells].sum(axis=1), BLOCK_ROWS):
            at, which = ranges(items.near[0], cells[begin:end].ravel())
            item, window = items.near[1][at], begin + which // BLOCKS
            near = (items.lengths[item] == size[window]) & (np.bitwise_count(items.prints[item] ^ prints[window]) <= RADIUS)
            pairs = np.unique(window[near] * len(items.ids) + item[near])
            window, item = pairs // len(items.ids), pairs % len(items.ids)
            # Exact similarity: shingles of the window against those of the item, with multiplicity.
            order = np.lexsort((starts[window], item))
            window, item = window[order], item[order]
            shared = shared_weights(items, shingles, weights, starts[window], ends[window], item)
            both = upto[ends[window]] - upto[starts[window]] + items.weights[item]
            score = shared / (both - shared)
            good = np.flatnonzero(score >= similarity)
            found = text[window[good]], item[good], score[good], first[window[good]], last[window[good]]
            best = first_of_each(*(np.concatenate(x) for x in zip(best, found, strict=True)))
    for t, i, s, a, b in zip(*(x.tolist() for x in best), strict=True):
        begin = a - int(words.bounds[t])
        out[t].append({"item_id": items.ids[i], "similarity": s, "start": begin, "end": begin + b - a})
    return out


def slices(benchmark: DataFrame, slice_bytes: int = SLICE_BYTES) -> Iterator[Items]:
    """The benchmark's distinct items in indexes of about ``slice_bytes`` of text each, made one after the other."""
    rows = narrow(benchmark, item_id="long", text="string").where("text is not null").distinct()
    size = rows.agg(F.sum(F.octet_length("text")).alias("bytes")).first()["bytes"] or 0
    n = -(-size // slice_bytes)
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) if n else F.lit(0)
    for k in range(n):
        found = rows.where(part == k).orderBy("item_id", "text").toArrow().to_pydict()
        if found["text"]:
            yield index_items(found["item_id"], found["text"])


def find_items(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """The rows of ``docs`` with their benchmark items in an added last column ``matches``."""
    name = free_name(docs, "matches")
    out = docs.withColumn(name, F.array().cast(MATCHES))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields) + f", `{name}` {MATCHES}"
    for items in slices(benchmark, slice_bytes):
        sent = send(docs.sparkSession, items)

        def helper(batch: pa.RecordBatch, sent=sent) -> pa.RecordBatch:
            last = batch.num_columns - 1
            found = match(sent(), batch.column("text"), similarity)
            before = batch.column(last).to_pylist()
            both = pa.array([a + b for a, b in zip(before, found, strict=True)], batch.schema.field(last).type)
            return pa.RecordBatch.from_arrays([*batch.columns[:last], both], batch.schema.names)

        out = map_pieces(out, helper, schema)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The rows without a benchmark item."""
    found = find_items(docs, benchmark, similarity)
    name = found.columns[-1]
    return found.where(F.size(f"`{name}`") == 0).drop(name)

"""Language identification by prediction by partial matching (PPM, escape method C).

Each language has a tree of byte contexts up to ``ORDER`` bytes, counted on a bounded sample of
labelled texts and then frozen. A byte is coded in the longest context that was seen; a byte that
is new there costs the escape probability of that context and is coded one order lower, where the
bytes of the longer context are excluded; below order 0 all bytes left are equally likely. With
frozen counts a code length depends only on the byte and its context, so lengths are looked up
per distinct gram and summed over whole texts: exact, and linear in the text.

The prediction is the language with the shortest code. ``score`` is its posterior probability
under equal priors. Texts that are null or hold no letter are ``und`` with score 0, as is every
text if there is nothing to learn from. The posterior only compares the languages; whether any of them
explains a text is told by its bits per byte, which ``accepted`` bounds by what is usual in the language.
Empty tables give empty results; equal texts get equal
predictions; ties go to the smaller language code. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from headroom.llm.arrow import free_name, map_pieces, narrow, pieces, send, utf8
from headroom.operators.quantile import order_statistic
from headroom.sources.shared import cut_lineage

ORDER = 3
#: About how many bytes of labelled text the trees are counted on, shared evenly by the languages.
TRAIN_BYTES = 24 << 20
#: A text is not explained if its code is longer than EXCESS times the usual rate of its language and START bits.
EXCESS, START = 3.0, 32
UNKNOWN = "und"
SLOT_BITS = 20


@dataclass
class Tree:
    """One language. Lists run over the orders 0 to ORDER; keys ascend."""

    symbols: list[np.ndarray]  # context bytes and next byte as one number
    counts: list[np.ndarray]
    contexts: list[np.ndarray]
    totals: list[np.ndarray]  # of a context: occurrences, and distinct next bytes
    distinct: list[np.ndarray]
    left_totals: list[np.ndarray]  # the same for the next shorter context, less what this one has seen
    left_distinct: list[np.ndarray]


@dataclass
class Model:
    languages: list[str]
    trees: list[Tree]
    grams: np.ndarray  # known grams, ascending
    bits: np.ndarray  # code length by gram and language
    slots: np.ndarray  # a hash table of positions in grams


def grams_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Every byte with the ORDER bytes before it as one number, and the bounds of the texts; line feeds precede a text."""
    raw, bounds = utf8(texts)
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    at = np.arange(len(raw)) + ORDER * (text + 1)
    padded = np.full(len(raw) + ORDER * (len(bounds) - 1), 10, np.uint32)
    padded[at] = raw
    grams = np.zeros(len(raw), np.uint32)
    for back in range(ORDER, -1, -1):
        grams = grams << np.uint32(8) | padded[at - back]
    return grams, bounds


def find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions in ascending ``keys``, and whether they hold what is wanted."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


def grow(grams: np.ndarray, counts: np.ndarray) -> Tree:
    tree = Tree([], [], [], [], [], [], [])
    for order in range(ORDER + 1):
        symbols, where = np.unique(grams & np.uint32((1 << 8 * (order + 1)) - 1) if order < 3 else grams, return_inverse=True)
        times = np.bincount(where, counts, len(symbols))
        contexts, of = np.unique(symbols >> np.uint32(8), return_inverse=True)
        tree.symbols.append(symbols)
        tree.counts.append(times)
        tree.contexts.append(contexts)
        tree.totals.append(np.bincount(of, times, len(contexts)))
        tree.distinct.append(np.bincount(of, minlength=len(contexts)).astype(float))
        if order == 0:
            tree.left_totals.append(np.zeros(len(contexts)))
            tree.left_distinct.append(256 - tree.distinct[0])
            continue
        keep = np.uint32((1 << 8 * (order - 1)) - 1)
        shorter, _ = find(tree.contexts[order - 1], contexts & keep)
        lower, _ = find(tree.symbols[order - 1], (symbols >> np.uint32(8) & keep) << np.uint32(8) | symbols & np.uint32(255))
        seen = np.bincount(of, tree.counts[order - 1][lower], len(contexts))
        tree.left_totals.append(tree.totals[order - 1][shorter] - seen)
        tree.left_distinct.append(tree.distinct[order - 1][shorter] - tree.distinct[order])
    return tree


def code_bits(tree: Tree, grams: np.ndarray) -> np.ndarray:
    """The exact code length of each gram's last byte after the bytes before it."""
    bits = np.zeros(len(grams))
    open_ = np.arange(len(grams))
    total = distinct = np.full(len(grams), np.nan)  # nan: no longer context was seen, so none limits this one
    total, distinct = total.copy(), distinct.copy()
    for order in range(ORDER, -1, -1):
        own = grams[open_] if order == 3 else grams[open_] & np.uint32((1 << 8 * (order + 1)) - 1)
        context, known = find(tree.contexts[order], own >> np.uint32(8))
        symbol, seen = find(tree.symbols[order], own)
        fresh = known & np.isnan(total[open_])
        total[open_[fresh]] = tree.totals[order][context[fresh]]
        distinct[open_[fresh]] = tree.distinct[order][context[fresh]]
        weight = total[open_] + distinct[open_]
        bits[open_[seen]] -= np.log2(tree.counts[order][symbol[seen]] / weight[seen])
        escape = known & ~seen & (weight > 0)
        bits[open_[escape]] -= np.log2(distinct[open_[escape]] / weight[escape])
        down = open_[known & ~seen]
        total[down] = tree.left_totals[order][context[known & ~seen]]
        distinct[down] = tree.left_distinct[order][context[known & ~seen]]
        open_ = open_[~seen]
    bits[open_] += np.log2(np.where(np.isnan(distinct[open_]), 256, np.maximum(distinct[open_], 1)))
    return bits


def slot_of(grams: np.ndarray) -> np.ndarray:
    return (grams * np.uint32(0x9E3779B1)) >> np.uint32(32 - SLOT_BITS)


def build(languages: list[str], counted: list[tuple[np.ndarray, np.ndarray]]) -> Model:
    trees = [grow(grams, counts) for grams, counts in counted]
    known = np.unique(np.concatenate([t.symbols[ORDER] for t in trees])) if trees else np.zeros(0, np.uint32)
    bits = np.stack([code_bits(t, known) for t in trees], axis=1) if trees else np.zeros((0, 0))
    slots = np.zeros(1 << SLOT_BITS, np.int32)
    slots[slot_of(known)] = np.arange(len(known))
    return Model(languages, trees, known, bits, slots)


def code_lengths(model: Model, texts: pa.Array) -> np.ndarray:
    """Bits of each whole text under each language."""
    grams, bounds = grams_of(texts)
    out = np.zeros((len(texts), len(model.languages)))
    if not len(grams) or not len(model.grams):
        return out
    at = model.slots[slot_of(grams)]
    missed = np.flatnonzero(model.grams[at] != grams)
    place, hit = find(model.grams, grams[missed])
    at[missed] = place
    new, which = np.unique(grams[missed[~hit]], return_inverse=True)
    full = np.flatnonzero(np.diff(bounds))
    for k, tree in enumerate(model.trees):
        each = model.bits[:, k][at]
        each[missed[~hit]] = code_bits(tree, new)[which]
        out[full, k] = np.add.reduceat(each, bounds[:-1][full])
    return out


def has_letter(text: str | None) -> bool:
    return text is not None and any(c.isalpha() for c in text)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def sampled(labelled: DataFrame, train_bytes: int) -> DataFrame | None:
    """Labelled texts of about ``train_bytes`` bytes: an even share per language, picked by hash. None without any."""
    labelled = labelled.where(F.col("text").isNotNull() & F.col("lang").isNotNull())
    sizes = labelled.groupBy("lang").agg(F.sum(F.octet_length("text")).alias("bytes")).toArrow().to_pydict()
    if not sizes["lang"]:
        return None
    share = train_bytes / len(sizes["lang"])
    shares = F.create_map(*[F.lit(x) for lang, n in zip(sizes["lang"], sizes["bytes"], strict=True) for x in (lang, min(1.0, share / max(n, 1)))])
    draw = F.shiftrightunsigned(F.xxhash64("doc_id", "text"), 11) / float(1 << 53)
    return labelled.where(draw < shares[F.col("lang")]).select("doc_id", "lang", "text")


def learn(docs: DataFrame, train_bytes: int = TRAIN_BYTES) -> Model:
    """Trees of all languages among the labelled texts that are not held out.

    At most about ``train_bytes`` bytes are counted: an even share per language, picked by hash.
    """
    labelled = narrow(docs, doc_id="long", lang="string", text="string")
    sample = sampled(labelled.where(~held_out(F.col("doc_id"))), train_bytes)
    if sample is None:
        return build([], [])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, to in pieces(batch.column("text")):
                langs, texts = batch.column("lang").slice(at, to - at), batch.column("text").slice(at, to - at)
                for lang in langs.unique().to_pylist():
                    grams, times = np.unique(grams_of(texts.filter(pa.compute.equal(langs, lang)))[0], return_counts=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * len(grams), pa.string()), pa.array(grams.astype(np.int64)), pa.array(times.astype(np.int64))],
                        ["lang", "gram", "n"],
                    )

    counted = sample.select("lang", "text").mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    found = counted.toArrow()
    languages = sorted(pa.compute.unique(found["lang"]).to_pylist())
    parts = [found.filter(pa.compute.equal(found["lang"], lang)) for lang in languages]
    return build(languages, [(p["gram"].to_numpy().astype(np.uint32), p["n"].to_numpy().astype(float)) for p in parts])


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` (all columns) with lang_pred, score and bits_per_byte."""
    names = [free_name(docs, n) for n in ("lang_pred", "score", "bits_per_byte")]
    sent = send(docs.sparkSession, model)

    def helper(batch: pa.RecordBatch) -> pa.RecordBatch:
        model, texts = sent(), batch.column("text")
        bits = code_lengths(model, texts)
        letters = np.fromiter((has_letter(t.as_py()) for t in texts), bool, len(texts))
        if model.languages:
            best = bits.argmin(axis=1)
            shortest = bits.min(axis=1)
            score = np.where(letters, 1 / np.exp2(np.maximum(shortest[:, None] - bits, -1000)).sum(axis=1), 0.0)
            pred = [model.languages[k] if ok else UNKNOWN for k, ok in zip(best, letters, strict=True)]
            size = np.maximum(pa.compute.fill_null(pa.compute.binary_length(texts), 0).to_numpy(zero_copy_only=False), 1)
            rate = shortest / size
        else:
            pred, score, rate = [UNKNOWN] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(pred, pa.string()), pa.array(score), pa.array(rate)], [*batch.schema.names, *names])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return map_pieces(docs, helper, f"{kinds}, {names[0]} string, {names[1]} double, {names[2]} double")


def identify(docs: DataFrame, train_bytes: int = TRAIN_BYTES) -> DataFrame:
    """doc_id, held_out, lang_pred, score, bits_per_byte for every row; learned from the rows not held out."""
    model = learn(docs, train_bytes)
    texts = narrow(docs, doc_id="long", text="string")
    found = predict(texts, model)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "bits_per_byte")


def usual_rates(docs: DataFrame, model: Model) -> dict[str, float]:
    """The lower median of the bits per byte of all labelled texts, by the language that they are predicted to be in.

    Held-out texts count, as others are part of the trees; these stand in where a language has no held-out text.
    """
    if not model.languages:
        return {}
    labelled = narrow(docs, doc_id="long", lang="string", text="string").where("text is not null and lang is not null")
    found = predict(labelled, model).where("lang_pred = lang")
    found = cut_lineage(found.select("lang", held_out(F.col("doc_id")).alias("own"), "bits_per_byte"), "rates")
    middle = F.floor((F.col("n") + 1) / 2).cast("long")
    rates = order_statistic(found, ["lang", "own"], "bits_per_byte", middle, middle, "rate")
    return {r.lang: r.rate for r in rates.orderBy("own").collect()}


def accepted(docs: DataFrame, least_score: float = 0.5, train_bytes: int = TRAIN_BYTES) -> DataFrame:
    """The rows whose language is recognised: texts without a letter, undecided ones and those that no language explains go.

    Unexplained are junk letters, encoded data, code and languages without a label: their code is longer than
    EXCESS times what is usual in the best language. That tells no near relatives apart: a language without a label
    that shares most of its letter sequences with a learned one (Dutch with German, Catalan with Spanish) stays.
    """
    model = learn(docs, train_bytes)
    usual = usual_rates(docs, model)
    found = predict(docs, model)
    pred, score, rate = found.columns[-3:]
    known = (F.col(pred) != UNKNOWN) & (F.col(score) >= least_score)
    if usual:
        limit = F.create_map(*[F.lit(x) for lang in sorted(usual) for x in (lang, EXCESS * usual[lang])])[F.col(pred)]
        size = F.octet_length("text")
        known &= F.coalesce(F.col(rate) * size <= limit * size + START, F.lit(True))
    return found.where(known).drop(pred, score, rate)

"""License scans by ordered signature rules.

Texts are reduced to words in lower case with one space before each. An Aho-Corasick automaton over the
rules' keywords finds, in one pass over a piece, which texts could match which rules; only those are
searched, with a few hundred regular expressions. Of detections that overlap, one that lies inside
another of higher priority goes: first by kind (tag, text, link, name, mention), then the longer one, then the
earlier rule. Phrases are found beside the rules and always stay.

A word is a run of digits, letters and characters outside ASCII; only A-Z are lowered. Places count words
from 0, the end exclusive. A null text is empty and has no detections; an empty table gives no rows,
equal rows give equal rows, other columns are ignored. Texts are read whole, however long.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from headroom.llm.arrow import map_pieces, narrow, utf8
from headroom.llm.license_rules import KINDS, RULES, Rule
from headroom.llm.words import IN_WORD

#: Label of each phrase whose words are looked for one after the other.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
PLACE = "struct<label:string,start:long,end:long>"
FOUND = "struct<label:string,kind:string,certainty:double,start:long,end:long>"


def normalized(texts: pa.Array) -> tuple[bytes, np.ndarray, np.ndarray]:
    """All words of all texts, each after a space; where each text begins and ends; where each word's space is."""
    raw, bounds = utf8(texts)
    lower = np.arange(256, dtype=np.uint8)
    lower[65:91] += 32
    raw = lower[raw]
    inside = IN_WORD[raw]
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    begins = bounds[:-1][bounds[:-1] < len(raw)]
    starts[begins] = inside[begins]
    # Where each byte goes: the bytes kept before it, and a space for each word begun so far.
    to = np.cumsum(inside) + np.cumsum(starts) - 1
    out = np.full(int(inside.sum() + starts.sum()), 32, np.uint8)
    out[to[inside]] = raw[inside]
    return out.tobytes(), np.concatenate([[0], to + 1])[bounds], to[starts] - 1


def automaton(rules: Sequence[Rule], phrases: Mapping[str, str]):
    """Keyword -> the numbers of the rules it gates; phrases are numbered behind the rules."""
    import ahocorasick

    gated: dict[str, list[int]] = {}
    for i, keyword in enumerate([rule.keyword for rule in rules] + list(phrases)):
        gated.setdefault(keyword, []).append(i)
    found = ahocorasick.Automaton()
    for keyword, numbers in gated.items():
        found.add_word(keyword, tuple(numbers))
    found.make_automaton()
    return found


def whole_words(pattern: str) -> re.Pattern[bytes]:
    return re.compile(rb"(?<= )(?:" + pattern.encode() + rb")(?![^ ])")


def places_of(phrase: str) -> re.Pattern[bytes]:
    """Matches nothing, at every place where the phrase begins, so that places may overlap."""
    return re.compile(rb"(?<= )(?=" + re.escape(phrase.encode()) + rb"(?![^ ]))")


def suppressed(rank: np.ndarray, order: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Which detections lie inside one that comes first: of lower rank, or of the same rank and longer, or earlier in ``order``.

    For each rank the furthest end of all detections that begin at or before a place tells it without comparing pairs.
    """
    out = np.zeros(len(rank), bool)
    for level in np.unique(rank):
        own = np.flatnonzero(rank == level)
        own = own[np.lexsort((order[own], -end[own], start[own]))]
        reach = np.maximum.accumulate(end[own])
        # In this order whatever holds a detection of the same rank stands before it.
        out[own[1:]] |= reach[:-1] >= end[own[1:]]
        below = np.flatnonzero(rank > level)
        at = np.searchsorted(start[own], start[below], side="right") - 1
        out[below] |= (at >= 0) & (reach[at] >= end[below])
    return out


def scan(docs: DataFrame, rules: Sequence[Rule] = RULES, phrases: Mapping[str, str] = PHRASES) -> DataFrame:
    """doc_id, n_words, places (of phrases), detections (by start): label, start, end, and kind and certainty of detections."""
    rules, phrases = tuple(rules), dict(phrases)
    ranks, labels = np.array([list(KINDS).index(rule.kind) for rule in rules]), list(phrases.values())
    made: list = []

    def candidates(text: bytes, bounds: np.ndarray) -> dict[int, set[int]]:
        """text number -> numbers of the rules and phrases whose keyword it has."""
        found: dict[int, set[int]] = {}
        ends = bounds[1:]
        # One character for each byte, so that places are places in the bytes.
        for last, numbers in made[0].iter(text.decode("latin-1")):
            found.setdefault(int(np.searchsorted(ends, last, side="right")), set()).update(numbers)
        return found

    def helper(batch: pa.RecordBatch) -> pa.RecordBatch:
        if not made:
            made.extend([automaton(rules, phrases), [whole_words(rule.pattern) for rule in rules], [places_of(p) for p in phrases]])
        _, patterns, literal = made
        text, bounds, spaces = normalized(batch.column("text"))
        first = np.searchsorted(spaces, bounds)
        places: list[list[dict]] = [[] for _ in range(batch.num_rows)]
        detections: list[list[dict]] = [[] for _ in range(batch.num_rows)]
        for i, numbers in candidates(text, bounds).items():
            own, words = text[bounds[i] : bounds[i + 1]], spaces[first[i] : first[i + 1]] - bounds[i]
            hits: list[tuple[int, int, int]] = []
            for number in sorted(numbers):
                if number >= len(rules):
                    size = len(list(phrases)[number - len(rules)].split())
                    at = np.searchsorted(words, [m.start() for m in literal[number - len(rules)].finditer(own)])
                    places[i] += [{"label": labels[number - len(rules)], "start": s - 1, "end": s - 1 + size} for s in at.tolist()]
                else:
                    hits += [(number, m.start(), m.end()) for m in patterns[number].finditer(own) if m.end() > m.start()]
            if hits:
                order, start, end = (np.array(c) for c in zip(*hits, strict=True))
                rank = ranks[order]
                kept = np.flatnonzero(~suppressed(rank, order, start, end))
                kept = kept[np.lexsort((order[kept], end[kept], start[kept]))]
                begin, stop = np.searchsorted(words, start[kept]) - 1, np.searchsorted(words, end[kept])
                for number, s, e in zip(order[kept].tolist(), begin.tolist(), stop.tolist(), strict=True):
                    rule = rules[number]
                    detections[i].append({"label": rule.label, "kind": rule.kind, "certainty": KINDS[rule.kind], "start": s, "end": e})
            places[i].sort(key=lambda p: (p["start"], p["label"]))
        place = pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
        found = pa.struct([("label", pa.string()), ("kind", pa.string()), ("certainty", pa.float64()), ("start", pa.int64()), ("end", pa.int64())])
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(np.diff(first)), pa.array(places, pa.list_(place)), pa.array(detections, pa.list_(found))],
            ["doc_id", "n_words", "places", "detections"],
        )

    return map_pieces(narrow(docs, doc_id="long", text="string"), helper, f"doc_id long, n_words long, places array<{PLACE}>, detections array<{FOUND}>")


def joined_labels(labels: Column) -> Column:
    return F.concat_ws(",", F.sort_array(F.array_distinct(labels)))


def digest(found: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels and score: the most certain of all that was found."""
    phrase = F.when(F.size("places") > 0, F.lit(KINDS["mention"])).otherwise(F.lit(0.0))
    return found.select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min("places.start").alias("first_word"),
        F.array_max("places.start").alias("last_word"),
        joined_labels(F.col("places.label")).alias("base_labels"),
        joined_labels(F.concat("places.label", "detections.label")).alias("labels"),
        F.greatest(phrase, F.coalesce(F.array_max("detections.certainty"), F.lit(0.0))).alias("score"),
    )

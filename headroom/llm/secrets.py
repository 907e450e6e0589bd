"""Secret scans through a trigram inverted index.

Each rule is a regular expression. A Boolean query over trigrams follows from it: whatever the
rule matches contains those trigrams. Texts are indexed in segments (pieces of a Spark
partition): a posting list per trigram, over the trigrams that some rule asks for. A rule's query
intersects and unites posting lists, and only texts that remain are searched with the rule. Rules
without a mandatory trigram scan every text of the segment. A segment's index lives in the task
that reads its texts, so nothing is shuffled, however often a trigram or a text repeats.

Nulls count as empty texts and give no spans; an empty table gives no rows. Offsets are code
points, the end exclusive. Equal rows give equal rows. Columns but doc_id and text are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from re import _parser as parser

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from headroom.llm.arrow import map_pieces, narrow, utf8

#: Alternatives that are spelled out before a part of a rule counts as unknown.
MAX_EXACT = 64
SPANS = "array<struct<kind:string,start:int,end:int>>"


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    keep: Callable[[re.Match], bool] | None = None


#: The rules every result has; a failing match is dropped and the search goes on behind it.
BASE_RULES = (
    Rule(
        "assign",
        r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        lambda m: len(m[2]) >= 6,
    ),
    Rule("access", r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20),
    Rule("hex", r"[0-9a-f]{24,}"),
)
#: Further kinds with a form of their own.
MORE_RULES = (
    Rule("github", r"gh[oprsu]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("pem", r"-----BEGIN (?:(?!PRIVATE KEY-)[A-Z]++ )*+PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("bearer", r"(?ai:bearer)\x20+[A-Za-z0-9._~+/-]{20,}"),
    Rule("login", r"://[^\s/:@]++:[^\s/@]++@"),
    Rule("google", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("stripe", r"[rs]k_live_[A-Za-z0-9]{16,}"),
)
RULES = BASE_RULES + MORE_RULES

#: A query is True (every text), a trigram, or ("and" | "or", parts).
Query = bool | bytes | tuple


def both(parts: Sequence[Query]) -> Query:
    parts = [p for p in dict.fromkeys(parts) if p is not True]
    return True if not parts else parts[0] if len(parts) == 1 else ("and", tuple(parts))


def either(parts: Sequence[Query]) -> Query:
    """One of the parts; a part that only asks for more than another one is left out."""
    sets = {p: trigrams(p) for p in dict.fromkeys(parts) if isinstance(p, bytes) or p is not True and p[0] == "and"}
    parts = [p for p in dict.fromkeys(parts) if not any(p in sets and other < sets[p] for other in sets.values())]
    return True if not parts or True in parts else parts[0] if len(parts) == 1 else ("or", tuple(parts))


def of_strings(strings: frozenset[bytes]) -> Query:
    """Holds for every text with one of the strings in it."""
    return either([both([s[i : i + 3] for i in range(len(s) - 2)]) for s in sorted(strings)])


def fold(char: int) -> bytes:
    return chr(char).lower().encode() if char < 128 else chr(char).encode()


def derive(nodes) -> tuple[frozenset[bytes] | None, Query]:
    """The strings a parsed expression can match (None: too many) and its trigram query."""
    query: list[Query] = []
    run: frozenset[bytes] = frozenset([b""])
    exact = True
    for op, arg in nodes:
        strings, inner = derive_one(op, arg)
        joined = frozenset(a + b for a in run for b in strings) if strings is not None else None
        if joined is not None and len(joined) <= MAX_EXACT:
            run = joined
            continue
        query += [of_strings(run), inner if strings is None else of_strings(strings)]
        run, exact = frozenset([b""]), False
    return (run, of_strings(run)) if exact else (None, both([*query, of_strings(run)]))


def derive_one(op, arg) -> tuple[frozenset[bytes] | None, Query]:
    empty = frozenset([b""])
    if op is parser.LITERAL:
        return frozenset([fold(arg)]), True
    if op is parser.IN and all(kind is parser.LITERAL for kind, _ in arg):
        return frozenset(fold(c) for _, c in arg), True
    if op is parser.SUBPATTERN:
        return derive(arg[-1])
    if op is parser.BRANCH:
        found = [derive(branch) for branch in arg[1]]
        if all(strings is not None for strings, _ in found):
            union = frozenset().union(*(strings for strings, _ in found))
            return (union if len(union) <= MAX_EXACT else None), of_strings(union)
        return None, either([inner for _, inner in found])
    if op in (parser.MAX_REPEAT, parser.MIN_REPEAT, parser.POSSESSIVE_REPEAT):
        least, most, body = arg
        strings, inner = derive(body)
        if (least, most) == (0, 1) and strings is not None:
            return strings | empty, True
        if 0 < least == most <= 8:
            return derive(list(body) * least)
        return None, (inner if strings is None else of_strings(strings)) if least else True
    if op is parser.AT:
        return empty, True
    return None, True


def trigram_query(pattern: str) -> Query:
    return derive(parser.parse(pattern))[1]


def trigrams(query: Query) -> set[bytes]:
    if isinstance(query, tuple):
        return set().union(*map(trigrams, query[1]))
    return {query} if isinstance(query, bytes) else set()


def codes(grams: Sequence[bytes]) -> np.ndarray:
    return np.array([g[0] << 16 | g[1] << 8 | g[2] for g in grams], np.int64)


def postings(texts: pa.Array, grams: Sequence[bytes]) -> dict[bytes, np.ndarray]:
    """For each trigram the texts that hold it, ascending; letters A-Z count as a-z."""
    raw, bounds = utf8(texts)
    if len(raw) < 3 or not grams:
        return {g: np.zeros(0, np.int64) for g in grams}
    low = np.arange(256, dtype=np.int32)
    low[65:91] += 32
    raw = low[raw]
    wanted = np.zeros(1 << 24, np.uint16)
    wanted[codes(grams)] = np.arange(1, len(grams) + 1)
    found = wanted[raw[:-2] << 16 | raw[1:-1] << 8 | raw[2:]]
    at = np.flatnonzero(found)
    text = np.searchsorted(bounds, at, side="right") - 1
    whole = at + 3 <= bounds[text + 1]
    pairs = np.unique(found[at[whole]].astype(np.int64) << 32 | text[whole])
    gram = pairs >> 32
    return {g: pairs[np.searchsorted(gram, i) : np.searchsorted(gram, i, side="right")] & 0xFFFFFFFF for i, g in enumerate(grams, 1)}


def candidates(query: Query, index: dict[bytes, np.ndarray], every: np.ndarray) -> np.ndarray:
    """The texts of a segment for which the query holds."""
    if query is True:
        return every
    if isinstance(query, bytes):
        return index[query]
    kind, parts = query
    found = [candidates(p, index, every) for p in parts]
    combine = np.intersect1d if kind == "and" else np.union1d
    if kind == "and":
        found.sort(key=len)
    out = found[0]
    for other in found[1:]:
        out = combine(out, other)
    return out


def scan(docs: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """doc_id, spans: kind, start, end of every secret, by start and then in the order of the rules."""
    queries = [trigram_query(rule.pattern) for rule in rules]
    grams = sorted(set().union(*map(trigrams, queries)))

    def helper(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column("text")
        index = postings(texts, grams)
        every = np.arange(batch.num_rows)
        spans: list[list[tuple[int, int, str, int]]] = [[] for _ in range(batch.num_rows)]
        for place, (rule, query) in enumerate(zip(rules, queries, strict=True)):
            find = re.compile(rule.pattern).finditer
            for i in candidates(query, index, every).tolist():
                for m in find(texts[i].as_py() or ""):
                    if rule.keep is None or rule.keep(m):
                        spans[i].append((m.start(), place, rule.kind, m.end()))
        rows = [[{"kind": kind, "start": start, "end": end} for start, _, kind, end in sorted(found)] for found in spans]
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(rows, kind)], ["doc_id", "spans"])

    return map_pieces(narrow(docs, doc_id="long", text="string"), helper, f"doc_id long, spans {SPANS}")


def joined_spans(spans: Column) -> Column:
    """kind:start:end, joined by commas."""
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))


def digest(found: DataFrame, base: Sequence[str]) -> DataFrame:
    """doc_id, a count per base kind, SHA-256 of the base spans, and all spans as text."""
    def of(*kinds: str) -> Column:
        return F.filter("spans", lambda s: s["kind"].isin(*kinds))

    return found.select(
        "doc_id",
        *[F.size(of(kind)).cast("long").alias(f"n_{kind}") for kind in base],
        F.sha2(joined_spans(of(*base)), 256).alias("base_sha256"),
        joined_spans(F.col("spans")).alias("spans"),
    )

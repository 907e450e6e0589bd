"""Personal data: four fixed patterns, and a semi-Markov conditional random field that adds spans.

The patterns (email, ip, card, phone) are searched leftmost and non-overlapping per kind; a match
that fails its check is dropped. Those base spans are always in the result.

The model segments islands: runs of space-separated chunks that hold a digit or an at sign. A
segment is one token outside any entity, or up to ``MAX_TOKENS`` tokens as an entity of a kind,
scored by features of the whole span (shape, digit groups, checksum, octets, separators, and what
stands beside it). Forward-backward over segmentations gives the likelihood's gradient in training;
Viterbi chooses boundaries and kinds together. It is trained on the islands of a bounded sample of
texts, labelled by the base patterns, together with rewritten forms that the patterns miss (a phone
without its plus, a spelled-out at sign) and broken ones that are none (a wrong check digit, an octet
above 255). An entity must raise a segmentation's score by ``MARGIN``; those that touch no base span are added.

Nulls count as empty texts and have no spans; an empty table gives no rows and an untrained model
adds nothing. Offsets are code points, the end exclusive. Equal rows give equal rows. Columns but
doc_id and text are ignored by ``scan`` and kept by ``redact``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from headroom.llm.arrow import map_pieces, narrow, send

KINDS = ("email", "ip", "card", "phone")
SPANS = "array<struct<kind:string,start:int,end:int>>"
SPAN_TYPE = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
#: Texts and islands that the model is trained on at most, picked by hash, and the longest island among them.
TRAIN_DOCS, TRAIN_ISLANDS, TRAIN_CHARS = 20_000, 600, 400
MAX_TOKENS = 14
MARGIN = 1.0
ROUNDS = 8
#: What a feature costs that training has never met.
UNSEEN = 1.0

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
NOT_DIGIT = re.compile(r"[^0-9]+")
#: Whatever a span of either way holds; most texts have none of it.
POSSIBLE = re.compile(r"[0-9@\[(]")
TRIGGER = re.compile(r"[0-9@]+|[\[(](?:at|AT)[\])]")
TOKEN = re.compile(r"[A-Za-z]+|[0-9]+|.", re.DOTALL)
AT = re.compile(r"@|[\[(](?:at|AT)[\])]")


def luhn(digits: str) -> bool:
    total = sum(int(d) for d in digits[::-2])
    return (total + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """From each at sign back over its local part and on over its domain: the leftmost matches, in linear time."""
    free = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        domain = DOMAIN.match(text, at + 1) if start < at else None
        # What lies before this at sign can be part of no later match.
        free = at + 1
        if domain:
            yield start, domain.end()
            free = domain.end()
        at = text.find("@", free)


def base_spans(text: str) -> list[tuple[int, int, str, int]]:
    """start, place of the kind, kind, end; ascending."""
    if not POSSIBLE.search(text):
        return []
    spans = [(start, 0, "email", end) for start, end in emails(text)] if "@" in text else []
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in m[0].split(".")):
            spans.append((m.start(), 1, "ip", m.end()))
    for m in CARD.finditer(text):
        digits = NOT_DIGIT.sub("", m[0])
        if 12 <= len(digits) <= 19 and luhn(digits):
            spans.append((m.start(), 2, "card", m.end()))
    for m in PHONE.finditer(text):
        if 9 <= len(NOT_DIGIT.sub("", m[0])) <= 15:
            spans.append((m.start(), 3, "phone", m.end()))
    return sorted(spans)


def islands(text: str) -> Iterator[tuple[int, int]]:
    """Runs of chunks with a trigger, joined over single spaces, that could hold an entity."""
    start = end = -1
    for m in TRIGGER.finditer(text):
        if m.start() < end:
            continue
        a, b = m.start(), m.end()
        while a > max(end, 0) and not text[a - 1].isspace():
            a -= 1
        while b < len(text) and not text[b].isspace():
            b += 1
        if a - end == 1 and text[end : a] == " " and start >= 0:
            end = b
            continue
        if start >= 0 and able(text[start:end]):
            yield start, end
        start, end = a, b
    if start >= 0 and able(text[start:end]):
        yield start, end


def able(span: str) -> bool:
    """Whether the span has an at sign, the digits of a number, or the parts of an address."""
    digits = len(NOT_DIGIT.sub("", span))
    return digits >= 9 or digits >= 4 and span.count(".") >= 3 or AT.search(span) is not None


@dataclass
class Field:
    """Feature weights, one row per feature, one column per kind."""

    places: dict[str, int]
    weights: np.ndarray


def features(span: str, left: str, right: str) -> list[str]:
    digits = NOT_DIGIT.sub("", span)
    groups = [g for g in NOT_DIGIT.split(span) if g]
    shape = re.sub(r"0+", "0", re.sub(r"[0-9]", "0", re.sub(r"[A-Za-z]+", "a", AT.sub("@", span))))
    out = [
        "any",
        f"shape {shape}" if len(shape) <= 24 else "long",
        f"digits {len(digits)}",
        f"groups {'-'.join(str(len(g)) for g in groups)}" if len(groups) <= 5 else "many groups",
        f"others {''.join(sorted(set(re.sub(r'[A-Za-z0-9]', '', span))))}",
        f"left {kind_of(left)}",
        f"right {kind_of(right)}",
        f"begins {kind_of(span[0])}",
        f"ends {kind_of(span[-1])}",
        f"ats {len(AT.findall(span))}",
        f"letters {bool(re.search('[A-Za-z]', span))}",
    ]
    if 12 <= len(digits) <= 19:
        out.append(f"luhn {luhn(digits)}")
    if len(groups) == 4 and span.count(".") == 3:
        out.append(f"octets {all(len(g) <= 3 and int(g) <= 255 for g in groups)}")
    return out


def kind_of(char: str) -> str:
    return "0" if char.isdigit() else "a" if char.isalpha() else char or "edge"


def candidates(island: str, left: str, right: str) -> tuple[list[int], list[tuple[int, int, list[str]]]]:
    """Token bounds, and the segments (first token, end token, features) that may be entities."""
    bounds = [0, *(m.end() for m in TOKEN.finditer(island))]
    out = []
    for i in range(len(bounds) - 1):
        if not (island[bounds[i]].isalnum() or island[bounds[i]] in "+("):
            continue
        for j in range(i + 1, min(i + MAX_TOKENS, len(bounds) - 1) + 1):
            span = island[bounds[i] : bounds[j]]
            if span[-1].isalnum() and able(span):
                before = island[bounds[i] - 1] if i else left
                after = island[bounds[j]] if j < len(bounds) - 1 else right
                out.append((i, j, features(span, before, after)))
    return bounds, out


def forward(n: int, segments: Sequence[tuple[int, int]], scores: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Marginal probability of each (segment, kind); log sums over the segmentations before and after."""
    best = scores.max(axis=1)
    each = best + np.log(np.exp(scores - best[:, None]).sum(axis=1))
    alpha, beta = np.zeros(n + 1), np.zeros(n + 1)
    ends: list[list[int]] = [[] for _ in range(n + 1)]
    starts: list[list[int]] = [[] for _ in range(n + 1)]
    for s, (i, j) in enumerate(segments):
        ends[j].append(s)
        starts[i].append(s)
    for t in range(1, n + 1):
        alpha[t] = np.logaddexp.reduce([alpha[t - 1], *(alpha[segments[s][0]] + each[s] for s in ends[t])])
    for t in range(n - 1, -1, -1):
        beta[t] = np.logaddexp.reduce([beta[t + 1], *(beta[segments[s][1]] + each[s] for s in starts[t])])
    inside = np.array([alpha[i] + beta[j] for i, j in segments]) - alpha[n]
    return np.exp(scores + inside[:, None]), alpha, alpha[n]


def rewritten(island: str, gold: tuple[int, int, str]) -> list[tuple[str, tuple[int, int, str] | None]]:
    """The island with its entity in other forms, and in forms that are no entity (None)."""
    start, end, kind = gold
    span = island[start:end]

    def put(new: str, entity: bool = True):
        return island[:start] + new + island[end:], (start, start + len(new), kind) if entity else None

    if kind == "phone":
        rest = span.lstrip("+")
        local = re.sub(r"^\+[0-9]{1,3}[ .-]", "", span)
        short = [put(local)] if len(NOT_DIGIT.sub("", local)) >= 9 else []
        return [*short, put("00" + rest), put("00 " + rest), put("+" + NOT_DIGIT.sub("", rest) * 2, False)]
    if kind == "email":
        return [put(span.replace("@", a, 1)) for a in ("[at]", "(at)")] + [put(span.replace(".", "").replace("@", "."), False)]
    if kind == "card":
        digits = NOT_DIGIT.sub("", span)
        wrong = digits[:-1] + str((int(digits[-1]) + 1) % 10)
        if len(digits) != 16:
            return [put(wrong, False)]
        parts = [digits[k : k + 4] for k in range(0, 16, 4)]
        return [put(".".join(parts)), put("/".join(parts)), put(wrong, False), put(" ".join(wrong[k : k + 4] for k in range(0, 16, 4)), False)]
    parts = span.split(".")
    return [put(".".join([*parts[:3], "999"]), False), put("[.]".join(parts))]


def train(rows: Sequence[tuple[str, str, str]]) -> Field:
    """Fits the field on islands (text, character before, character after); the base patterns label them."""
    cases = []
    for island, left, right in rows:
        spans = base_spans(island)
        cases.append((island, left, right, [(s, e, k) for s, _, k, e in spans]))
        if len(spans) == 1:
            start, _, kind, end = spans[0]
            cases += [(new, left, right, [gold] if gold else []) for new, gold in rewritten(island, (start, end, kind))]
    places: dict[str, int] = {}
    ready = []
    for island, left, right, gold in cases:
        bounds, found = candidates(island, left, right)
        wanted = {(s, e): KINDS.index(k) for s, e, k in gold}
        segments = [(i, j) for i, j, _ in found]
        truth = {s: wanted[bounds[i], bounds[j]] for s, (i, j) in enumerate(segments) if (bounds[i], bounds[j]) in wanted}
        ordered = sorted(gold)
        if not found or len(truth) != len(wanted) or any(b[0] < a[1] for a, b in zip(ordered, ordered[1:], strict=False)):
            continue  # labels that overlap or cut a token can't be a segmentation
        rows_ = [np.array([places.setdefault(f, len(places)) for f in fs]) for _, _, fs in found]
        ready.append((len(bounds) - 1, segments, rows_, truth))
    weights, power = np.zeros((len(places), len(KINDS))), np.full((len(places), len(KINDS)), 1e-3)
    for _ in range(ROUNDS if ready else 0):
        for n, segments, rows_, truth in ready:
            flat, bounds = np.concatenate(rows_), np.cumsum([0, *map(len, rows_)])[:-1]
            probability, _, _ = forward(n, segments, np.add.reduceat(weights[flat], bounds))
            change = -probability
            for s, kind in truth.items():
                change[s, kind] += 1
            touched, where = np.unique(flat, return_inverse=True)
            grad = -1e-3 * weights[touched]
            np.add.at(grad, where, np.repeat(change, [len(r) for r in rows_], axis=0))
            power[touched] += grad * grad
            weights[touched] += 0.3 * grad / np.sqrt(power[touched])
    return Field(places, weights)


def decode(field: Field, island: str, left: str, right: str) -> list[tuple[int, int, str]]:
    """The best segmentation's entities (start, end, kind), each of which pays MARGIN."""
    bounds, found = candidates(island, left, right)
    if not found or not len(field.weights):
        return []
    n = len(bounds) - 1
    scores = []
    for _, _, fs in found:
        known = [field.places[f] for f in fs if f in field.places]
        scores.append(field.weights[known].sum(axis=0) - UNSEEN * (len(fs) - len(known)))
    ends: list[list[int]] = [[] for _ in range(n + 1)]
    for s, (_, j, _) in enumerate(found):
        ends[j].append(s)
    best, back = np.zeros(n + 1), [-1] * (n + 1)
    for t in range(1, n + 1):
        best[t] = best[t - 1]
        for s in ends[t]:
            value = best[found[s][0]] + scores[s].max() - MARGIN
            if value > best[t]:
                best[t], back[t] = value, s
    out, t = [], n
    while t > 0:
        s = back[t]
        if s < 0:
            t -= 1
            continue
        i, j, _ = found[s]
        out.append((bounds[i], bounds[j], KINDS[int(scores[s].argmax())]))
        t = i
    return out[::-1]


def learn(docs: DataFrame, train_docs: int = TRAIN_DOCS, train_islands: int = TRAIN_ISLANDS) -> Field:
    """The field fitted on at most ``train_islands`` islands of about ``train_docs`` texts, picked by hash.

    Islands beyond ``TRAIN_CHARS`` characters are not trained on; ``scan`` and ``redact`` read islands of any length.
    """
    texts = narrow(docs, text="string").where("text is not null")
    share = min(1.0, train_docs / max(1, docs.count()))
    draw = F.shiftrightunsigned(F.xxhash64("text"), 11) / float(1 << 53)

    def helper(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = []
        for t in batch.column("text"):
            text = t.as_py()
            found += [(text[a:b], text[a - 1 : a], text[b : b + 1]) for a, b in islands(text) if b - a <= TRAIN_CHARS]
        return pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in (zip(*found, strict=True) if found else ([], [], []))], ["island", "before", "after"])

    found = map_pieces(texts.where(draw < share), helper, "island string, before string, after string")
    sample = found.distinct().orderBy(F.xxhash64("island"), "island", "before", "after").limit(train_islands).toArrow().to_pydict()
    return train(list(zip(*sample.values(), strict=True)))


def all_spans(text: str, spans: list[tuple[int, int, str, int]], decode_island) -> list[tuple[int, int, str, int]]:
    """The base spans and the field's additions, ascending by start and kind."""
    if not POSSIBLE.search(text):
        return spans
    added = []
    for a, b in islands(text):
        for start, end, kind in decode_island(text[a:b], text[a - 1 : a] if a else "", text[b : b + 1]):
            start, end = a + start, a + end
            if not any(s < end and start < e for s, _, _, e in spans):
                added.append((start, KINDS.index(kind), kind, end))
    return sorted(spans + added)


def decoder(field: Field):
    return lru_cache(maxsize=1 << 14)(lambda island, left, right: decode(field, island, left, right))


def scan(docs: DataFrame, field: Field) -> DataFrame:
    """doc_id, base (spans of the patterns) and spans (those and the added ones): kind, start, end by start and kind."""
    sent = send(docs.sparkSession, field)

    def helper(batch: pa.RecordBatch) -> pa.RecordBatch:
        decode_island, base, spans = decoder(sent()), [], []
        for t in batch.column("text"):
            text = t.as_py() or ""
            own = base_spans(text)
            base.append([{"kind": k, "start": s, "end": e} for s, _, k, e in own])
            spans.append([{"kind": k, "start": s, "end": e} for s, _, k, e in all_spans(text, own, decode_island)])
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(base, SPAN_TYPE), pa.array(spans, SPAN_TYPE)], ["doc_id", "base", "spans"])

    return map_pieces(narrow(docs, doc_id="long", text="string"), helper, f"doc_id long, base {SPANS}, spans {SPANS}")


def masked(text: str, spans: Sequence[tuple[int, int, str, int]]) -> str:
    """The text with each span replaced by its kind; overlapping spans become one, named after the first."""
    out, upto = [], 0
    for start, _, kind, end in spans:
        if start >= upto:
            out += [text[upto:start], f"<{kind.upper()}>"]
        upto = max(upto, end)
    return "".join([*out, text[upto:]])


def redact(docs: DataFrame, field: Field) -> DataFrame:
    """The rows with every span of ``text`` replaced by its kind; ``n_chars``, if there, follows the new text."""
    sent = send(docs.sparkSession, field)

    def helper(batch: pa.RecordBatch) -> pa.RecordBatch:
        decode_island, new = decoder(sent()), []
        for t in batch.column("text"):
            text = t.as_py()
            new.append(text and masked(text, all_spans(text, base_spans(text), decode_island)))
        at = batch.schema.get_field_index("text")
        return batch.set_column(at, batch.schema.field(at), pa.array(new, batch.schema.field(at).type))

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    out = map_pieces(docs, helper, kinds)
    if "n_chars" in docs.columns:
        size = F.when(F.col("n_chars").isNotNull(), F.length("text")).cast(docs.schema["n_chars"].dataType)
        out = out.withColumn("n_chars", size)
    return out

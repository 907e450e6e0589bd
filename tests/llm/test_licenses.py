import random
import re
from re import _parser as parser

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from headroom.llm import licenses as L
from headroom.llm.license_rules import KINDS, RULES
from headroom.llm.queries import QUERIES

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def sample(nodes, rng):
    """A random string that a parsed expression matches."""
    out = ""
    for op, arg in nodes:
        if op is parser.LITERAL:
            out += chr(arg)
        elif op is parser.NOT_LITERAL:
            out += "x"
        elif op is parser.IN:
            kind, value = rng.choice(arg)
            out += "x" if kind is parser.NEGATE else chr(value) if kind is parser.LITERAL else chr(rng.randint(*value)) if kind is parser.RANGE else "x"
        elif op is parser.SUBPATTERN:
            out += sample(arg[-1], rng)
        elif op is parser.BRANCH:
            out += sample(rng.choice(arg[1]), rng)
        elif op in (parser.MAX_REPEAT, parser.MIN_REPEAT):
            least, most, body = arg
            for _ in range(rng.randint(least, min(most, least + 2))):
                out += sample(body, rng)
        elif op is parser.ASSERT:
            out += sample(arg[1], rng)
        else:
            assert op is parser.ASSERT_NOT
    return out


def brute(texts, rules=RULES):
    """Every rule on every text, and pairs of detections compared one by one."""
    rows = []
    for text in texts:
        words = words_of(text)
        line = "".join(f" {w}" for w in words)
        starts = [i for i, c in enumerate(line) if c == " "]
        found = []
        for order, rule in enumerate(rules):
            for m in re.finditer(f"(?<= )(?:{rule.pattern})(?![^ ])", line):
                first = starts.index(m.start() - 1)
                found.append((list(KINDS).index(rule.kind), -(m.end() - m.start()), order, first, first + len(m[0].split())))
        kept = [f for f in found if not any(o[:3] < f[:3] and o[3] <= f[3] and f[4] <= o[4] for o in found)]
        places = [(i, i + len(p.split()), label) for p, label in L.PHRASES.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
        rows.append((len(words), sorted(places), sorted((f[3], f[4], rules[f[2]].label) for f in kept)))
    return rows


def scan(docs):
    out = {}
    for r in L.scan(docs).collect():
        out[r.doc_id] = (r.n_words, sorted((p.start, p.end, p.label) for p in r.places), sorted((p.start, p.end, p.label) for p in r.detections))
    return out


def test_hundreds_of_rules_that_match_what_they_say():
    assert len(RULES) >= 200 and len({(r.label, r.pattern) for r in RULES}) == len(RULES)
    rng = random.Random(0)
    for rule in RULES:
        assert rule.kind in KINDS
        for _ in range(30):
            text = sample(parser.parse(rule.pattern), rng)
            assert rule.keyword in text, (rule, text)
            assert re.search(f"(?<= )(?:{rule.pattern})(?![^ ])", f" {text}"), (rule, text)
            assert words_of(text) == text.split(" "), (rule, text)


@pytest.mark.parametrize(
    ("text", "labels"),
    [
        ("# SPDX-License-Identifier: GPL-3.0-or-later", {"gpl-3.0-or-later"}),
        ("Released under the MIT License.", {"mit", "free-license"}),
        ("This work is licensed under the GNU General Public License, version 3.", {"gpl-3.0", "gpl"}),
        ("the GNU Lesser General Public License v2.1 or later", {"lgpl-2.1", "gpl"}),
        ("Licensed under CC BY-NC 4.0", {"cc-by-nc", "cc-by"}),
        ("Licensed under the Apache License, Version 2.0", {"apache-2.0"}),
        ("see https://creativecommons.org/licenses/by-sa/4.0/", {"cc-by-sa-4.0"}),
        ("All rights reserved.", {"reserved", "rights-statement"}),
        ("Das geht mit dem Hund, python and rails.", set()),
    ],
)
def test_known_notices(spark, make_docs, text, labels):
    row = L.digest(L.scan(make_docs([(1, text)]))).first()
    got = set(filter(None, row.labels.split(",")))
    assert labels <= got and (labels or not got), got


def test_the_whole_table_against_every_rule_on_every_text(spark):
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    rows = docs.collect()
    want = dict(zip((r.doc_id for r in rows), brute([r.text for r in rows]), strict=True))
    assert scan(docs) == want
    digest = QUERIES["op11_licenses"](spark, folder).collect()
    assert len(digest) == len(rows) and sum(r.n_base > 0 for r in digest) > 10
    for r in digest:
        n, places, found = want[r.doc_id]
        first = [p[0] for p in places]
        assert (r.n_words, r.n_base) == (n, len(places))
        assert (r.first_word, r.last_word) == ((min(first), max(first)) if first else (None, None))
        assert r.base_labels == ",".join(sorted({p[2] for p in places}))
        assert r.labels == ",".join(sorted({p[2] for p in places + found}))
        assert 0 <= r.score <= 1 and (r.score > 0) == bool(places or found)


def test_overlaps_nulls_and_long_texts(spark, make_docs):
    texts = [
        None,
        "",
        "…-!",
        "CC BY CC-BY cc/by ccby cc bye",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. "
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "GPL-2.0-only GPL v3 or later, GNU GPL; LGPL 2.1; the GNU Affero General Public License version 3",
        "all rights reserved all rights reserved",
        "straße MIT LICENSE ünder",
        ("word " * 150_000) + "the MIT License " + ("wörter " * 50_000) + "all rights reserved",
        "licensed under " * 30_000,
    ]
    docs = make_docs(list(enumerate(texts)) + [(3, texts[3])])
    got = scan(docs)
    short = [i for i, t in enumerate(texts) if len(t or "") < 1000]
    assert [got[i] for i in short] == brute([texts[i] for i in short])
    assert got[8] == (200_000 + 3 + 3, [(200_003, 200_006, "reserved")], [(150_000, 150_003, "mit"), (200_003, 200_006, "rights-statement")])
    assert got[9][0] == 60_000
    assert L.digest(L.scan(docs)).where("doc_id = 0").first()[1:] == (0, 0, None, None, "", "", 0.0)


def test_clashing_columns_and_empty_tables(spark, make_docs, clash):
    rows = [(1, "MIT License"), (2, None)]
    names = ["n_words", "places", "detections", "labels"]
    wide = clash(make_docs(rows)).selectExpr("*", *[f"'x' AS {n}" for n in names])
    assert scan(wide) == scan(make_docs(rows))
    assert L.digest(L.scan(make_docs([]))).count() == 0


SPANS = st.lists(st.tuples(st.integers(0, 3), st.integers(0, 9), st.integers(1, 5)), min_size=1, max_size=12)


@settings(max_examples=200, deadline=None)
@given(SPANS)
def test_suppression_against_all_pairs(spans):
    rank, start, size = (np.array(c) for c in zip(*spans, strict=True))
    order, end = np.arange(len(spans)), start + size
    found = list(zip(rank, -size, order, start, end, strict=True))
    want = [any(o[:3] < f[:3] and o[3] <= f[3] and f[4] <= o[4] for o in found) for f in found]
    assert L.suppressed(rank, order, start, end).tolist() == want


@settings(max_examples=100, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aZ9 -éß{\x7f\n")), max_size=6))
def test_words_of_a_piece(texts):
    text, bounds, spaces = L.normalized(pa.array(texts, pa.string()))
    got = [text[a:b].decode().split(" ")[1:] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    assert got == [words_of(t) for t in texts]
    assert spaces.tolist() == [i for i, c in enumerate(text) if c == 32]

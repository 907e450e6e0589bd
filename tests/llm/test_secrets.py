import hashlib
import random
import re

import pyarrow as pa
import pytest

from headroom.llm import secrets as S

KEY = "AKIA" + "B7" * 8


def brute(text):
    """The base spans by their definition."""
    text, found = text or "", []
    for m in re.finditer(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[2]) >= 6:
            found.append((m.start(), 0, "assign", m.end()))
    for m in re.finditer(r"AKIA[A-Z0-9]+", text):
        if m.end() - m.start() >= 20:
            found.append((m.start(), 1, "access", m.end()))
    for m in re.finditer(r"[0-9a-f]+", text):
        if m.end() - m.start() >= 24:
            found.append((m.start(), 2, "hex", m.end()))
    return [(k, s, e) for s, _, k, e in sorted(found)]


CASES = [
    None,
    "",
    "PassWord = 'abcdef1' x",
    "api_key:short apikey=longenough",
    "toKen=\"" + "a1" * 20 + "\"",
    f"é {KEY} AKIAshort",
    "f" * 23 + " " + "0" * 24,
    "pass word=abcdefg",
    "secret" * 3 + "=aaaaaa=bbbbbb",
    "ghp_" + "z" * 40 + " https://u:p4ss@host/ -----BEGIN RSA PRIVATE KEY-----",
]


def spans(df):
    return {r.doc_id: [(s.kind, s.start, s.end) for s in r.spans] for r in df.collect()}


def test_base_spans_are_those_of_a_plain_scan(make_docs, clash):
    rng = random.Random(7)
    bits = ["token", "=", "'", " ", "abcdef", "AKIA", "B7" * 9, "0123abcd" * 3, "é", "api", "_", "key", ":", "x" * 3000]
    texts = CASES + ["".join(rng.choice(bits) for _ in range(rng.randint(0, 14))) for _ in range(300)]
    got = spans(S.scan(clash(make_docs(list(enumerate(texts))))))
    for i, text in enumerate(texts):
        assert [s for s in got[i] if s[0] in ("assign", "access", "hex")] == brute(text), text


def test_more_kinds_are_added(make_docs):
    got = spans(S.scan(make_docs([(1, CASES[-1])])))[1]
    assert [k for k, _, _ in got] == ["github", "login", "pem"]


def test_digest(make_docs):
    row = S.digest(S.scan(make_docs([(1, CASES[2] + " " + KEY)])), ["assign", "access", "hex"]).first()
    want = brute(CASES[2] + " " + KEY)
    assert (row.n_assign, row.n_access, row.n_hex) == (1, 1, 0)
    assert row.base_sha256 == hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in want).encode()).hexdigest()


@pytest.mark.parametrize("rule", S.RULES, ids=lambda r: r.kind)
def test_queries_hold_for_whatever_a_rule_matches(rule):
    query = S.trigram_query(rule.pattern)
    grams = sorted(S.trigrams(query))
    texts = pa.array([t or "" for t in CASES] + ["eyJhbGciOiJ9.eyJzdWIiOiIx.SflKxwRJSM", "Bearer " + "a" * 24, "AIza" + "b" * 35, "sk_live_" + "c" * 20, "xoxb-" + "1" * 12])
    index = S.postings(texts, grams)
    found = set(S.candidates(query, index, S.np.arange(len(texts))).tolist())
    assert {i for i, t in enumerate(texts.to_pylist()) if re.search(rule.pattern, t)} <= found


def test_only_the_hex_rule_scans_every_text():
    assert [r.kind for r in S.RULES if S.trigram_query(r.pattern) is True] == ["hex"]


def test_empty_table(make_docs):
    assert S.scan(make_docs([])).count() == 0


def test_long_logins_and_key_headers(spark, make_docs):
    texts = [f"postgres://{'u' * 400}:{'p' * 900}@host", "-----BEGIN VERY LONG KIND OF ENCRYPTED PRIVATE KEY-----", "-----BEGIN PRIVATE KEY-----", "-----BEGIN PUBLIC KEY-----"]
    got = {r.doc_id: [(s.kind, s.start, s.end) for s in r.spans] for r in S.scan(make_docs(list(enumerate(texts)))).collect()}
    assert got == {0: [("login", 8, len(texts[0]) - 4)], 1: [("pem", 0, len(texts[1]))], 2: [("pem", 0, len(texts[2]))], 3: []}

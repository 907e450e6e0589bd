import random
import re

import pytest

from headroom.llm import pii as P


def brute(text):
    """The base spans by their definition."""
    found = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        found.append((m.start(), 0, "email", m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            found.append((m.start(), 1, "ip", m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m[0])
        if 12 <= len(digits) <= 19 and P.luhn(digits):
            found.append((m.start(), 2, "card", m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            found.append((m.start(), 3, "phone", m.end()))
    return sorted(found)


@pytest.mark.parametrize("seed", range(4))
def test_base_spans_are_those_of_a_plain_scan(seed):
    rng = random.Random(seed)
    bits = ["a", "@", ".", "1", " ", "2", "+", "(", "-", "%", "255", "4111111111111111", "x.y", "é"]
    for _ in range(2500):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(0, 24)))
        assert P.base_spans(text) == brute(text), text


def test_long_texts_take_linear_time():
    for text in ("a" * 300_000, "1" * 300_000, "a." * 150_000 + "@", "+1 ((" * 60_000, "1.2.3." * 50_000):
        P.base_spans(text)
    assert P.base_spans("0" * 5000 + "1.2.3.4") == brute("0" * 3000 + "1.2.3.4")[:0] + [(0, 1, "ip", 5007)]


@pytest.fixture(scope="module")
def field(spark, documents):
    return P.learn(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))


def test_forward_sums_over_all_segmentations():
    segments, scores = [(0, 1), (0, 2), (1, 3)], P.np.array([[0.3, -1.0], [0.7, 0.2], [-0.4, 0.1]])
    each = P.np.exp(scores).sum(axis=1)
    total = 1 + each[0] + each[1] + each[2] + each[0] * each[2]
    marginal, _, log_total = P.forward(3, segments, scores)
    assert abs(log_total - P.np.log(total)) < 1e-12
    assert P.np.allclose(marginal[0], P.np.exp(scores[0]) * (1 + each[2]) / total)


def test_field_adds_what_the_patterns_miss_and_no_more(field):
    decode = P.decoder(field)

    def added(text):
        base = P.base_spans(text)
        return [(text[s:e], k) for s, _, k, e in P.all_spans(text, base, decode) if (s, _, k, e) not in base]

    assert ("+1 (269) 555-3296", "phone") in added("call +1 (269) 555-3296 4524132264652876 now")
    for text in ("in 1999-2024 we", "a token=b7db7aa4a5fcc78305b7db7aa4", "plain words only", ""):
        assert added(text) == []


def test_scan_and_redact(make_docs, field, clash):
    rows = make_docs([(1, "mail bob@mail.example.com ok"), (2, None), (3, ""), (4, "nothing here"), (4, "nothing here"), (None, "ip 10.0.0.7")])
    found = {r.doc_id: r for r in P.scan(clash(rows), field).collect()}
    assert [(s.kind, s.start, s.end) for s in found[1].base] == [("email", 5, 25)]
    assert found[2].spans == [] and found[3].spans == []
    masked = P.redact(clash(rows), field)
    assert masked.columns == clash(rows).columns
    texts = {r.doc_id: (r.text, r.n_chars) for r in masked.collect()}
    assert texts[1] == ("mail <EMAIL> ok", 15) and texts[4][0] == "nothing here" and texts[None][0] == "ip <IP>" and texts[2][0] is None


def test_empty_table(make_docs):
    empty = make_docs([])
    field = P.learn(empty)
    assert P.scan(empty, field).count() == 0
    assert [r.spans for r in P.scan(make_docs([(1, "+1 (269) 555-3296 4524132264652876")]), field).collect()] == [[]]


def best_value(n, found, scores):
    """The value of the best segmentation, by trying all of them."""

    def best(t):
        if t >= n:
            return 0.0
        ways = [best(t + 1)]
        ways += [scores[s].max() - P.MARGIN + best(j) for s, (i, j, _) in enumerate(found) if i == t]
        return max(ways)

    return best(0)


def test_decoding_is_the_best_of_all_segmentations(field):
    rng = random.Random(2)
    bits = ["555", "12", "4111", "1.2.3.4", "a@b.c", "(at)", "-", " ", "+49", "x", "/", "0170"]
    tried = 0
    while tried < 150:
        island = "".join(rng.choice(bits) for _ in range(rng.randint(2, 6))).strip()
        bounds, found = P.candidates(island, "", " ") if island else ([], [])
        if not found or len(bounds) > 14:
            continue
        tried += 1
        scores = []
        for _, _, fs in found:
            known = [field.places[f] for f in fs if f in field.places]
            scores.append(field.weights[known].sum(axis=0) - P.UNSEEN * (len(fs) - len(known)))
        decoded = P.decode(field, island, "", " ")
        at = {(bounds[i], bounds[j]): scores[s] for s, (i, j, _) in enumerate(found)}
        value = sum(at[a, b][P.KINDS.index(kind)] - P.MARGIN for a, b, kind in decoded)
        assert all(x[1] <= y[0] for x, y in zip(decoded, decoded[1:], strict=False))
        assert abs(value - best_value(len(bounds) - 1, found, scores)) < 1e-9


def test_training_follows_the_gradient_of_the_likelihood():
    """The marginals that training subtracts are the derivatives of the log total, by differences."""
    rng = P.np.random.default_rng(3)
    segments = [(0, 1), (0, 3), (1, 2), (1, 4), (2, 4), (3, 5)]
    scores = rng.standard_normal((len(segments), 4))
    marginal, _, _ = P.forward(5, segments, scores)
    for s in range(len(segments)):
        for k in range(4):
            step = P.np.zeros_like(scores)
            step[s, k] = 1e-6
            slope = (P.forward(5, segments, scores + step)[2] - P.forward(5, segments, scores - step)[2]) / 2e-6
            assert abs(slope - marginal[s, k]) < 1e-7

import base64
import random

import numpy as np
import pyarrow as pa
import pytest

from headroom.llm import language_id as L

TRAIN = {"en": "the cat sat on the mat and the end of the day", "fr": "le chat est sur la table et la fin de l'été"}


def counted(text):
    grams, times = np.unique(L.grams_of(pa.array([text]))[0], return_counts=True)
    return grams, times.astype(float)


def brute_bits(training: bytes, text: bytes) -> float:
    """PPM, escape method C with exclusion, byte by byte from plain dictionaries."""
    seen = {}
    padded = b"\n" * L.ORDER + training
    for i in range(L.ORDER, len(padded)):
        for order in range(L.ORDER + 1):
            context = padded[i - order : i]
            seen.setdefault(context, {}).setdefault(padded[i], 0)
            seen[context][padded[i]] += 1
    total, padded = 0.0, b"\n" * L.ORDER + text
    for i in range(L.ORDER, len(padded)):
        out, done = set(), False
        for order in range(L.ORDER, -1, -1):
            table = {b: n for b, n in seen.get(padded[i - order : i], {}).items() if b not in out}
            if not table:
                continue
            n, d = sum(table.values()), len(table)
            if padded[i] in table:
                total -= np.log2(table[padded[i]] / (n + d))
                done = True
                break
            total -= np.log2(d / (n + d))
            out |= set(table)
        if not done:
            total += np.log2(256 - len(out))
    return total


@pytest.mark.parametrize("text", ["the mat", "la table", "été", "zzz 123", "\x00", "catthe le chat"])
def test_code_lengths_are_those_of_plain_ppm(text):
    model = L.build(list(TRAIN), [counted(t) for t in TRAIN.values()])
    got = L.code_lengths(model, pa.array([None, text, ""]))
    want = [brute_bits(t.encode(), text.encode()) for t in TRAIN.values()]
    assert np.allclose(got[1], want, atol=1e-9)
    assert not got[0].any() and not got[2].any()


def test_probabilities_sum_to_one():
    model = L.build(list(TRAIN), [counted(t) for t in TRAIN.values()])
    for context in (b"the", b"xth", b"\xff\xfe\xfd"):
        grams = np.array([int.from_bytes(context + bytes([b]), "big") for b in range(256)], np.uint32)
        for tree in model.trees:
            assert abs(np.exp2(-L.code_bits(tree, grams)).sum() - 1) < 1e-9


def test_held_out_accuracy(documents):
    found = L.identify(documents).toPandas().merge(documents.select("doc_id", "lang").toPandas(), on="doc_id")
    held = found[found.held_out]
    assert len(held) > 20 and (held.lang_pred == held.lang).mean() > 0.95
    assert found.score.between(0, 1).all()


def test_nulls_ties_and_clashes(make_docs, documents, clash):
    rows = make_docs([(1, None), (2, ""), (3, "12 34"), (4, "the cat"), (4, "the cat"), (None, "x" * 200_000)])
    model = L.learn(documents)
    got = L.predict(clash(rows), model).toPandas()
    assert got["_lang_pred"].tolist()[:3] == ["und"] * 3 and (got["_score"][:3] == 0).all()
    assert got["_lang_pred"][3] == got["_lang_pred"][4]
    assert len(got) == 6


def test_nothing_to_learn_from(make_docs):
    got = L.identify(make_docs([(1, "abc", None), (2, None, None)])).toPandas()
    assert set(got.lang_pred) == {"und"} and set(got.score) == {0.0}
    assert L.identify(make_docs([])).count() == 0


def test_accepted_keeps_clean_documents(make_docs, documents):
    bad = make_docs([(10**9, None), (10**9 + 1, "--- 17 ---")])
    kept = L.accepted(documents.unionByName(bad.select([bad[c].cast(t).alias(c) for c, t in documents.dtypes])))
    assert kept.columns == documents.columns
    assert {r.doc_id for r in kept.select("doc_id").collect()} == {r.doc_id for r in documents.select("doc_id").collect()}


def test_accepted_drops_what_no_language_explains(make_docs, documents):
    rng = random.Random(2)
    letters = " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9))) for _ in range(80))
    unlearned = [
        "tämä kieli ei ole tunnettu eikä sen tekstejä ole koskaan opittu tässä järjestelmässä vaikka kirjaimet ovat tuttuja",
        "η γλώσσα αυτή δεν είναι γνωστή και τα κείμενα της δεν μαθαίνονται ποτέ από αυτό το σύστημα",
    ]
    code = "def f(x):\n    for i in range(10):\n        print(x[i], i ** 2)\n    return {k: v for k, v in x.items()}\n"
    texts = [letters, base64.b64encode(rng.randbytes(400)).decode(), code, *unlearned]
    bad = make_docs([(10**9 + i, text, None) for i, text in enumerate(texts)])
    kept = L.accepted(documents.unionByName(bad.select([bad[c].cast(t).alias(c) for c, t in documents.dtypes])))
    assert {r.doc_id for r in kept.select("doc_id").collect()} == {r.doc_id for r in documents.select("doc_id").collect()}


def test_usual_rates_come_from_all_labelled_texts(documents, monkeypatch):
    """However little the trees are counted on."""
    seen, usual = [], L.usual_rates
    monkeypatch.setattr(L, "usual_rates", lambda *args: seen.append(usual(*args)) or seen[-1])
    L.accepted(documents, train_bytes=20_000)
    found = L.predict(documents, L.learn(documents, 20_000)).where("lang_pred = lang and text is not null")
    rates = {}
    for row in found.select("lang", L.held_out(found["doc_id"]).alias("own"), "bits_per_byte").collect():
        rates.setdefault((row.lang, row.own), []).append(row.bits_per_byte)
    wanted = {lang: sorted(rates.get((lang, True)) or rates[lang, False]) for lang, _ in rates}
    assert seen[0] == {lang: x[(len(x) - 1) // 2] for lang, x in wanted.items()}

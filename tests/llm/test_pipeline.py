"""The chained stages against what is planted, and the mix against its definition in SQL."""

import random

import duckdb
import pytest

import corpus_pipeline
from headroom.llm import mixing
from tests.llm.conftest import DOC_SCHEMA


def shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


@pytest.fixture(scope="module")
def kept(spark, folder):
    """Documents with plants, and what is left of them after each stage but the last."""
    rng = random.Random(11)
    base = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").collect()]
    item = max((r.text for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()), key=len)
    long = [r for r in base if r[1] and 150 <= len(r[1].split()) <= 600 and r[2]]
    # Texts that resemble no other one and hold nothing that a stage acts on.
    alone = [r for r in long if all(r is o or len(shingles(r[1]) & shingles(o[1])) < 0.3 * len(shingles(r[1])) for o in base)][:12]
    edited = alone[1][1].split(" ")
    edited[len(edited) // 2] = "changedword"
    plants = {
        "junk": [(9000 + i, " ".join("".join(rng.choice("qxzjkvwb0189") for _ in range(rng.randint(3, 12))) for _ in range(120))) for i in range(3)],
        "letterless": [(9100, "123 456 -- 789"), (9101, None), (9102, "")],
        "copies": [(9200, alone[0][1]), (9201, alone[0][1])],
        "near": [(9300, " ".join(edited))],
        "leak": [(9400, f"{alone[2][1]}\n{item}\n{alone[3][1]}")],
        "private": [(9500, f"{alone[4][1]} write to someone.new@example.org or call +49 170 555 0123 {alone[5][1]}")],
    }
    rows = base + [(i, text, None, base[0][3], len(text or "")) for found in plants.values() for i, text in found]
    docs = spark.createDataFrame(rows, DOC_SCHEMA)
    after = [docs]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after.append(corpus_pipeline.cut_lineage(stage(spark, after[-1], folder), f"test-{name}"))
    texts = [{r.doc_id: r.text for r in d.select("doc_id", "text").collect()} for d in after]
    return {"plants": plants, "alone": alone, "texts": texts, "last": after[-1]}


def test_each_stage_drops_what_is_planted_for_it(kept):
    plants, texts = {k: [i for i, _ in v] for k, v in kept["plants"].items()}, kept["texts"]
    gone = [set(a) - set(b) for a, b in zip(texts, texts[1:], strict=False)]
    assert set(plants["junk"] + plants["letterless"]) <= gone[0]
    assert set(plants["copies"] + plants["near"]) <= gone[1]
    assert set(plants["leak"]) <= gone[2]
    assert not gone[3]


def test_texts_that_resemble_none_stay(kept):
    for r in kept["alone"][:2] + kept["alone"][6:]:
        assert all(r[0] in texts for texts in kept["texts"])


def test_personal_data_is_gone_and_the_rest_is_as_it_was(kept):
    text = kept["texts"][-1][9500]
    assert "someone.new@" not in text and "555 0123" not in text and "<EMAIL>" in text and "<PHONE>" in text
    for r in kept["alone"][6:]:
        if "<" not in kept["texts"][-1][r[0]]:
            assert kept["texts"][-1][r[0]] == r[1]


def test_the_mix_is_that_of_its_definition(kept):
    frame = kept["last"].toPandas()
    con = duckdb.connect()
    con.register("documents", frame)
    want = {r[0]: r[1] for r in con.execute(f"SELECT doc_id, copies FROM ({mixing.mix_sql()}) WHERE copies > 0").fetchall()}
    got = {r.doc_id: r.copies for r in corpus_pipeline.STAGES[-1][1](None, kept["last"], None).collect()}
    assert got == want and max(got.values()) <= mixing.MAX_COPIES

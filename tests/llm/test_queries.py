import duckdb
import pytest

import corpus_pipeline
from headroom.llm.queries import QUERIES, TWINS
from tests.oracle import connect, differences


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_query(spark, folder, key):
    got = QUERIES[key](spark, folder).toPandas()
    assert len(got)
    if key in TWINS:
        assert differences(got, connect(folder).execute(TWINS[key]).df()) is None


def test_one_query_for_each_operator():
    assert sorted(int(k[2:].split("_")[0]) for k in QUERIES) == list(range(1, 14))
    assert isinstance(duckdb.__version__, str)


def test_pipeline_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, kept = docs.columns, docs
    seen = docs.select("doc_id").toPandas().doc_id
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        kept = corpus_pipeline.cut_lineage(stage(spark, kept, folder), "test-stage")
        ids = kept.select("doc_id").toPandas().doc_id
        assert ids.is_unique and set(ids) <= set(seen)
        assert kept.columns == columns + ["copies"] * (i == len(corpus_pipeline.STAGES) - 1)
        seen = ids
    whole = corpus_pipeline.run(spark, folder)
    assert sorted(map(str, whole.collect())) == sorted(map(str, kept.collect()))


def test_pipeline_on_empty_documents(spark, folder, make_docs):
    docs = make_docs([])
    for _, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.cut_lineage(stage(spark, docs, folder), "test-stage")
    assert docs.count() == 0

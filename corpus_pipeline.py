"""The corpus pipeline: documents that are fit for training, stage by stage.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept and returns a
DataFrame, which is written as Parquet and read again before the next one. All but the last return
the columns of ``documents``; the last adds ``copies``, how often the mix takes a document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from headroom.llm import decontaminate, language_id, mixing, near_duplicates, pii
from headroom.llm.queries import QUERIES as OPERATORS
from headroom.llm.queries import TWINS
from headroom.sources.shared import cut_lineage


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: texts without a language that any learned one explains go; see ``accepted`` for near relatives."""
    return language_id.accepted(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: of each class the document with the smallest id stays."""
    return near_duplicates.keep_one(docs)


def decontaminate_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: documents that hold a benchmark item go."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: personal data in the text is replaced by its kind; every document stays."""
    return pii.redact(docs, pii.learn(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: each source by its weight; ``copies`` says how often a document is taken."""
    return mixing.keep_mixed(docs)


STAGES = [
    ("language_id", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("decontaminate", decontaminate_benchmark),
    ("personal_data", redact_personal_data),
    ("mix_sources", mix_sources),
]

#: Trained models and components are beyond SQL; tests/llm/test_pipeline.py plants cases for each stage and holds the mix against its SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = cut_lineage(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs


QUERIES = {**OPERATORS, "pipeline": run}
__all__ = ["ORACLE_SQL", "QUERIES", "STAGES", "TWINS", "run"]

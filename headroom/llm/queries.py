"""One registered query per operator, each over its whole table, and the SQL that checks it where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from headroom.llm import decontaminate, language_id, licenses, mixing, near_duplicates, nearest, passages, pii, prefix_trie, secrets, token_counts, toxicity, whitening
from headroom.llm.arrow import narrow
from headroom.sources.shared import cut_lineage

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
TWINS: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            TWINS[name] = sql
        return fn

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query(
    "op7_mix_sources",
    f"SELECT doc_id, size, source_size, target, CAST(copies * size AS BIGINT) AS taken FROM ({mixing.mix_sql()})",
)
def op7_mix_sources(spark: SparkSession, folder: str) -> DataFrame:
    mixed = mixing.mix(table(spark, folder, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


@query("op3_token_counts")
def op3_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents")
    histogram = token_counts.length_histogram(documents, token_counts.length_counter(spark))
    # Read twice by what follows: texts are encoded once.
    return token_counts.context_limits(cut_lineage(histogram, "lengths"))


@query("op2_secrets")
def op2_secrets(spark: SparkSession, folder: str) -> DataFrame:
    found = secrets.scan(table(spark, folder, "documents"))
    return secrets.digest(found, [rule.kind for rule in secrets.BASE_RULES])


@query("op1_language_id")
def op1_language_id(spark: SparkSession, folder: str) -> DataFrame:
    return language_id.identify(table(spark, folder, "documents"))


@query("op8_decontaminate")
def op8_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, contaminated, n_items, best_similarity, items (item:start:end in words)."""
    documents = narrow(table(spark, folder, "documents"), doc_id="long", text="string")
    found = decontaminate.find_items(documents, table(spark, folder, "benchmark"))
    items = F.transform("matches", lambda m: F.concat_ws(":", m["item_id"], m["start"], m["end"]))
    return found.select(
        "doc_id",
        (F.size("matches") > 0).alias("contaminated"),
        F.size("matches").alias("n_items"),
        F.array_max("matches.similarity").alias("best_similarity"),
        F.concat_ws(",", items).alias("items"),
    )


@query("op5_personal_data")
def op5_personal_data(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents")
    found = pii.scan(documents, pii.learn(documents))
    return found.select(
        "doc_id",
        *[F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}") for kind in pii.KINDS],
        F.sha2(secrets.joined_spans(F.col("base")), 256).alias("base_sha256"),
        secrets.joined_spans(F.col("spans")).alias("spans"),
    )


@query("op9_toxicity")
def op9_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents")
    return toxicity.predict(documents, toxicity.learn(documents, table(spark, folder, "labels")))


@query("op10_nearest")
def op10_nearest(spark: SparkSession, folder: str) -> DataFrame:
    return nearest.search(table(spark, folder, "embeddings"), F.col("vec_id") % 20 == 0)


@query("op11_licenses")
def op11_licenses(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.digest(licenses.scan(table(spark, folder, "documents")))


@query("op12_prefix_trie", prefix_trie.trie_sql())
def op12_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    """A conversation's first turns, none to three by its id's CRC-32, come from the first one of its block of 20 ids."""
    conv_id = F.col("conv_id")
    length = F.crc32(conv_id.cast("string")) % 4
    return prefix_trie.prefix_trie(table(spark, folder, "conversations"), conv_id - conv_id % 20, length, 3)


@query("op13_whitening")
def op13_whitening(spark: SparkSession, folder: str) -> DataFrame:
    return whitening.whiten(table(spark, folder, "embeddings"))


@query("op4_near_duplicates")
def op4_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates.near_duplicates(table(spark, folder, "documents"))


@query("op6_repeated_passages")
def op6_repeated_passages(spark: SparkSession, folder: str) -> DataFrame:
    """One row per document; ``passages`` as start:end in words."""
    found = passages.repeated_passages(table(spark, folder, "documents"))
    return found.withColumn("passages", F.concat_ws(",", F.transform("passages", lambda p: F.concat_ws(":", p["start"], p["end"]))))

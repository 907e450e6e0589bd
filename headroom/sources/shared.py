"""Shared storage: where lineage is cut and where intermediate tables go."""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence
from contextlib import AbstractContextManager, contextmanager

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"
WAREHOUSE_CONF = "spark.sql.warehouse.dir"
ALL_KEYS_CONF = "spark.sql.requireAllClusterKeysForCoPartition"
CLEANUP_CONF = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder: ``spark.checkpoint.dir``, or the warehouse, which every session has."""
    sc = spark.sparkContext
    folder = sc.getConf().get(CHECKPOINT_CONF) or spark.conf.get(CHECKPOINT_CONF, None)
    return (folder or sc.getCheckpointDir() or spark.conf.get(WAREHOUSE_CONF)).rstrip("/")


@contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """Within it, the session's setting ``key`` has this value."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def shuffles_dropped(spark: SparkSession) -> AbstractContextManager[None]:
    """Within it, the shuffle files of a statement go when it ends: what was stored needs them no more."""
    return setting(spark, CLEANUP_CONF, "true")


def keys_together(spark: SparkSession) -> AbstractContextManager[None]:
    """Within it, tables kept by some of the keys that a statement joins them on are joined where they lie."""
    return setting(spark, ALL_KEYS_CONF, "false")


def new_path(spark: SparkSession, name: str) -> str:
    """A path under the shared folder that no earlier run has used."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def keyed_name() -> str:
    """A name for a table kept by key that no earlier one has."""
    return f"keyed_{uuid.uuid4().hex}"


def bucket_count(spark: SparkSession) -> int:
    """How many buckets tables kept by key have: as many as a shuffle has partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def keyed_table(
    df: DataFrame, keys: Sequence[str], order: Sequence[str] = (), buckets: int | None = None, dealt: bool = False, name: str | None = None
) -> DataFrame:
    """``df`` stored by key: one bucket file for each hash of ``keys``, sorted by keys and ``order``.

    Aggregates and joins on the keys need no shuffle from then on, as often as the table is used. ``buckets`` is the
    session's number of shuffle partitions, if not given; a bucket should fit a task. The table's files lie in the shared folder.
    ``dealt`` says that the rows are already dealt by the keys, so that they are stored without a shuffle; where they are not, there
    are more files. Rows are added to the table ``name``, if there is one, which should have the same keys.
    """
    spark = df.sparkSession
    n = buckets or bucket_count(spark)
    name = name or keyed_name()
    # Dealt by the buckets' own hash first: each is one file.
    rows = (df if dealt else df.repartition(n, *keys)).write.bucketBy(n, *keys).sortBy(*keys, *order)
    with shuffles_dropped(spark), keys_together(spark):
        if spark.catalog.tableExists(name):
            rows.mode("append").saveAsTable(name)
        else:
            rows.option("path", new_path(spark, "keyed")).saveAsTable(name)
    return spark.table(name)


def cut_lineage(df: DataFrame, name: str = "table") -> DataFrame:
    """Write the rows once to shared storage and go on from there.

    Later plans neither repeat the work before this point nor depend on the executors that
    did it, and they see the real size of the table. The folder's retention policy clears it.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    with shuffles_dropped(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)

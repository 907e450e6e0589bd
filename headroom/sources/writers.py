"""Result sinks: delimited export and the BI extract."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def export_name(practice_area: str) -> str:
    """Folder name of an export: spaces become underscores."""
    return practice_area.replace(" ", "_") + "_counties.csv"


def export_csv(df: DataFrame, folder: str, practice_area: str, drop: Iterable[str] = ()) -> str:
    """Headered, unquoted CSV, optionally without the user-chosen feature columns.

    Unquoted as the form is, a value with a comma shifts the columns behind it for whoever reads the file back.

    One part file per task: gathering the rows into a single file would push the whole
    result through one executor.
    """
    path = f"{folder}/{export_name(practice_area)}"
    (
        df.drop(*drop)
        .write.mode("overwrite")
        .option("header", True)
        .option("quote", "")
        .option("escapeQuotes", False)
        .csv(path)
    )
    return path


def save_extract(df: DataFrame, path: str, by: str, parts: Sequence, measures: Sequence[str] = ()) -> DataFrame:
    """Columnar extract for the BI side, one folder for each of the ``parts`` (values of ``by``); returns its manifest.

    Rows and sums of each part are observed while the one pass writes the files, into a folder of this run's own. The manifest
    (part, run, rows, sums) comes last and replaces the lines of these parts only: until then readers see what
    was there before, and files of a run that failed are in no line. Rows of no listed part end the run.
    """
    counted, run = Observation("extract"), uuid.uuid4().hex
    each = []
    for i, part in enumerate(parts):
        own = F.col(by).eqNullSafe(F.lit(part))
        each += [F.count_if(own).alias(f"n{i}"), *[F.sum(F.when(own, F.col(m))).alias(f"s{i}_{j}") for j, m in enumerate(measures)]]
    rows = df.withColumn("_part", F.array_position(F.array(*map(F.lit, parts)), F.col(by)))
    rows.observe(counted, F.count("*").alias("n"), *each).withColumn("_run", F.lit(run)).write.mode("append").partitionBy("_run", "_part").parquet(f"{path}/data")
    seen = counted.get
    if seen["n"] != sum(seen[f"n{i}"] for i in range(len(parts))):
        raise ValueError(f"{by} has values beyond those listed")
    lines = [(i + 1, part, run, seen[f"n{i}"], [seen[f"s{i}_{j}"] for j in range(len(measures))]) for i, part in enumerate(parts)]
    kind = df.schema[by].dataType.simpleString()
    manifest = df.sparkSession.createDataFrame(lines, f"_part int, `{by}` {kind}, _run string, n long, sums array<double>")
    manifest = manifest.select(by, "_run", "_part", "n", *[F.col("sums")[j].alias(m) for j, m in enumerate(measures)], F.col(by).alias("_of"))
    manifest.coalesce(1).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_of").parquet(f"{path}/manifest")
    return read_manifest(df.sparkSession, path)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """One line for each part of an extract: its value, run, folder, rows and sums."""
    return spark.read.parquet(f"{path}/manifest").drop("_of")


def read_extract(spark: SparkSession, path: str) -> DataFrame:
    """The rows of an extract that its manifest lists."""
    listed = read_manifest(spark, path).select("_run", "_part")
    return spark.read.parquet(f"{path}/data").join(listed, ["_run", "_part"]).drop("_run", "_part")

"""Distinct counts that merge: bitmaps over densely numbered values.

The distinct values are dealt by range and numbered 0, 1, 2, ...: a part's first number is the count of the parts before
it. Per group and per bucket of 32,768 numbers a bitmap of 4 KB says which values occur. Bitmaps are built in tasks and
united by OR, so one stored table answers every coarser grouping and its subtotals exactly, without another look at
the rows, and a group with a third of the rows is combined before it moves.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from headroom.operators.joins import join_split
from headroom.sources.shared import cut_lineage


def dense_numbers(df: DataFrame, value: str) -> DataFrame:
    """value, number (from 0, ascending by value), times: one row for each distinct value but NULL; stored."""
    distinct = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("times"))
    dealt = cut_lineage(distinct.repartitionByRange(value).withColumn("_part", F.spark_partition_id()), "distinct")
    # One row for each part.
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = dealt.groupBy("_part").agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
    place = F.row_number().over(Window.partitionBy("_part").orderBy(value)) - 1
    numbered = dealt.withColumn("_place", place).join(parts.drop("_n"), "_part")
    return cut_lineage(numbered.select(value, (F.col("_before") + F.col("_place")).alias("number"), "times"), "numbers")


def value_bitmaps(df: DataFrame, keys: Iterable[str], value: str) -> DataFrame:
    """keys, bucket, bitmap: which values each group has. NULL values do not count, and a group of only such has no row."""
    keys = list(keys)
    rows = df.select(*keys, value).where(F.col(value).isNotNull())
    numbered = join_split(rows, dense_numbers(df, value), value, "times")
    number = F.col("number") + 1  # numbers of bitmaps begin with 1
    return numbered.groupBy(*keys, F.bitmap_bucket_number(number).alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(number)).alias("bitmap")
    )


def count_values(bitmaps: DataFrame, groupings: Sequence[Sequence[str]], out: str) -> DataFrame:
    """The distinct values of each group, for several groupings of one bitmap table.

    ``grouping`` is the place of the grouping in ``groupings``; keys outside it are NULL.
    """
    keys = list(dict.fromkeys(k for grouping in groupings for k in grouping))
    counted = []
    for i, grouping in enumerate(groupings):
        united = bitmaps.groupBy(*grouping, "bucket").agg(F.bitmap_or_agg("bitmap").alias("bitmap"))
        counts = united.groupBy(*grouping).agg(F.sum(F.bitmap_count("bitmap")).alias(out))
        absent = [F.lit(None).cast(bitmaps.schema[k].dataType).alias(k) for k in keys if k not in grouping]
        counted.append(counts.select(*grouping, *absent, F.lit(i).alias("grouping"), out).select("grouping", *keys, out))
    total = counted[0]
    for more in counted[1:]:
        total = total.unionByName(more)
    return total

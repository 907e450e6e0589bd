"""Positions and running sums inside groups of any size: no task orders a whole group.

Rows are dealt by range of (group, order) and stored once with the number of their part, so a large
group lies in many parts. Inside a part a window orders what one task was dealt; what the
group has in earlier parts is added as an offset. Rows that no order column tells apart
are dealt and ordered by a number of their own.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from headroom.sources.shared import cut_lineage

PART, ROW = "_part", "_row"


def in_parts(df: DataFrame, keys: Iterable[str], order: Iterable[str], name: str = "parts") -> DataFrame:
    """``df`` dealt by range of keys, order and a row number, stored, with columns ``_part`` and ``_row``."""
    numbered = df.withColumn(ROW, F.monotonically_increasing_id())
    dealt = numbered.repartitionByRange(*keys, *order, ROW)
    return cut_lineage(dealt.withColumn(PART, F.spark_partition_id()), name)


def part_totals(parts: DataFrame, keys: Iterable[str], **totals: Column) -> DataFrame:
    """For each group and part the given aggregates, and under ``before_*`` their sums over the group's earlier parts.

    One row for each part that a group touches, so a group has at most as many rows as there are parts.
    """
    keys = list(keys)
    earlier = Window.partitionBy(*keys).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    sums = parts.groupBy(*keys, PART).agg(*[column.alias(n) for n, column in totals.items()])
    return sums.withColumns({f"before_{n}": F.coalesce(F.sum(n).over(earlier), F.lit(0)) for n in totals})


def number_rows(df: DataFrame, keys: Iterable[str], order: Iterable[str], seq: str, size: str) -> DataFrame:
    """``seq``: the place of a row in its group, from 1, by ``order`` (nulls first); ``size``: the group's rows.

    Rows that no order column tells apart take places in any order. Null keys are a group of their own.
    """
    keys, order = list(keys), list(order)
    parts = in_parts(df, keys, order, "numbering")
    totals = part_totals(parts, keys, n=F.count("*")).withColumn("_size", F.sum("n").over(Window.partitionBy(*keys)))
    totals = totals.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col(PART).alias("_of"), "before_n", "_size")
    inside = F.row_number().over(Window.partitionBy(PART, *keys).orderBy(*order, ROW))
    same = (F.col(PART) == F.col("_of")) & reduce(and_, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
    numbered = parts.withColumn("_inside", inside).join(totals, same)
    return numbered.select(*df.columns, (F.col("before_n") + F.col("_inside")).alias(seq), F.col("_size").alias(size))

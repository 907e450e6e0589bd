"""Joins that need more than one join type."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def keep_both(many: DataFrame, one: DataFrame, on: Sequence[str]) -> DataFrame:
    """Full outer join of a table with many rows per key and its lookup.

    Spark can neither broadcast a side of a full outer join nor split its hot keys. As a
    left join plus the lookup rows that found nobody it can do both.
    """
    on = list(on)
    matched = many.join(one, on, "left")
    alone = one.join(many.select(*on).distinct(), on, "left_anti")
    return matched.unionByName(alone, allowMissingColumns=True)


#: Keys with more than this share of all rows are hot; there are fewer than its inverse of them.
HOT_SHARE = 0.001


def join_split(left: DataFrame, right: DataFrame, key: str, times: str) -> DataFrame:
    """Inner join with a table of one row per key whose column ``times`` says how many rows ``left`` has of it.

    Keys with more than ``HOT_SHARE`` of the rows are fewer than 1 / HOT_SHARE and are broadcast, so their rows
    stay where they are; all other keys meet by shuffle, none with more than that share. ``right`` is read several
    times and should be a stored table; ``times`` is not part of the result.
    """
    total = right.agg(F.sum(times).alias("n")).first()["n"] or 0
    hot = F.col(times) > HOT_SHARE * total
    few, rest = right.where(hot).drop(times), right.where(~hot).drop(times)
    near = left.join(F.broadcast(few), key)
    return near.unionByName(left.join(F.broadcast(few.select(key)), key, "left_anti").join(rest, key))

"""Exact order statistics per group by radix selection: only counts move, and no group is ordered.

A double is read from its leading bits on: its value rounded to 11 significant bits, the rest of it rounded
to 24, and what is left. Each part is exact and ascends with the value, as digits of a number do. A
round counts rows by (group, digit) in every task before anything is shuffled, and running sums over a
group's digits tell in which of them a rank lies; the next round reads only rows that agree so far.
Three rounds find any value, whatever the size of the group or its spread.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from headroom.sources.shared import cut_lineage

#: Beyond this a value times the splitting factor would overflow; such values share one leading digit.
LARGE = 2.0**980


def nearest_rank(n: Column, p: str) -> Column:
    """1-based rank of the nearest-order-statistic quantile, ties to the even rank.

    The product is taken in decimals: 0.7 * n in doubles would miss exact ties.
    """
    exact = n.cast("decimal(20,1)") * F.lit(p).cast("decimal(10,6)")
    return F.greatest(F.lit(1).cast("long"), F.bround(exact, 0).cast("long"))


def leading(value: Column) -> Column:
    """The value rounded to 11 significant bits (Veltkamp's splitting); large values become +-LARGE."""
    spread = value * F.lit(2.0**42 + 1)
    rounded = spread - (spread - value)
    return F.when(value > LARGE, F.lit(LARGE)).when(value < -LARGE, F.lit(-LARGE)).otherwise(rounded)


def digits(value: Column) -> dict[str, Column]:
    """Three parts of a double: of two doubles the smaller one has the smaller first part that differs."""
    first = leading(value)
    rest = F.when(F.abs(value) > LARGE, value).otherwise(value - first)
    second = F.when(F.abs(rest) > 3e38, rest).otherwise(rest.cast("float").cast("double"))
    return {"_d1": first, "_d2": second, "_d3": rest - second}


def order_statistic(df: DataFrame, keys: Iterable[str], value: str, low: Column, high: Column, out: str, times: str | None = None) -> DataFrame:
    """Mean of the values at ranks ``low`` and ``high`` (columns over the group size ``n``).

    ``times`` says how often a row counts (once, without it). NULL and NaN values do not count, and neither
    do rows with a NULL key. ``df`` is read once a round: what is costly to compute should be a stored table.
    What is kept between rounds has a row or two for each group.
    """
    keys = list(keys)
    v = F.col(value).cast("double")
    rows = df.select(*keys, (v + F.lit(0.0)).alias("_v"), (F.lit(1).cast("long") if times is None else F.col(times)).alias("_c"))
    rows = rows.where(F.col("_v").isNotNull() & ~F.isnan("_v")).dropna(subset=keys).withColumns(digits(F.col("_v")))
    known: list[str] = []
    state = None
    for digit in ("_d1", "_d2", "_d3"):
        near = rows if state is None else rows.join(state, [*keys, *known])
        wanted = [] if state is None else ["_low", "_high", "_before"]
        # The last digit tells the value.
        counts = near.groupBy(*keys, *known, *wanted, digit).agg(F.sum("_c").alias("_size"), F.min("_v").alias("_v"))
        whole = Window.partitionBy(*keys, *known)
        upto = F.sum("_size").over(whole.orderBy(digit))
        if state is None:
            counts = counts.withColumn("n", F.sum("_size").over(whole)).withColumns({"_low": low, "_high": high, "_before": F.lit(0).cast("long")})
        counts = counts.withColumn("_upto", F.col("_before") + upto)
        counts = counts.where((F.col("_upto") >= F.col("_low")) & (F.col("_upto") - F.col("_size") < F.col("_high")))
        known.append(digit)
        if digit == "_d3":
            return counts.groupBy(*keys).agg(F.avg("_v").alias(out))
        before = F.col("_upto") - F.col("_size")
        state = cut_lineage(counts.select(*keys, *known, "_low", "_high", before.alias("_before")), "ranks")
    raise AssertionError


def group_quantile(df: DataFrame, keys: Iterable[str], value: str, p: str, out: str) -> DataFrame:
    """Quantile as an existing member value: the nearest order statistic."""
    rank = nearest_rank(F.col("n"), p)
    return order_statistic(df, keys, value, rank, rank, out)


def group_median(df: DataFrame, keys: Iterable[str], value: str, out: str, times: str | None = None) -> DataFrame:
    """Median; the mean of the two middle values when the count is even."""
    n = F.col("n")
    low = F.floor((n + 1) / 2).cast("long")
    high = F.floor((n + 2) / 2).cast("long")
    return order_statistic(df, keys, value, low, high, out, times)


def split_array(values: np.ndarray) -> list[np.ndarray]:
    """The three digits of ``digits`` for an array of finite doubles."""
    with np.errstate(over="ignore", invalid="ignore"):
        spread = values * (2.0**42 + 1)
        first = np.where(np.abs(values) > LARGE, np.sign(values) * LARGE, spread - (spread - values))
        rest = np.where(np.abs(values) > LARGE, values, values - first)
        second = np.where(np.abs(rest) > 3e38, rest, rest.astype(np.float32).astype(np.float64))
        return [first, second, rest - second]


def whole(parts: Sequence[float]) -> float:
    """The double with these three digits."""
    first, second, third = parts
    if abs(second) > LARGE / 2:
        return second if np.isinf(second) else second + third
    return first + (second + third)


def column_counts(df: DataFrame, targets: Sequence[str], digit: Callable[[int, np.ndarray], np.ndarray]) -> DataFrame:
    """target, digit, n: how often each digit of the column ``targets[target]`` occurs.

    A task counts all columns of a batch and passes on the counts alone. ``digit`` takes a target and its
    column's values, and may leave values out.
    """
    cols = list(dict.fromkeys(targets))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = {c: batch.column(c).drop_null().to_numpy(zero_copy_only=False) for c in cols}
            values = {c: v[~np.isnan(v)] + 0.0 for c, v in values.items()}
            for i, name in enumerate(targets):
                found, n = np.unique(digit(i, values[name]), return_counts=True)
                columns = [pa.array(np.full(len(found), i, np.int32)), pa.array(found), pa.array(n.astype(np.int64))]
                yield pa.RecordBatch.from_arrays(columns, ["target", "digit", "n"])

    counted = df.select(*cols).mapInArrow(run, "target int, digit double, n long")
    return counted.groupBy("target", "digit").agg(F.sum("n").alias("n"))


def column_medians(df: DataFrame, cols: Sequence[str]) -> dict[str, float]:
    """The median of each column of doubles that has values: radix selection of all columns at once.

    Each of the three rounds is one scan that counts digits in tasks. A column has at most two digits under
    way, one for each middle rank, and only these reach the driver.
    """
    ways: list[tuple[str, tuple[float, ...], int]] = [(c, (), 0) for c in cols]
    ranks: dict[str, tuple[int, int]] = {}
    for turn in range(3):
        paths = [path for _, path, _ in ways]

        def digit(i: int, values: np.ndarray, paths=paths, turn=turn) -> np.ndarray:
            parts = split_array(values)
            same = np.ones(len(values), bool)
            for part, wanted in zip(parts, paths[i], strict=False):
                same &= part == wanted
            return parts[turn][same]

        each = Window.partitionBy("target")
        counts = column_counts(df, [c for c, _, _ in ways], digit)
        counts = counts.withColumns({"upto": F.sum("n").over(each.orderBy("digit")), "all": F.sum("n").over(each)})
        if turn == 0:
            low, high = F.floor((F.col("all") + 1) / 2), F.floor((F.col("all") + 2) / 2)
        else:
            left = F.array(*[F.array(*[F.lit(rank - before) for rank in ranks[c]]) for c, _, before in ways])[F.col("target")]
            low, high = left[0], left[1]
        picked = counts.where((F.col("upto") >= low) & (F.col("upto") - F.col("n") < high)).orderBy("target", "digit").collect()
        if turn == 0:
            ranks = {cols[r["target"]]: ((r["all"] + 1) // 2, (r["all"] + 2) // 2) for r in picked}
        ways = [(ways[r["target"]][0], (*ways[r["target"]][1], r["digit"]), ways[r["target"]][2] + r["upto"] - r["n"]) for r in picked]
        if not ways:
            return {}
    values: dict[str, list[float]] = {}
    for c, path, _ in ways:
        values.setdefault(c, []).append(whole(path))
    return {c: float(np.mean(v)) for c, v in values.items()}

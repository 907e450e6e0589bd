"""Standardising, clustering and nearest-center assignment of regions."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from headroom.operators.quantile import order_statistic
from headroom.sources.shared import cut_lineage

#: Standardised features keep so many decimals, so that their sums are exact in any order.
DIGITS = 6
#: Micro-clusters at most, between which distances are taken: their square is held by the driver.
MICRO = 2_000


def standardize(df: DataFrame, cols: Iterable[str], suffix: str = "") -> DataFrame:
    """Centre and scale features; a constant feature becomes 0.

    Means and deviations come from one scalar subquery over the same plan, whose shuffle
    Spark reuses.
    """
    cols = list(cols)
    moments = [F.struct(F.avg(c).alias("mean"), F.stddev_samp(c).alias("sd")).alias(c) for c in cols]
    stats = df.agg(F.struct(*moments).alias("moments")).scalar()
    return (
        df.withColumn("_moments", stats)
        .withColumns(
            {
                c + suffix: F.coalesce(
                    F.try_divide(F.col(c) - F.col("_moments")[c]["mean"], F.col("_moments")[c]["sd"]),
                    F.lit(0.0),
                )
                for c in cols
            }
        )
        .drop("_moments")
    )


def squared_distances(cols: Sequence[str], centers: Sequence[Sequence[float]]) -> Column:
    """Array of the squared distances to all centers."""
    table = F.array(*[F.array(*[F.lit(float(x)) for x in center]) for center in centers])

    def squared_distance(center: Column) -> Column:
        total = F.lit(0.0)
        for i, name in enumerate(cols):
            gap = F.col(name) - center[i]
            total = total + gap * gap
        return total

    return F.transform(table, squared_distance)


def assign_nearest(
    df: DataFrame, cols: Sequence[str], centers: Sequence[Sequence[float]], out: str = "cluster"
) -> DataFrame:
    """1-based number of the nearest center; the lower number wins a tie.

    All centers are one constant array: rows meet them in place, with no join, and the generated code has
    one distance whatever their number.
    """
    if not centers:
        raise ValueError("no centers")
    return (
        df.withColumn("_distances", squared_distances(cols, centers))
        .withColumn(out, F.array_position("_distances", F.array_min("_distances")).cast("int"))
        .drop("_distances")
    )


def cluster_sizes(df: DataFrame, keys: Iterable[str] = ("state", "county")) -> DataFrame:
    """Rows and distinct regions per cluster."""
    per_region = df.groupBy("cluster", *keys).agg(F.count("*").alias("_rows"))
    return per_region.groupBy("cluster").agg(
        F.sum("_rows").alias("members"), F.count("*").alias("regions")
    )


def cluster_centers(df: DataFrame, cols: Iterable[str]) -> DataFrame:
    """Mean of each raw feature per cluster and its share of the row's total."""
    cols = list(cols)
    means = df.groupBy("cluster").agg(*[F.avg(c).alias(c) for c in cols])
    total = sum((F.col(c) for c in cols[1:]), F.col(cols[0]))
    return means.withColumns({f"{c}_share": F.try_divide(F.col(c), total) for c in cols})


def scaled_points(df: DataFrame, features: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """``df`` with its standardised features, missing ones as 0, in columns of their own; stored, as it is read often."""
    scaled = [f"_z{i}" for i in range(len(features))]
    named = df.withColumns({z: F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for z, f in zip(scaled, features, strict=True)})
    return cut_lineage(standardize(named, scaled).withColumns({z: F.round(z, DIGITS) for z in scaled}), "scaled"), scaled


def _nearest_kept(centers: list[list[float]], sizes: dict[int, int], min_members: int):
    kept = [c for i, c in enumerate(centers) if sizes.get(i, 0) >= min_members]
    return sorted(kept or [centers[max(sizes, key=sizes.get)]])


def race(name: str, texts: Sequence[str]) -> np.ndarray:
    """An exponential time for each text, from 52 bits of the MD5 of ``name`` and the text: the same in any order and engine."""
    bits = [int.from_bytes(hashlib.md5(f"{name}|{text}".encode()).digest()[:7], "big") >> 4 for text in texts]
    return -np.log((np.array(bits, dtype=float) + 0.5) / 2.0**52)


def distances_to(at: np.ndarray, centers: Sequence[Sequence[float]]) -> np.ndarray:
    """Squared distances, rows x centers, added up feature by feature."""
    total = np.zeros((len(at), len(centers)))
    for i, column in enumerate(np.array(centers, dtype=float).reshape(len(centers), -1).T):
        total += (at[:, i, None] - column) ** 2
    return total


def coordinates(batch: pa.RecordBatch, cols: Sequence[str]) -> np.ndarray:
    return np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in cols], axis=1)


def seeded_centers(points: DataFrame, text: Column, cols: Sequence[str], k: int, starts: int, seed: int) -> list[list[list[float]]]:
    """Starting centers of every start: in each round the row whose time divided by its squared distance is least.

    That draws a row with a chance in proportion to its squared distance from the centers so far, without
    a random generator. All starts share a pass over the rows; a task passes on its best row for each.
    """
    named = points.select(text.alias("text"), *cols)
    chosen: list[list[list[float]]] = [[] for _ in range(starts)]
    for turn in range(k):

        def best(batches: Iterator[pa.RecordBatch], turn=turn, chosen=chosen) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at, texts = coordinates(batch, cols), batch.column("text").to_pylist()
                for s, centers in enumerate(chosen):
                    far = distances_to(at, centers).min(axis=1) if centers else np.ones(len(at))
                    time = np.divide(race(f"{seed}-{s}-{turn}", texts), far, where=far > 0, out=np.full(len(at), np.inf))
                    i = min(range(len(at)), key=lambda i: (time[i], texts[i]), default=None)
                    if i is not None and np.isfinite(time[i]):
                        yield pa.RecordBatch.from_pylist([{"start": s, "time": time[i], "text": texts[i], "at": at[i].tolist()}], schema=drawn)

        drawn = pa.schema([("start", pa.int32()), ("time", pa.float64()), ("text", pa.string()), ("at", pa.list_(pa.float64()))])
        rows = named.mapInArrow(best, "start int, time double, text string, at array<double>")
        for row in rows.groupBy("start").agg(F.min(F.struct("time", "text", "at")).alias("first")).collect():
            chosen[row["start"]].append(list(row["first"]["at"]))
    return chosen


def lloyd(points: DataFrame, cols: Sequence[str], chosen: list[list[list[float]]], max_iter: int) -> tuple[list[list[float]], dict[int, int]]:
    """Centers and sizes (by place) of the start with the least squared distances after ``max_iter`` steps.

    Tasks add up whole millionths, so centers do not depend on the order of rows. A center without rows stays where it is.
    """
    unit = 10**DIGITS

    def step(work: Sequence[int]) -> list:
        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at = coordinates(batch, cols)
                whole = np.rint(at * unit).astype(np.int64)
                for s in work:
                    near = distances_to(at, chosen[s])
                    place, cost = near.argmin(axis=1), np.rint(near.min(axis=1) * unit).astype(np.int64)
                    found, where = np.unique(place, return_inverse=True)
                    sums = np.zeros((len(found), len(cols) + 2), np.int64)
                    np.add.at(sums, where, np.column_stack([np.ones(len(at), np.int64), cost, whole]))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), s, np.int32)), pa.array(found.astype(np.int32)), *map(pa.array, sums.T)], names)

        names = ["start", "place", "n", "cost", *cols]
        parts = points.select(*cols).mapInArrow(add, "start int, place int, " + ", ".join(f"`{c}` long" for c in names[2:]))
        return parts.groupBy("start", "place").agg(*[F.sum(c).alias(c) for c in names[2:]]).collect()

    moving = list(range(len(chosen)))
    last: dict[int, list] = {}
    for turn in range(max_iter + 1):
        if not moving:
            break
        rows = step(moving)
        for s in moving:
            last[s] = [r for r in rows if r["start"] == s]
        if turn == max_iter:
            break
        new = {s: list(chosen[s]) for s in moving}
        for r in rows:
            new[r["start"]][r["place"]] = [r[c] / unit / r["n"] for c in cols]
        # A start that stands still keeps the sizes and costs just seen.
        moving = [s for s in moving if new[s] != chosen[s]]
        for s in moving:
            chosen[s] = new[s]
    best = min(last, key=lambda s: (sum(r["cost"] for r in last[s]), s))
    return chosen[best], {r["place"]: r["n"] for r in last[best]}


def cluster_regions(
    df: DataFrame,
    keys: Sequence[str],
    features: Sequence[str],
    k: int,
    min_members: int = 4,
    nstart: int = 3,
    max_iter: int = 20,
    seed: int = 1,
) -> tuple[DataFrame, DataFrame]:
    """K-means on standardised features: (rows with ``cluster``, centers in raw units).

    Seeds come from hashes of the keys and sums are exact, so the same rows give the same clusters, however
    they are dealt. The best of ``nstart`` starts by total cost is kept. Clusters with fewer than
    ``min_members`` regions are given up and their regions go to the nearest remaining
    center. Clusters are numbered 1.. by their center's coordinates. Only centers and sizes (at most
    k rows a start) reach the driver. Standardising first and the small-cluster rule are this library's choice.
    """
    base, scaled = scaled_points(df, features)
    # There can't be more clusters than different points, and one point is one cluster.
    k = min(k, base.select(*scaled).distinct().count())
    if k < 2:
        rows = assign_nearest(base, scaled, [[0.0] * len(scaled)])
        return rows.drop(*scaled), cluster_centers(rows, features)
    text = F.concat_ws("|", *[F.col(c).cast("string") for c in keys])
    centers, sizes = lloyd(base, scaled, seeded_centers(base, text, scaled, k, nstart, seed), max_iter)
    rows = assign_nearest(base, scaled, _nearest_kept(centers, sizes, min_members))
    return rows.drop(*scaled), cluster_centers(rows, features)


def complete_linkage(points: np.ndarray) -> list[tuple[int, int, float]]:
    """Agglomerative clustering by the largest distance: n - 1 merges (left, right, height), lowest first.

    A cluster goes by its smallest point. The chain of nearest neighbours finds pairs that are nearest to each
    other, which for this linkage merge sooner or later: n rows of distances are read some three times, where
    looking for the closest pair in each step would read all n squared.
    """
    n = len(points)
    distance = np.sqrt(((points[:, None, :] - points[None, :, :]) ** 2).sum(axis=2))
    np.fill_diagonal(distance, np.inf)
    name, alive, chain, out = list(range(n)), np.ones(n, bool), [], []
    while len(out) < n - 1:
        if not chain:
            chain.append(int(np.flatnonzero(alive)[0]))
        last = chain[-1]
        row = np.where(alive, distance[last], np.inf)
        near = int(row.argmin())
        # The one before in the chain wins a tie, or the chain would not end.
        if len(chain) > 1 and row[chain[-2]] <= row[near]:
            near = chain[-2]
            del chain[-2:]
            out.append((min(name[last], name[near]), max(name[last], name[near]), float(distance[last, near])))
            merged = np.maximum(distance[last], distance[near])
            distance[last], distance[:, last] = merged, merged
            distance[last, last] = np.inf
            alive[near] = False
            name[last] = min(name[last], name[near])
        else:
            chain.append(near)
    return sorted(out, key=lambda m: m[2])


def micro_clusters(points: DataFrame, cols: Sequence[str], most: int = MICRO, name: Column | None = None) -> tuple[Column, list, np.ndarray]:
    """(expression of a row's cell, cells ascending, their means): at most ``most`` cells, with ``n`` rows and their smallest ``name``.

    These are clustering features (count and sums) of the cells of nested grids, whose widths are powers of two
    in standard deviations; those of a wider cell are the sums of its parts. Cells are as narrow as ``most`` allows:
    if there are no more different points than that, every point is its own cell.
    """
    widths = [0.0] + [2.0**p for p in range(-10, 11)]
    cells = [F.array(*[F.floor(F.col(c) / w).cast("double") if w else F.col(c) for c in cols]) for w in widths]
    about = points.agg(*[F.approx_count_distinct(cell).alias(str(i)) for i, cell in enumerate(cells)]).first()
    at = next((i for i in range(len(widths)) if about[i] <= most), len(widths) - 1)
    while True:
        sums = [F.sum(F.col(c).cast(f"decimal(38,{DIGITS})")).alias(c) for c in cols]
        found = points.groupBy(cells[at].alias("cell")).agg(F.count("*").alias("n"), F.min(F.lit(None) if name is None else name).alias("name"), *sums)
        rows = found.limit(most + 1).collect()
        if len(rows) <= most or at == len(widths) - 1:
            break
        at += 1
    rows.sort(key=lambda r: tuple(r["cell"]))
    means = np.array([[float(r[c]) / r["n"] for c in cols] for r in rows]).reshape(len(rows), len(cols))
    return cells[at], rows, means


MERGES = "step int, left string, right string, height double, members long"


def hierarchical_merges(df: DataFrame, name: Column, features: Sequence[str], most: int = MICRO) -> DataFrame:
    """Complete linkage on standardised features: one row for each merge, lowest first.

    ``left`` and ``right`` are the smallest names in the first micro-cluster of either side, by standardised
    features (see ``micro_clusters``: single points, if there are no more than ``most``); ``members`` counts the rows of both.
    """
    points, scaled = scaled_points(df, features)
    _, cells, means = micro_clusters(points, scaled, most, name)
    size = [cell["n"] for cell in cells]
    rows = []
    for step, (a, b, height) in enumerate(complete_linkage(means), start=1):
        size[a] += size[b]
        rows.append((step, cells[a]["name"], cells[b]["name"], height, size[a]))
    return df.sparkSession.createDataFrame(rows, MERGES)


def hierarchical_regions(df: DataFrame, features: Sequence[str], k: int, most: int = MICRO) -> DataFrame:
    """The rows with ``cluster``: complete linkage on standardised features, cut where ``k`` clusters are left.

    Clusters are numbered by their first micro-cluster. At most ``most`` of these and their merges are on the driver.
    """
    points, scaled = scaled_points(df, features)
    cell, cells, means = micro_clusters(points, scaled, most)
    owner = list(range(len(cells)))
    for a, b, _ in complete_linkage(means)[: max(0, len(cells) - k)]:
        owner[b] = a

    def top(i: int) -> int:
        while owner[i] != i:
            i = owner[i]
        return i

    number = {t: n for n, t in enumerate(sorted({top(i) for i in range(len(cells))}), start=1)}
    labels = df.sparkSession.createDataFrame([(c["cell"], number[top(i)]) for i, c in enumerate(cells)], "_cell array<double>, cluster int")
    # At most ``most`` labels.
    return points.withColumn("_cell", cell).join(F.broadcast(labels), "_cell").drop("_cell", *scaled)


def split_groups(df: DataFrame, keys: Sequence[str], measures: Sequence[str], groups: int, least: int, out: str = "cluster") -> DataFrame:
    """The rows with ``out``: a k-d tree's leaves, 1.. in its order.

    Each level splits at the lower median of the next measure, unless a side would have fewer than ``least`` rows; rows
    at the median stay on the lower side. Levels are as many as ``groups`` leaves need, so there can be up to the
    next power of two. Missing measures count as 0. The leaves follow from the rows alone.
    """
    rows = cut_lineage(df.select(*keys, *[F.coalesce(F.col(m).cast("double"), F.lit(0.0)).alias(m) for m in measures], F.lit(1).alias("_leaf")), "leaves")
    for level in range(max(0, (groups - 1).bit_length())):
        measure = measures[level % len(measures)]
        middle = F.floor((F.col("n") + 1) / 2).cast("long")
        medians = order_statistic(rows, ["_leaf"], measure, middle, middle, "_median")
        # One row for each leaf, of which there are fewer than twice as many as groups.
        sides = rows.join(F.broadcast(medians), "_leaf").groupBy("_leaf", "_median").agg(F.count_if(F.col(measure) <= F.col("_median")).alias("low"), F.count("*").alias("all"))
        able = sides.where((F.col("low") >= least) & (F.col("all") - F.col("low") >= least)).select("_leaf", "_median")
        right = F.coalesce((F.col(measure) > F.col("_median")).cast("int"), F.lit(0))
        rows = rows.join(F.broadcast(able), "_leaf", "left").withColumn("_leaf", F.col("_leaf") * 2 + right).drop("_median")
        rows = cut_lineage(rows, "leaves")
    leaves = sorted(r["_leaf"] for r in rows.select("_leaf").distinct().collect())
    number = F.array_position(F.array(*map(F.lit, leaves)), F.col("_leaf")) if leaves else F.lit(None)
    return rows.withColumn(out, number.cast("int")).drop("_leaf")

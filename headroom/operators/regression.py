"""Least squares per group from mergeable triangular factors.

The models regress y on (A + B) * weekend, fully or partly interacted with dummy factors
such as page type and device. Within one cell of (factors, weekend) such a model is linear
in (1, A, B), so the triangular factor of a cell's rows (1, A, B, y) holds everything a fit needs:
ten numbers. Factors of two sets of rows are merged by factoring them on top of each other, in
every task first and then per cell, so a group with a third of all rows costs its tasks
one pass. The fit of a group is the least squares of its cells' stacked factors, a few dozen rows
with the singular values of the whole design: errors grow with its condition, not with the square of it.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterable, Iterator, Mapping, Sequence
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType
from headroom.sources.shared import cut_lineage

# The factors each model interacts with (A + B) * weekend.
MODELS: dict[str, tuple[str, ...]] = {"m1": ("pt", "rt"), "m2": ("pt",), "m3": ()}
#: Columns of a factor: 1, A, B, y.
WIDTH = 4
UPPER = np.triu_indices(WIDTH)
#: Singular values of a design below this share of the largest count as empty directions.
EMPTY = 1e-6
#: Rows factored at once, and cells that a task holds before it passes them on.
STACK, HELD = 8, 1 << 16
#: A cell's factors from all tasks are merged in this many sets before they meet.
SETS = 64
#: Groups solved at once.
BLOCK = 2048


def merge_factors(codes: np.ndarray, stacks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct codes, ascending, and one WIDTH x WIDTH factor each of all stacks (n x rows x WIDTH) with that code.

    Stacks of a code are factored a few at a time, level by level.
    """
    order = np.argsort(codes, kind="stable")
    codes, stacks = codes[order], stacks[order]
    done_codes, done = [np.zeros(0, codes.dtype)], [np.zeros((0, WIDTH, WIDTH))]
    while len(codes):
        rows = stacks.shape[1]
        several = max(2, STACK // rows)
        new = np.append(True, codes[1:] != codes[:-1])
        place = np.arange(len(codes)) - np.maximum.accumulate(np.where(new, np.arange(len(codes)), 0))
        heads = place % several == 0
        block = np.cumsum(heads) - 1
        pile = np.zeros((block[-1] + 1, several, rows, WIDTH))
        pile[block, place % several] = stacks
        factors = np.linalg.qr(pile.reshape(len(pile), several * rows, WIDTH), mode="r")
        codes = codes[heads]
        alone = np.append(True, codes[1:] != codes[:-1]) & np.append(codes[:-1] != codes[1:], True)
        done_codes.append(codes[alone])
        done.append(factors[alone])
        codes, stacks = codes[~alone], factors[~alone]
    codes, factors = np.concatenate(done_codes), np.concatenate(done)
    order = np.argsort(codes, kind="stable")
    return codes[order], factors[order]


def cell_codes(table: pa.Table, keys: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """A number for each row's combination of keys, and a row that has it."""
    codes = np.zeros(table.num_rows, np.int64)
    for key in keys:
        coded = table[key].combine_chunks()
        coded = coded if pa.types.is_dictionary(coded.type) else coded.dictionary_encode(null_encoding="encode")
        each = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        codes = np.unique(codes * (len(coded.dictionary) + 1) + each, return_inverse=True)[1]
    first = np.unique(codes, return_index=True)[1]
    return codes, first


def packed(keys: pa.Table, factors: np.ndarray) -> pa.Table:
    flat = pa.array(factors[:, *UPPER].ravel())
    bounds = pa.array(np.arange(len(factors) + 1, dtype=np.int32) * len(UPPER[0]))
    return keys.append_column("factor", pa.ListArray.from_arrays(bounds, flat))


def unpacked(factors: pa.Array | pa.ChunkedArray) -> np.ndarray:
    flat = pc.list_flatten(factors).to_numpy().reshape(len(factors), -1)
    out = np.zeros((len(flat), WIDTH, WIDTH))
    out[:, *UPPER] = flat
    return out


def cell_factors(
    df: DataFrame, group: Iterable[str], factors: Iterable[str], weekend: str, y: str, a: str, b: str
) -> DataFrame:
    """The triangular factors of the rows (1, A, B, y) of each group and cell: ``factor``, in at most SETS parts.

    Rows with a missing y, A, B or weekend do not take part.
    """
    cell = [*group, *factors, weekend]
    vy, va, vb = (F.col(c).cast("double") for c in (y, a, b))
    rows = df.where(vy.isNotNull() & va.isNotNull() & vb.isNotNull() & F.col(weekend).isNotNull())
    rows = rows.select(*group, *factors, F.col(weekend).cast("int").alias(weekend), va.alias("_a"), vb.alias("_b"), vy.alias("_y"))
    out = StructType([f for f in rows.schema.fields if f.name in cell] + [StructField("_set", IntegerType())])
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in out.fields) + ", factor array<double>"

    def merged(held: list[pa.Table]) -> pa.Table:
        table = pa.concat_tables(held)
        codes, first = cell_codes(table, cell)
        return packed(table.select([*cell, "_set"]).take(pa.array(first)), merge_factors(codes, unpacked(table["factor"]))[1])

    def collect(tables: Iterator[pa.Table]) -> Iterator[pa.RecordBatch]:
        """Factors of the same cell made one, as long as not too many cells are held."""
        held: list[pa.Table] = []
        for table in tables:
            held.append(table)
            if sum(t.num_rows for t in held) > HELD:
                held = [merged(held)]
                if held[0].num_rows > HELD // 2:
                    yield from held.pop().to_batches()
        if held:
            yield from merged(held).to_batches()

    def factor(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def tables() -> Iterator[pa.Table]:
            for batch in batches:
                if batch.num_rows:
                    table = pa.Table.from_batches([batch])
                    codes, first = cell_codes(table, cell)
                    design = np.stack([np.ones(len(codes)), *(table[c].to_numpy() for c in ("_a", "_b", "_y"))], axis=1)
                    keys = table.select(cell).take(pa.array(first))
                    part = pa.array(np.full(len(first), TaskContext.get().partitionId() % SETS, np.int32))
                    yield packed(keys.append_column("_set", part), merge_factors(codes, design[:, None, :])[1])

        return collect(tables())

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return collect(pa.Table.from_batches([batch]) for batch in batches if batch.num_rows)

    parts = rows.mapInArrow(factor, schema)
    return parts.repartition(*cell, "_set").mapInArrow(again, schema)


def _dummies(levels: Sequence) -> np.ndarray:
    """Treatment coding over the group's own sorted levels, the first one left out."""
    names = sorted(set(levels), key=str)
    return np.array([[float(v == name) for name in names[1:]] for v in levels]).reshape(len(levels), -1)


def solve_whole(factored: np.ndarray, weekend: np.ndarray, main: np.ndarray) -> np.ndarray:
    """``solve_cells`` by the singular values of the whole design."""
    terms = np.concatenate([main, main * weekend[:, None]], axis=1)
    groups, cells, n_terms = len(factored), len(weekend), terms.shape[1]
    design = np.einsum("ct,gcrk->gcrtk", terms, factored[:, :, :3, :3]).reshape(groups, cells * 3, n_terms * 3)
    target = factored[:, :, :3, 3].reshape(groups, cells * 3)
    left, values, right = np.linalg.svd(design, full_matrices=False)
    full = values > values[:, :1] * EMPTY
    scaled = np.where(full, np.einsum("gri,gr->gi", left, target) / np.where(full, values, 1.0), 0.0)
    beta = np.einsum("gij,gi->gj", right, scaled).reshape(groups, n_terms, 3)
    return np.einsum("ct,gtk->gck", terms, beta)


def solve_halves(factored: np.ndarray, weekend: np.ndarray, main: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``solve_cells`` from the designs of either kind of day, and for which groups that decides like the whole design.

    With u the terms of a day and v those of a weekend, the cells' equations fall into two sets. Where these leave
    some of u or v open, the whole design's solution of smallest norm is the one with the least |u|^2 + |v - u|^2. Singular values
    of the whole are within a factor of 1.7 of the halves', so groups whose halves have none near ``EMPTY`` have the same empty directions.
    """
    groups, size = len(factored), main.shape[1] * 3
    solved, held, values = [], [], []
    for half in (0, 1):
        cells = np.flatnonzero(weekend == half)
        part = factored[:, cells]
        design = np.einsum("ct,gcrk->gcrtk", main[cells], part[:, :, :3, :3]).reshape(groups, len(cells) * 3, size)
        target = part[:, :, :3, 3].reshape(groups, len(cells) * 3)
        if len(cells):
            left, value, right = np.linalg.svd(design, full_matrices=False)
            solved.append(np.einsum("gri,gr->gi", left, target))
        else:
            value, right = np.zeros((groups, 0)), np.zeros((groups, 0, size))
            solved.append(np.zeros((groups, 0)))
        held.append(right)
        values.append(value)
    most = np.max(np.concatenate(values, axis=1), axis=1, initial=0.0)[:, None]
    clear = np.ones(groups, bool)
    for half in (0, 1):
        full = values[half] > most * EMPTY * 10
        clear &= (full | (values[half] <= most * EMPTY * EMPTY * 10)).all(axis=1)
        held[half] = held[half] * full[:, :, None]
        solved[half] = np.einsum("gij,gi->gj", held[half], np.where(full, solved[half] / np.where(full, values[half], 1.0), 0.0))

    def kept(half: int, vector: np.ndarray, of: slice | np.ndarray = slice(None)) -> np.ndarray:
        """The part of a vector that the half's equations decide on."""
        return np.einsum("gij,gi->gj", held[half][of], np.einsum("gij,gj->gi", held[half][of], vector))

    day, end = solved
    # What the days leave open of u goes halfway to what the weekends want of it.
    open_ = np.flatnonzero((values[0] > most * EMPTY * 10).sum(axis=1) < size)
    if len(open_):
        free = np.eye(size) - np.einsum("gij,gik->gjk", held[0][open_], held[0][open_])
        wish = end[open_] - kept(1, day[open_], open_)
        matrix = np.eye(size) + free @ np.einsum("gij,gik->gjk", held[1][open_], held[1][open_]) @ free
        day[open_] += np.linalg.solve(matrix, np.einsum("gij,gj->gi", free, wish)[:, :, None])[:, :, 0]
    end = end + day - kept(1, day)
    terms = np.where((weekend == 1)[None, :, None], end[:, None, :], day[:, None, :]).reshape(groups, len(weekend), main.shape[1], 3)
    return np.einsum("ct,gctk->gck", main, terms), clear


def solve_cells(factored: np.ndarray, weekend: np.ndarray, factors: Mapping[str, Sequence], use: Sequence[str]) -> np.ndarray:
    """Intercept and slopes of A and B for every cell of many groups with the same cells.

    ``factored`` is groups x cells x WIDTH x WIDTH. A design of deficient rank (a market with one
    device, fewer rows than terms) gets the solution of smallest norm in the design's own columns.
    """
    main = np.concatenate([np.ones((len(weekend), 1)), *[_dummies(factors[f]) for f in use]], axis=1)
    if not np.isin(weekend, (0, 1)).all() or not np.isfinite(factored).all():
        return solve_whole(factored, weekend, main)
    out, clear = solve_halves(factored, weekend, main)
    if not clear.all():
        out[~clear] = solve_whole(factored[~clear], weekend, main)
    return out


def solve_groups(
    owner: np.ndarray, place: np.ndarray, factored: np.ndarray, known: Sequence[Mapping], factors: Sequence[str], weekend: str, models: Mapping[str, Sequence[str]]
) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """owner, place and models x 3 coefficients of cells, in parts; ``factored`` is of the group ``owner`` (ascending) and the cell ``known[place]``.

    Groups with the same levels of all factors are solved together: a cell that one of them lacks is an equation without terms.
    """
    week = np.array([cell[weekend] for cell in known], dtype=float)
    levels = [np.unique([str(cell[f]) for cell in known], return_inverse=True)[1] for f in factors]
    bounds = np.searchsorted(owner, np.arange(0, owner[-1] + 1 + BLOCK, BLOCK)) if len(owner) else []
    for start, end in itertools.pairwise(bounds):
        own, first = np.unique(owner[start:end], return_inverse=True)
        slot = np.full((len(own), len(known)), -1)
        slot[first, place[start:end]] = np.arange(start, end)
        has = [np.zeros((len(own), 0), bool)]
        for level in levels:
            has.append(np.stack([(slot[:, level == i] >= 0).any(axis=1) for i in range(level.max() + 1)], axis=1))
        layout = np.unique(np.packbits(np.concatenate(has, axis=1), axis=1), axis=0, return_inverse=True)[1].ravel() if levels else np.zeros(len(own), int)
        for each in range(layout.max() + 1 if len(own) else 0):
            groups = np.flatnonzero(layout == each)
            cells = np.flatnonzero((slot[groups] >= 0).any(axis=0))
            at = slot[groups][:, cells]
            design = np.where((at >= 0)[:, :, None, None], factored[at], 0.0)
            values = {f: [known[i][f] for i in cells] for f in factors}
            found = [solve_cells(design, week[cells], values, use) for use in models.values()]
            g, c = np.nonzero(at >= 0)
            yield own[groups[g]], cells[c], np.stack([model[g, c] for model in found], axis=1)


def ordered(known: list[dict], number: np.ndarray, factors: Sequence[str], weekend: str) -> tuple[list[dict], np.ndarray]:
    """Cells in the order of their levels, and the places there of cells by ``number``."""
    order = sorted(range(len(known)), key=lambda i: (*(str(known[i][f]) for f in factors), known[i][weekend] is not None, known[i][weekend] or 0))
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return [known[i] for i in order], rank[number]


def cell_coefficients(
    parts: DataFrame, group: Sequence[str], factors: Sequence[str], weekend: str, models: Mapping[str, Sequence[str]]
) -> DataFrame:
    """Per group and cell the (1, A, B) coefficients of every model, from ``cell_factors``.

    A group's cells are gathered: there are at most as many as the factors' levels have combinations, times SETS.
    """
    cell = [*factors, weekend]
    rows = parts.groupBy(*group).agg(F.collect_list(F.struct(*cell, "factor")).alias("_cells"))
    names = [f"{m}_{part}" for m in models for part in ("one", "a", "b")]
    fields = {f.name: f for f in parts.schema.fields}
    schema = StructType([fields[c] for c in (*group, *cell)] + [StructField(c, DoubleType()) for c in names])
    group, models = list(group), {m: tuple(f) for m, f in models.items()}

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            lists = batch.column("_cells")
            owner = np.repeat(np.arange(batch.num_rows), pc.list_value_length(lists).to_numpy())
            flat = pa.Table.from_batches([pa.RecordBatch.from_struct_array(pc.list_flatten(lists))])
            number, first = cell_codes(flat, cell)
            known = flat.select(cell).take(pa.array(first)).to_pylist()
            known, number = ordered(known, number, factors, weekend)
            codes, factored = merge_factors(owner * len(known) + number, unpacked(flat["factor"]))
            for groups, cells, found in solve_groups(codes // len(known), codes % len(known), factored, known, factors, weekend, models):
                table = {c: batch.column(c).take(pa.array(groups)) for c in group}
                table |= {c: pa.array([known[i][c] for i in cells.tolist()], flat.schema.field(c).type) for c in cell}
                table |= {name: pa.array(found.reshape(len(found), -1)[:, i]) for i, name in enumerate(names)}
                yield from pa.table(table).select([f.name for f in schema.fields]).to_batches()

    return rows.mapInArrow(solve, schema)


def linear(model: str, a: str, b: str) -> Column:
    return F.col(f"{model}_one") + F.col(f"{model}_a") * F.col(a) + F.col(f"{model}_b") * F.col(b)


def fit_together(
    df: DataFrame, group: Sequence[str], y: str, a: str, b: str, predicted: Mapping[str, tuple[str, str]], models: Mapping[str, Sequence[str]], weekend: str
) -> DataFrame:
    """``df`` with the columns ``predicted`` (name -> model and its B), each group fitted by the task that has its rows.

    A window counts a group's rows, which brings them to one task one after another; the task makes sure of that.
    """
    factors = list(dict.fromkeys(f for use in models.values() for f in use))
    cell, columns, group = [*factors, weekend], list(df.columns), list(group)
    models, predicted, number = dict(models), dict(predicted), {m: i for i, m in enumerate(models)}
    counted = df.withColumn("_rows", F.count(F.lit(1)).over(Window.partitionBy(*group)))
    schema = StructType([*df.schema.fields, *[StructField(name, DoubleType()) for name in predicted]])

    def doubles(table: pa.Table, name: str) -> tuple[np.ndarray, np.ndarray]:
        """A column's values, and which of them there are."""
        column = table[name].combine_chunks()
        there = column.is_valid().to_numpy(zero_copy_only=False)
        return pc.fill_null(column.cast(pa.float64()), 0.0).to_numpy(zero_copy_only=False), there

    def fitted(table: pa.Table, sizes: list[int]) -> pa.Table:
        owner = np.repeat(np.arange(len(sizes)), sizes)
        codes = cell_codes(table, group)[0]
        starts = np.cumsum([0, *sizes[:-1]])
        if len(np.unique(codes[starts])) < len(sizes) or (codes != codes[starts][owner]).any():
            raise RuntimeError("rows of a group do not lie together")
        place, first = cell_codes(table, cell)
        known, place = ordered(table.select(cell).take(pa.array(first)).to_pylist(), place, factors, weekend)
        values, there = zip(*(doubles(table, c) for c in (a, b, y)), strict=True)
        used = np.logical_and.reduce(there) & np.array([k[weekend] is not None for k in known])[place]
        known = [{**k, weekend: None if k[weekend] is None else int(k[weekend])} for k in known]
        found = np.zeros((len(sizes), len(known), len(models), 3))
        has = np.zeros(found.shape[:2], bool)
        if used.any():
            design = np.stack([np.ones(len(codes)), *values], axis=1)[used, None, :]
            cells, factored = merge_factors(owner[used] * len(known) + place[used], design)
            known_ = [{**k, weekend: k[weekend] or 0} for k in known]
            for g, c, coefficients in solve_groups(cells // len(known), cells % len(known), factored, known_, factors, weekend, models):
                found[g, c], has[g, c] = coefficients, True
        # A null matches nothing, neither as a group nor as a level.
        whole = np.array([all(v is not None for v in k.values()) for k in known])[place] & has[owner, place]
        for c in group:
            whole &= table[c].combine_chunks().is_valid().to_numpy(zero_copy_only=False)
        for name, (model, by) in predicted.items():
            own = found[owner, place, number[model]]
            new, known_new = doubles(table, by)
            value = own[:, 0] + own[:, 1] * values[0] + own[:, 2] * new
            table = table.append_column(name, pa.array(value, mask=~(whole & there[0] & known_new)))
        return table.select([*columns, *predicted])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in itertools.chain(batches, [None]):
            if batch is not None:
                held += [batch] if batch.num_rows else []
                if sum(h.num_rows for h in held) < HELD:
                    continue
            if not held:
                continue
            table = pa.Table.from_batches(held)
            rows, sizes, at = table["_rows"].to_numpy(), [], 0
            while at < len(rows) and at + rows[at] <= len(rows):
                sizes.append(int(rows[at]))
                at += sizes[-1]
            if batch is None and at < len(rows):
                raise RuntimeError("rows of a group do not lie together")
            if sizes:
                yield from fitted(table.slice(0, at), sizes).to_batches()
            held = table.slice(at).to_batches()

    return counted.mapInArrow(run, schema)


def grouped_ols(
    df: DataFrame,
    group: Sequence[str],
    y: str,
    a: str,
    b: str,
    b_new: str,
    models: Mapping[str, Sequence[str]] = MODELS,
    weekend: str = "weekend",
    fitted: bool = False,
    together: bool = False,
) -> DataFrame:
    """Fit every model per group and predict each row with B replaced by ``b_new``.

    Adds one prediction column per model (and ``<model>_fitted`` with B itself). All models
    share one pass over the data. ``together`` says that the rows of any group fit a task: they are then fitted and predicted
    in one pass, without a shuffle if ``df`` is kept by the group.
    """
    if together:
        predicted = {m: (m, b_new) for m in models} | ({f"{m}_fitted": (m, b) for m in models} if fitted else {})
        return fit_together(df, list(group), y, a, b, predicted, models, weekend)
    factors = list(dict.fromkeys(f for use in models.values() for f in use))
    parts = cell_factors(df, list(group), factors, weekend, y, a, b)
    cell, names = [*factors, weekend], [f"{m}_{part}" for m in models for part in ("one", "a", "b")]
    # Stored, so that a few groups' coefficients go to the rows and not the rows to them; one row for each group, so
    # that rows kept by group stay where they are.
    coefficients = cut_lineage(cell_coefficients(parts, list(group), factors, weekend, models), "coefficients")
    cells = coefficients.groupBy(*group).agg(F.collect_list(F.struct(*cell, *names)).alias("_cells"))

    def own(known: Column) -> Column:
        return reduce(and_, [known[c] == F.col(c) for c in cell])

    joined = df.join(cells, list(group), "left").withColumn("_cell", F.get(F.filter("_cells", own), F.lit(0)))
    joined = joined.withColumns({name: F.col("_cell")[name] for name in names})
    out = {m: linear(m, a, b_new) for m in models}
    if fitted:
        out.update({f"{m}_fitted": linear(m, a, b) for m in models})
    return joined.withColumns(out).drop("_cells", "_cell", *names)


def design_columns(
    a: str, b: str, weekend: str, levels: Mapping[str, Sequence[str]], use: Sequence[str]
) -> dict[str, Column]:
    """The same design written out: 1, A, B, W, A:W, B:W and each dummy times all of them."""
    va, vb, vw = F.col(a), F.col(b), F.col(weekend).cast("double")
    base = {"one": F.lit(1.0), "a": va, "b": vb, "w": vw, "a_w": va * vw, "b_w": vb * vw}
    out = dict(base)
    for factor in use:
        for level in sorted(levels[factor])[1:]:
            on = (F.col(factor) == level).cast("double")
            out.update({f"{factor}_{level}_{name}": on * col for name, col in base.items()})
    return out

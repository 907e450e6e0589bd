"""Arrow batches in bounded pieces: the frame around every per-batch helper."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text a helper sees at once; a longer single text is a piece of its own.
PIECE_BYTES = 1 << 21


def pieces(texts: pa.Array, limit: int = PIECE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges that hold about ``limit`` bytes each, never splitting a text."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(sizes)
    at = 0
    while at < len(sizes):
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + limit, side="right")))
        yield at, to
        at = to


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts in a row, and where each one begins and ends."""
    texts = pc.fill_null(texts, "")
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    wide = pa.types.is_large_string(texts.type)
    _, offsets, data = texts.buffers()
    bounds = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1]
    bounds = bounds.astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[bounds[0] : bounds[-1]], bounds - bounds[0]


def map_pieces(df: DataFrame, helper: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str, text: str = "text", limit: int = PIECE_BYTES) -> DataFrame:
    """``helper`` over pieces of every batch; ``text`` names the column that is measured."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, to in pieces(batch.column(text), limit):
                yield helper(batch.slice(at, to - at))

    return df.mapInArrow(run, schema)


def send(spark: SparkSession, value: Any) -> Callable[[], Any]:
    """Broadcasts ``value`` and gives the function that reads it in a task.

    It travels as bytes that hold its classes too, since workers may not have this package.
    """
    sent = spark.sparkContext.broadcast(cloudpickle.dumps(value))
    read: list = []

    def received() -> Any:
        if not read:
            read.append(pickle.loads(sent.value))
        return read[0]

    return received


def free_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, or with underscores before it where the table has a column of that name."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted = f"_{wanted}"
    return wanted


def narrow(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns under the given types, missing ones as nulls: the rest may have any name."""
    have = {c.lower(): c for c in df.columns}
    return df.select(
        *(
            (F.col(f"`{have[name.lower()]}`") if name.lower() in have else F.lit(None)).cast(kind).alias(name)
            for name, kind in columns.items()
        )
    )

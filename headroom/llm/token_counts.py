"""Token counts by an exact length histogram.

Every whole text is encoded once and only its length is kept; documents are aggregated by that
length. Suffix sums over the histogram then answer, for any context limit n: how many documents
are longer, how many tokens remain after truncation at n, and which quantile n is.

Nulls and empty texts have 0 tokens and are counted as documents. An empty table gives an empty
histogram. Columns other than the text are ignored.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from headroom.llm.arrow import narrow

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pattern that splits texts before merging, as published with the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Runs of white space (as the pattern's \s has it) that are encoded apart: the pattern backtracks over them.
LONG_RUN = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{512,}")
#: Lengths per block of the suffix sums. Texts are below 2**31 bytes, so there are at most 2**19 blocks.
BLOCK = 4096


def count_tokens(encoding, text: str) -> int:
    """Tokens of a text. A long run of white space is cut out and merged as the one piece that it is.

    The pattern makes one piece of a run, but for its last character if text follows, which goes on with that.
    """
    total = at = 0
    for m in LONG_RUN.finditer(text):
        end = m.end() - (m.end() < len(text))
        total += len(encoding.encode_ordinary(text[at : m.start()])) + len(encoding._encode_single_piece(text[m.start() : end]))
        at = end
    return total + len(encoding.encode_ordinary(text[at:]))


def length_counter(spark: SparkSession, vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> Callable[[], Callable[[str], int]]:
    """Makes, inside a task, the function text -> number of tokens. The file is read by the driver and sent along."""
    with open(vocabulary, "rb") as file:
        lines = spark.sparkContext.broadcast(file.read())

    def make() -> Callable[[str], int]:
        import tiktoken

        ranks = {base64.b64decode(token): int(rank) for token, rank in (x.split() for x in lines.value.splitlines() if x)}
        encoding = tiktoken.Encoding("vocabulary", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        return lambda text: count_tokens(encoding, text)

    return make


def length_histogram(docs: DataFrame, counter: Callable[[], Callable[[str], int]]) -> DataFrame:
    """n_tokens, n_docs: one row per encoded length that occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter()
        for batch in batches:
            lengths = np.fromiter((count(t.as_py() or "") for t in batch.column("text")), np.int64, batch.num_rows)
            found, times = np.unique(lengths, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(times.astype(np.int64))], ["n_tokens", "n_docs"])

    parts = narrow(docs, text="string").mapInArrow(run, "n_tokens long, n_docs long")
    return parts.groupBy("n_tokens").agg(F.sum("n_docs").alias("n_docs"))


def _suffix(histogram: DataFrame) -> DataFrame:
    """Adds docs_from and tokens_from (over lengths of n_tokens and more), total_docs and total_tokens.

    Sums run inside a block of lengths and over the blocks, so no task sees the whole histogram.
    """
    block = F.floor(F.col("n_tokens") / BLOCK)
    rows = histogram.withColumn("block", block).withColumn("tokens", F.col("n_tokens") * F.col("n_docs"))
    sums = rows.groupBy("block").agg(F.sum("n_docs").alias("docs"), F.sum("tokens").alias("block_tokens"))
    later = Window.orderBy(F.col("block").desc()).rowsBetween(Window.unboundedPreceding, -1)
    blocks = sums.select(
        "block",
        F.coalesce(F.sum("docs").over(later), F.lit(0)).alias("docs_later"),
        F.coalesce(F.sum("block_tokens").over(later), F.lit(0)).alias("tokens_later"),
        F.sum("docs").over(Window.partitionBy()).alias("total_docs"),
        F.sum("block_tokens").over(Window.partitionBy()).alias("total_tokens"),
    )
    inside = Window.partitionBy("block").orderBy(F.col("n_tokens").desc())
    return (
        rows.withColumn("docs_inside", F.sum("n_docs").over(inside))
        .withColumn("tokens_inside", F.sum("tokens").over(inside))
        .join(blocks, "block")
        .withColumn("docs_from", F.col("docs_inside") + F.col("docs_later"))
        .withColumn("tokens_from", F.col("tokens_inside") + F.col("tokens_later"))
    )


def context_limits(histogram: DataFrame) -> DataFrame:
    """The answers at every length that occurs; between two of them they are linear.

    n_tokens, n_docs, longer_docs, tokens_upto (whole documents that fit), truncated_tokens (all
    documents cut at n_tokens), share_upto (the quantile), total_docs, total_tokens.
    """
    n = F.col("n_tokens")
    longer = F.col("docs_from") - F.col("n_docs")
    return _suffix(histogram).select(
        "n_tokens",
        "n_docs",
        longer.alias("longer_docs"),
        (F.col("total_tokens") - F.col("tokens_from") + F.col("tokens")).alias("tokens_upto"),
        (F.col("total_tokens") - F.col("tokens_from") + n * F.col("docs_from")).alias("truncated_tokens"),
        ((F.col("total_docs") - longer) / F.col("total_docs")).alias("share_upto"),
        "total_docs",
        "total_tokens",
    )


def truncated_totals(histogram: DataFrame, limits: Sequence[int]) -> DataFrame:
    """context_limit, truncated_tokens, longer_docs for stated limits, from one pass over the histogram."""
    n = F.col("n_tokens")
    found = histogram.agg(
        *[F.coalesce(F.sum(F.least(n, F.lit(x)) * F.col("n_docs")), F.lit(0)).alias(f"t{i}") for i, x in enumerate(limits)],
        *[F.coalesce(F.sum(F.when(n > x, F.col("n_docs"))), F.lit(0)).alias(f"d{i}") for i, x in enumerate(limits)],
    )
    rows = [F.struct(F.lit(x).alias("context_limit"), F.col(f"t{i}").alias("truncated_tokens"), F.col(f"d{i}").alias("longer_docs")) for i, x in enumerate(limits)]
    return found.select(F.inline(F.array(*rows)))


def length_quantiles(histogram: DataFrame, shares: Sequence[float]) -> DataFrame:
    """share, n_tokens: the smallest length that at least this share of the documents does not exceed."""
    answers = context_limits(histogram)
    found = answers.agg(*[F.min(F.when(F.col("share_upto") >= x, F.col("n_tokens"))).alias(f"q{i}") for i, x in enumerate(shares)])
    rows = [F.struct(F.lit(float(x)).alias("share"), F.col(f"q{i}").alias("n_tokens")) for i, x in enumerate(shares)]
    return found.select(F.inline(F.array(*rows)))

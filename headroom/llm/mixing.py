"""Mixing sources to target weights: nested hash thresholds from histograms, no sort of documents.

Every document gets a 60-bit hash. A source's share is a number of whole passes over it plus
the documents whose hash lies below a threshold. The threshold is found by histograms of words
by (source, hash bucket): the bucket in which the budget ends is refined, and only its rows are
read for the next level, until it holds a single hash value. A larger share keeps every document
of a smaller one.

Nulls: a null text has size 0, a null source is a source of its own, a null doc_id hashes like
any other value. Rows with equal doc_id and text share a hash and are taken together. An empty
table gives no rows. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from headroom.llm.arrow import free_name, narrow
from headroom.sources.shared import cut_lineage

WEIGHTS = (5, 2, 1)
MAX_COPIES = 3
HASH_BITS = 60
LEVEL_BITS = 15
WORD = r"[^\x20\x09-\x0D]+"


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def hash_of(doc_id: Column, text: Column) -> Column:
    """60 bits of the MD5 of id and text: any engine gives the same number."""
    joined = F.concat(F.coalesce(doc_id.cast("string"), F.lit("-")), F.lit("|"), F.coalesce(text, F.lit("")))
    return F.conv(F.substring(F.md5(joined), 1, HASH_BITS // 4), 16, 10).cast("long")


def source_key(source: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), source), F.lit("null"))


def sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source, its key, size in words and hash: all that mixing needs, without the texts."""
    docs = narrow(docs, doc_id="long", source="string", text="string")
    return docs.select(
        "doc_id",
        "source",
        source_key(F.col("source")).alias("source_key"),
        size_of(F.col("text")).alias("size"),
        hash_of(F.col("doc_id"), F.col("text")).alias("hash"),
    )


def targets(sized: DataFrame, weights: Sequence[int] = WEIGHTS, copies: int = MAX_COPIES) -> DataFrame:
    """source_key, source_size, target: one row per source.

    Shares follow the weights, which repeat over the sources in code point order, null last. A
    share stops at ``copies`` times the source; in order of that limit per weight, the sources
    that stop are a prefix, so running sums find them without rounds. The windows here see one
    row per source.
    """
    totals = sized.groupBy("source_key").agg(F.first("source").alias("source"), F.sum("size").alias("source_size"))
    position = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (position % len(weights) + 1).cast("int")).cast("long")
    limit = (F.lit(copies) * F.col("source_size")).cast("long")
    ranked = totals.withColumn("weight", weight).withColumn("limit", limit)
    by_limit = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last())
    earlier, everything = by_limit.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    # The level that the remaining sources would get, if all before this one had stopped.
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("limit").over(earlier), F.lit(0))
    heavy = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(earlier), F.lit(0))
    leveled = ranked.withColumn("level", left / heavy)
    stops = F.col("limit") / F.col("weight") <= F.col("level")
    leveled = leveled.withColumn("stops", stops)
    level = F.min(F.when(~F.col("stops"), F.struct(F.col("limit") / F.col("weight"), "level"))).over(everything)["level"]
    target = F.when(F.col("stops"), F.col("limit").cast("double")).otherwise(level * F.col("weight"))
    return leveled.select("source_key", "source_size", target.alias("target"))


def thresholds(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """source_key, source_size, target, epochs, cut: each document ``epochs`` times, once more below ``cut``."""
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    state = targets.withColumn("epochs", epochs).withColumn(
        "budget", F.col("target") - F.col("epochs") * F.col("source_size")
    )
    state = cut_lineage(state.withColumn("prefix", F.lit(0).cast("long")), "mix-targets")
    whole = state.drop("budget", "prefix")
    # Whole passes use up these targets: nothing more is taken, documents without words neither.
    spent = state.where("budget <= 0").select("source_key")
    for level in range(HASH_BITS // LEVEL_BITS):
        rest = HASH_BITS - LEVEL_BITS * (level + 1)
        at = F.shiftright("hash", rest)
        rows = sized.join(state.select("source_key", "budget", "prefix"), "source_key")
        rows = rows.where(F.shiftright("hash", rest + LEVEL_BITS) == F.col("prefix"))
        buckets = rows.groupBy("source_key", at.alias("bucket")).agg(
            F.sum("size").alias("words"), F.first("budget").alias("budget")
        )
        upto = F.sum("words").over(Window.partitionBy("source_key").orderBy("bucket"))
        ends = buckets.withColumn("upto", upto).where(
            (F.col("upto") > F.col("budget")) & (F.col("upto") - F.col("words") <= F.col("budget"))
        )
        left = F.col("budget") - (F.col("upto") - F.col("words"))
        state = cut_lineage(
            ends.select("source_key", left.alias("budget"), F.col("bucket").alias("prefix"), "words"), "mix-level"
        )
    # The last bucket is a single hash value: it is taken if that comes nearer to the target.
    cut = F.col("prefix") + F.when(F.col("words") / 2 <= F.col("budget"), 1).otherwise(0)
    state = state.join(spent, "source_key", "left_anti")
    return whole.join(state.select("source_key", cut.alias("cut")), "source_key", "left").fillna(0, ["cut"])


def copies_of(hash: Column, epochs: Column, cut: Column) -> Column:
    return epochs + F.when(hash < cut, 1).otherwise(0)


def mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS, copies: int = MAX_COPIES) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, copies, taken (words, repeats counted)."""
    sized = cut_lineage(sizes(docs), "mix-sizes")
    limits = cut_lineage(thresholds(sized, targets(sized, weights, copies)), "mix-thresholds")
    times = copies_of(F.col("hash"), F.col("epochs"), F.col("cut"))
    return (
        sized.join(limits, "source_key")
        .withColumn("copies", times)
        .select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))
    )


def keep_mixed(docs: DataFrame, weights: Sequence[int] = WEIGHTS, copies: int = MAX_COPIES) -> DataFrame:
    """The documents that the mix takes, with ``copies``: how often."""
    sized = cut_lineage(sizes(docs), "mix-sizes")
    limits = cut_lineage(thresholds(sized, targets(sized, weights, copies)), "mix-thresholds")
    key, epochs, cut = (free_name(docs, n) for n in ("mix_source", "mix_epochs", "mix_cut"))
    limits = limits.select(F.col("source_key").alias(key), F.col("epochs").alias(epochs), F.col("cut").alias(cut))
    copies = copies_of(hash_of(F.col("doc_id"), F.col("text")), F.col(epochs), F.col(cut))
    name = free_name(docs, "copies")
    kept = docs.join(limits, source_key(F.col("source")) == F.col(key)).withColumn(name, copies)
    return kept.where(F.col(name) > 0).drop(key, epochs, cut)


def mix_sql(table: str = "documents", ids: str = "CAST(doc_id AS VARCHAR)") -> str:
    """The mix by its definition: documents in hash order up to the budget."""
    return f"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS size,
         CAST('0x' || substr(md5(coalesce({ids}, '-') || '|' || coalesce(text, '')), 1, 15) AS BIGINT) AS hash
  FROM {table}),
totals AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight
  FROM sized GROUP BY source),
leveled AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER earlier, 0))::DOUBLE
            / (sum(weight) OVER () - coalesce(sum(weight) OVER earlier, 0))::DOUBLE AS level,
         (3 * source_size)::DOUBLE / weight::DOUBLE AS per_weight
  FROM totals
  WINDOW earlier AS (ORDER BY (3 * source_size)::DOUBLE / weight::DOUBLE, source NULLS LAST
                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
shares AS (
  SELECT source, source_size,
         CASE WHEN per_weight <= level THEN (3 * source_size)::DOUBLE
              ELSE arg_min(level, per_weight) FILTER (WHERE per_weight > level) OVER () * weight END AS target
  FROM leveled),
ordered AS (
  SELECT d.doc_id, d.source, d.size, s.source_size, s.target,
         CASE WHEN s.source_size > 0 THEN floor(s.target / s.source_size) ELSE 0 END AS epochs,
         sum(d.size) OVER (PARTITION BY d.source ORDER BY d.hash) AS upto,
         sum(d.size) OVER (PARTITION BY d.source, d.hash) AS same
  FROM sized d JOIN shares s ON d.source IS NOT DISTINCT FROM s.source)
SELECT doc_id, source, CAST(size AS BIGINT) AS size, source_size, target,
       CAST(epochs + CASE WHEN upto - same + same / 2.0 <= target - epochs * source_size
                            AND upto - same < source_size AND target > epochs * source_size
                          THEN 1 ELSE 0 END AS BIGINT) AS copies
FROM ordered"""

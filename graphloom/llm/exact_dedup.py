"""Exact deduplication by two-pass Bloom filtering, in DataFrame functions only.

Texts are equal when they are identical after deleting space and U+0009..U+000D. Each text has a SHA-256 of
that form; its 64-bit hash selects one word of a blocked Bloom filter (one 64-bit word per four texts) and four
bits in it.

Pass 1 inserts every hash. The filter is sharded by word: (word, mask) pairs are counted with partial
aggregation, so a group of copies shrinks to one pair per task before it moves, and each word then yields its
bits that were set by at least two texts. Those words are the second filter, "possibly repeated".
Pass 2 probes it: rows with a bit missing there are unique for sure and pass straight through; only the rest
shuffles, and is grouped by the full SHA-256, so false positives cost a little movement and no exactness.

The second filter is broadcast while it has at most ``common.FILTER_WORDS`` words (16 bytes each in the wire format,
about 80 MB as a hash table); above that its words are joined by shuffling the narrow key rows.

Of equal texts the row with the most code points stays, then the smallest doc_id, then the earliest row.

Defined results: null text = empty text; texts of white space only equal the empty text; null doc_id sorts
before all others; repeated rows (same doc_id, same text) are kept once; an empty table gives an empty table;
extra columns stay as they are, and helper columns live in one struct so that no name can clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bloom_address, documents, forget, maybe_broadcast, probed, written

#: Characters that do not count: space and U+0009 to U+000D.
IGNORED = " \t\n\x0b\x0c\r"
TEXTS_PER_WORD = 4


def normalised(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), IGNORED, "")


def repeated_bits(keys: DataFrame, words: int) -> DataFrame:
    """(word, bits): the bits that at least two rows set."""
    word, mask = bloom_address(F.col("sha"), words)
    sets = keys.select(word.alias("word"), mask.alias("mask")).groupBy("word", "mask").agg(F.count("*").alias("n"))
    zero = F.lit(0).cast("bigint")

    def step(acc: Column, x: Column) -> Column:
        seen = acc["once"].bitwiseAND(x["mask"])
        return F.struct(
            acc["once"].bitwiseOR(x["mask"]).alias("once"),
            acc["bits"].bitwiseOR(seen).bitwiseOR(F.when(x["n"] > 1, x["mask"]).otherwise(zero)).alias("bits"),
        )

    # A word gets four distinct masks on average, however many rows share one, so this list stays short.
    return (
        sets.groupBy("word")
        .agg(F.collect_list(F.struct("mask", "n")).alias("masks"))
        .select("word", F.aggregate("masks", F.struct(zero.alias("once"), zero.alias("bits")), step, lambda a: a["bits"]).alias("bits"))
        .where(F.col("bits") != 0)
    )


def keys_of(docs: DataFrame, text: str = "text") -> DataFrame:
    """One narrow row per document: sha, doc_id, code points, row number within the written table."""
    return docs.select(
        F.sha2(normalised(F.col(text)).cast("binary"), 256).alias("sha"),
        F.col("doc_id"),
        F.char_length(F.coalesce(F.col(text), F.lit(""))).alias("points"),
        F.monotonically_increasing_id().alias("row"),
    )


def decide(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256. Texts are read once and never shuffled."""
    keys = written(keys_of(docs, text), "exact-keys")
    words = max(1, keys.count() // TEXTS_PER_WORD)
    bits = written(repeated_bits(keys, words), "exact-bits")
    split = probed(keys, "sha", bits, words)
    unique = split.where(~F.col("maybe")).select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("bigint").alias("group_size"), F.lit(True).alias("kept"), F.col("sha").alias("text_sha256"))
    rest = split.where("maybe").drop("maybe")
    best = F.min(F.struct((-F.col("points")).alias("p"), "doc_id", "row")).alias("best")
    # One narrow row a group, made by partial aggregation. A large group never meets in one task: the table is
    # broadcast while small, and beyond that joined by sort-merge, whose large partitions adaptive execution splits.
    groups = written(rest.groupBy("sha").agg(best, F.count("*").alias("group_size")), "exact-groups")
    joined = rest.join(maybe_broadcast(groups, 300_000), "sha")
    copies = joined.select("doc_id", F.col("best.doc_id").alias("keep_id"), "group_size", (F.col("row") == F.col("best.row")).alias("kept"), F.col("sha").alias("text_sha256"))
    return unique.unionByName(copies)


def deduplicate(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, all columns as they are.

    Whole rows pass straight through when the filter proves them unique; only the others shuffle, and copies
    are reduced within each task before they move.
    """
    packed = docs.select(F.struct("*").alias("row"))
    sha = F.sha2(normalised(F.col(f"row.`{text}`")).cast("binary"), 256).alias("sha")
    keys = written(packed.select(sha), "exact-keys")
    words = max(1, keys.count() // TEXTS_PER_WORD)
    bits = written(repeated_bits(keys, words), "exact-bits")
    forget(keys)
    split = probed(packed.select("row", sha), "sha", bits, words)
    order = F.struct((-F.char_length(F.coalesce(F.col(f"row.`{text}`"), F.lit("")))).alias("p"), F.col("row.doc_id").alias("i"))
    copies = split.where("maybe").groupBy("sha").agg(F.min_by("row", order).alias("row"))
    return split.where(~F.col("maybe")).select("row.*").unionByName(copies.select("row.*"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decide(documents(spark, sf_dir))


OP6_SQL = r"""
WITH keyed AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256, length(coalesce(text, '')) AS points
  FROM documents
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY text_sha256 ORDER BY points DESC, doc_id) AS rn,
         first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY points DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY text_sha256) AS group_size
  FROM keyed
)
SELECT doc_id, keep_id, group_size, rn = 1 AS kept, text_sha256 FROM ranked
"""


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: one document of each group of equal texts stays."""
    return deduplicate(docs)

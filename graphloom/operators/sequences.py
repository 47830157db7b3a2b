"""Ordered rows: chunks, spans, carried values, BIO tags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def pack_parts(parts: Column, limit: int, joiner: str = "\n") -> Column:
    """Greedy chunks of an array of texts: a new chunk starts when the bytes would exceed the limit."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit(None).cast("string").alias("open"))

    def step(acc: Column, part: Column) -> Column:
        grown = F.concat(acc["open"], F.lit(joiner), part)
        fits = F.octet_length(grown) <= limit
        return (
            F.when(acc["open"].isNull(), F.struct(acc["done"].alias("done"), part.alias("open")))
            .when(fits, F.struct(acc["done"].alias("done"), grown.alias("open")))
            .otherwise(F.struct(F.concat(acc["done"], F.array(acc["open"])).alias("done"), part.alias("open")))
        )

    return F.aggregate(parts, start, step, lambda acc: F.when(acc["open"].isNull(), acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["open"]))))


def runs(df: DataFrame, key: str, pos: str, kind: str) -> DataFrame:
    """Maximal runs of equal ``kind`` at consecutive positions: (key, kind, start, end), end exclusive."""
    island = F.row_number().over(Window.partitionBy(key).orderBy(pos)) - F.row_number().over(Window.partitionBy(key, kind).orderBy(pos))
    return df.withColumn("island", island).groupBy(key, kind, "island").agg(F.min(pos).alias("start"), (F.max(pos) + 1).alias("end")).drop("island")


def carried(value: str, key: str, pos: str) -> Column:
    """The last non-null value before the row."""
    return F.last(value, ignorenulls=True).over(Window.partitionBy(key).orderBy(pos).rowsBetween(Window.unboundedPreceding, -1))


def state(marker: str, key: str, pos: str) -> Column:
    """The last non-null marker up to and with the row."""
    return F.last(marker, ignorenulls=True).over(Window.partitionBy(key).orderBy(pos).rowsBetween(Window.unboundedPreceding, 0))


def numbered_blocks(df: DataFrame, blank: Column, key: str, pos: str) -> DataFrame:
    """Rows with the number of blank rows before them in their key: the sentence id of a CoNLL file."""
    before = F.sum(F.when(blank, 1).otherwise(0)).over(Window.partitionBy(key).orderBy(pos).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return df.withColumn("block", before)


def bio(tokens: DataFrame, spans: DataFrame, key: str) -> DataFrame:
    """(key, start, end, token) and spans (key, s, e, kind) -> tokens with tag B-, I- or O; the first span wins."""
    inside = (F.col("t.start") >= F.col("p.s")) & (F.col("t.end") <= F.col("p.e"))
    joined = tokens.alias("t").join(spans.alias("p"), (F.col(f"t.{key}") == F.col(f"p.{key}")) & inside, "left")
    best = joined.groupBy(F.col(f"t.{key}").alias(key), F.col("t.start").alias("start"), F.col("t.token").alias("token")).agg(F.min(F.struct("p.s", "p.kind")).alias("x"))
    tag = F.when(F.col("x.s").isNull(), "O").when(F.col("x.s") == F.col("start"), F.concat(F.lit("B-"), F.col("x.kind"))).otherwise(F.concat(F.lit("I-"), F.col("x.kind")))
    return best.select(key, "start", "token", tag.alias("tag"))


def overlapping_windows(x: Column, size: int, overlap: int) -> Column:
    """Pieces of ``size`` characters, each starting ``size - overlap`` after the one before."""
    step = size - overlap
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.length(x) - overlap - 1), F.lit(step))
    return F.transform(starts, lambda s: F.substring(x, s + 1, F.lit(size)))

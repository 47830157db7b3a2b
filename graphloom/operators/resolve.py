"""Entity memory and resolution."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def canonical_map(entities: DataFrame) -> DataFrame:
    """(mention, canonical): canonical names map to themselves, mentions fill gaps, the first writer wins.

    entities: (pos, name, mention)."""
    names = entities.select(F.col("name").alias("mention"), F.col("name").alias("canonical"), F.lit(0).alias("prio"), "pos")
    aliases = entities.select("mention", F.col("name").alias("canonical"), F.lit(1).alias("prio"), "pos")
    return names.union(aliases).groupBy("mention").agg(F.min_by("canonical", F.struct("prio", "pos", "canonical")).alias("canonical"))


def best_evidence(evidence: DataFrame) -> DataFrame:
    """Per key the evidence of the highest weight, then longest text, then first position, then smallest text."""
    order = F.struct(-F.col("weight"), -F.length("text"), "pos", "text")
    return evidence.groupBy("key").agg(F.min_by(F.struct("text", "weight"), order).alias("x")).select("key", "x.text", "x.weight")


def consensus(votes: DataFrame) -> DataFrame:
    """Per key the most frequent class, the smallest name of ties."""
    counts = votes.groupBy("key", "cls").agg(F.count("*").alias("votes"))
    order = Window.partitionBy("key").orderBy(F.desc("votes"), "cls")
    return counts.withColumn("r", F.row_number().over(order)).where("r = 1").drop("r")


def first_seen(df: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """The first row per key in input order."""
    return df.withColumn("r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("r = 1").drop("r")


def upsert(store: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Rows replace stored rows of the same key."""
    return store.join(rows.select(key).distinct(), key, "left_anti").unionByName(rows)


def swap_inverse(triples: DataFrame, pairs: list[tuple[str, str]], inverse: str, literal: str) -> DataFrame:
    """Exchange each pair of columns where the predicate is inverse and the object no literal."""
    turn = F.col(inverse) & ~F.col(literal)
    return triples.withColumns({c: F.when(turn, F.col(d)).otherwise(F.col(c)) for a, b in pairs for c, d in ((a, b), (b, a))})


def compliant(triples: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept, dropped) by: typed subject, typed predicate, and a literal or typed object."""
    ok = F.coalesce((F.col("subject_class") != "") & (F.col("predicate_uri") != "") & (F.col("object_is_literal") | (F.col("object_class") != "")), F.lit(False))
    return triples.where(ok), triples.where(~ok)

"""Writers: evaluation JSON, traces, Turtle of instances, graph tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def results(rows: DataFrame, path: str) -> None:
    """One JSON object per document."""
    rows.write.mode("overwrite").json(path)


def evaluation(totals: DataFrame, samples: DataFrame, path: str) -> None:
    """Aggregates and samples side by side."""
    totals.write.mode("overwrite").json(f"{path}/aggregate")
    samples.write.mode("overwrite").json(f"{path}/samples")


def append_trace(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).csv(path)


def turtle_lines(triples: DataFrame, base: str) -> DataFrame:
    """A line per triple whose subject is an instance (starts with the base)."""
    o = F.when(F.col("kind") == "literal", F.concat(F.lit('"'), F.regexp_replace(F.regexp_replace("o", r"\\", r"\\\\"), '"', r'\\"'), F.lit('"'))).otherwise(F.concat(F.lit("<"), "o", F.lit(">")))
    return triples.where(F.col("s").startswith(base)).select(F.concat(F.lit("<"), "s", F.lit("> <"), "p", F.lit("> "), o, F.lit(" .")).alias("value"))


def turtle(triples: DataFrame, base: str, path: str) -> None:
    turtle_lines(triples, base).write.mode("overwrite").text(path)


def graph_tables(triples: DataFrame, base: str) -> tuple[DataFrame, DataFrame]:
    """(nodes with types and attributes, edges between instances)."""
    own = triples.where(F.col("s").startswith(base))
    local = F.substring_index(F.substring_index("p", "/", -1), "#", -1)
    types = own.where(F.col("p").endswith("type")).groupBy("s").agg(F.array_sort(F.collect_set("o")).alias("types"))
    facts = own.where(~F.col("p").endswith("type") & (F.col("kind") == "literal")).groupBy("s", local.alias("k")).agg(F.max("o").alias("v"))
    attrs = facts.groupBy("s").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v")))).alias("attributes"))
    nodes = own.select("s").distinct().join(types, "s", "left").join(attrs, "s", "left")
    ends = own.select(F.col("s").alias("o")).distinct()
    return nodes, own.where(F.col("kind") == "uri").join(ends, "o").select("s", "p", "o")

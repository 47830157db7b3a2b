"""Precision, recall and F1 from counts; nothing is rounded before the edge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ratio(a: Column, b: Column, none: float = 0.0) -> Column:
    """a / b, or ``none`` when b is 0."""
    return F.when(b != 0, a / F.when(b != 0, b)).otherwise(none)


def f1(p: Column, r: Column) -> Column:
    return ratio(2 * p * r, p + r)


def with_prf(df: DataFrame, tp: str = "tp", predicted: str = "predicted", gold: str = "gold", none: float = 0.0) -> DataFrame:
    """Adds precision, recall and f1."""
    out = df.withColumns({"precision": ratio(F.col(tp), F.col(predicted), none), "recall": ratio(F.col(tp), F.col(gold))})
    return out.withColumn("f1", f1(F.col("precision"), F.col("recall")))


def micro(samples: DataFrame, *keys: str) -> DataFrame:
    """One row per key from summed counts, with false positives and negatives."""
    sums = samples.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in ("tp", "predicted", "gold")])
    return with_prf(sums.withColumns({"fp": F.col("predicted") - F.col("tp"), "fn": F.col("gold") - F.col("tp")}))


def macro(samples: DataFrame, *keys: str, digits: int = 4) -> DataFrame:
    """Means of the samples' rounded metrics, rounded again."""
    each = with_prf(samples)
    mean = lambda c: F.round(F.avg(F.round(c, digits)), digits)
    return each.groupBy(*keys).agg(*[mean(c).alias(c) for c in ("precision", "recall", "f1")], F.count("*").alias("samples"))


def on_spine(spine: DataFrame, counts: DataFrame, key: str) -> DataFrame:
    """Counts for every document of the spine; those without any keep zeros. Never an inner join."""
    joined = spine.join(counts, key, "left")
    return joined.withColumns({c: F.coalesce(c, F.lit(0)).cast("bigint") for c in ("tp", "predicted", "gold")})


def best_by(df: DataFrame, group: str, key: str, metrics: list[str]) -> DataFrame:
    """Per group and metric the best value and the smallest key that reaches it."""
    best = [x for m in metrics for x in (F.max(m).alias(f"best_{m}"), F.max_by(key, F.struct(F.col(m), -F.col("rank"))).alias(f"best_{m}_key"))]
    return df.withColumn("rank", F.dense_rank().over(Window.partitionBy(group).orderBy(key))).groupBy(group).agg(*best)


def credit(depth: Column) -> Column:
    """Typing credit by distance in the hierarchy: 1, 0.6, 0.3, else 0."""
    return F.when(depth == 0, 1.0).when(depth == 1, 0.6).when(depth == 2, 0.3).otherwise(0.0)

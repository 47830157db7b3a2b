"""Assignment of predictions to gold within a document.

Candidates have (key, i, j, score); key is the document, i the prediction's and j the gold's ordinal. Only
pairs at or above the threshold are gathered, and only within a document, the unit of the metric.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _taken(pairs: Column) -> Column:
    """Fold over an ordered array of (i, j, ...): a pair is taken when both its ends are free."""
    free = lambda acc, x: ~F.exists(acc, lambda t: (t["i"] == x["i"]) | (t["j"] == x["j"]))
    return F.aggregate(pairs, F.slice(pairs, 1, 0), lambda acc, x: F.when(free(acc, x), F.concat(acc, F.array(x))).otherwise(acc))


def _fold(candidates: DataFrame, key: str, threshold: float, first: list[str]) -> DataFrame:
    order = [(-F.col("score")).alias("s") if c == "score" else F.col(c).alias(c + "_") for c in first]
    rows = candidates.where(F.col("score") >= threshold).select(key, F.struct(*order, "i", "j", "score").alias("x"))
    arrays = rows.groupBy(key).agg(F.sort_array(F.collect_list("x")).alias("xs"))
    return arrays.select(key, F.explode(_taken(F.col("xs"))).alias("x")).select(key, "x.i", "x.j", "x.score")


def greedy(candidates: DataFrame, key: str, threshold: float) -> DataFrame:
    """One to one, best score first; ties by prediction, then gold."""
    return _fold(candidates, key, threshold, ["score", "i", "j"])


def first_fit(candidates: DataFrame, key: str, threshold: float) -> DataFrame:
    """One to one; predictions in order take the first free gold over the threshold."""
    return _fold(candidates, key, threshold, ["i", "j"])


def gold_only(candidates: DataFrame, key: str, threshold: float) -> DataFrame:
    """Gold is used once, a prediction may serve several: the best prediction of each gold."""
    hit = candidates.where(F.col("score") >= threshold)
    best = hit.groupBy(key, "j").agg(F.max_by(F.struct("i", "score"), F.struct("score", -F.col("i"))).alias("x"))
    return best.select(key, "x.i", "j", "x.score")


def missed(gold: DataFrame, pairs: DataFrame, key: str) -> DataFrame:
    """Gold rows (key, j) in no pair."""
    return gold.join(pairs.select(key, "j"), [key, "j"], "left_anti")


def review_candidates(candidates: DataFrame, judged: DataFrame, key: str, threshold: float) -> DataFrame:
    """Greedy pairs at a low threshold plus judged pairs of predictions that have none."""
    own = greedy(candidates, key, threshold).withColumn("origin", F.lit("similarity"))
    more = judged.join(own.select(key, "i"), [key, "i"], "left_anti").withColumn("origin", F.lit("judge"))
    return own.unionByName(more)


def judged_pairs(responses: DataFrame, key: str, n_pred: str, n_gold: str) -> DataFrame:
    """Pairs from a judge's text: the first [...] of {"pred": 1-based, "gold": 1-based}; bad numbers are dropped."""
    body = F.regexp_extract("response", r"(?s)\[.*?\]", 0)
    items = F.from_json(body, "array<struct<pred:int,gold:int>>")
    rows = responses.select(key, n_pred, n_gold, F.explode(items).alias("x"))
    ok = F.col("x.pred").between(1, F.col(n_pred)) & F.col("x.gold").between(1, F.col(n_gold))
    return rows.where(ok).select(key, (F.col("x.pred") - 1).alias("i"), (F.col("x.gold") - 1).alias("j")).distinct()


def triple_text(subject: Column, obj: Column, relation: Column | None = None) -> Column:
    """subject [SEP] object, or with the relation between them, trimmed."""
    parts = [subject, obj] if relation is None else [subject, relation, obj]
    return F.trim(F.concat_ws(" [SEP] ", *[F.trim(F.coalesce(p, F.lit(""))) for p in parts]))

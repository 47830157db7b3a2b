"""Scores arriving files batch by batch: the same metric plan as for tables, in foreachBatch.

Each batch's counts are appended under its batch id, so that a batch that runs again replaces nothing and is
counted once when its latest file is read by id.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def score_stream(rows: DataFrame, counts: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """rows: a streaming DataFrame. Writes ``counts`` of every batch to out/batch=<id> until the input is used up."""

    def batch(df: DataFrame, number: int) -> None:
        counts(df).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return rows.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def totals(spark: SparkSession, out: str, *keys: str) -> DataFrame:
    """Sums over all batches so far."""
    rows = spark.read.option("basePath", out).parquet(f"{out}/batch=*")
    return rows.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in ("tp", "predicted", "gold")])

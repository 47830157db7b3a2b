"""Streaming extension: incremental scoring of ``documents`` as they arrive."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph
from ..streaming import scoring
from .base import query, table


@query("SELECT lang, count(*) FILTER (toxic = 1 AND n_chars > 2000) AS tp, count(*) FILTER (n_chars > 2000) AS predicted, count(*) FILTER (toxic = 1) AS gold FROM documents JOIN labels USING (doc_id) GROUP BY lang")
def stream_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file stream joined with static labels, scored per batch, summed over the batches."""
    labels = table(spark, sf_dir, "labels")
    schema = table(spark, sf_dir, "documents").schema
    rows = spark.readStream.schema(schema).parquet(f"{sf_dir}/documents.parque[t]")  # a glob takes a file or a folder

    def counts(df: DataFrame) -> DataFrame:
        yes, said = F.col("toxic") == 1, F.col("n_chars") > 2000
        return df.join(labels, "doc_id").groupBy("lang").agg(F.count_if(yes & said).alias("tp"), F.count_if(said).alias("predicted"), F.count_if(yes).alias("gold"))

    folder = f"{graph.shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    scoring.score_stream(rows, counts, f"{folder}/out", f"{folder}/state").awaitTermination()
    return scoring.totals(spark, f"{folder}/out", "lang")

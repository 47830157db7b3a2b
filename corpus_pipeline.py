"""The corpus pipeline: toxic documents go, copies and near-copies go, personal data is sanitised, the rest is packed.

Each stage takes (spark, docs, sf_dir), works on all its predecessor kept, and is written as Parquet and read again
before the next one. All but the last return the columns of documents; the last returns packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from graphloom.llm import exact_dedup, minhash, packing, pii, toxicity
from graphloom.llm.common import documents, forget, release, written

STAGES = [
    ("toxicity", toxicity.stage),
    ("exact_dedup", exact_dedup.stage),
    ("minhash", minhash.stage),
    ("pii", pii.stage),
    ("best_fit_packing", packing.stage),
]

#: A trained classifier, near-duplicate classes and tokenising have no SQL form; the stages are tested against
#: brute-force versions in tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    last = None
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if last is not None:
            forget(last)
        last = docs
        release(spark)
    return STAGES[-1][1](spark, docs, sf_dir)

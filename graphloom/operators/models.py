"""Model slots: an encoder and a judge as columns. Defaults are deterministic and need no network.

An encoder is a function from a list of texts to a list of vectors, a judge one from prompts to responses; both run in
Arrow batches on the executors, once per distinct input.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hashing_encoder(size: int = 64) -> Callable[[list[str]], list[list[float]]]:
    """Counts of hashed words."""

    def encode(texts: list[str]) -> list[list[float]]:
        out = []
        for t in texts:
            v = [0.0] * size
            for w in (t or "").lower().split():
                v[zlib.crc32(w.encode()) % size] += 1.0
            out.append(v)
        return out

    return encode


def encoded(df: DataFrame, text: str, encoder: Callable[[list[str]], list[list[float]]], to: str = "embedding") -> DataFrame:
    """``df`` with a vector column; equal texts are encoded once."""

    @F.pandas_udf("array<float>")
    def vectors(x):
        import pandas as pd

        return pd.Series(encoder(x.fillna("").tolist()))

    distinct = df.select(F.col(text).alias("__text")).distinct().withColumn(to, vectors("__text"))
    return df.join(distinct, df[text].eqNullSafe(F.col("__text")), "left").drop("__text")


def judged(prompts: DataFrame, prompt: str, ask: Callable[[list[str]], list[str]], tries: int = 3, to: str = "response") -> DataFrame:
    """``prompts`` with the judge's responses; a batch that fails is asked again, then left null."""

    @F.pandas_udf("string")
    def responses(x):
        import pandas as pd

        for left in range(tries, 0, -1):
            try:
                return pd.Series(ask(x.tolist()), dtype="object")
            except Exception:
                if left == 1:
                    return pd.Series([None] * len(x), dtype="object")

    return prompts.withColumn(to, responses(prompt))


def replayed(prompts: DataFrame, key: str, table: DataFrame) -> DataFrame:
    """Responses from a table (key, response) instead of a model."""
    return prompts.join(table.select(key, "response"), key, "left")

"""Toxicity: a linear classifier on character n-grams whose features are scaled by naive Bayes log-count ratios.

Features are the distinct byte 4-, 5- and 6-grams of the lower-cased text with white space folded,
hashed into ``BUCKETS`` buckets (presence only, so length does not dilute a hit). For each bucket
r = log((p_b / |p|) / (q_b / |q|)) over smoothed document counts of the two classes; a logistic regression
is then fitted on the features multiplied by r, and its weights are folded back: w_b = r_b * v_b. Buckets
that are rare in both classes, or whose ratio is within three standard errors of none, get r = 0.

Fitting reads at most ``MAX_ROWS`` labelled rows (the smallest by a hash of doc_id: a bounded, documented
sample); scoring reads every row and whole text.

Defined results: null text = empty text, whose score is the intercept's; rows without labels are only scored;
repeated rows are scored each; a doc_id labelled twice takes the larger label; null labels are ignored. With no
labelled row, or one class only, the score is the smoothed share of the positive class. Extra columns of
``docs`` are kept by ``score``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import documents, forget, tidy, written

BUCKETS = 1 << 18
GRAMS = (4, 5, 6)
#: The most labelled rows that fitting looks at.
MAX_ROWS = 10_000
#: Bytes of text hashed at once; a longer text goes through in overlapping windows.
WINDOW = 1 << 18
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], dtype=np.uint64)
_SPACE = np.arange(256, dtype=np.uint8)
_SPACE[[9, 10, 11, 12, 13]] = 32


def _window_buckets(raw: np.ndarray) -> np.ndarray:
    wide = _SPACE[raw].astype(np.uint64)
    out, n = [], len(wide)
    for g in GRAMS:
        if n < g:
            continue
        h = wide[: n - g + 1] * _ODD[0]
        for k in range(1, g):
            h += wide[k : n - g + 1 + k] * _ODD[k]
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9 + 2 * g)
        out.append((h >> np.uint64(64 - 18)).astype(np.int32))
    return np.concatenate(out) if out else np.empty(0, np.int32)


class _Seen:
    """Reusable scratch that tells which buckets of a document are new."""

    def __init__(self):
        self.mark = np.zeros(BUCKETS, np.bool_)

    def distinct(self, raw: np.ndarray) -> np.ndarray:
        parts, step = [], WINDOW - max(GRAMS) + 1
        for at in range(0, max(1, len(raw)), step):
            b = _window_buckets(raw[at : at + WINDOW])
            b = b[~self.mark[b]]
            if len(b):
                stamp = np.arange(len(b), dtype=np.int32)
                self.order = getattr(self, "order", None)
                if self.order is None:
                    self.order = np.empty(BUCKETS, np.int32)
                self.order[b] = stamp
                b = b[self.order[b] == stamp]
                self.mark[b] = True
                parts.append(b)
        got = np.concatenate(parts) if parts else np.empty(0, np.int32)
        self.mark[got] = False
        return got


def _raw(batch: pa.RecordBatch, name: str):
    """The UTF-8 bytes of each row of a string column, without copying."""
    for piece in [batch.column(name)]:
        piece = piece.cast(pa.large_binary())
        offsets = np.frombuffer(piece.buffers()[1], np.int64, len(piece) + 1, piece.offset * 8)
        data = np.frombuffer(piece.buffers()[2] or b"", np.uint8)
        for i in range(len(piece)):
            yield data[offsets[i] : offsets[i + 1]]


def _featurised(texts: DataFrame, schema: str, make) -> DataFrame:
    """``make`` turns an iterator of (y, distinct buckets) into record batches of ``schema``."""

    def run(batches):
        seen = _Seen()
        yield from make((y, seen.distinct(x)) for b in batches for y, x in zip(b.column("y").to_pylist(), _raw(b, "text")))

    return texts.mapInArrow(tidy(run), schema)


def _class_counts(rows):
    """Per task: in how many toxic and clean texts each bucket occurs."""
    counts = np.zeros((2, BUCKETS), np.int64)
    for y, buckets in rows:
        counts[int(y > 0), buckets] += 1
    used = np.flatnonzero(counts.sum(0))
    yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(counts[1, used]), pa.array(counts[0, used])], ["bucket", "toxic", "clean"])


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> dict:
    """Fit on labelled documents outside the held-out fold. Returns {"w": float32[BUCKETS], "b": float}.

    The driver gets one row of counts per bucket, and per labelled row the few buckets whose ratio isn't zero."""
    chosen = (
        labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
        .groupBy("doc_id")
        .agg(F.max(F.col("toxic").cast("int")).alias("y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(max_rows)
    )
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("y", F.lower(F.coalesce("text", F.lit(""))).alias("text"))
    texts = written(texts, "toxic-sample")
    n_all, n_toxic = texts.select(F.count("*"), F.coalesce(F.sum(F.when(F.col("y") > 0, 1)), F.lit(0))).first()
    share = (n_toxic + 1) / (n_all + 2)
    bias = float(np.log(share / (1 - share)))
    w = np.zeros(BUCKETS, np.float32)
    if n_toxic in (0, n_all):
        forget(texts)
        return {"w": w, "b": bias}
    table = _featurised(texts, "bucket bigint, toxic bigint, clean bigint", _class_counts)
    table = table.groupBy("bucket").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")).toPandas()
    toxic, clean = np.zeros(BUCKETS), np.zeros(BUCKETS)
    toxic[table["bucket"]], clean[table["bucket"]] = table["toxic"], table["clean"]
    n_clean = n_all - n_toxic
    r = np.log(((1 + toxic) / (n_toxic + 2)) / ((1 + clean) / (n_clean + 2)))
    often = (toxic >= max(3, 0.02 * n_toxic)) | (clean >= max(3, 0.02 * n_clean))
    r[~often | (np.abs(r) < 0.7) | (np.abs(r) < 3 * np.sqrt(1 / (1 + toxic) + 1 / (1 + clean)))] = 0  # rare, or not surely apart
    mark = np.packbits(r != 0)

    def kept(rows):
        keep = np.unpackbits(mark)[:BUCKETS].astype(bool)
        found = [(int(y > 0), x[keep[x]].tobytes()) for y, x in rows]
        yield pa.RecordBatch.from_arrays([pa.array([y for y, _ in found], pa.int32()), pa.array([x for _, x in found], pa.binary())], ["y", "buckets"])

    got = _featurised(texts, "y int, buckets binary", kept).toPandas()
    forget(texts)
    y = got["y"].to_numpy(np.float64)
    rows = [np.frombuffer(x, np.int32) for x in got["buckets"]]
    index = np.concatenate(rows)
    of_row = np.repeat(np.arange(len(y), dtype=np.int32), [len(x) for x in rows])
    used, local = np.unique(index, return_inverse=True)
    values = r[used][local]
    v, b = np.zeros(len(used)), bias
    # Full-batch Adam on the L2-regularised logistic loss; sums over the index arrays replace a sparse matrix.
    m1, m2, mb1, mb2, rate, penalty = np.zeros_like(v), np.zeros_like(v), 0.0, 0.0, 0.02, 1e-3
    for step in range(1, 121):
        z = np.bincount(of_row, weights=values * v[local], minlength=len(y)) + b
        e = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y) / len(y)
        g = np.bincount(local, weights=values * e[of_row], minlength=len(used)) + penalty * v
        gb = e.sum()
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.99 * m2 + 0.01 * g * g
        mb1, mb2 = 0.9 * mb1 + 0.1 * gb, 0.99 * mb2 + 0.01 * gb * gb
        fix1, fix2 = 1 - 0.9**step, 1 - 0.99**step
        v -= rate * (m1 / fix1) / (np.sqrt(m2 / fix2) + 1e-9)
        b -= rate * (mb1 / fix1) / (np.sqrt(mb2 / fix2) + 1e-9)
    w[used] = r[used] * v
    return {"w": w, "b": float(b)}


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))


def score(docs: DataFrame, model: dict, text: str = "text", to: str | None = "score") -> DataFrame:
    """``docs`` with a double column ``to``, in place of one of that name; (row, score) with ``to`` None. The model (1 MB, fixed size) travels with the tasks."""
    shipped = docs.sparkSession.sparkContext.broadcast((model["w"], model["b"]))
    packed = docs.select(F.struct("*").alias("row"), F.lower(F.coalesce(F.col(text).cast("string"), F.lit(""))).alias("text"))
    schema = T.StructType([T.StructField("row", docs.schema), T.StructField("score", T.DoubleType())])

    def run(batches):
        w, bias = shipped.value
        seen = _Seen()
        for b in batches:
            z = np.array([w[seen.distinct(x)].sum(dtype=np.float64) for x in _raw(b, "text")]) + bias
            yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(1 / (1 + np.exp(-np.clip(z, -40, 40))))], ["row", "score"])

    scored = packed.mapInArrow(tidy(run), schema)
    return scored if to is None else scored.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns if c != to], F.col("score").alias(to))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", held_out().alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents scored 0.5 or more go."""
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, model, to=None).where(F.col("score") < 0.5).select("row.*")

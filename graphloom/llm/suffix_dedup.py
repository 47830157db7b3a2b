"""Repeated substrings, exactly: bytes covered by a string of ``LENGTH`` bytes that also starts elsewhere.

Bucket-pointer refinement orders suffixes by first throwing them into q-gram buckets and then refining each
bucket by the bucket ids found at later offsets. Only membership matters here (does a string have an equal?), so
buckets are split and never ordered, and only one suffix in about 75 enters at all: every window of LENGTH bytes
points to its smallest q-gram by hash (the leftmost of equals), a choice that depends on the window's content alone,
so equal windows point to equal q-grams at equal distance. Windows that follow one another mostly share their
pointer and travel as one range.

1. q-gram buckets: ranges whose q-gram occurs once are done, nothing in them repeats.
2. First refinement, by the bucket id of the whole range (everything its windows touch): ranges with an equal
   one are done, all of them repeats. Exact copies and the inside of shared passages end here, and of the equal
   ranges one goes on as a witness for the others' neighbours.
3. Recursive refinement of the rest, bucket by bucket: each window's bucket id (q-gram bucket, distance, rolling
   hash of its bytes) is looked up among all windows of its bucket. Buckets of over ``HOT`` ranges are split by
   window over all tasks instead.

A bucket id is two independent 64-bit hashes (that of the q-gram and that of the string), and strings only meet
within a q-gram bucket.

Defined results: null text = empty text; matches never cross documents; repeated rows repeat each other wholly;
rows are told apart by doc_id and text hash, equal rows get equal results; an empty table gives an empty table;
extra columns stay in ``remove``. Texts longer than ``SEGMENT`` are worked on in overlapping segments.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bloom, documents, forget, probed, release, written

LENGTH = 200
Q = 50
#: Ranges of one bucket that a task refines by itself.
HOT = 20_000
SEGMENT = 1 << 19

_RNG = np.random.default_rng(7)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_U = np.uint64
_TABLES: dict[str, np.ndarray] = {}


def _powers() -> tuple[np.ndarray, np.ndarray]:
    if not _TABLES:
        n = SEGMENT + LENGTH + 1
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            factors = np.full(n + 1, base, np.uint64)
            factors[0] = 1
            _TABLES[name] = np.cumprod(factors, dtype=np.uint64)
    return _TABLES["up"], _TABLES["down"]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(33))) * _U(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> _U(29))) * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(32))


def _sums(raw: np.ndarray) -> np.ndarray:
    up, _ = _powers()
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[raw] * up[: len(raw)], dtype=np.uint64)])


def _hashes(sums: np.ndarray, starts, ends) -> np.ndarray:
    """Hashes of the strings [start, end), the same wherever they stand."""
    return (sums[ends] - sums[starts]) * _powers()[1][starts]


def ranges(raw: np.ndarray):
    """(first start, end of starts, q-gram, q-gram hash, hash of all that the windows touch), for a whole text."""
    out = []
    for at in range(0, max(0, len(raw) - LENGTH + 1), SEGMENT):
        own = raw[at : at + SEGMENT + LENGTH - 1]
        sums = _sums(own)
        n = len(own) - LENGTH + 1
        grams = _mix((sums[Q:] - sums[:-Q]) * _powers()[1][: len(own) - Q + 1])
        low = (grams & ~_U((1 << 20) - 1)) | np.arange(len(grams), dtype=np.uint64)
        width = 1
        while 2 * width <= LENGTH - Q + 1:
            low = np.minimum(low[:-width], low[width:])
            width *= 2
        if rest := LENGTH - Q + 1 - width:
            low = np.minimum(low[:-rest], low[rest:])
        points = (low[:n] & _U((1 << 20) - 1)).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], points[1:] != points[:-1]]))
        end = np.append(first[1:], n)
        p = points[first]
        whole = _mix(_hashes(sums, first, end + LENGTH - 1) ^ _mix(((p - first) << 20 | (end - first)).astype(np.uint64)))
        out.append((first + at, end + at, p + at, grams[p].view(np.int64), whole.view(np.int64)))
    return [np.concatenate(x) for x in zip(*out)] if out else [np.empty(0, np.int64)] * 5


def _raws(column):
    for x in column.cast(pa.binary()):
        yield np.frombuffer(x.as_buffer(), np.uint8) if x.is_valid else np.empty(0, np.uint8)


def _window_ids(context: np.ndarray, starts: int, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """Distance to the q-gram and hash of each window in a range's context. reach: of its first window."""
    sums = _sums(context)
    k = np.arange(starts)
    distance = (reach - k).astype(np.int64)
    return distance, _mix(_hashes(sums, k, k + LENGTH) ^ _mix(distance.astype(np.uint64)))


def _runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def _batch(columns: dict, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)


def _refined(batches):
    """Rows sorted by gram, whole buckets in one task -> the byte runs that repeat: (row, first, last)."""
    schema = pa.schema([("row", pa.binary()), ("first", pa.int64()), ("last", pa.int64())])

    def resolve(rows):
        ids, at, weight = [], [], []
        for i, (gram, s0, s1, p, times, context, _) in enumerate(rows):
            _, h = _window_ids(context, s1 - s0, p - s0)
            ids.append(_mix(h ^ _U(gram & 0xFFFFFFFFFFFFFFFF)))
            at.append(s1 - s0)
            weight.append(times)
        flat = np.concatenate(ids)
        _, back = np.unique(flat, return_inverse=True)
        repeats = np.bincount(back, weights=np.repeat(weight, at))[back] > 1
        out = {"row": [], "first": [], "last": []}
        stops = np.cumsum(at)
        for (_, s0, _, _, times, _, row), stop, n in zip(rows, stops, at):
            if times == 1:  # witnesses are done already
                for a, b in zip(*_runs(repeats[stop - n : stop])):
                    out["row"].append(row), out["first"].append(s0 + int(a)), out["last"].append(s0 + int(b) - 1 + LENGTH)
        return _batch(out, schema)

    held, whole = [], 0  # rows; how many of them belong to finished buckets
    for b in batches:
        columns = [b.column(c).to_pylist() for c in ("gram", "s0", "s1", "p", "times")]
        for gram, s0, s1, p, times, context, row in zip(*columns, _raws(b.column("context")), b.column("row").to_pylist()):
            if held and held[-1][0] != gram:
                whole = len(held)
            held.append((gram, s0, s1, p, times, context, row))
            if whole >= 4096:
                yield resolve(held[:whole])
                held, whole = held[whole:], 0
    if held:
        yield resolve(held)


def repeats(docs: DataFrame, text: str = "text") -> DataFrame:
    """(row, runs): for each distinct (doc_id, text), named ``row``, its repeated byte runs, unmerged."""
    own = _named(docs, text).select("row", "whole")

    def first_pass(batches):
        schema = pa.schema([("row", pa.binary()), ("s0", pa.int64()), ("s1", pa.int64()), ("p", pa.int64()), ("gram", pa.int64()), ("wide", pa.int64())])
        for b in batches:
            found = [ranges(raw) for raw in _raws(b.column("whole"))]
            n = np.array([len(x[0]) for x in found], np.int64)
            columns = [np.concatenate(x) for x in zip(*found)] if found else [[]] * 5
            rows = b.column("row").take(pa.array(np.repeat(np.arange(len(found)), n)))
            yield pa.RecordBatch.from_arrays([rows.cast(pa.binary()), *[pa.array(c, pa.int64()) for c in columns]], schema=schema)

    all_ranges = written(own.mapInArrow(first_pass, "row binary, s0 bigint, s1 bigint, p bigint, gram bigint, wide bigint"), "repeat-ranges")
    grams = written(all_ranges.groupBy("gram").agg(F.count("*").alias("n")).where(F.col("n") > 1).select("gram"), "repeat-grams")
    bits, n_words = bloom(grams, "gram", "repeat-bits")
    # The few false positives go on as buckets of one range and drop out below.
    shared = written(probed(all_ranges, "gram", bits, n_words).where("maybe").drop("maybe"), "repeat-shared")
    for old in (all_ranges, grams, bits):
        forget(old)
    release(docs.sparkSession)
    # Equal ranges shrink to one row per bucket id and task before they move.
    wide = shared.groupBy("gram", "wide").agg(F.count("*").alias("times"), F.min(F.struct("row", "s0", "s1", "p")).alias("one"))
    wide = written(wide, "repeat-wide")
    again = wide.where(F.col("times") > 1).select("gram", "wide")
    done = shared.join(again, ["gram", "wide"], "left_semi").select("row", F.col("s0").alias("first"), (F.col("s1") - 1 + LENGTH).alias("last"))
    # Buckets with a range that is still open, one row per bucket id: open ones once, witnesses counted twice.
    open_grams = wide.groupBy("gram").agg(F.min("times").alias("fewest"), F.count("*").alias("n")).where((F.col("fewest") == 1) & (F.col("n") > 1))
    todo = wide.join(open_grams.select("gram", "n"), "gram").select("gram", F.least("times", F.lit(2)).alias("times"), "n", "one.*")
    todo = written(todo, "repeat-todo")

    by_row = todo.groupBy("row").agg(F.collect_list(F.struct("gram", "times", "n", "s0", "s1", "p")).alias("todo"))

    def contexts(batches):
        schema = pa.schema([("row", pa.binary()), ("gram", pa.int64()), ("times", pa.int64()), ("n", pa.int64()), ("s0", pa.int64()), ("s1", pa.int64()), ("p", pa.int64()), ("context", pa.binary())])
        for b in batches:
            out: dict = {f.name: [] for f in schema}
            for row, raw, items in zip(b.column("row").to_pylist(), b.column("whole").cast(pa.binary()), b.column("todo").to_pylist()):
                data = raw.as_py()
                for x in items:
                    out["row"].append(row)
                    for k in ("gram", "times", "n", "s0", "s1", "p"):
                        out[k].append(x[k])
                    out["context"].append(data[x["s0"] : x["s1"] - 1 + LENGTH])
            yield _batch(out, schema)

    kinds = "row binary, gram bigint, times bigint, n bigint, s0 bigint, s1 bigint, p bigint, context binary"
    # Only texts with something to do move.
    bits, n_words = bloom(todo.select("row").distinct(), "row", "repeat-bits")
    texts = probed(own, "row", bits, n_words).where("maybe").join(by_row, "row")
    detail = written(texts.select("row", "whole", "todo").mapInArrow(contexts, kinds), "repeat-contexts")
    forget(bits)
    release(docs.sparkSession)
    usual = detail.where(F.col("n") <= HOT).repartition("gram").sortWithinPartitions("gram").mapInArrow(_refined, "row binary, first bigint, last bigint")

    def windows(batches):
        schema = pa.schema([("row", pa.binary()), ("start", pa.int64()), ("times", pa.int64()), ("gram", pa.int64()), ("distance", pa.int64()), ("id", pa.int64())])
        for b in batches:
            rows = zip(b.column("row").to_pylist(), b.column("gram").to_pylist(), b.column("times").to_pylist(), b.column("s0").to_pylist(), b.column("s1").to_pylist(), b.column("p").to_pylist(), _raws(b.column("context")))
            for row, gram, times, s0, s1, p, context in rows:
                distance, h = _window_ids(context, s1 - s0, p - s0)
                k = len(h)
                yield _batch({"row": [row] * k, "start": np.arange(s0, s1), "times": np.full(k, times), "gram": np.full(k, gram), "distance": distance, "id": h.view(np.int64)}, schema)

    parts = [done, usual]
    hot = detail.where(F.col("n") > HOT)
    if hot.head(1):
        each = hot.mapInArrow(windows, "row binary, start bigint, times bigint, gram bigint, distance bigint, id bigint")
        key = ["gram", "distance", "id"]
        twice = each.groupBy(*key).agg(F.sum("times").alias("n")).where(F.col("n") > 1).select(*key)
        parts.append(each.where(F.col("times") == 1).join(twice, key, "left_semi").select("row", F.col("start").alias("first"), (F.col("start") + LENGTH).alias("last")))
    runs = parts[0]
    for more in parts[1:]:
        runs = runs.unionByName(more)
    found = written(runs.groupBy("row").agg(F.collect_set(F.struct("first", "last")).alias("runs")), "repeat-runs")
    for old in (wide, todo, detail, shared):
        forget(old)
    release(docs.sparkSession)
    return found


def _named(docs: DataFrame, text: str) -> DataFrame:
    """Rows packed, with their name and whole text."""
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    name = F.unhex(F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), whole).cast("binary")))
    return docs.select(F.struct("*").alias("packed"), name.alias("row"), whole.alias("whole"))


def _merged(runs: list[dict] | None) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for first, last in sorted((r["first"], r["last"]) for r in runs or []):
        if out and first <= out[-1][1]:
            out[-1][1] = max(out[-1][1], last)
        else:
            out.append([first, last])
    return [(a, b) for a, b in out]


def remove(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``kept_bytes`` (what is left of the text's UTF-8 bytes), ``removed`` (array of first, last) and ``n_bytes``."""
    found = repeats(docs, text)
    # Texts without repeats pass straight through, the others meet their runs.
    bits, n_words = bloom(found.select("row"), "row", "repeat-bits")
    named = probed(_named(docs, text), "row", bits, n_words)
    clean = named.where(~F.col("maybe")).withColumn("runs", F.lit(None).cast(found.schema["runs"].dataType))
    joined = clean.unionByName(named.where("maybe").join(found, "row", "left"))
    fields = list(docs.schema.fields)
    schema = T.StructType([*fields, T.StructField("kept_bytes", T.BinaryType()), T.StructField("removed", T.ArrayType(T.StructType([T.StructField("first", T.LongType()), T.StructField("last", T.LongType())]))), T.StructField("n_bytes", T.LongType())])
    flat = joined.select(*[F.col(f"packed.`{f.name}`").alias(f"c{i}") for i, f in enumerate(fields)], F.col("whole").alias("w"), F.col("runs").alias("r"))
    arrow_runs = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))
    names = [f.name for f in schema]

    def run(batches):
        for b in batches:
            kept, removed, size = [], [], []
            for raw, runs in zip(b.column("w").cast(pa.binary()), b.column("r")):
                data, spans, at, parts = raw.as_py(), _merged(runs.as_py()), 0, []
                for first, last in spans:
                    parts.append(data[at:first])
                    at = last
                parts.append(data[at:])
                kept.append(b"".join(parts)), removed.append([{"first": x, "last": y} for x, y in spans]), size.append(len(data))
            yield pa.RecordBatch.from_arrays([*b.columns[:-2], pa.array(kept, pa.binary()), pa.array(removed, arrow_runs), pa.array(size, pa.int64())], names)

    return flat.mapInArrow(run, schema)


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove(documents(spark, sf_dir).select("doc_id", "text"))
    return found.select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.octet_length("kept_bytes")).cast("bigint").alias("n_removed"),
        F.size("removed").cast("bigint").alias("n_spans"),
        F.sha2("kept_bytes", 256).alias("kept_sha256"),
    )

"""Helpers shared by the training-data operators: the shared folder, written tables, safe column access."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows a table may have to be broadcast; with the fixed row widths used here that is at most about 60 MB.
BROADCAST_ROWS = 1_000_000
#: Words of a Bloom filter that are broadcast, about 80 MB as a hash table.
FILTER_WORDS = 2_000_000


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``. Only in local mode, where one machine holds all, is a
    folder made if it is unset; a cluster without one is an error, as a local folder would lose rows there."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="graphloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder as Parquet and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._graphloom_path = path
    return out


def forget(df: DataFrame) -> None:
    """Delete a table made by ``written`` that no later plan reads."""
    path = getattr(df, "_graphloom_path", None)
    if path:
        jvm = df.sparkSession._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether a written table has at most ``rows`` rows (its Parquet footers answer this)."""
    return df.count() <= rows


def maybe_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast when the measured row count is within the bound; otherwise leave the join to shuffle."""
    return F.broadcast(df) if small(df, rows) else df


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def whole_text(column: str = "text"):
    """The text with null read as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def release(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of plans that nobody holds any more, once their results are written.

    It does so when the driver's garbage is collected, which on a large heap can be long after. The listeners' threads
    hold the event they got last, the end of the last query with its whole plan, so another small one is run first."""
    spark.range(0, 1, 1, 1).collect()
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def bloom(keys: DataFrame, column: str, name: str) -> tuple[DataFrame, int]:
    """A blocked Bloom filter of a key column, as a written table (word, bits), and its number of words."""
    words = max(1, keys.count() // 4)
    word, mask = bloom_address(F.col(column), words)
    return written(keys.select(word.alias("word"), mask.alias("mask")).groupBy("word").agg(F.bit_or("mask").alias("bits")), name), words


def bloom_address(key: Column, words: int) -> tuple[Column, Column]:
    """The filter word of a key and its mask of up to four bits, from two independent 64-bit hashes."""
    h = F.xxhash64(key)
    g = F.xxhash64(key, F.lit(1))
    bit = lambda k: F.call_function("shiftleft", F.lit(1).cast("bigint"), F.shiftrightunsigned(g, 6 * k).bitwiseAND(63).cast("int"))
    return F.pmod(h, F.lit(words).cast("bigint")), bit(0).bitwiseOR(bit(1)).bitwiseOR(bit(2)).bitwiseOR(bit(3))


def probed(df: DataFrame, column: str, bits: DataFrame, words: int) -> DataFrame:
    """``df`` with a boolean ``maybe``: false proves that the key isn't in the filter.

    The filter is broadcast while it has at most FILTER_WORDS words; above, narrow words join by shuffle."""
    word, mask = bloom_address(F.col(column), words)
    joined = df.withColumns({"word": word, "mask": mask}).join(maybe_broadcast(bits, FILTER_WORDS), "word", "left")
    hit = F.coalesce(F.col("bits").bitwiseAND(F.col("mask")) == F.col("mask"), F.lit(False))
    return joined.withColumn("maybe", hit).drop("word", "mask", "bits")


#: Elements of an array that a fold works on at once.
CHUNK = 64


def let(value: Column, f) -> Column:
    """``f`` of a value that is computed once, however often ``f`` names it, also in functions for an array's elements."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def chunks(array: Column) -> Column:
    """The array, a column or what ``let`` names, cut into arrays of ``CHUNK``."""
    count = F.floor((F.size(array) + CHUNK - 1) / CHUNK).cast("int")
    starts = F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda k: F.slice(array, k * CHUNK + 1, CHUNK))


def running(values: Column, op) -> Column:
    """For each of an array's whole numbers, ``op`` (sum or maximum) over those before it; 0 for the first.

    A fold that appends copies its array at each step, so it runs within chunks and then over the chunks."""
    start = F.struct(F.lit(0).alias("s"), F.array().cast("array<int>").alias("out"))
    step = lambda acc, x: F.struct(op(acc["s"], x).alias("s"), F.concat(acc["out"], F.array(acc["s"])).alias("out"))
    inner = let(values, lambda own: F.transform(chunks(own), lambda c: F.aggregate(c, start, step)))

    def joined(inner: Column) -> Column:
        before = F.aggregate(F.transform(inner, lambda x: x["s"]), start, step, lambda acc: acc["out"])
        return F.flatten(F.zip_with(inner, before, lambda x, b: F.transform(x["out"], lambda o: op(o, b))))

    return let(inner, joined)


def tidy(run):
    """A function for ``mapInArrow`` whose worker gives memory back to the machine when the task ends.

    Workers serve task after task, and what one has freed inside the process counts against its executor."""

    def to_the_end(batches):
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):
                ctypes.CDLL(None).malloc_trim(0)

    return to_the_end


class Memo(dict):
    """A dict that computes what is missing and starts anew at its bound."""

    def __init__(self, make, bound: int):
        self.make, self.bound = make, bound

    def __missing__(self, key):
        if len(self) >= self.bound:
            self.clear()
        value = self[key] = self.make(key)
        return value

"""Media columns: text bytes kept as lossless WebP images and read back as pixel arrays.

A text's UTF-8 bytes, padded with blanks to a positive multiple of 192, fill rows of 192 grey pixels, one byte
each. Up to 16 different bytes are stored by a palette with several pixels in one, more of them with green taken
from red and blue, which leaves one channel; both with prefix codes and copies. A colour cache could only repeat
what one code for a grey pixel says. A payload of more than ``ROWS`` rows becomes several images, one after the
other; each RIFF file states its own length. ``store`` writes them, ``read`` decodes any lossless WebP column into
width, height and raw pixels, and ``feature`` summarises pixels.

Defined results: null text = empty text = 192 blanks; equal texts give equal stored bytes; repeated rows are
stored each; bytes that are no lossless WebP file raise; extra columns stay. A text is held whole in one task,
with a few copies of itself; nothing else grows.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import webp
from .common import documents

UNIT = 192
ROWS = 256
BUNDLED = 16  # colours up to which the format's palette puts several pixels into one


def to_media(raw: bytes) -> tuple[bytes, int]:
    """(stored form, payload bytes)."""
    payload = raw + b" " * (UNIT - len(raw) if len(raw) < UNIT else -len(raw) % UNIT)
    rows = np.frombuffer(payload, np.uint8).reshape(-1, UNIT)
    files = []
    for at in range(0, len(rows), ROWS):
        own = rows[at : at + ROWS]
        few = np.count_nonzero(np.bincount(own.ravel())) <= BUNDLED
        grey = np.full((*own.shape, 4), 255, np.uint8)
        grey[..., :3] = own[..., None]
        files.append(webp.encode(grey, ((webp.PALETTE if few else webp.SUBTRACT_GREEN,),), copies=True))
    return b"".join(files), len(payload)


def images(media: bytes):
    """The pixel arrays of the files in a stored form."""
    at = 0
    while at < len(media):
        size = 8 + struct.unpack("<I", media[at + 4 : at + 8])[0]
        yield webp.decode(media[at : at + size])
        at += size + size % 2


def from_media(media: bytes) -> bytes:
    return b"".join(image[..., 1].tobytes() for image in images(media))


def feature(payload: bytes) -> str:
    """Rows and width, the rounded mean and the number of distinct values."""
    counts = np.bincount(np.frombuffer(payload, np.uint8), minlength=256)
    return f"{len(payload) // UNIT}x{UNIT};grey:{int(counts @ np.arange(256)) // len(payload)}:{int((counts > 0).sum())}"


def store(docs: DataFrame, text: str = "text", to: str = "media") -> DataFrame:
    """``docs`` with the binary column ``to``."""
    schema = T.StructType([*docs.schema.fields, T.StructField(to, T.BinaryType())])

    def run(batches):
        for b in batches:
            made = [to_media((x.as_py() or "").encode())[0] for x in b.column(text)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(made, pa.binary())], [*b.schema.names, to])

    return docs.mapInArrow(run, schema)


def read(stored: DataFrame, media: str = "media", to: str = "image") -> DataFrame:
    """``stored`` with ``to``: an array of (width, height, pixels as red, green, blue, alpha bytes)."""
    kind = T.ArrayType(T.StructType([T.StructField("width", T.IntegerType()), T.StructField("height", T.IntegerType()), T.StructField("pixels", T.BinaryType())]))
    schema = T.StructType([*stored.schema.fields, T.StructField(to, kind)])
    arrow = pa.list_(pa.struct([("width", pa.int32()), ("height", pa.int32()), ("pixels", pa.binary())]))

    def run(batches):
        for b in batches:
            made = [[{"width": i.shape[1], "height": i.shape[0], "pixels": i.tobytes()} for i in images(x.as_py() or b"")] for x in b.column(media)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(made, arrow)], [*b.schema.names, to])

    return stored.mapInArrow(run, schema)


def round_trip(docs: DataFrame) -> DataFrame:
    """(doc_id, text) -> digests of what was stored and of what was read back from the stored bytes."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

    def run(batches):
        for b in batches:
            out: list[list] = [[] for _ in names[1:]]
            for x in b.column("text"):
                raw = (x.as_py() or "").encode()
                media, _ = to_media(raw)
                back = from_media(media)
                for column, value in zip(out, (len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature(back))):
                    column.append(value)
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *map(pa.array, out, kinds)], names)

    schema = f"doc_id {kind}, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def op7_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(documents(spark, sf_dir))

"""Byte-level BPE encoding and decoding with a two-tier lookup.

A pre-token is first looked up whole in a minimal perfect hash over the vocabulary (hash and displace: one
displacement per bucket of keys, one slot per key, one comparison to confirm). A miss is merged bottom up: bytes
form a doubly linked list, neighbouring pairs wait in a heap by (rank, position), and stale entries are skipped,
so a piece of n bytes costs O(n log n).

Pre-tokens repeat, so each Python worker remembers ids in a table that is emptied at ``REMEMBER`` entries.
Texts are cut at single blanks between visible characters, where the pattern always breaks, and the pieces go
through the pattern only when they are new; texts with blanks next to other white space take the plain path.

Defined results: null text = empty text = no tokens (the hash of the empty string); special-token strings are
ordinary text; any text, however long, round-trips; repeated rows are encoded each; extra columns stay.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from array import array

import pyarrow as pa
import public_tokenizers
import regex
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import documents

REMEMBER = 400_000


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class PerfectHash:
    """Minimal perfect hash over byte strings: n keys, n slots."""

    def __init__(self, keys: dict[bytes, int]):
        n = self.n = len(keys)
        self.buckets = n // 4 + 1
        groups: dict[int, list[bytes]] = {}
        for key in keys:
            groups.setdefault(xxhash.xxh3_64_intdigest(key) % self.buckets, []).append(key)
        self.displace, taken = [0] * self.buckets, bytearray(n)
        self.keys: list[bytes] = [b""] * n
        self.values = array("i", bytes(4 * n))
        place = lambda slot, key: (taken.__setitem__(slot, 1), self.keys.__setitem__(slot, key), self.values.__setitem__(slot, keys[key]))
        free = 0
        for b, group in sorted(groups.items(), key=lambda x: -len(x[1])):
            if len(group) == 1:  # the next free slot, stored as such
                while taken[free]:
                    free += 1
                self.displace[b] = -free - 1
                place(free, group[0])
                continue
            seed = 1
            while True:
                slots = {xxhash.xxh3_64_intdigest(key, seed) % n for key in group}
                if len(slots) == len(group) and not any(taken[s] for s in slots):
                    break
                seed += 1
            self.displace[b] = seed
            for key in group:
                place(xxhash.xxh3_64_intdigest(key, seed) % n, key)

    def get(self, key: bytes) -> int:
        """The value of ``key``, or -1."""
        d = self.displace[xxhash.xxh3_64_intdigest(key) % self.buckets]
        slot = -d - 1 if d < 0 else xxhash.xxh3_64_intdigest(key, d) % self.n
        return self.values[slot] if self.keys[slot] == key else -1


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of ``piece`` by merging the lowest-ranked neighbouring pair, leftmost first, until none is left."""
    n = len(piece)
    ends = list(range(1, n + 1))  # ends[i]: where the part that starts at i ends; 0 once merged away
    before = list(range(-1, n - 1))
    rank = ranks.get
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := rank(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, end = heapq.heappop(heap)
        middle = ends[i]
        if not middle or middle >= end or ends[middle] != end:
            continue  # one of the two parts has changed since
        ends[i], ends[middle] = end, 0
        if end < n:
            before[end] = i
            if (r := rank(piece[i : ends[end]])) is not None:
                heapq.heappush(heap, (r, i, ends[end]))
        if (j := before[i]) >= 0 and (r := rank(piece[j:end])) is not None:
            heapq.heappush(heap, (r, j, end))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : ends[i]]])
        i = ends[i]
    return out


class _Memo(dict):
    """A dict that computes what is missing and is emptied at REMEMBER entries."""

    def __init__(self, make):
        self.make = make

    def __missing__(self, key):
        if len(self) >= REMEMBER:
            self.clear()
        value = self[key] = self.make(key)
        return value


class Codec:
    def __init__(self, path: str, pattern: str):
        self.ranks = read_ranks(path)
        self.whole = PerfectHash(self.ranks)
        self.find = regex.compile(pattern).findall
        self.awkward = regex.compile(r" \s|\s |^ ").search
        self.pieces = _Memo(self._piece)
        self.first = _Memo(lambda s: " ".join(map(self.pieces.__getitem__, self.find(s))))
        self.later = _Memo(lambda s: " ".join(map(self.pieces.__getitem__, self.find(" " + s))))
        self.bytes_of = {str(i): token for token, i in self.ranks.items()}

    def _piece(self, pre_token: str) -> str:
        raw = pre_token.encode()
        found = self.whole.get(raw)
        return str(found) if found >= 0 else " ".join(map(str, merge(raw, self.ranks)))

    def encode(self, text: str) -> str:
        """Decimal ids joined by one space."""
        if not text:
            return ""
        if self.awkward(text):
            return " ".join(map(self.pieces.__getitem__, self.find(text)))
        head, *tail = text.split(" ")
        return " ".join([self.first[head], *map(self.later.__getitem__, tail)])

    def decode(self, ids: str) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids.split(" "))) if ids else b""


_CODECS: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    """One codec per Python worker and vocabulary."""
    if (path, pattern) not in _CODECS:
        _CODECS[path, pattern] = Codec(path, pattern)
    return _CODECS[path, pattern]


def encode(docs: DataFrame, text: str = "text", to: str = "ids", vocabulary: str = "byte_bpe_50k.tiktoken") -> DataFrame:
    """``docs`` with the array column ``to`` of token ids."""
    schema = T.StructType([*docs.schema.fields, T.StructField(to, T.ArrayType(T.IntegerType()))])

    def run(batches):
        c = codec(public_tokenizers.path(vocabulary), public_tokenizers.PATTERN)
        for b in batches:
            ids = [list(map(int, s.split(" "))) if (s := c.encode(x or "")) else [] for x in b.column(text).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(ids, pa.list_(pa.int32()))], [*b.schema.names, to])

    return docs.mapInArrow(run, schema)


def decode(coded: DataFrame, ids: str = "ids", to: str = "text", vocabulary: str = "byte_bpe_50k.tiktoken") -> DataFrame:
    """``coded`` with the binary column ``to`` of decoded bytes."""
    schema = T.StructType([*coded.schema.fields, T.StructField(to, T.BinaryType())])

    def run(batches):
        c = codec(public_tokenizers.path(vocabulary), public_tokenizers.PATTERN)
        for b in batches:
            raw = [c.decode(" ".join(map(str, x or []))) for x in b.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(raw, pa.binary())], [*b.schema.names, to])

    return coded.mapInArrow(run, schema)


def digests(docs: DataFrame, vocabulary: str = "byte_bpe_50k.tiktoken") -> DataFrame:
    """(doc_id, text) -> doc_id, n_tokens, ids_sha256, decoded_sha256; ids go through encode and decode of the codec."""

    def run(batches):
        c = codec(public_tokenizers.path(vocabulary), public_tokenizers.PATTERN)
        for b in batches:
            n, coded, back = [], [], []
            for x in b.column("text"):
                ids = c.encode(x.as_py() or "")
                n.append(ids.count(" ") + 1 if ids else 0)
                coded.append(hashlib.sha256(ids.encode()).hexdigest())
                back.append(hashlib.sha256(c.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(coded, pa.string()), pa.array(back, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(documents(spark, sf_dir))

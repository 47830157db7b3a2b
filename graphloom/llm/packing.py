"""Best-fit packing of token sequences into fixed capacities.

Bulk-synchronous best fit: documents and gaps are kept sorted by size, each sweep gives every waiting document
its successor (the smallest gap that holds it), several documents that want the same gaps are served in rank
order, the gaps shrink, and the sweep repeats; what finds no gap opens new sequences.

Sizes are whole numbers up to the capacity, so documents of one length are interchangeable, and so are gaps of
one size. The sorted lists are therefore kept as runs (size, first rank, count): at most ``capacity`` runs of
documents, whatever the corpus. Building the runs and giving every document its rank and place is done by the
executors; the sweep itself works on the runs and holds no row of a document.

Lengths, ranks and places are exact: each document's rank among those of its length is its rank in its task
plus the count of earlier tasks, so no length, however frequent, meets in one task.

Defined results: null text = empty text = the closing id alone, one piece of length 1; only documents longer
than the capacity are cut, into full pieces and one last shorter piece; repeated rows are packed each; null
doc_id is carried along; an empty table packs into nothing; extra columns are not needed and not read.
"""

from __future__ import annotations

import json
import os
import unicodedata
import zlib
from array import array

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Memo, documents, forget, maybe_broadcast, tidy, written

CAPACITY = 2048
#: Words and pieces remembered; about 40 MB a Python worker, given back when the task ends.
WORDS, PIECES = 150_000, 150_000
#: Characters tokenised at once; longer texts are cut at white space, which the tokenizer drops anyway.
WINDOW = 1 << 20
#: Controls that str.split() takes for white space and the tokenizer doesn't.
_CONTROLS = "\x1c\x1d\x1e\x1f"


class WordIds:
    """Ids of a text as packed little-endian uint32.

    The tokenizer drops white space and never joins across it, so ids are found word by word, and the words and
    their pieces are remembered. A piece (lower-cased, as the vocabulary's pattern cuts it) goes through the
    tokenizer's own BPE model. Texts that name one of the vocabulary's added tokens go through the tokenizer whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content.lower() for t in self.tokenizer.get_added_tokens_decoder().values()]
        spec = json.loads(self.tokenizer.to_str())
        self.find = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]).findall
        self.model = self.tokenizer.model
        self.visible = {b: c for b, c in enumerate(_byte_characters())}
        self.known = Memo(self._word, WORDS)
        self.pieces = Memo(self._piece, PIECES)

    def _piece(self, piece: str) -> bytes:
        shown = piece if piece.isascii() and piece.isalnum() else piece.encode().decode("latin-1").translate(self.visible)
        return array("I", [t.id for t in self.model.tokenize(shown)]).tobytes()

    def _word(self, word: str) -> bytes:
        low = word.lower() if word.isascii() else self._lowered(word)
        if low.isalpha():  # one piece, as most words are
            return self.pieces[low]
        if low[-1] in ".," and low[:-1].isalpha():
            return self.pieces[low[:-1]] + self.pieces[low[-1]]
        return b"".join(map(self.pieces.__getitem__, self.find(low)))

    @staticmethod
    def _lowered(word: str) -> str:
        word = unicodedata.normalize("NFC", word)
        return "".join(map(str.lower, word)) if "\u03a3" in word else word.lower()

    def ids(self, text: str) -> bytes:
        if any(c in text for c in _CONTROLS) or any(t in text.lower() for t in self.added):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        if len(text) <= WINDOW:
            return b"".join(map(self.known.__getitem__, text.split()))
        return b"".join(b"".join(map(self.known.__getitem__, part.split())) for part in self._windows(text))

    def _windows(self, text: str):
        at = 0
        while len(text) - at > WINDOW:
            cut = text.find(" ", at + WINDOW)
            if cut < 0:
                break
            yield text[at:cut]
            at = cut
        yield text[at:]


def _byte_characters() -> list[str]:
    """The visible character that stands for each byte in a byte-level vocabulary: itself, or 256 onwards."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


_WORD_IDS: dict[str, WordIds] = {}


def pieces(docs: DataFrame, text: str = "text", capacity: int = CAPACITY, vocabulary: str = "word_bpe_49k.json", keep_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, task, rank[, ids]); rank counts equal lengths within the task."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, task int, rank bigint" + ", ids array<int>" * keep_ids

    def run(batches):
        path = public_tokenizers.path(vocabulary)
        coder = _WORD_IDS.get(path) or _WORD_IDS.setdefault(path, WordIds(path))
        task, seen = TaskContext.get().partitionId(), [0] * (capacity + 1)
        for b in batches:
            at, cut, starts, lengths, sums, ranks, ids = [], [], [], [], [], [], []
            for i, packed in enumerate(b.column(1)):
                packed = coder.ids(packed.as_py() or "") + b"\0\0\0\0"
                n = len(packed) // 4
                for k, start in enumerate(range(0, n, capacity)):
                    own = packed[4 * start : 4 * (start + capacity)]
                    length = len(own) // 4
                    at.append(i), cut.append(k), starts.append(start), lengths.append(length), sums.append(zlib.crc32(own)), ranks.append(seen[length])
                    seen[length] += 1
                    if keep_ids:
                        ids.append(np.frombuffer(own, "<i4"))
            columns = [b.column(0).take(pa.array(at, pa.int64())), pa.array(cut, pa.int32()), pa.array(starts, pa.int64()), pa.array(lengths, pa.int64()), pa.array(sums, pa.int64()), pa.array([task] * len(at), pa.int32()), pa.array(ranks, pa.int64())]
            yield pa.RecordBatch.from_arrays([*columns, *[pa.array(ids, pa.list_(pa.int32()))] * keep_ids], ["doc_id", "piece", "start", "length", "ids_crc32", "task", "rank", *["ids"] * keep_ids])

    def ended(batches):
        yield from run(batches)
        for coder in _WORD_IDS.values():
            coder.known.clear(), coder.pieces.clear()

    return docs.select("doc_id", F.col(text).cast("string")).mapInArrow(tidy(ended), schema)


def best_fit(counts: np.ndarray, capacity: int = CAPACITY) -> dict[str, np.ndarray]:
    """Sweeps over runs. counts[n]: documents of length n. Returns runs (length, rank, n, sequence, offset):
    documents of that length and ranks rank..rank+n-1 go to sequences sequence.. at that offset."""
    out: dict[str, list[int]] = {k: [] for k in ("length", "rank", "n", "sequence", "offset")}
    gaps: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]  # by size: runs (first sequence, count)
    opened = 0
    left = counts.astype(np.int64).copy()
    for length in range(capacity, 0, -1):  # the largest documents have the first rank
        rank = 0
        while left[length]:
            size = next((g for g in range(length, capacity + 1) if gaps[g]), 0)  # the successor
            if size:
                first, n = gaps[size].pop()
            else:  # nothing holds it: open as many as these documents fill
                each = capacity // length
                size, first, n = capacity, opened, -(-int(left[length]) // each)
                opened += n
            taken = min(n, int(left[length]))
            if taken < n:
                gaps[size].append((first + taken, n - taken))
            gaps[size - length].append((first, taken))
            for k, v in zip(out, (length, rank, taken, first, capacity - size)):
                out[k].append(v)
            rank += taken
            left[length] -= taken
    return {k: np.array(v, np.int64) for k, v in out.items()}


def place(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to rows with length, task and rank (a written table)."""
    spark = cut.sparkSession
    counts = written(cut.groupBy("length", "task").agg(F.count("*").alias("n")), "pack-counts")
    runs = np.zeros(capacity + 1, np.int64)
    for row in counts.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most ``capacity`` rows
        runs[row["length"]] = row["n"]
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("length", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = cut.join(maybe_broadcast(bases, 500_000), ["length", "task"])
    plan = spark.sparkContext.broadcast(best_fit(runs, capacity))
    names = [c for c in cut.columns if c not in ("task", "rank")]
    schema = ", ".join(f"`{c}` {cut.schema[c].dataType.simpleString()}" for c in names) + ", sequence_id bigint, offset bigint"

    def run(batches):
        p = plan.value
        key = p["length"] << 44 | p["rank"]  # rises: lengths were swept one by one, ranks in order
        order = np.argsort(key)
        key = key[order]
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("rank").to_numpy() + b.column("base").to_numpy()
            at = order[np.searchsorted(key, length << 44 | rank, "right") - 1]
            sequence = p["sequence"][at] + rank - p["rank"][at]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(sequence), pa.array(p["offset"][at])], [*names, "sequence_id", "offset"])

    return ranked.mapInArrow(tidy(run), schema)


def pack(docs: DataFrame, text: str = "text", capacity: int = CAPACITY, vocabulary: str = "word_bpe_49k.json", keep_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32[, ids], sequence_id, offset."""
    return place(written(pieces(docs, text, capacity, vocabulary, keep_ids), "pack-pieces"), capacity)


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage, the last: pieces and their places."""
    return pack(docs)

"""Near-duplicate detection: improved consistent weighted sampling over TF-IDF weighted word shingles.

1. A text is normalised to lower-cased runs of letters, digits and non-ASCII characters. Texts equal in that form
   are one vertex; they are found by the two-pass Bloom filter of ``exact_dedup``, so only possible copies move.
2. Shingles are five words (a shorter text is one shingle), weight = tf * (1 + ln(N / df) / ln(N)) with the shingle's
   true document frequency over the N distinct texts; the inverse frequency is taken relative to its largest value, so
   that what a large family of near copies shares doesn't fade against each member's own edits. Texts are cut into parts of about ``PART`` bytes. A part sends
   each of its distinct shingles once, packed by bucket of shingle hashes, so that a shingle of a third of all texts
   is a few rows; a bucket answers with the frequencies above one, and each part meets its answers and texts again.
3. Improved consistent weighted sampling (Ioffe) draws ``BANDS * ROWS`` samples (shingle, level) a text; two texts
   agree on a sample with the probability of their weighted Jaccard similarity. Bands of ``ROWS`` samples are the
   blocking keys: at similarity 0.8 a pair shares one of the bands with probability 0.9992.
4. Members of a band bucket are first compared with one centre, so that a bucket of n gives n - 1 pairs. The centre is
   the member that meets most others over all its bands, which in a family of copies is what they descend from.
   Buckets of up to ``PAIRED`` members then compare all members that are still in different classes. The texts of
   larger buckets that are still in several classes meet by shared shingles under an exact prefix filter instead:
   ``TURNS`` rounds within random groups of about ``GROUP`` members of a shingle, which join most of a family, and then
   all pairs of different classes that are left, so that every link among them is found.
5. Every candidate pair is verified by exact weighted Jaccard similarity of the whole texts, and verified links
   are joined into classes by minimum-label propagation over the graph of the classes so far.

Defined results: null text = empty text; texts without words are copies of one another; null doc_id sorts before
all others; repeated rows share a class; rows with one doc_id and equal words count as one document in the
pipeline stage; an empty table gives an empty table; extra columns stay (stage) or are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bloom, documents, forget, maybe_broadcast, probed, release, small, tidy, written
from .exact_dedup import TEXTS_PER_WORD, repeated_bits

WORDS = 5
SIMILAR = 0.8
BANDS, ROWS = 10, 3
PAIRED = 64
#: Rounds within random groups of so many members of a shingle, before all pairs that are left.
TURNS, GROUP = 3, 128
#: Bytes of a part's texts, at least, and distinct texts for each bucket of shingle hashes.
PART, TEXTS_A_BUCKET = 1 << 18, 4096
#: Bits of a shingle hash that travel beside its bucket. A bucket has a fixed number of texts, and so about one chance
#: in 10 ** 8 that two of its shingles are taken for one, whatever the corpus.
TRAVELLING = 48
#: Bytes of a text hashed at once.
WINDOW = 1 << 21

_RNG = np.random.default_rng(20240607)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_BYTE[32] = 0
_POWER = _RNG.integers(1, 2**63, 1024, dtype=np.uint64) | np.uint64(1)
_PLACE = _RNG.integers(1, 2**63, WORDS, dtype=np.uint64) | np.uint64(1)
_SEED = _RNG.integers(1, 2**63, BANDS * ROWS, dtype=np.uint64)
_FOLD = _RNG.integers(1, 2**63, (BANDS, ROWS), dtype=np.uint64) | np.uint64(1)


def _gamma_quantiles(n: int = 1 << 16) -> np.ndarray:
    """Quantiles of the Gamma(2, 1) distribution at the middle of n equal steps, by bisection."""
    u = (np.arange(n) + 0.5) / n
    low, high = np.zeros(n), np.full(n, 60.0)
    for _ in range(60):
        mid = (low + high) / 2
        under = 1 - np.exp(-mid) * (1 + mid) < u
        low, high = np.where(under, mid, low), np.where(under, high, mid)
    return (low + high) / 2


_GAMMA = _gamma_quantiles()
_R, _INVERSE_R, _LOG_C = _GAMMA.astype(np.float32), (1 / _GAMMA).astype(np.float32), np.log(_GAMMA).astype(np.float32)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _word_hashes(raw: np.ndarray) -> np.ndarray:
    if len(raw) > WINDOW:  # cut at a blank
        blanks = np.flatnonzero(raw[WINDOW // 2 :][: WINDOW // 2] == 32)
        cut = int(blanks[-1]) + WINDOW // 2 if len(blanks) else next(iter(np.flatnonzero(raw[WINDOW:] == 32)), -1) + (WINDOW if (raw[WINDOW:] == 32).any() else 0)
        if cut > 0:
            parts, at = [], 0
            while cut > at:
                parts.append(_word_hashes_of(raw[at:cut]))
                at = cut + 1
                rest = raw[at : at + WINDOW]
                blanks = np.flatnonzero(rest == 32)
                cut = at + int(blanks[-1]) if len(rest) == WINDOW and len(blanks) else len(raw)
            return np.concatenate(parts)
    return _word_hashes_of(raw)


def _word_hashes_of(raw: np.ndarray) -> np.ndarray:
    if not len(raw):
        return np.empty(0, np.uint64)
    starts = np.concatenate([[0], np.flatnonzero(raw == 32) + 1])
    starts = starts[starts < len(raw)]
    place = np.arange(len(raw)) - np.repeat(starts, np.diff(np.append(starts, len(raw))))
    return _mix(np.add.reduceat(_BYTE[raw] * _POWER[place & 1023], starts))


def shingles(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of a normalised text and how often each occurs."""
    w = _word_hashes(raw)
    n = len(w)
    if n == 0:
        return w, np.empty(0, np.int64)
    if n < WORDS:
        return _mix(np.array([(w * _PLACE[:n]).sum() + np.uint64(n)], np.uint64)), np.ones(1, np.int64)
    h = w[: n - WORDS + 1] * _PLACE[0]
    for k in range(1, WORDS):
        h += w[k : n - WORDS + 1 + k] * _PLACE[k]
    return np.unique(_mix(h), return_counts=True)


def weights(tf: np.ndarray, df: np.ndarray, n: int) -> np.ndarray:
    return tf * (1 + np.log(n / df) / np.log(max(n, 2)))


def _pack(h: np.ndarray) -> bytes:
    """The lower ``TRAVELLING`` bits of each number."""
    return h.astype(np.uint32).tobytes() + (h >> np.uint64(32)).astype(np.uint16).tobytes()


def _unpack(raw: bytes) -> np.ndarray:
    n = len(raw) // 6
    return np.frombuffer(raw, np.uint32, n).astype(np.uint64) | np.frombuffer(raw, np.uint16, n, 4 * n).astype(np.uint64) << np.uint64(32)


def weighted_jaccard(a: tuple, b: tuple) -> float:
    """Sum of minima over sum of maxima of weights; a and b are (sorted shingles, weights). Two empty texts are equal."""
    (ha, wa), (hb, wb) = a, b
    if not len(ha) or not len(hb):
        return float(len(ha) == len(hb))
    at = np.searchsorted(ha, hb)
    at[at == len(ha)] = 0
    same = ha[at] == hb
    shared = np.minimum(wa[at[same]], wb[same]).sum()
    return float(shared / (wa.sum() + wb.sum() - shared))


def signature(h: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """One 64-bit hash of (shingle, level) per sample."""
    k = len(_SEED)
    best, out = np.full(k, np.inf, np.float32), np.zeros(k, np.uint64)
    for at in range(0, len(h), 2048):
        own, log_w = h[at : at + 2048, None], np.log(weight[at : at + 2048]).astype(np.float32)[:, None]
        x = (own ^ _SEED) * np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(29)
        x *= np.uint64(0x94D049BB133111EB)
        first = (x >> np.uint64(48)).astype(np.int64)
        beta = (x >> np.uint64(8) & np.uint64(0xFFFFFF)).astype(np.float32) * np.float32(2**-24)
        r = _R[first]
        level = np.floor(log_w * _INVERSE_R[first] + beta)
        log_a = _LOG_C[(x >> np.uint64(32) & np.uint64(0xFFFF)).astype(np.int64)] - r * (level - beta + 1)
        row = log_a.argmin(0)
        value = log_a[row, np.arange(k)]
        better = value < best
        best = np.where(better, value, best)
        chosen = _mix(own[row, 0] + level[row, np.arange(k)].astype(np.int64).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        out = np.where(better, chosen, out)
    return out


def band_keys(sig: np.ndarray) -> np.ndarray:
    return _mix((sig.reshape(BANDS, ROWS) * _FOLD).sum(1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64)).view(np.int64)


def _raws(column):
    for x in column:
        yield np.frombuffer(x.as_buffer(), np.uint8) if x.is_valid else np.empty(0, np.uint8)


def normalised(text):
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[\x00-\x2f\x3a-\x60\x7b-\x7f]+", " "))


def _vertex(norm):
    return F.substring(F.unhex(F.sha2(norm.cast("binary"), 256)), 1, 16)


def distinct_texts(docs: DataFrame, text: str = "text") -> tuple[DataFrame, DataFrame, int]:
    """(doc_id, v) of every row, written; (v, norm) of every distinct normalised text; the number of rows."""
    own = docs.select("doc_id", normalised(F.col(text)).alias("norm"))
    keyed = own.select("doc_id", _vertex(F.col("norm")).alias("sha"), "norm")
    keys = written(keyed.select("doc_id", "sha"), "near-keys")
    rows = keys.count()
    words = max(1, rows // TEXTS_PER_WORD)
    bits = written(repeated_bits(keys.select("sha"), words), "near-bits")
    split = probed(keyed.select("sha", "norm"), "sha", bits, words)
    copies = split.where("maybe").groupBy("sha").agg(F.min("norm").alias("norm"))
    texts = split.where(~F.col("maybe")).select("sha", "norm").unionByName(copies)
    return keys.withColumnRenamed("sha", "v"), texts.withColumnRenamed("sha", "v"), rows


def _parted(texts: DataFrame, size_of_part: int) -> DataFrame:
    """Written (part, v, norm): neighbouring texts, about that many bytes of them, have one part."""

    def run(batches):
        base, size = TaskContext.get().partitionId() << 32, 0
        for b in batches:
            ends = size + np.cumsum(pc.binary_length(b.column("norm")).to_numpy(zero_copy_only=False).astype(np.int64))
            size = int(ends[-1]) if len(ends) else size
            yield pa.RecordBatch.from_arrays([pa.array(base + ends // size_of_part), b.column("v"), b.column("norm")], ["part", "v", "norm"])

    own = texts.where(F.col("norm").rlike("[^ ]"))
    return written(own.select("v", "norm").mapInArrow(tidy(run), "part bigint, v binary, norm string"), "near-parts")


def _travelling(h: np.ndarray, bits: int) -> np.ndarray:
    """Bucket and travelling bits of shingle hashes."""
    return h >> np.uint64(64 - bits - TRAVELLING)


def _shared_out(parts: DataFrame, bits: int) -> DataFrame:
    """(bucket, part, hashes, counts): for each part and bucket of 2 ** bits, the part's distinct shingles and in how
    many of its texts each occurs (null: in one each)."""

    def packed(part, held):
        h, counts = np.unique(_travelling(np.concatenate(held), bits), return_counts=True)
        cuts = np.searchsorted(h >> np.uint64(TRAVELLING), np.arange((1 << bits) + 1, dtype=np.uint64))
        rows = [(k, a, b) for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])) if b > a]
        blobs = [_pack(h[a:b]) for _, a, b in rows]
        numbers = [counts[a:b].astype(np.uint32).tobytes() if counts[a:b].max() > 1 else None for _, a, b in rows]
        columns = [pa.array([k for k, _, _ in rows], pa.int32()), pa.array([part] * len(rows), pa.int64()), pa.array(blobs, pa.binary()), pa.array(numbers, pa.binary())]
        return pa.RecordBatch.from_arrays(columns, ["bucket", "part", "hashes", "counts"])

    def run(batches):
        last, held = None, []
        for b in batches:
            for part, raw in zip(b.column("part").to_pylist(), _raws(b.column("norm").cast(pa.binary()))):
                if part != last and held:
                    yield packed(last, held)
                    held = []
                last = part
                held.append(shingles(raw)[0])
        if held:
            yield packed(last, held)

    return parts.select("part", "norm").mapInArrow(tidy(run), "bucket int, part bigint, hashes binary, counts binary")


def _frequencies(parts: DataFrame, bits: int) -> DataFrame:
    """Written (part, bucket, hashes, counts): the shingles of each part that occur in two texts or more, and in how many."""

    def add(bucket, blobs):
        h = np.concatenate([x for _, x, _ in blobs])
        order = np.argsort(h, kind="stable")
        h = h[order]
        n = np.concatenate([c for _, _, c in blobs])[order]
        first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        total = np.empty(len(h), np.uint32)
        total[order] = np.repeat(np.add.reduceat(n, first), np.diff(np.append(first, len(h)))).astype(np.uint32)
        out, at = [], 0
        for part, x, _ in blobs:
            own = total[at : at + len(x)]
            at += len(x)
            if (own > 1).any():
                out.append((part, bucket, _pack(x[own > 1]), own[own > 1].tobytes()))
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate((pa.int64(), pa.int32(), pa.binary(), pa.binary()))], ["part", "bucket", "hashes", "counts"])

    def run(batches):
        last, held = None, []
        for b in batches:
            for bucket, part, h, c in zip(b.column("bucket").to_pylist(), b.column("part").to_pylist(), b.column("hashes"), b.column("counts")):
                if bucket != last and held:
                    yield add(last, held)
                    held = []
                last = bucket
                own = _unpack(h.as_py())
                held.append((part, own, np.frombuffer(c.as_py(), np.uint32) if c.is_valid else np.ones(len(own), np.uint32)))
        if held:
            yield add(last, held)

    own = _shared_out(parts, bits).repartition("bucket").sortWithinPartitions("bucket")
    return written(own.mapInArrow(tidy(run), "part bigint, bucket int, hashes binary, counts binary"), "near-answers")


def weighed(texts: DataFrame, rows: int) -> tuple[DataFrame, DataFrame, int]:
    """Of the texts that have words, both written: (part, v, norm); (v, counts, bands), where counts are the document
    frequencies of the text's sorted distinct shingles as uint32; and the number of these texts."""
    bits = max(4, min(16, (rows // TEXTS_A_BUCKET).bit_length()))
    parts = _parted(texts, max(PART, 512 << bits))
    n = max(1, parts.count())
    answers = _frequencies(parts, bits)
    release(texts.sparkSession)
    # The answers of a part come before its texts.
    first = answers.select("part", F.lit(0).alias("kind"), F.lit(None).cast("binary").alias("v"), F.lit(None).cast("string").alias("norm"), "bucket", "hashes", "counts")
    own = parts.select("part", F.lit(1).alias("kind"), "v", "norm", F.lit(None).cast("int").alias("bucket"), F.lit(None).cast("binary").alias("hashes"), F.lit(None).cast("binary").alias("counts"))
    both = first.unionByName(own).repartition("part").sortWithinPartitions("part", "kind")

    def run(batches):
        last, blobs, known, df = None, [], np.empty(0, np.uint64), np.empty(0, np.uint32)
        for b in batches:
            keys, counts, of = [], [], []
            norms, buckets, hashes, frequencies = b.column("norm").cast(pa.binary()), b.column("bucket"), b.column("hashes"), b.column("counts")
            for i, (part, kind) in enumerate(zip(b.column("part").to_pylist(), b.column("kind").to_pylist())):
                if part != last:
                    last, blobs, known, df = part, [], np.empty(0, np.uint64), np.empty(0, np.uint32)
                if kind == 0:
                    blobs.append((_unpack(hashes[i].as_py()) | np.uint64(buckets[i].as_py() << TRAVELLING), np.frombuffer(frequencies[i].as_py(), np.uint32)))
                    continue
                if blobs:
                    known, df = np.concatenate([x for x, _ in blobs]), np.concatenate([x for _, x in blobs])
                    order = np.argsort(known)
                    known, df, blobs = known[order], df[order], []
                h, tf = shingles(np.frombuffer(norms[i].as_buffer(), np.uint8))
                own = np.ones(len(h), np.uint32)
                if len(known):
                    short = _travelling(h, bits)
                    at = np.searchsorted(known, short)
                    at[at == len(known)] = 0
                    hit = known[at] == short
                    own[hit] = df[at[hit]]
                keys.append(band_keys(signature(h, weights(tf, own, n))))
                counts.append(own.tobytes())
                of.append(i)
            rows = pa.array(of, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("v").take(rows), pa.array(counts, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], ["v", "counts", "bands"])

    out = written(both.mapInArrow(tidy(run), "v binary, counts binary, bands array<bigint>"), "near-bands")
    forget(answers)
    release(texts.sparkSession)
    return parts, out, n


def _vectors(texts: DataFrame, n: int) -> DataFrame:
    """(v, h, w): sorted shingles and their weights as float64, from (v, norm, counts)."""

    def run(batches):
        for b in batches:
            hs, ws = [], []
            for raw, counts in zip(_raws(b.column("norm").cast(pa.binary())), b.column("counts")):
                h, tf = shingles(raw)
                hs.append(h.tobytes()), ws.append(weights(tf, np.frombuffer(counts.as_py(), np.uint32), n).tobytes())
            yield pa.RecordBatch.from_arrays([b.column("v"), pa.array(hs, pa.binary()), pa.array(ws, pa.binary())], ["v", "h", "w"])

    return texts.select("v", "norm", "counts").mapInArrow(tidy(run), "v binary, h binary, w binary")


def prefixes(texts: DataFrame, n: int, similar: float) -> DataFrame:
    """Written (shingle, left, whole, v): the shingles of each text, rarest first, from which at least ``similar`` of its
    weight is ``left``. Two texts of that similarity have the first shingle they share among these."""

    def run(batches):
        for b in batches:
            keys, lefts, wholes, of = [], [], [], []
            for i, (raw, counts) in enumerate(zip(_raws(b.column("norm").cast(pa.binary())), b.column("counts"))):
                h, tf = shingles(raw)
                df = np.frombuffer(counts.as_py(), np.uint32)
                by = np.lexsort((h, df))
                weight = weights(tf, df, n)[by]
                left = np.cumsum(weight[::-1])[::-1]
                few = int((left >= similar * weight.sum() * (1 - 1e-9)).sum())
                # A shingle that no other text has joins nothing.
                few = np.flatnonzero((df[by] > 1)[:few])
                keys.append(h[by[few]].view(np.int64))
                lefts.append(left[few])
                wholes.append(np.full(len(few), weight.sum()))
                of.append(np.full(len(few), i))
            flat = lambda parts, kind: np.concatenate(parts) if parts else np.empty(0, kind)
            rows = pa.array(flat(of, np.int64))
            columns = [pa.array(flat(keys, np.int64)), pa.array(flat(lefts, np.float64)), pa.array(flat(wholes, np.float64)), b.column("v").take(rows)]
            yield pa.RecordBatch.from_arrays(columns, ["shingle", "left", "whole", "v"])

    return written(texts.select("v", "norm", "counts").mapInArrow(tidy(run), "shingle bigint, left double, whole double, v binary"), "near-prefixes")


def close_pairs(keyed: DataFrame, labels: DataFrame, similar: float, turn: int | None) -> DataFrame:
    """(a, b): pairs of texts of different classes that may have that similarity and meet at one of their ``prefixes``:
    all of them, or those within random groups, other ones each turn.

    Two texts share at most what is left from their first common shingle on, and at similarity s they share
    s / (1 + s) of the sum of their weights; the lighter one has at least s of the heavier one's weight. Shingles
    that only one class has, such as those of a large group of copies, meet nothing."""
    now = keyed.join(labels, "v")
    mixed = now.groupBy("shingle").agg(F.min("c").alias("low"), F.max("c").alias("high"), F.count("*").alias("size")).where(F.col("low") != F.col("high"))
    group = F.lit(0) if turn is None else F.pmod(F.xxhash64("v", F.lit(turn)), F.ceil(F.col("size") / GROUP)).cast("int")
    now = written(now.join(mixed.select("shingle", "size"), "shingle").withColumn("part", group), "near-mixed")
    names = ("left", "whole", "v", "c")
    side = lambda k: now.select("shingle", "part", *[F.col(x).alias(f"{x}_{k}") for x in names])
    near = F.least("whole_a", "whole_b") >= F.greatest("whole_a", "whole_b") * (similar * (1 - 1e-9))
    enough = F.least("left_a", "left_b") >= (F.col("whole_a") + F.col("whole_b")) * (similar / (1 + similar) * (1 - 1e-9))
    met = side("a").join(side("b"), ["shingle", "part"]).where((F.col("v_a") > F.col("v_b")) & (F.col("c_a") != F.col("c_b")) & near & enough)
    return met.select(F.col("v_a").alias("a"), F.col("v_b").alias("b")).distinct()


def verified(pairs: DataFrame, vectors: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """The (a, b) pairs whose whole texts have at least that weighted Jaccard similarity."""
    side = lambda k: vectors.select(F.col("v").alias(k), F.col("h").alias(f"h{k}"), F.col("w").alias(f"w{k}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")

    def run(batches):
        for b in batches:
            of = lambda name, kind: (np.frombuffer(x.as_buffer(), kind) for x in b.column(name))
            keep = [weighted_jaccard((ha, wa), (hb, wb)) >= similar for ha, wa, hb, wb in zip(of("ha", np.uint64), of("wa", np.float64), of("hb", np.uint64), of("wb", np.float64))]
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.select("a", "b", "ha", "wa", "hb", "wb").mapInArrow(tidy(run), "a binary, b binary")


def components(edges: DataFrame) -> DataFrame:
    """(v, c): the smallest vertex of each vertex's component, for all vertices with edges. Written."""
    both = written(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "near-edges")
    labels = written(both.groupBy(F.col("a").alias("v")).agg(F.least(F.col("v"), F.min("b")).alias("c")), "near-labels")
    while True:
        near = both.join(labels.select(F.col("v").alias("b"), "c"), "b").groupBy(F.col("a").alias("v")).agg(F.min("c").alias("m"))
        stepped = labels.join(near, "v").select("v", F.least("c", "m").alias("d"), F.col("c").alias("old"))
        jump = labels.select(F.col("v").alias("d"), F.col("c").alias("e"))
        new = written(stepped.join(jump, "d", "left").select("v", F.least("d", F.coalesce("e", "d")).alias("c"), "old"), "near-labels")
        moved = new.where(F.col("c") != F.col("old")).limit(1).count()
        forget(labels)
        labels = new.select("v", "c")
        labels._graphloom_path = new._graphloom_path
        if not moved:
            forget(both)
            return labels


def joined(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels`` (v, c), written, after ``links`` (a, b): only classes and the links between them take part."""
    of = lambda k: labels.select(F.col("v").alias(k), F.col("c").alias(f"c{k}"))
    between = links.join(of("a"), "a").join(of("b"), "b").where("ca != cb").select(F.col("ca").alias("a"), F.col("cb").alias("b")).distinct()
    roots = components(between)
    new = labels.join(roots.select(F.col("v").alias("c"), F.col("c").alias("root")), "c", "left")
    new = written(new.select("v", F.coalesce("root", "c").alias("c")), "near-classes")
    forget(labels), forget(roots)
    return new


def classes(texts: DataFrame, banded: DataFrame, n: int, similar: float = SIMILAR) -> DataFrame:
    """(v, c), written, for the texts that share a band with another; the arguments are the results of ``weighed``, whose
    tables are deleted as soon as they aren't needed."""
    spark = texts.sparkSession
    bands = banded.select("v", F.explode("bands").alias("band"))
    shared = bands.groupBy("band").agg(F.count("*").alias("size")).where(F.col("size") > 1)
    members = written(bands.join(shared, "band"), "near-shared")
    # How many others a text meets over its bands: what a family of copies descends from meets the most.
    met = written(members.groupBy("v").agg(F.sum("size").alias("met")), "near-met")
    # Texts that meet no other stay where they are: a Bloom filter of those that do lets few others move.
    bits, words = bloom(met, "v", "near-bits")
    few = lambda df: probed(df, "v", bits, words).where("maybe").drop("maybe")
    meeting = few(texts.select("v", "norm")).join(met.select("v"), "v", "left_semi").join(few(banded.select("v", "counts")), "v")
    meeting = written(meeting, "near-meeting")
    forget(texts), forget(banded), forget(bits)
    release(spark)
    vectors = written(_vectors(meeting, n), "near-vectors")
    labels = written(met.select("v", F.col("v").alias("c")), "near-classes")
    done = None

    def linked(pairs: DataFrame) -> bool:
        """Verify the pairs that weren't yet, and join classes."""
        nonlocal labels, done
        pairs = written(pairs.join(done, ["a", "b"], "left_anti") if done is not None else pairs, "near-pairs")
        done = done.union(pairs) if done is not None else pairs
        # While the texts of the pairs are few enough to be broadcast, only their vectors move.
        ends = written(pairs.select(F.explode(F.array("a", "b")).alias("v")).distinct(), "near-ends")
        own = vectors.join(F.broadcast(ends), "v", "left_semi") if small(ends) else vectors
        links = written(verified(pairs, own, similar), "near-links")
        forget(ends)
        found = bool(links.head(1))
        if found:
            labels = joined(labels, links)
        forget(links)
        release(spark)
        return found

    def open_members() -> DataFrame:
        now = members.join(labels, "v")
        state = now.groupBy("band").agg(F.min("c").alias("low"), F.max("c").alias("high")).where(F.col("low") != F.col("high"))
        return written(now.join(state.select("band"), "band"), "near-open")

    centres = members.join(met, "v").groupBy("band").agg(F.max_by("v", F.struct("met", "v")).alias("centre"))
    stars = members.join(centres, "band").where(F.col("v") != F.col("centre"))
    linked(stars.select(F.greatest("v", "centre").alias("a"), F.least("v", "centre").alias("b")).distinct())
    now = open_members()
    left = now.where(F.col("size") <= PAIRED).select("band", "v", "c")
    right = left.select("band", F.col("v").alias("v2"), F.col("c").alias("c2"))
    linked(left.join(right, "band").where((F.col("c") != F.col("c2")) & (F.col("v") > F.col("v2"))).select(F.col("v").alias("a"), F.col("v2").alias("b")).distinct())
    forget(now)
    # Large buckets that are still in several classes: all their texts meet by shingles, whatever the bucket.
    now = open_members()
    still = written(now.where(F.col("size") > PAIRED).select("v").distinct(), "near-still")
    forget(now)
    if still.head(1):
        keyed = prefixes(meeting.join(still, "v"), n, similar)
        for turn in range(TURNS):
            if not linked(close_pairs(keyed, labels, similar, turn)):
                break
        linked(close_pairs(keyed, labels, similar, None))
        forget(keyed)
    for old in (members, met, meeting, vectors, still):
        forget(old)
    return labels


def near_duplicates(docs: DataFrame, text: str = "text", similar: float = SIMILAR) -> DataFrame:
    """One row per document: doc_id, v (its normalised text's key), class_id (smallest doc_id), class_size."""
    keys, texts, rows = distinct_texts(docs, text)
    texts, banded, n = weighed(texts, rows)
    labels = classes(texts, banded, n, similar)
    # Rows shrink to one per text and then to one per class by partial aggregation before they meet.
    per_text = written(keys.groupBy("v").agg(F.min(F.struct(F.col("doc_id").isNotNull().alias("n"), "doc_id")).alias("first"), F.count("*").alias("n")), "near-per-text")
    in_class = per_text.join(labels, "v", "left").withColumn("c", F.coalesce("c", "v"))
    sums = in_class.groupBy("c").agg(F.min("first").alias("first"), F.sum("n").alias("class_size"))
    by_text = written(in_class.select("v", "c").join(sums, "c").select("v", F.col("first.doc_id").alias("class_id"), "class_size").where("class_size > 1"), "near-classes")
    found = keys.join(maybe_broadcast(by_text, 300_000), "v", "left")
    return found.select("doc_id", "v", F.when(F.col("class_size").isNotNull(), F.col("class_id")).otherwise(F.col("doc_id")).alias("class_id"), F.coalesce("class_size", F.lit(1)).cast("bigint").alias("class_size"))


def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir)).select("doc_id", "class_id", "class_size")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the document with the smallest id of each class stays."""
    found = near_duplicates(docs)
    gone = written(found.where(~F.col("doc_id").eqNullSafe(F.col("class_id"))).select(F.col("doc_id").alias("gone_id"), "v").distinct(), "near-gone")
    packed = docs.select(F.struct("*").alias("row"), _vertex(normalised(F.col("text"))).alias("own"))
    here = F.col("row.doc_id").eqNullSafe(F.col("gone_id")) & (F.col("own") == F.col("v"))
    return packed.join(maybe_broadcast(gone), here, "left_anti").select("row.*")

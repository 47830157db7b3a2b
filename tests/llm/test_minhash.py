import re
import time
from collections import Counter

import numpy as np
from graphloom.llm import minhash
from graphloom.llm.common import forget, release, written


def norm(t):
    return re.sub(r"[\x00-\x2f\x3a-\x60\x7b-\x7f]+", " ", (t or "").lower()).strip(" ")


def shingled(t):
    return minhash.shingles(np.frombuffer(norm(t).encode(), np.uint8))


def test_classes_equal_brute_force(awkward):
    rows = awkward.collect()
    got = minhash.near_duplicates(awkward).collect()
    assert len(got) == len(rows)
    texts = sorted({norm(r.text) for r in rows})
    df = Counter(h for t in texts for h in shingled(t)[0].tolist())
    n = sum(len(shingled(t)[0]) > 0 for t in texts)

    def weighed(t):
        h, tf = shingled(t)
        return h, minhash.weights(tf, np.array([df[x] for x in h.tolist()]), n)

    parent = {t: t for t in texts}

    def find(t):
        while parent[t] != t:
            t = parent[t]
        return t

    for i, a in enumerate(texts):
        for b in texts[:i]:
            if minhash.weighted_jaccard(weighed(a), weighed(b)) >= minhash.SIMILAR:
                parent[find(a)] = find(b)
    groups = {}
    for r in rows:
        groups.setdefault(find(norm(r.text)), []).append(r.doc_id)
    smallest = lambda ids: None if None in ids else min(ids)
    want = sorted((str(i), str(smallest(ids)), len(ids)) for ids in groups.values() for i in ids)
    assert sorted((str(r.doc_id), str(r.class_id), r.class_size) for r in got) == want


def test_samples_estimate_weighted_jaccard():
    rng = np.random.default_rng(1)
    pool = rng.integers(0, 2**63, 3000, dtype=np.uint64)
    weight = dict(zip(pool.tolist(), rng.uniform(1, 6, len(pool))))
    agree, true = [], []
    for k in range(60):
        own = rng.permutation(pool)[:700]
        a, b = np.unique(own[: 500 + k]), np.unique(own[100:])
        wa, wb = np.array([weight[x] for x in a.tolist()]), np.array([weight[x] for x in b.tolist()])
        agree.append((minhash.signature(a, wa) == minhash.signature(b, wb)).mean())
        shared = sum(weight[x] for x in set(a.tolist()) & set(b.tolist()))
        true.append(shared / (wa.sum() + wb.sum() - shared))
    assert abs(np.mean(agree) - np.mean(true)) < 0.03


def test_long_texts_hash_like_short_ones(monkeypatch):
    raw = np.frombuffer(" ".join(f"w{i}" for i in range(3000)).encode(), np.uint8)
    whole = minhash._word_hashes(raw)
    monkeypatch.setattr(minhash, "WINDOW", 1000)
    assert (minhash._word_hashes(raw) == whole).all()


def test_stage_keeps_one_of_each_class(awkward, nothing, spark):
    kept = minhash.stage(spark, awkward, "")
    assert kept.columns == awkward.columns
    ids = [r.doc_id for r in kept.collect()]
    assert 8 not in ids and 99 not in ids and 5 in ids and 12 in ids
    assert minhash.stage(spark, nothing, "").count() == 0


def test_families_on_one_template_are_all_found(spark):
    """Large buckets: 70 % of each text's weight is a template, and every text has one partner."""
    rng = np.random.default_rng(3)
    template = " ".join(f"t{i}" for i in range(600))
    block = lambda n: " ".join(f"u{x}" for x in rng.integers(0, 2**40, n))
    rows = []
    for family in range(90):
        own = block(40)
        rows += [(bytes([2 * family + k]), f"{own} {template} {block(20)}") for k in (0, 1)]
    got = minhash.classes(*minhash.weighed(spark.createDataFrame(rows, "v binary, norm string").coalesce(1), len(rows))).collect()
    assert {r.v[0]: r.c[0] for r in got} == {i: i - i % 2 for i in range(180)}


def test_document_frequencies_are_true_across_parts(spark, monkeypatch):
    monkeypatch.setattr(minhash, "PART", 1000)
    rng = np.random.default_rng(4)
    rows = [(bytes([k]), " ".join(f"w{x}" for x in rng.integers(0, 3, 40))) for k in range(60)]
    texts, banded, n = minhash.weighed(spark.createDataFrame(rows, "v binary, norm string").repartition(3), len(rows))
    df = Counter(h for _, t in rows for h in shingled(t)[0].tolist())
    got = texts.join(banded, "v").collect()
    assert n == len(got) == 60
    for r in got:
        assert np.frombuffer(r.counts, np.uint32).tolist() == [df[h] for h in shingled(r.norm)[0].tolist()]


def test_twins_in_a_template_family_are_found(spark):
    """Buckets of hundreds: pairs in a family are just under the threshold, planted twins above it; against brute force."""
    rng = np.random.default_rng(11)
    word = lambda: f"u{rng.integers(0, 2**40)}"
    template = [f"t{i}" for i in range(260)]
    rows = []
    for k in range(200):
        text = template + [word() for _ in range(22)]
        twin = [word() if 20 <= i < 22 else w for i, w in enumerate(text)]
        rows += [(f"{k:03}a".encode(), " ".join(text)), (f"{k:03}b".encode(), " ".join(twin))]
    rows += [(f"x{k:04}".encode(), " ".join(word() for _ in range(30))) for k in range(600)]
    df = Counter(h for _, t in rows for h in shingled(t)[0].tolist())
    weighed = []
    for _, t in rows:
        h, tf = shingled(t)
        weighed.append((h, minhash.weights(tf, np.array([df[x] for x in h.tolist()]), len(rows))))
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(400):
        for j in range(i):
            if minhash.weighted_jaccard(weighed[i], weighed[j]) >= minhash.SIMILAR:
                parent[find(i)] = find(j)
    want = {}
    for i in range(400):
        want.setdefault(find(i), set()).add(rows[i][0])
    assert max(map(len, want.values())) < 400  # the template alone makes no link
    got = {}
    for r in minhash.classes(*minhash.weighed(spark.createDataFrame(rows, "v binary, norm string").repartition(2), len(rows))).collect():
        got.setdefault(bytes(r.c), set()).add(bytes(r.v))
    found = {frozenset(x) for x in got.values()}
    links = [x for x in want.values() if len(x) > 1]
    assert len(links) > 100
    assert sum(frozenset(x) in found for x in links) >= 0.99 * len(links)


def _sent(spark):
    """Bytes shuffled so far in this application."""
    return spark.sparkContext._jsc.sc().statusStore().executorSummary("driver").totalShuffleWrite()


def test_texts_that_meet_no_other_stay_where_they_are(spark):
    """What candidates cost moves in proportion to the texts that meet, also where joins aren't broadcast."""
    rng = np.random.default_rng(6)
    words = lambda n: [f"w{x}" for x in rng.integers(0, 2**40, n)]
    alone = [" ".join(words(1500)) for _ in range(300)]
    near = words(100)
    rows = [(f"a{k:03}".encode(), t) for k, t in enumerate(alone)]
    rows += [(f"b{k}".encode(), " ".join([*near[:50], f"edit{k}", *near[51:]])) for k in range(3)]
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = minhash.weighed(spark.createDataFrame(rows, "v binary, norm string").coalesce(1), len(rows))
        start = _sent(spark)
        got = minhash.classes(*found)
        sent = _sent(spark) - start
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert {bytes(r.v): bytes(r.c) for r in got.collect()} == {b"b0": b"b0", b"b1": b"b0", b"b2": b"b0"}
    assert sent < sum(map(len, alone)) / 20


def test_release_drops_the_last_shuffle(spark):
    """The files of the query that ended last go too, though nothing ran after it."""
    manager = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def files():
        return {str(f) for f in manager.getAllFiles().mkString("\n").split("\n") if f.endswith(".data")}

    old = files()
    forget(written(spark.range(1000).repartition(3, "id"), "released"))
    assert files() - old
    release(spark)
    end = time.monotonic() + 10
    while files() - old and time.monotonic() < end:
        time.sleep(0.2)
    assert not files() - old

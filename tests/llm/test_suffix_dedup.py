import collections
import random

import pytest
from graphloom.llm import suffix_dedup


def brute(docs, n=suffix_dedup.LENGTH):
    seen = collections.Counter(d[i : i + n] for d in docs for i in range(len(d) - n + 1))
    out = []
    for d in docs:
        gone = bytearray(len(d))
        for i in range(len(d) - n + 1):
            if seen[d[i : i + n]] > 1:
                gone[i : i + n] = b"\1" * n
        out.append((bytes(x for x, g in zip(d, gone) if not g), sum(g and (not i or not gone[i - 1]) for i, g in enumerate(gone))))
    return out


@pytest.mark.parametrize("hot", [suffix_dedup.HOT, 1])
def test_equals_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    monkeypatch.setattr(suffix_dedup, "SEGMENT", 700)
    suffix_dedup._TABLES.clear()
    rng = random.Random(hot)
    part = ["".join(rng.choice("abc ") for _ in range(n)) for n in (900, 500, 260, 210)]
    texts = ["", None, "x" * 450, "x" * 199, part[0] + part[1], part[1] + part[0][5:], part[2] + part[3], part[3] + part[2], part[0][300:560] + "é" * 120, "ab" * 260, part[0]]
    texts += [texts[4], part[2] * 3]
    rows = [(i, t, 0) for i, t in enumerate(texts)]
    got = {r.doc_id: (bytes(r.kept_bytes), len(r.removed)) for r in suffix_dedup.remove(spark.createDataFrame(rows, "doc_id long, text string, removed_ long")).collect()}
    assert [got[i] for i in range(len(texts))] == brute([(t or "").encode() for t in texts])
    suffix_dedup._TABLES.clear()


def test_awkward_rows(awkward, nothing):
    rows = suffix_dedup.remove(awkward.select("doc_id", "text", "row", "v")).collect()
    want = brute([(r.text or "").encode() for r in awkward.collect()])
    assert collections.Counter((bytes(r.kept_bytes), len(r.removed)) for r in rows) == collections.Counter(want)
    assert suffix_dedup.remove(nothing).count() == 0

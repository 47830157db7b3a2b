import collections
import hashlib
import re

from graphloom.llm import exact_dedup


def norm(t):
    return re.sub(r"[\x20\x09-\x0D]", "", t or "")


def test_groups_equal_brute_force(awkward, nothing):
    rows, groups = awkward.collect(), collections.defaultdict(list)
    for r in rows:
        groups[norm(r.text)].append(r)
    got = exact_dedup.decide(awkward).collect()
    assert len(got) == len(rows)
    for r in got:
        own = next(g for t, g in groups.items() if hashlib.sha256(t.encode()).hexdigest() == r.text_sha256)
        best = min(own, key=lambda x: (-len(x.text or ""), x.doc_id is not None, x.doc_id or 0))
        assert (r.group_size, r.keep_id) == (len(own), best.doc_id)
    kept = collections.Counter(r.text_sha256 for r in got if r.kept)
    assert set(kept.values()) == {1} and len(kept) == len(groups)
    assert exact_dedup.decide(nothing).count() == 0


def test_stage_keeps_rows_whole(awkward, nothing):
    kept = exact_dedup.deduplicate(awkward)
    assert kept.columns == awkward.columns
    texts = [norm(r.text) for r in kept.collect()]
    assert len(texts) == len(set(texts)) == len({norm(r.text) for r in awkward.collect()})
    assert exact_dedup.deduplicate(nothing).count() == 0


def test_filter_passes_no_copy(spark):
    rows = [(i, f"text {i % 700}") for i in range(1000)]
    got = exact_dedup.decide(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sum(r.kept for r in got) == 700 and {r.group_size for r in got} == {1, 2}

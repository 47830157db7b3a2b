import os

import duckdb
from graphloom.llm import toxicity

DATA = os.environ.get("TEST_DATA_LABELS", "/root/testdata/sf0.01")


def test_held_out_accuracy(spark):
    rows = {r.doc_id: r for r in toxicity.op5_toxicity(spark, DATA).collect()}
    labels = duckdb.sql(f"select doc_id, toxic from '{DATA}/labels.parquet'").fetchall()
    own = [(rows[i], t) for i, t in labels if rows[i].held_out]
    assert sum(r.predicted == t for r, t in own) / len(own) > 0.9
    assert all(0 <= r.score <= 1 for r in rows.values())


def test_awkward_rows_and_missing_labels(spark, awkward, nothing):
    none = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.fit(awkward, none)
    scored = toxicity.score(awkward, model).collect()
    assert len(scored) == awkward.count() and {round(r.score, 6) for r in scored} == {0.5}
    assert toxicity.score(nothing, model).count() == 0


def test_windows_find_the_same_buckets(monkeypatch):
    import numpy as np

    raw = np.frombuffer(("the quick brown fox " * 60).encode(), np.uint8)
    whole = sorted(toxicity._Seen().distinct(raw).tolist())
    monkeypatch.setattr(toxicity, "WINDOW", 100)
    assert sorted(toxicity._Seen().distinct(raw).tolist()) == whole

import corpus_pipeline

DATA = "/root/testdata/sf0.001"


def test_stages_in_order(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, DATA).cache()
        assert docs.columns == columns, name
        assert 0 < docs.count() <= before
        before = docs.count()
    assert docs.where("text RLIKE '[0-9]+[.][0-9]+[.][0-9]+[.][0-9]+'").count() == 0
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, DATA)
    assert {r.doc_id for r in packed.select("doc_id").collect()} == {r.doc_id for r in docs.select("doc_id").collect()}


def test_awkward_documents_pass(spark, awkward):
    for _, stage in corpus_pipeline.STAGES[1:-1]:
        awkward = stage(spark, awkward, DATA).cache()
    assert corpus_pipeline.STAGES[-1][1](spark, awkward, DATA).count() > 0

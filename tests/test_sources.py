import json

from graphloom.operators import models
from graphloom.sources import rdf, readers, writers
from pyspark.sql import functions as F


def test_gold_and_predictions(spark, tmp_path):
    doc = {"text": "t", "entities": [{"entity_id": 0, "entity_name": " A ", "entity_type": "x", "mentions": []}, {"entity_id": 1, "entity_name": "", "entity_type": "x", "mentions": []}],
           "explicit_triplets": [{"subject": "A", "relation": "r", "object": "B"}],
           "implicit_triplets": [{"subject": {"entity_id": 1, "entity_text": "B"}, "relation": "s", "object": "C"}]}
    (tmp_path / "one.json").write_text(json.dumps(doc, indent=1))
    (tmp_path / "one_typed.json").write_text(json.dumps(doc))
    (tmp_path / "two_typed.json").write_text(json.dumps(doc))
    docs = readers.gold_preferring_plain(spark, str(tmp_path))
    assert sorted(r.doc_id for r in docs.collect()) == ["one", "two"]
    assert {r.name for r in readers.gold_entities(docs).collect()} == {"A"}
    got = {(r.doc_id, r.subject, r.object, r.scope) for r in readers.gold_triples(docs).collect()}
    assert ("one", "A", "B", "explicit") in got and ("one", "B", "C", "implicit") in got
    (tmp_path / "p").mkdir()
    rows = [{"file": "one.json", "text": "t", "ontology": "uco", "extracted_entities": [{"name": "A", "class": None}]}, {"file": "x.json", "error": "bad"}]
    (tmp_path / "p/run_results.json").write_text(json.dumps(rows))
    assert [(r.run, r.doc_id) for r in readers.predictions(spark, str(tmp_path / "p")).collect()] == [("run", "one")]


def test_turtle_and_xml(spark, tmp_path):
    (tmp_path / "a.ttl").write_text('@prefix o: <http://x/o#> .\n@prefix owl: <http://w/owl#> .\n@prefix rdfs: <http://w/rdfs#> .\no:A a owl:Class ; rdfs:label "A thing"@en , "b" ; rdfs:subClassOf o:B .\no:B a owl:Class .\no:p a owl:ObjectProperty ; rdfs:domain o:A ; rdfs:range [ a owl:Class ; o:q ( o:A 1 ) ] .')
    (tmp_path / "b.owl").write_text('<?xml version="1.0"?><!DOCTYPE r [<!ENTITY x "http://y/">]><rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:owl="http://w/owl#" xmlns:rdfs="http://w/rdfs#"><owl:Class rdf:about="&x;C"><rdfs:label>C</rdfs:label></owl:Class></rdf:RDF>')
    (tmp_path / "c.owl").write_text("<broken")
    rows = rdf.triples(spark, str(tmp_path)).cache()
    assert rows.where("error IS NOT NULL").count() == 1
    tables = rdf.schema_tables(rows.where("error IS NULL"))
    assert {r.uri for r in tables["classes"].collect()} == {"http://x/o#A", "http://x/o#B", "http://y/C"}
    assert [(r.child, r.parent) for r in tables["subclass_edges"].collect()] == [("http://x/o#A", "http://x/o#B")]
    assert [r.class_uri for r in tables["prop_domain"].collect()] == ["http://x/o#A"]


def test_conll_csv_and_writers(spark, tmp_path):
    (tmp_path / "t.txt").write_text("A B-X\nb O\n\nC B-Y\n")
    assert [(r.sent_id, r.pos, r.token, r.tag) for r in readers.conll(spark, str(tmp_path / "t.txt")).collect()] == [(0, 0, "A", "B-X"), (0, 1, "b", "O"), (1, 0, "C", "B-Y")]
    (tmp_path / "k.csv").write_text('Sentence,Behavior,sampled_tactic,Ground_Truth\na,true,x,"[s, v, o]"\nb,FALSE,x,"[s, v, o]"\nc,TRUE,x,none\nd,TRUE,x,"[p, q, r]"\n')
    assert [(r.id, r.Sentence) for r in readers.behaviours(spark, str(tmp_path / "k.csv")).collect()] == [(0, "a"), (1, "d")]
    t = spark.createDataFrame([("i:a", "p#type", "C", "uri"), ("i:a", "p#n", 'x"y', "literal"), ("z", "p", "o", "uri")], "s string, p string, o string, kind string")
    assert len(writers.turtle_lines(t, "i:").collect()) == 2
    nodes, edges = writers.graph_tables(t, "i:")
    assert nodes.first().attributes == {"n": 'x"y'} and edges.count() == 0


def test_model_slots(spark):
    df = spark.createDataFrame([("a b",), ("a b",), (None,)], "text string")
    assert [sum(r.embedding) for r in models.encoded(df, "text", models.hashing_encoder(8)).orderBy(F.desc_nulls_last("text")).collect()] == [2.0, 2.0, 0.0]
    calls = models.judged(df.where("text IS NOT NULL"), "text", lambda xs: [x.upper() for x in xs])
    assert {r.response for r in calls.collect()} == {"A B"}

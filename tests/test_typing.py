"""Matchers, decisions, shapes and result rows on small tables."""

import random

import pytest
from graphloom.functions import text
from graphloom.operators import extraction, matchers, ontology
from graphloom.sources import rdf
from pyspark.sql import functions as F


def test_matchers_by_mode(spark):
    p = spark.createDataFrame([(1, 0, "the red fox", "eats", "a hen"), (1, 1, "red fox", "sees", "dogs")], "doc int, i int, subject string, relation string, object string")
    g = spark.createDataFrame([(1, 0, "red fox", "eats", "a hen"), (2, 0, "red fox", "eats", "a hen")], "doc int, j int, subject string, relation string, object string")
    assert [(r.i, r.j) for r in matchers.matcher("slots", bar=0.6).match_triples(p, g).collect()] == [(0, 0)]
    assert matchers.matcher("exact").match_triples(p, g).count() == 0
    assert [(r.i, r.j) for r in matchers.matcher("jaccard", bar=0.7).match_triples(p, g).collect()] == [(0, 0)]
    name = lambda df, k: df.select("doc", k, F.col("subject").alias("name"))
    assert [(r.i, r.j) for r in matchers.matcher("exact").match_entities(name(p, "i"), name(g, "j")).collect()] == [(1, 0)]
    with pytest.raises(ValueError, match="slots"):
        matchers.matcher("nothing")


def test_decisions(spark):
    c = spark.createDataFrame([(1, i, 10 * i + k, k) for i in range(6) for k in range(2)], "doc int, i int, j int, rank int")
    d = spark.createDataFrame([(1, 0, "y"), (1, 1, "2"), (1, 2, "n"), (1, 3, "a"), (1, 5, "q")], "doc int, i int, answer string")
    got = {r.i: (r.j, r.state) for r in matchers.decided(c, d).collect()}
    assert got == {0: (0, "matched"), 1: (11, "matched"), 2: (None, "rejected"), 3: (30, "matched"), 4: (40, "matched"), 5: (None, "undecided")}


def test_validation_with_and_without_bounds(spark):
    edges = spark.createDataFrame([("dog", "animal")], "child string, parent string")
    uses = spark.createDataFrame([("dog", "eats", "animal"), ("animal", "barks", "dog"), ("dog", "free", "x")], "subject string, prop string, object string")
    domain = spark.createDataFrame([("eats", "animal"), ("barks", "dog")], "prop string, cls string")
    ranges = spark.createDataFrame([("eats", "dog")], "prop string, cls string")
    got = {r.prop: (r.domain_ok, r.range_ok, r.valid) for r in ontology.validated(uses, ontology.bounded_closure(edges), domain, ranges).collect()}
    assert got == {"eats": (True, False, False), "barks": (False, True, False), "free": (True, True, True)}


def test_shapes_out_of_turtle(spark, tmp_path):
    (tmp_path / "s.ttl").write_text(
        "@prefix sh: <http://www.w3.org/ns/shacl#> .\n@prefix x: <http://x.example/o#> .\n"
        "x:S sh:targetClass x:Dog ; sh:property x:P .\nx:P sh:path x:name ; sh:minCount 1 ; sh:maxCount 2 ; sh:node x:Label .\n"
    )
    triples = rdf.triples(spark, str(tmp_path / "s.ttl"))
    assert [tuple(r) for r in ontology.shacl_shapes(triples).collect()] == [("dog", "name", 1, 2, "label")]


def test_results(spark):
    m = spark.createDataFrame([(1, 2, "a", "late", False), (1, 1, "a", "early", False), (1, 3, "5", None, True), (1, 4, "b", None, False)], "doc int, ord int, name string, cls string, literal boolean")
    assert {tuple(r) for r in extraction.entities_output(m).collect()} == {(1, "a", "early"), (1, "b", "")}


def test_slots_of_equal_rows_are_compared_once(spark):
    """Before, every two rows of a document were compared, and a missing brand counted as an empty one."""
    names = ["red fox", "fox  RED", "a b c", "a b d", "", "x"]
    rng = random.Random(4)
    rows = [(rng.randrange(3), i, rng.choice(names), rng.choice(names) if i % 11 else None) for i in range(120)]
    data = spark.createDataFrame(rows, "doc int, i int, a string, b string")
    t = data.select("doc", "i", text.blank_tokens(F.col("a")).alias("s"), text.blank_tokens(F.col("b")).alias("o"))
    p, g = t.where("i % 2 = 0"), t.where("i % 2 = 1").withColumnRenamed("i", "j")
    got = sorted(tuple(r) for r in matchers.slot_pairs(p, g, 0.5, 0.3).collect())
    a, b = matchers.jaccard(F.col("p.s"), F.col("g.s")), matchers.jaccard(F.col("p.o"), F.col("g.o"))
    plain = p.alias("p").join(g.alias("g"), "doc").where((a >= 0.5) & (b >= 0.3)).select("doc", "i", "j", ((a + b) / 2).alias("score"))
    assert got and got == sorted(tuple(r) for r in plain.collect())

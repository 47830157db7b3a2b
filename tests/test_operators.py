"""Hand examples of text, ontology, graph, resolution and sequence operators."""

import re

from graphloom.functions import jsontext, text
from graphloom.operators import graph, metrics, ontology, resolve, sequences
from pyspark.sql import functions as F


def one(spark, column):
    return spark.range(1).select(column).first()[0]


def test_type_labels(spark):
    for x, want in (("uco:Malware", "malware"), ("http://x/y#Tool", "tool"), ("NON_MATCH", ""), ("Threat Actor", "threatactor"), (None, "")):
        assert one(spark, text.type_label(F.lit(x).cast("string"))) == want


def test_results_keys(spark):
    assert one(spark, text.results_key(F.lit("runner_uco_results"))) == "runner_uco"
    assert one(spark, text.results_key(F.lit("a_uco_openai-gpt-4o_embedding_2511251134_results"))) == "a_uco_openai-gpt-4o"


def test_indicators(spark):
    found = one(spark, text.mention_kinds(F.lit("192.168.1.100 CVE-2023-1234 malicious.example.com January 2023 version 1.2.3 " + "a" * 32 + " " + "b" * 64)))
    assert {x["kind"] for x in found} >= {"ip", "cve", "domain", "date", "version", "hash_md5", "hash_sha256"}
    assert one(spark, text.mention_kinds(F.lit("This is normal text without indicators"))) == []


def test_mention_kinds_as_plain_patterns(spark):
    lines = [
        "In 2020 the energy sector and the health sector, not the oil sector9",
        "x sector9 y sector", "9foo bar sector", "sector", "_a b sector_ c sector", "a  b sector", "", "v 1.2 costs $3.5 million",
        "a Linux operating systems CVSS9.8 YARA1234 www.example.org/x. a.com.9", "sectors of one sector.\nthe two\nsector",
        "word " * 20_000 + "sector", "word " * 500,
    ]
    found = spark.createDataFrame(list(enumerate(lines)), "n int, x string").select("n", text.mention_kinds(F.col("x")).alias("k")).collect()
    for n, kinds in found:
        first = {k: m[0] for k, p in text.MENTION_KINDS.items() if (m := re.search(p, lines[n], re.ASCII))}
        assert {k["kind"]: k["value"] for k in kinds} == first, lines[n][:80]


def test_malformed_json(spark):
    for said in ("{'a': 'x'}", '{"a": "x",}', "{a: 'x'}", 'so {"a": "x"} it is'):
        assert one(spark, jsontext.field(F.lit(said), "a")) == "x"
    assert one(spark, jsontext.field(F.lit("no object"), "a")) is None


def test_hierarchy_credit(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d")], "child string, parent string")
    pairs = spark.createDataFrame([("a", "a"), ("a", "b"), ("a", "c"), ("a", "d"), ("c", "a")], "pred string, gold string")
    scored = ontology.distance(pairs, ontology.bounded_closure(edges)).select("pred", "gold", metrics.credit(F.col("depth")).alias("s"))
    assert {(r.pred, r.gold): r.s for r in scored.collect()} == {("a", "a"): 1.0, ("a", "b"): 0.6, ("a", "c"): 0.3, ("a", "d"): 0.0, ("c", "a"): 0.3}


def test_closure_ends_on_cycles(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a")], "child string, parent string")
    assert ontology.closure(edges).count() == 9


def test_components_of_paths_and_islands(spark):
    edges = spark.createDataFrame([(0, 1), (2, 3), *((i, i + 1) for i in range(10, 60))], "src int, dst int")
    labels = {r.node: r.component for r in graph.components(edges).collect()}
    assert labels[1] == 0 and labels[3] == 2 and labels[60] == 10 and len(set(labels.values())) == 3
    assert graph.prune_islands(graph.components(edges), 2).count() == 51


def test_alignment_is_by_direct_neighbours(spark):
    mentions = spark.createDataFrame([("k", i) for i in range(4)], "kind string, mention int")
    near = spark.createDataFrame([("k", a, b) for a, b in ((0, 1), (1, 0), (1, 2), (2, 1))], "kind string, a int, b int")
    entity = {r.mention: r.entity for r in graph.align(mentions, near).collect()}
    assert entity == {0: 0, 1: 1, 2: 1, 3: 3}


def test_canonical_names_win_over_mentions(spark):
    rows = [(0, "APT1", "the group"), (1, "the group", "x"), (2, "Other", "x")]
    got = {r.mention: r.canonical for r in resolve.canonical_map(spark.createDataFrame(rows, "pos int, name string, mention string")).collect()}
    assert got == {"APT1": "APT1", "the group": "the group", "x": "the group", "Other": "Other"}


def test_bio_runs(spark):
    rows = [(0, i, t) for i, t in enumerate(["LOC", "O", "O", "ORG", "ORG", "O"])]
    got = sequences.runs(spark.createDataFrame(rows, "s int, p int, kind string"), "s", "p", "kind").where("kind <> 'O'")
    assert sorted((r.kind, r.start, r.end) for r in got.collect()) == [("LOC", 0, 1), ("ORG", 3, 5)]


def test_byte_budget_packing(spark):
    parts = F.array(*map(F.lit, ("aaaa", "bbb", "é", "c" * 20)))
    assert one(spark, sequences.pack_parts(parts, 8)) == ["aaaa\nbbb", "é", "c" * 20]
    assert one(spark, sequences.pack_parts(F.array().cast("array<string>"), 8)) == []


def test_pronouns_are_numbered(spark):
    assert one(spark, text.annotate_pronouns(F.lit("He saw it and them"))) == "<he:1> saw <it:2> and <them:3>"


def test_shape_violations_and_sentences(spark):
    assert one(spark, text.sentences(F.lit("One. Two!\nThree"))) == ["One.", "Two!", "Three"]
    shapes = spark.createDataFrame([("T", "p", 1, 2)], "target string, path string, min_count int, max_count int")
    inst = spark.createDataFrame([("x", "T"), ("y", "S"), ("z", "T")], "s string, cls string")
    values = spark.createDataFrame([("x", "p")] * 3 + [("y", "p")], "s string, path string")
    closed = ontology.bounded_closure(spark.createDataFrame([("S", "T")], "child string, parent string"))
    got = {r.s: r.violation for r in ontology.violations(shapes, inst, values, closed).collect()}
    assert got == {"x": "too many", "z": "too few"}


def test_shape_violations_by_tasks_of_bounded_rows(spark, monkeypatch):
    """Before, the number of tasks didn't follow the rows, and instances were made distinct before they were counted."""
    monkeypatch.setattr(ontology, "TASK_ROWS", 100)
    shapes = spark.createDataFrame([("T", "p", 1, 2)], "target string, path string, min_count int, max_count int")
    inst = spark.range(2000).select("id", F.explode(F.array(F.lit("T"), F.lit("S"))).alias("cls")).selectExpr("id AS s", "cls")
    values = spark.range(2000).selectExpr("id", "explode(sequence(1, 4)) AS k").where("k <= id % 5").selectExpr("id AS s", "'p' AS path")
    closed = ontology.bounded_closure(spark.createDataFrame([("S", "T")], "child string, parent string"))
    found = ontology.violations(shapes, inst, values, closed)
    assert found.rdd.getNumPartitions() >= 80
    got = {r.s: r.violation for r in found.collect()}
    assert got == {i: "too few" if i % 5 == 0 else "too many" for i in range(2000) if i % 5 in (0, 3, 4)} and found.count() == len(got)

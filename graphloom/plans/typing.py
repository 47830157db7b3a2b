"""Ontology ranges, facets and shapes, matchers, decisions and result rows on driver tables.

Analogues: nation and region are the class hierarchy, part types its properties with domains (classes of part sizes)
and ranges (classes of brands); parts and lines stand for triples, users' events for mentions and decisions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import blank_tokens
from ..operators import extraction, matchers, ontology
from .base import query, table
from .knowledge import _CLOSURE, _PROPS, _domain, _edges
from .rules import _STEM

C = F.col

_RANGE = "ran AS (SELECT DISTINCT p_type AS prop, CASE WHEN p_size % 2 = 0 THEN 'r' || p_size % 4 ELSE 'n' || p_size % 23 END AS cls FROM part WHERE p_type <> 'PROMO')"
_USES = "uses AS (SELECT p_partkey, 'n' || p_partkey % 25 AS subject, p_type AS prop, 'n' || p_partkey % 23 AS object FROM part)"
_IN = "indom AS (SELECT DISTINCT d.prop, k.child AS cls FROM dom d JOIN closed k ON k.ancestor = d.cls), inran AS (SELECT DISTINCT d.prop, k.child AS cls FROM ran d JOIN closed k ON k.ancestor = d.cls)"


def _range(spark: SparkSession, sf_dir: str) -> DataFrame:
    cls = F.when(C("p_size") % 2 == 0, F.concat(F.lit("r"), (C("p_size") % 4).cast("string"))).otherwise(F.concat(F.lit("n"), (C("p_size") % 23).cast("string")))
    return table(spark, sf_dir, "part").where("p_type <> 'PROMO'").select(C("p_type").alias("prop"), cls.alias("cls")).distinct()


def _known(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ontology.bounded_closure(_edges(spark, sf_dir), 3)


def _tag(p: str, c) -> F.Column:
    return F.concat(F.lit(p), c.cast("string"))


@query(f"{_CLOSURE}, {_PROPS}, {_RANGE}, {_USES}, {_IN} SELECT p_partkey, prop NOT IN (SELECT prop FROM dom) OR EXISTS (SELECT 1 FROM indom i WHERE i.prop = u.prop AND i.cls = u.subject) AS domain_ok, prop NOT IN (SELECT prop FROM ran) OR EXISTS (SELECT 1 FROM inran i WHERE i.prop = u.prop AND i.cls = u.object) AS range_ok FROM uses u")
def validate_property_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uses of properties against domain and range, ancestors included; a missing bound allows all."""
    uses = table(spark, sf_dir, "part").select("p_partkey", _tag("n", C("p_partkey") % 25).alias("subject"), C("p_type").alias("prop"), _tag("n", C("p_partkey") % 23).alias("object"))
    return ontology.validated(uses, _known(spark, sf_dir), _domain(spark, sf_dir)[1], _range(spark, sf_dir)).select("p_partkey", "domain_ok", "range_ok")


@query(f"{_CLOSURE}, {_RANGE} SELECT DISTINCT k.child AS cls, d.prop FROM ran d JOIN closed k ON k.ancestor = d.cls")
def properties_into_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Properties whose range holds a class; one without a range is never an inverse candidate."""
    return ontology.properties_into(_known(spark, sf_dir), _range(spark, sf_dir))


_SHAPES = "shapes AS (SELECT DISTINCT p_type AS path, 'n' || p_size % 7 AS target, 'r' || p_size % 5 AS node FROM part WHERE p_size < 12)"


def _shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").where("p_size < 12").select(C("p_type").alias("path"), _tag("n", C("p_size") % 7).alias("target"), _tag("r", C("p_size") % 5).alias("node")).distinct()


@query(f"{_CLOSURE}, {_PROPS}, {_SHAPES} SELECT prop, cls FROM dom UNION SELECT path, target FROM shapes")
def shape_augment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A shape's target class joins the domain of its path."""
    return ontology.augmented(_domain(spark, sf_dir)[1], _shapes(spark, sf_dir))


_FACETS = "fr AS (SELECT prop, cls AS domain, 'r' || length(prop) % 5 AS facet FROM dom WHERE prop < 'M'), sub AS (SELECT DISTINCT p_type AS prop, 'ECONOMY' AS parent FROM part WHERE p_type > 'M'), fr2 AS (SELECT * FROM fr UNION SELECT 'ECONOMY', 'n3', 'r2'), facets AS (SELECT 'r' || r_regionkey AS facet FROM region WHERE r_regionkey < 3 UNION SELECT 'STANDARD'), anc AS (SELECT domain AS a, facet FROM fr2 UNION SELECT f.domain, f.facet FROM sub JOIN fr2 f ON f.prop = sub.parent UNION SELECT target, facet FROM shapes JOIN facets ON node = facet UNION SELECT target, facet FROM shapes JOIN facets ON path = facet)"


@query(f"{_CLOSURE}, {_PROPS}, {_SHAPES}, {_FACETS} SELECT DISTINCT k.child AS cls, facet FROM anc JOIN closed k ON k.ancestor = anc.a")
def facet_bridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class to facet by four ways: facet ranges, properties below them, shape nodes, and paths that name a facet."""
    dom = _domain(spark, sf_dir)[1]
    ranges = dom.where("prop < 'M'").select("prop", C("cls").alias("domain"), _tag("r", F.length("prop") % 5).alias("facet")).union(spark.createDataFrame([("ECONOMY", "n3", "r2")], "prop string, domain string, facet string"))
    below = table(spark, sf_dir, "part").where("p_type > 'M'").select(C("p_type").alias("prop"), F.lit("ECONOMY").alias("parent")).distinct()
    facets = table(spark, sf_dir, "region").where("r_regionkey < 3").select(_tag("r", C("r_regionkey")).alias("facet")).union(spark.createDataFrame([("STANDARD",)], "facet string"))
    return ontology.facets_of(_known(spark, sf_dir), ranges, below, _shapes(spark, sf_dir), facets)


@query(f"{_CLOSURE}, {_PROPS}, {_RANGE}, {_IN}, pairs AS (SELECT DISTINCT 'n' || c_nationkey AS s, 'n' || c_custkey % 25 AS o FROM customer), w AS (SELECT s, o, d.prop, 1 AS way FROM pairs JOIN indom d ON d.cls = s JOIN inran r ON r.prop = d.prop AND r.cls = o UNION ALL SELECT s, o, d.prop, 2 FROM pairs JOIN indom d ON d.cls = o JOIN inran r ON r.prop = d.prop AND r.cls = s UNION ALL SELECT s, o, d.prop, 3 FROM pairs JOIN indom d ON d.cls = s UNION ALL SELECT s, o, r.prop, 4 FROM pairs JOIN inran r ON r.cls = o) SELECT s, o, prop, min(way) AS way FROM w GROUP BY ALL")
def type_pair_ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidate properties between two classes by four ways; the first way to a property stays."""
    pairs = table(spark, sf_dir, "customer").select(_tag("n", C("c_nationkey")).alias("s"), _tag("n", C("c_custkey") % 25).alias("o")).distinct()
    return ontology.between(pairs, _known(spark, sf_dir), _domain(spark, sf_dir)[1], _range(spark, sf_dir))


@query("WITH e AS (SELECT 's' || s_suppkey AS name, 'n' || s_nationkey AS cls FROM supplier), i AS (SELECT 's' || s_suppkey AS name, 'ioc' AS cls FROM supplier WHERE s_suppkey % 5 = 0), c AS (SELECT name, cls FROM i UNION ALL SELECT name, cls FROM e WHERE name NOT IN (SELECT name FROM i)), t AS (SELECT p_partkey AS id, 's' || p_partkey % 10 AS s, lower(p_type) AS p, 's' || p_size % 7 AS o FROM part), a AS (SELECT DISTINCT 'ioc' AS s_cls, lower(p_type) AS p, 'n' || p_size % 25 AS o_cls FROM part) SELECT id, x.cls AS s_cls, y.cls AS o_cls, EXISTS (SELECT 1 FROM a WHERE a.s_cls = x.cls AND a.p = t.p AND a.o_cls = y.cls) AS matched FROM t LEFT JOIN c x ON x.name = s LEFT JOIN c y ON y.name = o")
def type_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed ends of triples, an indicator's class before an entity's, and whether the predicate fits them."""
    s, p = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "part")
    entities = s.select(_tag("s", C("s_suppkey")).alias("name"), _tag("n", C("s_nationkey")).alias("cls"))
    indicators = s.where("s_suppkey % 5 = 0").select(_tag("s", C("s_suppkey")).alias("name"), F.lit("ioc").alias("cls"))
    triples = p.select(C("p_partkey").alias("id"), _tag("s", C("p_partkey") % 10).alias("s"), F.lower("p_type").alias("p"), _tag("s", C("p_size") % 7).alias("o"))
    allowed = p.select(F.lit("ioc").alias("s_cls"), F.lower("p_type").alias("p"), _tag("n", C("p_size") % 25).alias("o_cls")).distinct()
    return extraction.type_matched(triples, indicators, entities, allowed).select("id", "s_cls", "o_cls", "matched")


@query("WITH c AS (SELECT p_size AS key, p_type AS prop, CASE WHEN p_partkey % 3 = 0 THEN 'data' ELSE 'object' END AS kind, p_partkey % 2 = 0 AS inverse, p_partkey AS ord FROM part), f AS (SELECT key, prop, inverse, arg_min(kind, ord) AS kind, min(ord) AS ord FROM c WHERE NOT (inverse AND kind = 'data') GROUP BY ALL) SELECT *, row_number() OVER (PARTITION BY key ORDER BY ord) - 1 AS rank FROM f")
def normalize_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Property candidates: inverse data properties go, of equal ones the first stays."""
    kind = F.when(C("p_partkey") % 3 == 0, "data").otherwise("object")
    return extraction.normalised_candidates(table(spark, sf_dir, "part").select(C("p_size").alias("key"), C("p_type").alias("prop"), kind.alias("kind"), (C("p_partkey") % 2 == 0).alias("inverse"), C("p_partkey").alias("ord")))


@query("WITH m AS (SELECT user_id AS doc, event_id AS ord, props AS name, CASE WHEN event_type <> 'view' THEN event_type END AS cls FROM events WHERE event_type <> 'error') SELECT doc, name, coalesce((array_agg(cls ORDER BY ord))[1], '') AS cls FROM m GROUP BY doc, name")
def build_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result's entities: one a name, with the class of its first mention; literals are left out."""
    e = table(spark, sf_dir, "events")
    return extraction.entities_output(e.select(C("user_id").alias("doc"), C("event_id").alias("ord"), C("props").alias("name"), F.when(C("event_type") != "view", C("event_type")).alias("cls"), (C("event_type") == "error").alias("literal")))


@query("SELECT l_orderkey AS doc, 's' || l_suppkey AS subject, 'm' || l_linenumber || ':' || lower(l_returnflag) AS relation, 'p' || l_partkey AS object FROM lineitem WHERE l_linestatus <> 'O'")
def build_triplets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result's triples: explicit ones, with short names of relations."""
    relation = F.concat(F.lit("http://x.example/m"), C("l_linenumber").cast("string"), F.lit("/"), F.lower("l_returnflag"))
    return extraction.triplets_output(table(spark, sf_dir, "lineitem").select(C("l_orderkey").alias("doc"), _tag("s", C("l_suppkey")).alias("subject"), relation.alias("relation"), _tag("p", C("l_partkey")).alias("object"), (C("l_linestatus") == "O").alias("implicit")))


@query("SELECT doc_id FROM documents WHERE coalesce(lang, 'none') IN ('en', 'de', 'fr')")
def typing_schema_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only files of the three schemas that have types take part in the typing task."""
    return table(spark, sf_dir, "documents").where(F.coalesce("lang", F.lit("none")).isin("en", "de", "fr")).select("doc_id")


@query("WITH m AS (SELECT o_orderkey AS doc, o_custkey % 7 + 1 AS i, o_orderkey % 7 + 1 AS j FROM orders) SELECT doc, p.l_returnflag AS pred, g.l_returnflag AS gold FROM m JOIN lineitem p ON p.l_orderkey = doc AND p.l_linenumber = i JOIN lineitem g ON g.l_orderkey = doc AND g.l_linenumber = j")
def matched_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The types of both rows of each matched pair, by (document, index)."""
    m = table(spark, sf_dir, "orders").select(C("o_orderkey").alias("doc"), (C("o_custkey") % 7 + 1).alias("i"), (C("o_orderkey") % 7 + 1).alias("j"))
    side = lambda k, to: table(spark, sf_dir, "lineitem").select(C("l_orderkey").alias("doc"), C("l_linenumber").cast("bigint").alias(k), C("l_returnflag").alias(to))
    return m.join(side("i", "pred"), ["doc", "i"]).join(side("j", "gold"), ["doc", "j"]).select("doc", "pred", "gold")


@query("SELECT p_partkey, s_suppkey IS NOT NULL AS is_ioc, CASE WHEN s_suppkey IS NULL THEN '' ELSE 'k' || s_nationkey END AS ioc_type FROM part LEFT JOIN supplier ON p_partkey = s_suppkey AND s_acctbal > 0")
def entity_ioc_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities with their indicator flag and type; unknown ones get false and nothing."""
    known = table(spark, sf_dir, "supplier").where("s_acctbal > 0").select(C("s_suppkey").alias("name"), _tag("k", C("s_nationkey")).alias("ioc_type"))
    return extraction.flagged(table(spark, sf_dir, "part").select(C("p_partkey").alias("name")), known).select(C("name").alias("p_partkey"), "is_ioc", "ioc_type")


@query("SELECT event_type AS kind, CASE event_type WHEN 'click' THEN 'a person pressed something' WHEN 'error' THEN 'something failed' ELSE 'an event' END AS description, count(*) AS n FROM events GROUP BY ALL")
def kind_descriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds with their descriptions; others get the default."""
    mapping = spark.createDataFrame([("click", "a person pressed something"), ("error", "something failed")], "kind string, description string")
    return extraction.described(table(spark, sf_dir, "events").groupBy(C("event_type").alias("kind")).agg(F.count("*").alias("n")), F.broadcast(mapping), "an event")  # two rows


@query("SELECT page_id, html = '' AS failed FROM (SELECT * FROM pages ORDER BY page_id LIMIT 40)")
def file_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first inputs in file order, failed ones among them (the limit is the feature)."""
    return extraction.first_files(table(spark, sf_dir, "pages"), 40, "page_id").select("page_id", (C("html") == "").alias("failed"))


@query("SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_linenumber) - 1 AS id FROM lineitem")
def sequential_mention_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids 0, 1, ... over (chunk, position) of a document."""
    return extraction.sequential_ids(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_shipdate", "l_linenumber").select("l_orderkey", "l_linenumber", C("id").cast("bigint").alias("id"))


@query("WITH p AS (SELECT DISTINCT l_orderkey AS doc, l_linenumber AS i, l_suppkey % 3 AS j FROM lineitem) SELECT doc, count(*) AS pairs, count(DISTINCT j) AS gold_once FROM p GROUP BY doc")
def judged_pair_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A judge's pairs counted as they are (entities) and with each gold row once (triples)."""
    pairs = table(spark, sf_dir, "lineitem").select(C("l_orderkey").alias("doc"), C("l_linenumber").alias("i"), (C("l_suppkey") % 3).alias("j"))
    count = lambda once, to: matchers.judged_pairs(pairs, once).groupBy("doc").agg(F.count("*").alias(to))
    return count(False, "pairs").join(count(True, "gold_once"), "doc")


@query("""
WITH c AS (SELECT user_id AS doc, event_id AS i, [event_id * 2, event_id * 3] AS choices FROM events),
d AS (SELECT user_id AS doc, event_id AS i, CASE WHEN event_id % 9 < 6 THEN ['y', 'n', '2', '7', 's', 'y'][event_id % 9 + 1] WHEN event_id % 400 = 6 THEN 'a' WHEN event_id % 700 = 699 THEN 'q' END AS answer FROM events WHERE event_id % 9 < 6 OR event_id % 400 = 6 OR event_id % 700 = 699),
m AS (SELECT doc, min(i) FILTER (answer = 'a') AS all_from, min(i) FILTER (answer = 'q') AS quit_at FROM d GROUP BY doc),
x AS (SELECT c.*, CASE WHEN c.i >= quit_at THEN 'q' ELSE coalesce(answer, CASE WHEN c.i > all_from THEN 'y' END) END AS answer FROM c LEFT JOIN d USING (doc, i) LEFT JOIN m USING (doc))
SELECT doc, i, CASE WHEN answer IN ('y', 'a') THEN choices[1] WHEN answer = '2' THEN choices[2] END AS j, CASE WHEN answer IN ('y', 'a', '2') THEN 'matched' WHEN answer IN ('n', 's', '7') THEN 'rejected' ELSE 'undecided' END AS state FROM x""")
def hitl_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A person's answers (yes, no, a number, skip, all, quit) applied to ranked candidates."""
    e = table(spark, sf_dir, "events")
    candidates = e.select(C("user_id").alias("doc"), C("event_id").alias("i"), F.posexplode(F.array(C("event_id") * 2, C("event_id") * 3)).alias("rank", "j"))
    k = C("event_id") % 9
    listed = F.get(F.array(*[F.lit(x) for x in ("y", "n", "2", "7", "s", "y")]), k.cast("int"))
    answer = F.when(k < 6, listed).when(C("event_id") % 400 == 6, "a").when(C("event_id") % 700 == 699, "q")
    decisions = e.select(C("user_id").alias("doc"), C("event_id").alias("i"), answer.alias("answer")).where("answer IS NOT NULL")
    return matchers.decided(candidates, decisions)


_SLOTS = r"string_split(trim(regexp_replace(lower({}), '\s+', ' ', 'g')), ' ')"


@query(f"WITH t AS (SELECT p_partkey, p_size AS doc, list_distinct({_SLOTS.format('p_name')}) AS s, list_distinct({_SLOTS.format(chr(39).join(['p_brand || ', ' ', ' || p_type']))}) AS o FROM part), x AS (SELECT p.doc, p.p_partkey AS i, g.p_partkey AS j, len(list_intersect(p.s, g.s)) / (len(p.s) + len(g.s) - len(list_intersect(p.s, g.s))) AS a, len(list_intersect(p.o, g.o)) / (len(p.o) + len(g.o) - len(list_intersect(p.o, g.o))) AS b FROM t p JOIN t g ON p.doc = g.doc WHERE p.p_partkey % 2 = 0 AND g.p_partkey % 2 = 1) SELECT doc, i, j, (a + b) / 2 AS score FROM x WHERE a >= 0.5 AND b >= 0.3")
def independent_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subject and object of two triples of one document must each reach a bar."""
    t = table(spark, sf_dir, "part").select(C("p_size").alias("doc"), "p_partkey", blank_tokens(C("p_name")).alias("s"), blank_tokens(F.concat("p_brand", F.lit(" "), "p_type")).alias("o"))
    p, g = t.where("p_partkey % 2 = 0").withColumnRenamed("p_partkey", "i"), t.where("p_partkey % 2 = 1").withColumnRenamed("p_partkey", "j")
    return matchers.slot_pairs(p, g, 0.5, 0.3)


@query(rf"WITH t AS (SELECT p_partkey, unnest(list_filter(string_split_regex(lower(p_name || ' ' || p_type || ' ' || coalesce(p_brand, '')), '[^a-z0-9]+'), lambda x: x <> '')) AS w FROM part), s AS (SELECT DISTINCT p_partkey, {_STEM} AS stem FROM t) SELECT p_partkey, array_to_string(list_sort(list(stem)), ' ') AS bag FROM s GROUP BY 1")
def five_w_bag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stemmed words of an action's fields."""
    bag = extraction.bag_of_words([C("p_name"), C("p_type"), C("p_brand")])
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(F.array_sort(bag), " ").alias("bag"))


@query("SELECT event_id, event_type <> 'error' AND user_id % 4 <> 0 AND CASE WHEN event_type = 'view' THEN 1 ELSE 2 END > 1 AS keep FROM events")
def attack_vector_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Negated actions, the authors' own ones and those of a single argument go."""
    pairs = F.array(F.lit("V"), F.when(C("event_type") == "error", "ARGM-NEG").otherwise("ARGM-TMP"), F.lit("ARG0"), F.lit("ARG1"))
    values = F.array(F.lit("do"), F.lit("now"), F.when(C("user_id") % 4 == 0, "We").otherwise("it"), F.when(C("event_type") == "view", " ").otherwise(C("props")))
    roles = F.map_from_arrays(pairs, values)
    roles = F.map_filter(roles, lambda k, v: k != "ARGM-TMP")
    return table(spark, sf_dir, "events").select("event_id", extraction.attack_vector(roles).alias("keep"))


@query("SELECT event_id FROM events WHERE event_type IN ('click', 'view')")
def verb_dictionary_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps whose stemmed verb is in the stemmed verb list."""
    verbs = spark.createDataFrame([("clicking",), ("views",)], "verb string")
    return extraction.with_known_verb(table(spark, sf_dir, "events").withColumn("verb", F.concat("event_type", F.lit("ed"))), F.broadcast(verbs)).select("event_id")  # two rows


@query("WITH w AS (SELECT user_id AS doc, event_id AS ord, unnest([event_type, 's' || event_id % 3, 'x' || event_id]) AS word, unnest([0, 1, 2]) AS i FROM events), k AS (SELECT *, max(ord) OVER (PARTITION BY doc, word) AS last FROM w) SELECT doc, ord, string_agg(word, ' ' ORDER BY i) AS words FROM k WHERE ord = last GROUP BY doc, ord")
def extra_arguments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of a vector that a later one of the document has too go."""
    words = F.array(C("event_type"), _tag("s", C("event_id") % 3), _tag("x", C("event_id")))
    found = extraction.without_later_arguments(table(spark, sf_dir, "events").select(C("user_id").alias("doc"), C("event_id").alias("ord"), words.alias("words")))
    return found.select("doc", "ord", F.array_join("words", " ").alias("words"))


@query("SELECT event_id, CASE event_id % 4 WHEN 3 THEN '[]' ELSE '[' || event_id || ']' END AS triples FROM events")
def response_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers whose triples are under one of several keys."""
    key = F.element_at(F.array(*[F.lit(x) for x in ("tagged_triples", "triplets", "values", "other")]), (C("event_id") % 4 + 1).cast("int"))
    answer = F.concat(F.lit('{"'), key, F.lit('": ['), C("event_id").cast("string"), F.lit("]}"))
    return table(spark, sf_dir, "events").select("event_id", extraction.response_triples(answer).alias("triples"))


@query("WITH r AS (SELECT user_id AS entity, event_type || event_id AS text, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_type || event_id) AS r FROM events) SELECT entity, string_agg(text, ' | ' ORDER BY r) AS texts FROM r WHERE r <= 2 GROUP BY entity")
def evidence_top2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two best pieces of evidence of each entity."""
    return extraction.evidence_lines(table(spark, sf_dir, "events").select(C("user_id").alias("entity"), F.concat("event_type", C("event_id").cast("string")).alias("text"), C("value").alias("score")))


@query("WITH g AS (SELECT l_returnflag AS label, count(*) AS gold, count(*) FILTER (pred = l_returnflag) AS hit FROM (SELECT *, CASE WHEN l_partkey % 4 = 0 THEN 'N' ELSE l_returnflag END AS pred FROM lineitem) GROUP BY 1), p AS (SELECT CASE WHEN l_partkey % 4 = 0 THEN 'N' ELSE l_returnflag END AS label, count(*) AS pred FROM lineitem GROUP BY 1) SELECT label, coalesce(hit, 0) / nullif(pred, 0) AS precision, hit / nullif(gold, 0) AS recall FROM g FULL JOIN p USING (label)")
def per_label_prf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Precision and recall of each token label; null where a label has no predicted or no gold token."""
    t = table(spark, sf_dir, "lineitem").select(C("l_returnflag").alias("gold"), F.when(C("l_partkey") % 4 == 0, "N").otherwise(C("l_returnflag")).alias("pred"))
    cells = t.groupBy("gold", "pred").agg(F.count("*").alias("n"))
    sums = cells.select("n", "gold", "pred", F.explode(F.array_distinct(F.array("gold", "pred"))).alias("label")).groupBy("label").agg(
        F.sum(F.when((C("gold") == C("label")) & (C("pred") == C("label")), C("n")).otherwise(0)).alias("hit"),
        F.sum(F.when(C("pred") == C("label"), C("n"))).alias("predicted"),
        F.sum(F.when(C("gold") == C("label"), C("n"))).alias("wanted"),
    )
    return sums.select("label", F.try_divide("hit", "predicted").alias("precision"), F.try_divide("hit", "wanted").alias("recall"))


@query("SELECT page_id, translate(url, '!\"#$%&''()*+,-./:;<=>?@[\\]^_`{|}~', '') AS plain FROM pages")
def punctuation_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ASCII punctuation removed."""
    return table(spark, sf_dir, "pages").select("page_id", F.translate("url", "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~", "").alias("plain"))


@query(r"SELECT doc_id, unnest(list_filter(string_split(regexp_replace(replace(text, chr(9), ''), '\n+', chr(10), 'g'), chr(10)), lambda x: trim(x) <> '')) AS line FROM documents")
def sentence_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tabs out, runs of line ends as one, one row a line."""
    lines = F.split(F.regexp_replace(F.replace("text", F.lit("\t"), F.lit("")), r"\n+", "\n"), "\n")
    return table(spark, sf_dir, "documents").select("doc_id", F.explode(F.filter(lines, lambda x: F.trim(x) != "")).alias("line"))

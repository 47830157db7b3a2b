"""Predicates, small joins, rankings and folds of the extraction pipelines on driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.stem import RULES, stem
from ..functions.text import PRONOUNS, all_tokens, short_name
from .base import query, table

C = F.col


@query("SELECT l_orderkey, l_linenumber, CASE WHEN s IS NULL OR trim(s) = '' THEN 'subject' WHEN r IS NULL OR trim(r) = '' THEN 'relation' WHEN o IS NULL OR trim(o) = '' THEN 'object' ELSE 'valid' END AS verdict FROM (SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 1 THEN NULL ELSE l_returnflag END AS s, CASE WHEN l_quantity < 3 THEN '  ' ELSE l_linestatus END AS r, CASE WHEN l_quantity > 48 THEN '' ELSE 'x' END AS o FROM lineitem)")
def validate_triplets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a triple lacks; invalid ones are named, not dropped in silence."""
    t = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.when(C("l_linenumber") != 1, C("l_returnflag")).alias("s"), F.when(C("l_quantity") < 3, "  ").otherwise(C("l_linestatus")).alias("r"), F.when(C("l_quantity") > 48, "").otherwise("x").alias("o"))
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    return t.select("l_orderkey", "l_linenumber", F.when(blank("s"), "subject").when(blank("r"), "relation").when(blank("o"), "object").otherwise("valid").alias("verdict"))


@query("SELECT coalesce(nullif(lower(trim(CASE WHEN p_size % 5 = 0 THEN NULL ELSE ' ' || p_brand || ' ' END)), ''), 'none') AS ontology, count(*) AS n FROM part GROUP BY 1")
def ontology_lenient(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A missing ontology is ``none``."""
    named = F.when(C("p_size") % 5 != 0, F.concat(F.lit(" "), "p_brand", F.lit(" ")))
    return table(spark, sf_dir, "part").groupBy(F.coalesce(F.nullif(F.lower(F.trim(named)), F.lit("")), F.lit("none")).alias("ontology")).agg(F.count("*").alias("n"))


@query("SELECT doc_id, length(text) >= 120 AND NOT regexp_matches(text, '(^|\\n)[-*#]') AND len(list_filter(string_split_regex(text, '[.!?]'), lambda s: trim(s) <> '')) BETWEEN 3 AND 60 AS ok FROM documents")
def well_formed_paragraph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long enough, no bullets or headers, a plausible number of sentences."""
    n = F.size(F.filter(F.split("text", "[.!?]"), lambda s: F.trim(s) != ""))
    return table(spark, sf_dir, "documents").select("doc_id", ((F.length("text") >= 120) & ~C("text").rlike(r"(^|\n)[-*#]") & n.between(3, 60)).alias("ok"))


@query("SELECT page_id, regexp_matches(url, '^https?://[^ ]+$') AND NOT starts_with(url, 'https://') AS real_uri FROM pages")
def real_uri(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scheme, no blanks, and not of the instances' base."""
    return table(spark, sf_dir, "pages").select("page_id", (C("url").rlike("^https?://[^ ]+$") & ~C("url").startswith("https://")).alias("real_uri"))


@query("SELECT o_orderkey FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_orderstatus <> 'P' AND o_totalprice / 500000 >= 0.75")
def promote_qualifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Qualifiers that are worth a node, of an entity kind, with confidence of at least 0.75."""
    return table(spark, sf_dir, "orders").where(C("o_orderpriority").isin("1-URGENT", "2-HIGH") & (C("o_orderstatus") != "P") & (C("o_totalprice") / 500000 >= 0.75)).select("o_orderkey")


@query("SELECT doc_id, contains(lower(text), 'token') OR contains(lower(text), 'license') AS has_keyword FROM documents")
def keyword_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports with and without keywords."""
    low = F.lower("text")
    return table(spark, sf_dir, "documents").select("doc_id", (F.contains(low, F.lit("token")) | F.contains(low, F.lit("license"))).alias("has_keyword"))


@query("WITH m AS (SELECT *, max(CASE WHEN event_type = 'signup' THEN event_id END) OVER (PARTITION BY user_id) AS s, max(CASE WHEN event_type = 'purchase' THEN event_id END) OVER (PARTITION BY user_id) AS e FROM events) SELECT user_id, event_id FROM m WHERE event_id > s AND event_id < e")
def section_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows between the last start marker and the last end marker."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    last = lambda t: F.max(F.when(C("event_type") == t, C("event_id")))
    marks = e.groupBy("user_id").agg(last("signup").alias("s"), last("purchase").alias("e"))
    return e.join(marks, "user_id").where("event_id > s AND event_id < e").select("user_id", "event_id")


@query("SELECT event_id, CASE event_type WHEN 'click' THEN 'ACT' WHEN 'view' THEN 'ACT' WHEN 'error' THEN 'FAULT' ELSE 'O' END AS label FROM events")
def label_remap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of a set to shared labels; unknown ones become O."""
    shared = spark.createDataFrame([("click", "ACT"), ("view", "ACT"), ("error", "FAULT")], "event_type string, to string")
    return table(spark, sf_dir, "events").join(F.broadcast(shared), "event_type", "left").select("event_id", F.coalesce("to", F.lit("O")).alias("label"))  # shared: three rows


@query("WITH x AS (SELECT p_partkey, string_split(p_name, ' ') AS what, CASE WHEN p_size % 2 = 0 THEN ['a', 'b'] ELSE ['c'] END AS place FROM part) SELECT p_partkey, what[i] AS what, place[i] AS place FROM x, generate_series(1, 9) g(i) WHERE len(what) = len(place) AND i <= len(what) UNION ALL SELECT p_partkey, w, p FROM (SELECT p_partkey, unnest(what) AS w, place FROM x WHERE len(what) <> len(place)) y, unnest(y.place) u(p)")
def zip_or_cross(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists of equal length are paired by position, others crossed within the row."""
    x = table(spark, sf_dir, "part").select("p_partkey", F.split("p_name", " ").alias("what"), F.when(C("p_size") % 2 == 0, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array(F.lit("c"))).alias("place"))
    crossed = F.flatten(F.transform("what", lambda w: F.transform("place", lambda p: F.struct(w.alias("what"), p.alias("place")))))
    pairs = F.when(F.size("what") == F.size("place"), F.arrays_zip("what", "place")).otherwise(crossed)
    return x.select("p_partkey", F.explode(pairs).alias("x")).select("p_partkey", "x.*")


@query("WITH d AS (SELECT l_orderkey AS chunk, l_partkey AS name, min(l_linenumber) AS local_desc FROM lineitem GROUP BY 1, 2), g AS (SELECT l_partkey AS name, min(l_linenumber) AS any_desc FROM lineitem WHERE l_quantity > 25 GROUP BY 1) SELECT l.l_orderkey, l.l_linenumber, coalesce(CASE WHEN l.l_tax > 0.03 THEN d.local_desc END, g.any_desc, 0) AS description FROM lineitem l LEFT JOIN d ON d.chunk = l.l_orderkey AND d.name = l.l_partkey LEFT JOIN g ON g.name = l.l_partkey")
def description_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunk's own description first, then any, then a default."""
    li = table(spark, sf_dir, "lineitem")
    local = li.groupBy("l_orderkey", "l_partkey").agg(F.min("l_linenumber").alias("local_desc"))
    other = li.where("l_quantity > 25").groupBy("l_partkey").agg(F.min("l_linenumber").alias("any_desc"))
    rows = li.select("l_orderkey", "l_linenumber", "l_partkey", "l_tax").join(local, ["l_orderkey", "l_partkey"], "left").join(other, "l_partkey", "left")
    return rows.select("l_orderkey", "l_linenumber", F.coalesce(F.when(C("l_tax") > 0.03, C("local_desc")), "any_desc", F.lit(0)).alias("description"))


@query("SELECT o_orderpriority AS run, round(avg(n), 6) AS coverage FROM (SELECT o_orderpriority, o_custkey, count(DISTINCT o_orderstatus) AS n FROM orders GROUP BY 1, 2) GROUP BY 1")
def schema_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean number of distinct classes per sample."""
    per = table(spark, sf_dir, "orders").groupBy("o_orderpriority", "o_custkey").agg(F.count_distinct("o_orderstatus").alias("n"))
    return per.groupBy(C("o_orderpriority").alias("run")).agg(F.round(F.avg("n"), 6).alias("coverage"))


@query("SELECT c_mktsegment AS run, count(*) AS predicted, count(n_nationkey) AS valid, round(count(n_nationkey)::DOUBLE / count(*), 6) AS rate FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_regionkey < 3) ON c_nationkey = n_nationkey GROUP BY 1")
def validity_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of predicted classes that the ontology knows."""
    known = table(spark, sf_dir, "nation").where("n_regionkey < 3").select(C("n_nationkey").alias("c_nationkey"), F.lit(1).alias("known"))
    rows = table(spark, sf_dir, "customer").join(F.broadcast(known), "c_nationkey", "left")  # known: 25 rows at most
    return rows.groupBy(C("c_mktsegment").alias("run")).agg(F.count("*").alias("predicted"), F.count("known").alias("valid"), F.round(F.count("known") / F.count("*"), 6).alias("rate"))


@query("SELECT source, arg_min(lang, (-n, lang)) AS lang FROM (SELECT source, lang, count(*) AS n FROM documents GROUP BY 1, 2) GROUP BY 1")
def most_frequent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most frequent language of a source, the first by name of ties."""
    n = table(spark, sf_dir, "documents").groupBy("source", "lang").agg(F.count("*").alias("n"))
    return n.groupBy("source").agg(F.min_by("lang", F.struct(-C("n"), C("lang"))).alias("lang"))


_STEM = "CASE " + " ".join(f"WHEN ends_with(w, '{s}') AND length(w) >= {least + len(s)}" + (" AND NOT ends_with(w, 'ss')" if s == "s" else "") + f" THEN left(w, length(w) - {len(s)}) || '{to}'" for s, to, least in RULES) + " ELSE w END"


@query(rf"WITH t AS (SELECT item_id, unnest(list_filter(string_split(trim(regexp_replace(lower(text), '[^\p{{L}}\p{{N}}_]+', ' ', 'g')), ' '), lambda t: t <> '')) AS w FROM benchmark) SELECT {_STEM} AS stem, count(*) AS n, max(w) AS raw FROM t GROUP BY 1")
def distinct_by_stem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects that share a stem are one; the last raw form stands for them."""
    w = table(spark, sf_dir, "benchmark").select(F.explode(all_tokens(C("text"))).alias("w"))
    return w.groupBy(stem(C("w")).alias("stem")).agg(F.count("*").alias("n"), F.max("w").alias("raw"))


@query("SELECT user_id, event_id, CASE WHEN event_type = 'view' AND lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) IS DISTINCT FROM 'view' THEN 'B' WHEN event_type = 'view' THEN 'I' ELSE 'O' END AS tag FROM events")
def bio_fixup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B or I from the tag before."""
    before = F.lag("event_type").over(Window.partitionBy("user_id").orderBy("event_id"))
    same = F.coalesce(before == "view", F.lit(False))
    return table(spark, sf_dir, "events").select("user_id", "event_id", F.when((C("event_type") == "view") & ~same, "B").when(C("event_type") == "view", "I").otherwise("O").alias("tag"))


@query("WITH r AS (SELECT l_orderkey, l_partkey, l_discount AS score, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_discount DESC, l_linenumber, l_partkey) AS rn FROM lineitem) SELECT l_orderkey, CASE WHEN score >= 0.05 THEN l_partkey::VARCHAR ELSE '_' END AS best FROM r WHERE rn = 1")
def best_match_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best candidate, or a placeholder below the bar."""
    best = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.min_by(F.struct("l_partkey", "l_discount"), F.struct(-C("l_discount"), C("l_linenumber"), C("l_partkey"))).alias("x"))
    return best.select("l_orderkey", F.when(C("x.l_discount") >= 0.05, C("x.l_partkey").cast("string")).otherwise("_").alias("best"))


@query("SELECT p_brand AS key, row_number() OVER (ORDER BY CASE WHEN p_brand LIKE 'Brand#1%' THEN 0 WHEN p_brand LIKE 'Brand#2%' THEN 1 ELSE 2 END, p_brand) AS pos FROM (SELECT DISTINCT p_brand FROM part)")
def report_key_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs by the rank of their model, then by name; the table is one row per run."""
    keys = table(spark, sf_dir, "part").select(C("p_brand").alias("key")).distinct()
    rank = F.when(C("key").startswith("Brand#1"), 0).when(C("key").startswith("Brand#2"), 1).otherwise(2)
    return keys.withColumn("pos", F.row_number().over(Window.orderBy(rank, "key")).cast("bigint"))


@query("SELECT p_brand AS label FROM part WHERE p_size < 10 INTERSECT SELECT p_brand FROM part WHERE p_size > 45")
def unseen_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels that two splits share."""
    p = table(spark, sf_dir, "part")
    return p.where("p_size < 10").select(C("p_brand").alias("label")).intersect(p.where("p_size > 45").select("p_brand"))


@query("SELECT DISTINCT trim(x) AS value FROM (SELECT unnest(string_split(replace(p_type || '/' || p_name || '-x', '-', ' '), '/')) AS x FROM part)")
def distinct_exploded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of a column that holds lists as text."""
    x = F.explode(F.split(F.translate(F.concat("p_type", F.lit("/"), "p_name", F.lit("-x")), "-", " "), "/"))
    return table(spark, sf_dir, "part").select(x.alias("value")).select(F.trim("value").alias("value")).distinct()


_PRON = ", ".join(f"'{p}'" for p in PRONOUNS)


@query(f"WITH w AS (SELECT doc_id, unnest(string_split(text, ' ')) AS w, generate_subscripts(string_split(text, ' '), 1) AS n FROM documents) SELECT doc_id, md5(string_agg(CASE WHEN lower(w) IN ({_PRON}) THEN 'E' || doc_id ELSE w END, ' ' ORDER BY n)) AS h, count(*) FILTER (lower(w) IN ({_PRON})) AS replaced FROM w GROUP BY doc_id")
def pronoun_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pronouns replaced by the entity they stand for (here one per document)."""
    words = F.split("text", " ")
    put = F.transform(words, lambda w: F.when(F.lower(w).isin(*PRONOUNS), F.concat(F.lit("E"), "doc_id")).otherwise(w))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(F.array_join(put, " ")).alias("h"), F.size(F.filter(words, lambda w: F.lower(w).isin(*PRONOUNS))).cast("bigint").alias("replaced"))


@query("SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN p_type || ':' || replace(p_name, ' ', '') ELSE p_brand END AS short FROM part")
def short_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    uri = F.when(C("p_size") % 2 == 0, F.concat(F.lit("http://x.org/"), "p_type", F.lit("/"), F.replace("p_name", F.lit(" "), F.lit("")))).otherwise(F.concat(F.lit("http://x.org/o#"), F.replace("p_brand", F.lit("#"), F.lit("~"))))
    return table(spark, sf_dir, "part").select("p_partkey", F.replace(short_name(uri), F.lit("~"), F.lit("#")).alias("short"))


@query("SELECT s_suppkey, s_name, n_name, 's' || s_suppkey || '-' || n_nationkey AS component FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_regionkey <> 2")
def instance_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Instances as (s, p, o) rows: entities created, a property set, a component attached, some removed again."""
    s = table(spark, sf_dir, "supplier").join(F.broadcast(table(spark, sf_dir, "nation")), C("s_nationkey") == C("n_nationkey"))  # nation: 25 rows
    name = s.select("s_suppkey", F.lit("name").alias("p"), C("s_name").alias("o"))
    located = s.select("s_suppkey", F.lit("in"), "n_name")
    attached = s.select("s_suppkey", F.lit("component"), F.concat(F.lit("s"), "s_suppkey", F.lit("-"), "n_nationkey"))
    rows = name.union(located).union(attached)
    gone = s.where("n_regionkey = 2").select("s_suppkey")
    left = rows.join(gone, "s_suppkey", "left_anti")
    one = lambda p: F.max(F.when(C("p") == p, C("o")))
    return left.groupBy("s_suppkey").agg(one("name").alias("s_name"), one("in").alias("n_name"), one("component").alias("component"))


@query("SELECT lower(p_brand) AS id, string_agg(DISTINCT p_type, '; ' ORDER BY p_type) AS tactics, min(p_name) AS technique FROM part GROUP BY 1")
def technique_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Technique ids with their tactics joined."""
    return table(spark, sf_dir, "part").groupBy(F.lower("p_brand").alias("id")).agg(F.array_join(F.array_sort(F.collect_set("p_type")), "; ").alias("tactics"), F.min("p_name").alias("technique"))


@query("SELECT l_orderkey, count(*) AS n, count(DISTINCT (l_partkey, l_linenumber, l_returnflag)) AS kept FROM lineitem GROUP BY 1")
def evidence_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal evidence counts once."""
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.count_distinct("l_partkey", "l_linenumber", "l_returnflag").alias("kept"))


@query("WITH q AS (SELECT * FROM embeddings WHERE vec_id % 100 = 0), s AS (SELECT q.vec_id AS a, e.vec_id AS b, list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]) + CASE e.vec_id % 3 WHEN 0 THEN 0.1 WHEN 1 THEN -0.05 ELSE 0 END + CASE WHEN e.vec_id % 2 = 0 THEN 0.2 ELSE 0 END AS score FROM q JOIN embeddings e ON q.label = e.label AND q.vec_id <> e.vec_id), r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY round(score, 6) DESC, b) AS rank FROM s) SELECT a, b, rank FROM r WHERE rank <= 5")
def recommend_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Similarity with the bonuses of the recommenders: direct +0.1, inverse -0.05, fitting datatype +0.2; five best."""
    from ..operators import search

    e = table(spark, sf_dir, "embeddings")
    pairs = search.vector_pairs(e.where("vec_id % 100 = 0"), e, "label", -2.0)
    bonus = F.when(C("b") % 3 == 0, 0.1).when(C("b") % 3 == 1, -0.05).otherwise(0.0)
    score = C("score") + bonus + F.when(C("b") % 2 == 0, 0.2).otherwise(0.0)
    return search.top(pairs.withColumn("score", score), 5, ["a"], F.desc(F.round("score", 6)), C("b")).select("a", "b", "rank")


@query(r"WITH x AS (SELECT doc_id, unnest(regexp_extract_all(text, '[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}')) AS v FROM documents) SELECT doc_id, v AS value, count(*) AS n FROM x GROUP BY ALL")
def indicator_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses with their code-point spans, checked to read back, and counted."""
    pattern = r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}"
    d = table(spark, sf_dir, "documents").select("doc_id", "text", F.regexp_extract_all("text", F.lit(pattern), F.lit(0)).alias("m"), F.split("text", pattern, -1).alias("parts")).where(F.size("m") > 0)
    step = lambda acc, x: F.struct((acc["at"] + F.length(x["part"]) + F.length(x["m"])).alias("at"), F.concat(acc["out"], F.array(F.struct((acc["at"] + F.length(x["part"])).alias("start"), x["m"].alias("value")))).alias("out"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,value:string>>").alias("out"))
    spans = F.aggregate(F.arrays_zip(F.slice("parts", 1, F.size("m")).alias("part"), C("m").alias("m")), start, step, lambda acc: acc["out"])
    rows = d.select("doc_id", "text", F.explode(spans).alias("x")).where(F.substring("text", C("x.start") + 1, F.length("x.value")) == C("x.value"))
    return rows.groupBy("doc_id", C("x.value").alias("value")).agg(F.count("*").alias("n"))

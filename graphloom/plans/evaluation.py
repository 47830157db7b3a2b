"""Matching and metrics on driver tables.

Analogue of prediction files: in a conversation (the document), assistant turns are predictions and user turns
are gold, both numbered by turn; ``documents`` and ``labels`` stand for labelled rows of several runs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.similarity import jaccard
from ..functions.text import tokens
from ..operators import matching, metrics, ranks
from .base import query, table

#: Turns share few words, so the bars lie below those of entity names (0.2).
THRESHOLD, JUDGED = 0.06, 0.04

TOKENS_SQL = r"list_distinct(list_filter(string_split(trim(regexp_replace(lower({0}), '[^\p{{L}}\p{{N}}_]+', ' ', 'g')), ' '), lambda t: t <> ''))"
_CAND = rf"""
turns AS (SELECT conv_id, turn, role, {TOKENS_SQL.format("text")} AS tok FROM conversations),
cand AS (
  SELECT p.conv_id, p.turn AS i, g.turn AS j,
         CASE WHEN len(p.tok) + len(g.tok) = 0 THEN 1.0::DOUBLE
              ELSE len(list_intersect(p.tok, g.tok))::DOUBLE / (len(p.tok) + len(g.tok) - len(list_intersect(p.tok, g.tok))) END AS score
  FROM turns p JOIN turns g ON p.conv_id = g.conv_id WHERE p.role = 'assistant' AND g.role = 'user'
)"""


def _fold_sql(order: str) -> str:
    return rf"""
WITH RECURSIVE {_CAND.strip()},
ranked AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY {order}) AS rk FROM cand WHERE score >= {THRESHOLD}),
walk AS (
  SELECT conv_id, rk, i, j, score, true AS took, [i] AS ui, [j] AS uj FROM ranked WHERE rk = 1
  UNION ALL
  SELECT r.conv_id, r.rk, r.i, r.j, r.score, NOT (list_contains(ui, r.i) OR list_contains(uj, r.j)),
         CASE WHEN list_contains(ui, r.i) OR list_contains(uj, r.j) THEN ui ELSE list_append(ui, r.i) END,
         CASE WHEN list_contains(ui, r.i) OR list_contains(uj, r.j) THEN uj ELSE list_append(uj, r.j) END
  FROM walk w JOIN ranked r ON r.conv_id = w.conv_id AND r.rk = w.rk + 1
),
pairs AS (SELECT conv_id, i, j, score FROM walk WHERE took)"""


_GREEDY = _fold_sql("score DESC, i, j")
_FIRST = _fold_sql("i, j")


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", tokens(F.col("text")).alias("tok"))


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _turns(spark, sf_dir)
    p = t.where("role = 'assistant'").select("conv_id", F.col("turn").alias("i"), F.col("tok").alias("a"))
    g = t.where("role = 'user'").select("conv_id", F.col("turn").alias("j"), F.col("tok").alias("b"))
    return p.join(g, "conv_id").select("conv_id", "i", "j", jaccard(F.col("a"), F.col("b")).alias("score"))


def _samples(spark: SparkSession, sf_dir: str, pairs: DataFrame) -> DataFrame:
    spine = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count_if(F.col("role") == "assistant").alias("predicted"), F.count_if(F.col("role") == "user").alias("gold"))
    hits = pairs.groupBy("conv_id").agg(F.count("*").alias("tp"))
    return spine.join(hits, "conv_id", "left").withColumn("tp", F.coalesce("tp", F.lit(0)))


_SPINE = "spine AS (SELECT conv_id, count(*) FILTER (role = 'assistant') AS predicted, count(*) FILTER (role = 'user') AS gold FROM conversations GROUP BY conv_id),\nsamples AS (SELECT s.*, coalesce(h.tp, 0) AS tp FROM spine s LEFT JOIN (SELECT conv_id, count(*) AS tp FROM pairs GROUP BY conv_id) h USING (conv_id))"
_R = "CASE WHEN {1} = 0 THEN 0 ELSE {0}::DOUBLE / {1} END"


@query(_GREEDY + "," + _SPINE + ", m AS (SELECT sum(tp)::BIGINT AS tp, sum(predicted)::BIGINT AS predicted, sum(gold)::BIGINT AS gold FROM samples), pr AS (SELECT *, " + _R.format("tp", "predicted") + " AS precision, " + _R.format("tp", "gold") + " AS recall FROM m) SELECT tp, predicted, gold, predicted - tp AS fp, gold - tp AS fn, round(precision, 6) AS precision, round(recall, 6) AS recall, round(CASE WHEN precision + recall = 0 THEN 0 ELSE 2 * precision * recall / (precision + recall) END, 6) AS f1 FROM pr")
def jaccard_prf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token-Jaccard candidates, greedy one-to-one matches, micro precision, recall and F1."""
    pairs = matching.greedy(_candidates(spark, sf_dir), "conv_id", THRESHOLD)
    return _round(metrics.micro(_samples(spark, sf_dir, pairs)))


def _round(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f1")})


@query(_GREEDY + " SELECT conv_id, i, j, score FROM pairs")
def greedy_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.greedy(_candidates(spark, sf_dir), "conv_id", THRESHOLD)


@query(_FIRST + " SELECT conv_id, i, j, score FROM pairs")
def first_fit_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.first_fit(_candidates(spark, sf_dir), "conv_id", THRESHOLD)


@query(f"WITH {_CAND} SELECT conv_id, i, j, score FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, j ORDER BY score DESC, i) AS rn FROM cand WHERE score >= {THRESHOLD}) WHERE rn = 1")
def gold_only_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.gold_only(_candidates(spark, sf_dir), "conv_id", THRESHOLD)


@query(_GREEDY + " SELECT conv_id, turn AS j FROM conversations c WHERE role = 'user' AND NOT EXISTS (SELECT 1 FROM pairs p WHERE p.conv_id = c.conv_id AND p.j = c.turn)")
def missed_gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    gold = table(spark, sf_dir, "conversations").where("role = 'user'").select("conv_id", F.col("turn").alias("j"))
    return matching.missed(gold, matching.greedy(_candidates(spark, sf_dir), "conv_id", THRESHOLD), "conv_id")


@query(_GREEDY + ", judged AS (SELECT conv_id, i, min(j) AS j FROM cand WHERE score >= 0.04 GROUP BY conv_id, i) SELECT conv_id, i, j, 'similarity' AS origin FROM pairs UNION ALL SELECT conv_id, i, j, 'judge' FROM judged q WHERE NOT EXISTS (SELECT 1 FROM pairs p WHERE p.conv_id = q.conv_id AND p.i = q.i)")
def hitl_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Review list: greedy pairs plus a (rule) judge's pairs for predictions without one."""
    cand = _candidates(spark, sf_dir)
    judged = cand.where(F.col("score") >= JUDGED).groupBy("conv_id", "i").agg(F.min("j").alias("j")).withColumn("score", F.lit(None).cast("double"))
    return matching.review_candidates(cand, judged, "conv_id", THRESHOLD).select("conv_id", "i", "j", "origin")


@query(_GREEDY + f", judged AS (SELECT conv_id, i, min(j) AS jj FROM cand WHERE score >= 0.04 GROUP BY conv_id, i) SELECT c.conv_id, c.turn AS i, p.j AS matched, p.j IS NOT NULL AS by_similarity, q.jj IS NOT NULL AS by_judge, (p.j IS NOT NULL) <> (q.jj IS NOT NULL) AS disagree FROM conversations c LEFT JOIN pairs p ON p.conv_id = c.conv_id AND p.i = c.turn LEFT JOIN judged q ON q.conv_id = c.conv_id AND q.i = c.turn WHERE c.role = 'assistant'")
def match_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per prediction: what each method found, and whether they disagree."""
    cand = _candidates(spark, sf_dir)
    own = matching.greedy(cand, "conv_id", THRESHOLD).select("conv_id", "i", F.col("j").alias("matched"))
    judged = cand.where(F.col("score") >= JUDGED).select("conv_id", "i").distinct().withColumn("yes", F.lit(True))
    preds = table(spark, sf_dir, "conversations").where("role = 'assistant'").select("conv_id", F.col("turn").alias("i"))
    out = preds.join(own, ["conv_id", "i"], "left").join(judged, ["conv_id", "i"], "left")
    a, b = F.col("matched").isNotNull(), F.col("yes").isNotNull()
    return out.select("conv_id", "i", "matched", a.alias("by_similarity"), b.alias("by_judge"), (a != b).alias("disagree"))


@query("WITH r AS (SELECT conv_id, turn, 1 + turn % 3 AS pred, CASE WHEN turn % 4 = 3 THEN 9 ELSE 1 + turn % 2 END AS gold FROM conversations), n AS (SELECT conv_id, count(*) AS n FROM conversations GROUP BY conv_id) SELECT DISTINCT r.conv_id, (pred - 1)::INT AS i, (gold - 1)::INT AS j FROM r JOIN n USING (conv_id) WHERE pred BETWEEN 1 AND n AND gold BETWEEN 1 AND n")
def judge_pairs_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers written as text with JSON inside, parsed back into pairs."""
    item = F.concat(F.lit('{"pred": '), (1 + F.col("turn") % 3).cast("string"), F.lit(', "gold": '), F.when(F.col("turn") % 4 == 3, 9).otherwise(1 + F.col("turn") % 2).cast("string"), F.lit("}"))
    said = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.concat(F.lit("Pairs: ["), F.array_join(F.collect_list(item), ", "), F.lit("] done [x]")).alias("response"), F.count("*").cast("int").alias("n"))
    return matching.judged_pairs(said.withColumn("m", F.col("n")), "conv_id", "n", "m")


@query("SELECT o_orderkey, l_linenumber, trim(c_name || ' [SEP] ' || p_name) AS soft, trim(c_name || ' [SEP] ' || l_returnflag || ' [SEP] ' || p_name) AS full_text FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN part ON l_partkey = p_partkey")
def soft_full_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(customer, return flag, part) as subject, relation and object."""
    t = lambda n: table(spark, sf_dir, n)
    rows = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("part"), F.col("l_partkey") == F.col("p_partkey"))
    s, o, r = F.col("c_name"), F.col("p_name"), F.col("l_returnflag")
    return rows.select("o_orderkey", "l_linenumber", matching.triple_text(s, o).alias("soft"), matching.triple_text(s, o, r).alias("full_text"))


# ---- labelled documents: gold = toxic, predictions = rules on length --------------------------------------

_L = "l AS (SELECT d.doc_id, d.lang, d.source, d.n_chars, toxic, quality FROM documents d JOIN labels USING (doc_id))"
_PRF = "round(CASE WHEN predicted = 0 THEN 0 ELSE tp::DOUBLE / predicted END, {0}) AS precision, round(CASE WHEN gold = 0 THEN 0 ELSE tp::DOUBLE / gold END, {0}) AS recall, round(CASE WHEN predicted + gold = 0 THEN 0 ELSE 2 * tp::DOUBLE / (predicted + gold) END, {0}) AS f1"
_BY = "SELECT {0}, count(*) FILTER (toxic = 1 AND n_chars > 2000) AS tp, count(*) FILTER (n_chars > 2000) AS predicted, count(*) FILTER (toxic = 1) AS gold FROM l GROUP BY {0}"


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id")


def _counts(df: DataFrame, *keys: str) -> DataFrame:
    yes, said = F.col("toxic") == 1, F.col("n_chars") > 2000
    return df.groupBy(*keys).agg(F.count_if(yes & said).alias("tp"), F.count_if(said).alias("predicted"), F.count_if(yes).alias("gold"))


@query(f"WITH {_L}, c AS ({_BY.format('lang')}) SELECT lang, tp, predicted, gold, predicted - tp AS fp, gold - tp AS fn, {_PRF.format(6)} FROM c")
def prf_micro(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(metrics.micro(_counts(_labelled(spark, sf_dir), "lang", "source"), "lang"))


@query(f"WITH {_L}, c AS ({_BY.format('lang, source')}), p AS (SELECT *, {_PRF.format(4)} FROM c) SELECT lang, round(avg(precision), 3) AS precision, round(avg(recall), 3) AS recall, count(*) AS samples FROM p GROUP BY lang")
def prf_macro(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means over sources; three digits, since the engines round halves apart."""
    out = metrics.macro(_counts(_labelled(spark, sf_dir), "lang", "source"), "lang", digits=4)
    return out.select("lang", F.round("precision", 3).alias("precision"), F.round("recall", 3).alias("recall"), "samples")


@query(f"WITH {_L}, c AS ({_BY.format('source')}), s AS (SELECT DISTINCT source FROM documents) SELECT source, coalesce(tp, 0) AS tp, coalesce(predicted, 0) AS predicted, coalesce(gold, 0) AS gold FROM s LEFT JOIN (SELECT * FROM c WHERE gold > 3) c USING (source)")
def prf_zero_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document without predictions or gold keeps zeros."""
    spine = table(spark, sf_dir, "documents").select("source").distinct()
    return metrics.on_spine(spine, _counts(_labelled(spark, sf_dir), "source").where("gold > 3"), "source")


_RUNS = "runs AS (SELECT lang, k.run, count(*) FILTER (toxic = 1 AND n_chars > cut) AS tp, count(*) FILTER (n_chars > cut) AS predicted, count(*) FILTER (toxic = 1) AS gold FROM l, (VALUES ('short', 500), ('middle', 2000), ('long', 6000)) k(run, cut) GROUP BY lang, k.run)"


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    cuts = F.array(*[F.struct(F.lit(r).alias("run"), F.lit(c).alias("cut")) for r, c in (("short", 500), ("middle", 2000), ("long", 6000))])
    df = _labelled(spark, sf_dir).select("lang", "toxic", "n_chars", F.explode(cuts).alias("k"))
    yes, said = F.col("toxic") == 1, F.col("n_chars") > F.col("k.cut")
    return df.groupBy("lang", F.col("k.run").alias("run")).agg(F.count_if(yes & said).alias("tp"), F.count_if(said).alias("predicted"), F.count_if(yes).alias("gold"))


@query(f"WITH {_L}, {_RUNS}, p AS (SELECT lang, run, {_PRF.format(6)} FROM runs) SELECT lang, max(precision) AS best_precision, min_by(run, (-precision, run)) AS best_precision_key, max(recall) AS best_recall, min_by(run, (-recall, run)) AS best_recall_key FROM p GROUP BY lang")
def compare_best_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several runs per schema (language): the best value of each metric and the run that has it."""
    return metrics.best_by(_round(metrics.with_prf(_runs(spark, sf_dir))), "lang", "run", ["precision", "recall"])


@query(f"WITH {_L}, {_RUNS} SELECT lang, run, grouping(lang, run)::BIGINT AS level, sum(tp)::BIGINT AS tp, sum(predicted)::BIGINT AS predicted, sum(gold)::BIGINT AS gold FROM runs GROUP BY ROLLUP (lang, run)")
def rollup_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs, schema subtotals and the total in one pass."""
    return _runs(spark, sf_dir).rollup("lang", "run").agg(F.grouping_id().alias("level"), *[F.sum(c).alias(c) for c in ("tp", "predicted", "gold")])


@query(f"WITH {_L}, {_RUNS} SELECT lang, max(tp) FILTER (run = 'short') AS short, max(tp) FILTER (run = 'middle') AS middle, max(tp) FILTER (run = 'long') AS long FROM runs GROUP BY lang")
def task_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _runs(spark, sf_dir).groupBy("lang").pivot("run", ["short", "middle", "long"]).agg(F.max("tp"))


@query(f"WITH {_L}, x AS (SELECT lang, toxic AS gold_label, CASE WHEN n_chars > 4000 THEN 2 WHEN n_chars > 2000 THEN 1 ELSE 0 END AS guess, toxic + quality AS label FROM l), c AS (SELECT lang, count(*) FILTER (guess > 0 AND guess = label) AS tp, count(*) FILTER (guess > 0) AS predicted, count(*) FILTER (label > 0) AS gold FROM x GROUP BY lang) SELECT lang, tp, predicted, gold, round(CASE WHEN predicted = 0 THEN 1.0 ELSE tp::DOUBLE / predicted END, 6) AS precision, round(CASE WHEN gold = 0 THEN 0 ELSE tp::DOUBLE / gold END, 6) AS recall FROM c")
def re_micro_prf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label 0 is no relation; precision is 1 when nothing was guessed."""
    df = _labelled(spark, sf_dir).withColumns({"guess": F.when(F.col("n_chars") > 4000, 2).when(F.col("n_chars") > 2000, 1).otherwise(0), "label": F.col("toxic") + F.col("quality")})
    counts = df.groupBy("lang").agg(F.count_if((F.col("guess") > 0) & (F.col("guess") == F.col("label"))).alias("tp"), F.count_if(F.col("guess") > 0).alias("predicted"), F.count_if(F.col("label") > 0).alias("gold"))
    return _round(metrics.with_prf(counts, none=1.0)).drop("f1")


@query(f"WITH {_L} SELECT toxic + quality AS label, count(*) FILTER (n_chars <= 2000) AS guess_0, count(*) FILTER (n_chars > 2000 AND n_chars <= 4000) AS guess_1, count(*) FILTER (n_chars > 4000) AS guess_2 FROM l GROUP BY 1")
def confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _labelled(spark, sf_dir).select((F.col("toxic") + F.col("quality")).alias("label"), F.when(F.col("n_chars") > 4000, "guess_2").when(F.col("n_chars") > 2000, "guess_1").otherwise("guess_0").alias("guess"))
    return df.groupBy("label").pivot("guess", ["guess_0", "guess_1", "guess_2"]).count().na.fill(0)


@query("SELECT l_returnflag AS label, count(*) AS n, count(*) FILTER (l_linestatus = 'F') AS correct, round(count(*) FILTER (l_linestatus = 'F')::DOUBLE / count(*), 6) AS accuracy FROM lineitem GROUP BY 1")
def label_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    ok = F.count_if(F.col("l_linestatus") == "F")
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("label")).agg(F.count("*").alias("n"), ok.alias("correct"), F.round(ok / F.count("*"), 6).alias("accuracy"))


@query("WITH x AS (SELECT p_type, CASE WHEN p_size % 4 = 0 THEN '' ELSE p_brand END AS predicted_type, CASE WHEN p_size % 7 = 0 THEN '' ELSE p_brand END AS gold_type FROM part) SELECT p_type, count(*) FILTER (predicted_type <> '' AND gold_type <> '') AS eligible, count(*) FILTER (predicted_type = '' AND gold_type <> '') AS untyped, round(CASE WHEN count(*) FILTER (gold_type <> '') = 0 THEN 0 ELSE count(*) FILTER (predicted_type <> '' AND gold_type <> '')::DOUBLE / count(*) FILTER (gold_type <> '') END, 6) AS coverage FROM x GROUP BY p_type")
def typing_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "part").select("p_type", (F.col("p_size") % 4 != 0).alias("p"), (F.col("p_size") % 7 != 0).alias("g"))
    e, u = F.count_if(F.col("p") & F.col("g")), F.count_if(~F.col("p") & F.col("g"))
    return x.groupBy("p_type").agg(e.alias("eligible"), u.alias("untyped")).withColumn("coverage", F.round(metrics.ratio(F.col("eligible"), F.col("eligible") + F.col("untyped")), 6))


@query("SELECT event_type AS model, count(*) AS calls, sum(json_extract(props, '$.k')::BIGINT)::BIGINT AS input_tokens, round(sum(json_extract(props, '$.k')::BIGINT)::DOUBLE * 0.25, 4) AS cost FROM events GROUP BY 1")
def usage_cost_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_type", F.get_json_object("props", "$.k").cast("bigint").alias("k"))
    return e.groupBy(F.col("event_type").alias("model")).agg(F.count("*").alias("calls"), F.sum("k").alias("input_tokens"), F.round(F.sum("k") * F.lit(0.25), 4).alias("cost"))


# ---- samples ------------------------------------------------------------------------------------------------


@query("WITH c AS (SELECT toxic, count(*) AS n FROM labels GROUP BY toxic), r AS (SELECT *, row_number() OVER (PARTITION BY toxic ORDER BY md5(doc_id::VARCHAR), doc_id) AS rn FROM labels) SELECT doc_id, toxic FROM r WHERE rn <= (SELECT min(n) FROM c)")
def class_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every class cut to the size of the smallest, in hash order."""
    ranked = ranks.numbered_within(table(spark, sf_dir, "labels"), "toxic", F.md5(F.col("doc_id").cast("string")), F.col("doc_id"))
    least = ranked.agg(F.min("n").alias("least"))
    return ranked.crossJoin(F.broadcast(least)).where("rank <= least").select("doc_id", "toxic")  # least: one row


@query("WITH r AS (SELECT *, row_number() OVER (PARTITION BY toxic ORDER BY md5(doc_id::VARCHAR), doc_id) AS rn, count(*) OVER (PARTITION BY toxic) AS n FROM labels) SELECT doc_id, toxic FROM r WHERE rn <= floor(n * 0.25)")
def stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quarter of each label."""
    ranked = ranks.numbered_within(table(spark, sf_dir, "labels"), "toxic", F.md5(F.col("doc_id").cast("string")), F.col("doc_id"))
    return ranked.where("rank <= floor(n * 0.25)").select("doc_id", "toxic")


@query("SELECT item_id FROM benchmark ORDER BY md5(item_id::VARCHAR || '7'), item_id LIMIT 5")
def random_demos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five demonstrations in seeded hash order."""
    return table(spark, sf_dir, "benchmark").orderBy(F.md5(F.concat(F.col("item_id").cast("string"), F.lit("7"))), "item_id").limit(5).select("item_id")


@query("WITH r AS (SELECT vec_id, label, abs(embedding[1])::DOUBLE AS conf, row_number() OVER (ORDER BY abs(embedding[1]) DESC, vec_id) AS rn FROM embeddings) SELECT vec_id, label, conf FROM r WHERE rn <= (SELECT floor(count(*) * 0.1) FROM embeddings)")
def top_z_pseudo_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most confident tenth keeps its label."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.abs(F.element_at("embedding", 1)).cast("double").alias("conf"))
    return ranks.numbered(e, F.desc("conf"), F.col("vec_id")).where(F.col("rank") <= e.count() // 10).drop("rank")

"""Chunks, spans and other ordered operators on driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import all_tokens
from ..operators import metrics, sequences
from .base import query, table


@query("WITH RECURSIVE l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents), walk AS (SELECT doc_id, n, 1 AS chunk, strlen(line) AS size FROM l WHERE n = 1 UNION ALL SELECT l.doc_id, l.n, CASE WHEN w.size + 1 + strlen(l.line) <= 1000 THEN w.chunk ELSE w.chunk + 1 END, CASE WHEN w.size + 1 + strlen(l.line) <= 1000 THEN w.size + 1 + strlen(l.line) ELSE strlen(l.line) END FROM walk w JOIN l ON l.doc_id = w.doc_id AND l.n = w.n + 1) SELECT doc_id, chunk::INT AS chunk, max(size)::INT AS bytes FROM walk GROUP BY 1, 2")
def chunk_by_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines packed greedily into chunks of at most 1000 bytes; longer lines stay whole."""
    d = table(spark, sf_dir, "documents").select("doc_id", sequences.pack_parts(F.split("text", "\n"), 1000).alias("chunks"))
    return d.select("doc_id", F.posexplode("chunks").alias("p", "c")).select("doc_id", (F.col("p") + 1).alias("chunk"), F.octet_length("c").alias("bytes"))


@query("WITH w AS (SELECT doc_id, length(text) AS n, unnest(range(0, greatest(0, length(text) - 400 - 1) + 1, 3600)) AS s FROM documents) SELECT doc_id, count(*) AS pieces, sum(least(4000, n - s))::BIGINT AS chars FROM w GROUP BY 1")
def overlapping_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of 4000 characters that overlap by 400."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.explode(sequences.overlapping_windows(F.col("text"), 4000, 400)).alias("x"))
    return d.groupBy("doc_id").agg(F.count("*").alias("pieces"), F.sum(F.length("x")).alias("chars"))


_ISLANDS = "WITH r AS (SELECT *, row_number() OVER (PARTITION BY {k} ORDER BY {p}) - row_number() OVER (PARTITION BY {k}, {v} ORDER BY {p}) AS island FROM {t}) SELECT {k}, {v} AS kind, min({p}) AS start, max({p}) + 1 AS stop FROM r GROUP BY {k}, {v}, island"


@query(_ISLANDS.format(k="user_id", p="event_id", v="event_type", t="events"))
def bio_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Maximal runs of one type in an ordered sequence."""
    out = sequences.runs(table(spark, sf_dir, "events"), "user_id", "event_id", "event_type")
    return out.select("user_id", F.col("event_type").alias("kind"), "start", F.col("end").alias("stop"))


@query("WITH e AS (SELECT user_id, event_id, event_type IN ('click', 'view', 'error') AS atk FROM events), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - row_number() OVER (PARTITION BY user_id, atk ORDER BY event_id) AS island FROM e) SELECT user_id, min(event_id) AS start, count(*) AS words FROM r WHERE atk GROUP BY user_id, island HAVING count(*) >= 2")
def attack_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of marked words of length two or more."""
    e = table(spark, sf_dir, "events").withColumn("atk", F.col("event_type").isin("click", "view", "error"))
    island = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - F.row_number().over(Window.partitionBy("user_id", "atk").orderBy("event_id"))
    return e.withColumn("island", island).where("atk").groupBy("user_id", "island").agg(F.min("event_id").alias("start"), F.count("*").alias("words")).where("words >= 2").drop("island")


@query("SELECT user_id, event_id, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS block FROM events")
def conll_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentence numbers from blank rows (here: errors)."""
    return sequences.numbered_blocks(table(spark, sf_dir, "events"), F.col("event_type") == "error", "user_id", "event_id").select("user_id", "event_id", "block")


@query("SELECT user_id, event_id, last_value(CASE WHEN event_type = 'click' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS carried FROM events")
def carry_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last subject before a row."""
    e = table(spark, sf_dir, "events").withColumn("v", F.when(F.col("event_type") == "click", F.col("event_id")))
    return e.select("user_id", "event_id", sequences.carried("v", "user_id", "event_id").alias("carried"))


@query("SELECT user_id, event_id, round(value - lag(value) OVER (PARTITION BY user_id ORDER BY event_id), 4) AS step FROM events")
def step_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    step = F.col("value") - F.lag("value").over(Window.partitionBy("user_id").orderBy("event_id"))
    return table(spark, sf_dir, "events").select("user_id", "event_id", F.round(step, 4).alias("step"))


@query("WITH t AS (SELECT conv_id, turn * 100 AS start, turn * 100 + 50 AS stop, role AS token FROM conversations), s AS (SELECT conv_id, turn * 100 AS s, turn * 100 + 160 AS e, 'U' AS kind FROM conversations WHERE role = 'user'), j AS (SELECT t.conv_id, t.start, t.token, min((s.s, s.kind)) FILTER (WHERE s.s IS NOT NULL) AS x FROM t LEFT JOIN s ON t.conv_id = s.conv_id AND t.start >= s.s AND t.stop <= s.e GROUP BY 1, 2, 3) SELECT conv_id, start, token, CASE WHEN x IS NULL THEN 'O' WHEN x[1] = start THEN 'B-' || x[2] ELSE 'I-' || x[2] END AS tag FROM j")
def offsets_to_bio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token and span offsets to B-, I- and O tags; a range join within the document."""
    c = table(spark, sf_dir, "conversations")
    t = c.select("conv_id", (F.col("turn") * 100).alias("start"), (F.col("turn") * 100 + 50).alias("end"), F.col("role").alias("token"))
    s = c.where("role = 'user'").select("conv_id", (F.col("turn") * 100).alias("s"), (F.col("turn") * 100 + 160).alias("e"), F.lit("U").alias("kind"))
    return sequences.bio(t, s, "conv_id")


_SPANS = "g AS (SELECT user_id, kind, start, stop FROM (" + _ISLANDS.format(k="user_id", p="event_id", v="event_type", t="events") + "))"


@query(f"WITH {_SPANS}, p AS (SELECT user_id, CASE WHEN start % 5 = 0 THEN 'view' ELSE kind END AS kind, start, stop FROM g WHERE start % 7 <> 0), c AS (SELECT (SELECT count(*) FROM p JOIN g USING (user_id, kind, start, stop)) AS tp, (SELECT count(*) FROM p) AS predicted, (SELECT count(*) FROM g) AS gold) SELECT tp, predicted, gold, round(tp::DOUBLE / predicted, 6) AS precision, round(tp::DOUBLE / gold, 6) AS recall FROM c")
def span_ner_prf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans are right when start, end and type agree."""
    g = bio_spans(spark, sf_dir)
    p = g.where("start % 7 <> 0").withColumn("kind", F.when(F.col("start") % 5 == 0, "view").otherwise(F.col("kind")))
    both = p.withColumn("p", F.lit(1)).join(g.withColumn("g", F.lit(1)), ["user_id", "kind", "start", "stop"], "full")
    counts = both.agg(F.count_if(F.col("p").isNotNull() & F.col("g").isNotNull()).alias("tp"), F.count("p").alias("predicted"), F.count("g").alias("gold"))
    return metrics.with_prf(counts).select("tp", "predicted", "gold", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


@query(r"WITH w AS (SELECT item_id, unnest(list_filter(string_split(trim(regexp_replace(lower(text), '[^\p{L}\p{N}_]+', ' ', 'g')), ' '), lambda t: t <> '')) AS w FROM benchmark) SELECT w AS token, count(*) AS n, count(DISTINCT item_id) AS items FROM w GROUP BY 1")
def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = table(spark, sf_dir, "benchmark").select("item_id", F.explode(all_tokens(F.col("text"))).alias("token"))
    return w.groupBy("token").agg(F.count("*").alias("n"), F.count_distinct("item_id").alias("items"))

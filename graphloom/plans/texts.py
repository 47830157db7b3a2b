"""Text functions on driver tables. Regular expressions are kept to what Java and RE2 read alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import jsontext, text
from .base import query, table


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def _q(s: str) -> str:
    return s.replace("'", "''")


_KINDS = ", ".join(f"list_transform(regexp_extract_all(text, '{_q(p)}'), lambda v: {{'kind': '{k}', 'value': v}})" for k, p in text.INDICATORS.items())


@query(f"SELECT doc_id, x.kind AS kind, x.value AS value FROM (SELECT DISTINCT doc_id, unnest(list_concat({_KINDS})) AS x FROM documents)")
def ioc_extract_a(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every indicator of a document once."""
    return _docs(spark, sf_dir).select("doc_id", F.explode(text.indicators(F.col("text"))).alias("x")).select("doc_id", "x.kind", "x.value").distinct()


_FIRST = ", ".join(f"{{'kind': '{k}', 'value': regexp_extract(text, '{_q(p)}', 0)}}" for k, p in text.MENTION_KINDS.items())


@query(f"SELECT doc_id, x.kind AS kind, x.value AS value FROM (SELECT doc_id, unnest([{_FIRST}]) AS x FROM documents) WHERE x.value <> ''")
def ioc_extract_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first match of each kind."""
    return _docs(spark, sf_dir).select("doc_id", F.explode(text.mention_kinds(F.col("text"))).alias("x")).select("doc_id", "x.kind", "x.value")


@query(r"SELECT doc_id, md5(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS h FROM documents")
def clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", F.md5(text.clean_text(F.col("text"))).alias("h"))


@query(r"SELECT doc_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'), '[ \t]{2,}', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'))) AS h FROM documents")
def normalize_plain_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", F.md5(text.normalize_plain(F.col("text"))).alias("h"))


@query(r"WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents), f AS (SELECT doc_id, line, n, row_number() OVER (PARTITION BY doc_id, lower(trim(line)) ORDER BY n) AS rn FROM l WHERE trim(line) <> '') SELECT doc_id, md5(string_agg(trim(line), chr(10) ORDER BY n)) AS h, count(*) AS lines FROM f WHERE rn = 1 GROUP BY doc_id")
def normalize_lines_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated lines go, the first of each (without regard to case) stays."""
    trimmed = F.filter(F.transform(F.split("text", "\n"), lambda v: F.trim(v)), lambda x: x != "")
    lines = _docs(spark, sf_dir).select("doc_id", F.posexplode(trimmed).alias("n", "line"))
    first = lines.withColumn("rn", F.row_number().over(Window.partitionBy("doc_id", F.lower("line")).orderBy("n"))).where("rn = 1")
    kept = first.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("n", "line"))).alias("x"))
    return kept.select("doc_id", F.md5(F.array_join("x.line", "\n")).alias("h"), F.size("x").cast("bigint").alias("lines"))


_TERMS = ("malware", "token", "password", "license", "copyright", "http", "secret", "@")


@query("WITH l AS (SELECT doc_id, trim(unnest(string_split(text, chr(10)))) AS line FROM documents) SELECT doc_id, count(*) FILTER (" + " OR ".join(f"contains(lower(line), '{t}')" for t in _TERMS) + r") AS strong, count(*) FILTER (NOT (" + " OR ".join(f"contains(lower(line), '{t}')" for t in _TERMS) + r") AND length(line) >= 90 AND regexp_matches(line, '[.!?]$')) AS long_enough FROM l WHERE line <> '' GROUP BY doc_id")
def cti_signal_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with a strong term, else long lines that end like a sentence."""
    lines = _docs(spark, sf_dir).select("doc_id", F.explode(F.transform(F.split("text", "\n"), lambda v: F.trim(v))).alias("line")).where("line <> ''")
    strong = F.exists(F.array(*map(F.lit, _TERMS)), lambda t: F.contains(F.lower("line"), t))
    whole = (F.length("line") >= 90) & F.col("line").rlike("[.!?]$")
    return lines.groupBy("doc_id").agg(F.count_if(strong).alias("strong"), F.count_if(~strong & whole).alias("long_enough"))


@query("WITH m AS (SELECT conv_id, turn, CASE WHEN role = 'user' AND length(text) < 60 THEN 'skip' WHEN role = 'assistant' THEN 'keep' END AS marker FROM conversations) SELECT conv_id, turn FROM (SELECT *, last_value(marker IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS state FROM m) WHERE coalesce(state, 'keep') <> 'skip'")
def section_skip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From a skip header (a short user turn) to a resume header (an assistant turn) rows are left out."""
    from ..operators.sequences import state

    m = table(spark, sf_dir, "conversations").withColumn("marker", F.when((F.col("role") == "user") & (F.length("text") < 60), "skip").when(F.col("role") == "assistant", "keep"))
    return m.withColumn("state", state("marker", "conv_id", "turn")).where("coalesce(state, 'keep') <> 'skip'").select("conv_id", "turn")


@query("WITH x AS (SELECT p_partkey, 'http://x.org/ns/' || p_type || '#' || replace(p_name, ' ', '_') AS uri, CASE p_partkey % 4 WHEN 0 THEN 'uco:' || p_brand WHEN 1 THEN 'http://x/y#' || p_name WHEN 2 THEN 'NON_MATCH' ELSE p_type || ' ' || p_name END AS label FROM part) SELECT p_partkey, regexp_replace(uri, '^.*[/#]', '') AS local, CASE WHEN t IN ('', 'nonmatch', 'none', 'null', 'unknown', 'na') THEN '' ELSE t END AS type_label FROM (SELECT *, regexp_replace(regexp_replace(lower(trim(label)), '^.*[/#:]', ''), '[^a-z0-9]', '', 'g') AS t FROM x)")
def type_label_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey") % 4
    label = F.when(k == 0, F.concat(F.lit("uco:"), "p_brand")).when(k == 1, F.concat(F.lit("http://x/y#"), "p_name")).when(k == 2, "NON_MATCH").otherwise(F.concat_ws(" ", "p_type", "p_name"))
    uri = F.concat(F.lit("http://x.org/ns/"), "p_type", F.lit("#"), F.translate("p_name", " ", "_"))
    return table(spark, sf_dir, "part").select("p_partkey", text.local_name(uri).alias("local"), text.type_label(label).alias("type_label"))


@query(r"SELECT page_id, regexp_replace(regexp_replace(regexp_replace(url, '[?#].*$', ''), '^.*/', ''), '[^A-Za-z0-9._-]+', '_', 'g') AS file, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host FROM pages")
def safe_filename(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", text.safe_filename(F.col("url")).alias("file"), F.regexp_extract("url", r"^[a-z]+://([^/?#]+)", 1).alias("host"))


@query(r"WITH x AS (SELECT p_partkey, lower(p_brand) || '_uco' || CASE WHEN p_partkey % 2 = 0 THEN '_embedding_2511251134' ELSE '' END || '_results' AS f, replace(initcap_name, ' ', '') AS camel, p_name || ' (' || p_type || ')' AS typed FROM (SELECT *, array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || w[2:]), ' ') AS initcap_name FROM part)) SELECT p_partkey, CASE WHEN regexp_matches(regexp_replace(f, '_results$', ''), '^.+_[a-z]+_[0-9]{10}$') THEN regexp_replace(regexp_replace(f, '_results$', ''), '_[a-z]+_[0-9]{10}$', '') ELSE regexp_replace(f, '_results$', '') END AS run, regexp_replace(camel, '([a-z0-9])([A-Z])', '\1 \2', 'g') AS words, trim(regexp_replace(typed, '\s*\([^()]*\)\s*$', '')) AS bare FROM x")
def name_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run keys from file names, words of camel-case names, names without a type in brackets."""
    p = table(spark, sf_dir, "part")
    f = F.concat(F.lower("p_brand"), F.lit("_uco"), F.when(F.col("p_partkey") % 2 == 0, "_embedding_2511251134").otherwise(""), F.lit("_results"))
    camel = F.replace(F.initcap("p_name"), F.lit(" "), F.lit(""))
    return p.select("p_partkey", text.results_key(f).alias("run"), text.camel_words(camel).alias("words"), text.strip_type_suffix(F.concat("p_name", F.lit(" ("), "p_type", F.lit(")"))).alias("bare"))


@query(r"WITH s AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(regexp_replace(replace(text, chr(9), ' '), '([.!?])\s+', '\1' || chr(10), 'g'), '\n+'), lambda x: trim(x)), lambda x: x <> '') AS s FROM documents) SELECT doc_id, len(s)::BIGINT AS sentences, md5(array_to_string(s, '|')) AS h FROM s")
def sentence_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _docs(spark, sf_dir).select("doc_id", text.sentences(F.col("text")).alias("s"))
    return s.select("doc_id", F.size("s").cast("bigint").alias("sentences"), F.md5(F.array_join("s", "|")).alias("h"))


_STOP = ", ".join(f"'{w}'" for w in text.STOPWORDS)


@query(rf"SELECT item_id, array_to_string(list_filter(string_split(trim(regexp_replace(lower(text), '[^\p{{L}}\p{{N}}_]+', ' ', 'g')), ' '), lambda w: w <> '' AND w NOT IN ({_STOP})), ' ') AS words FROM benchmark")
def stopword_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select("item_id", F.array_join(text.without_stopwords(text.all_tokens(F.col("text"))), " ").alias("words"))


@query(r"SELECT doc_id, CASE WHEN length(text) <= 100 THEN text WHEN contains(text[1:100], ' ') THEN regexp_extract(text[1:100], '(?s)^(.*) ', 1) ELSE text[1:100] END AS head FROM documents")
def truncate_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", text.truncate_words(F.col("text"), 100).alias("head"))


@query(r"SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(text, '[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}', 'ip address', 'g'), 'https?://[^\s]+', 'url', 'g'), '[^\s@]+@[^\s@]+', 'mail', 'g')) AS h FROM documents")
def regex_normalizers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses become their kind."""
    x = F.regexp_replace("text", r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}", "ip address")
    return _docs(spark, sf_dir).select("doc_id", F.md5(F.regexp_replace(F.regexp_replace(x, r"https?://[^\s]+", "url"), r"[^\s@]+@[^\s@]+", "mail")).alias("h"))


_PRON = ", ".join(f"'{p}'" for p in text.PRONOUNS)


@query(f"WITH w AS (SELECT doc_id, unnest(string_split(text, ' ')) AS w, generate_subscripts(string_split(text, ' '), 1) AS n FROM documents), r AS (SELECT *, lower(w) IN ({_PRON}) AS p, sum(CASE WHEN lower(w) IN ({_PRON}) THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY n) AS k FROM w) SELECT doc_id, md5(string_agg(CASE WHEN p THEN '<' || lower(w) || ':' || k::BIGINT || '>' ELSE w END, ' ' ORDER BY n)) AS h FROM r GROUP BY doc_id")
def pronoun_annotate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pronouns numbered in order. Words are exploded, numbered by a window within the document and joined again."""
    words = _docs(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", " ")).alias("n", "w"))
    p = F.lower("w").isin(*text.PRONOUNS)
    k = F.sum(F.when(p, 1).otherwise(0)).over(Window.partitionBy("doc_id").orderBy("n"))
    tagged = words.select("doc_id", "n", F.when(p, F.concat(F.lit("<"), F.lower("w"), F.lit(":"), k.cast("string"), F.lit(">"))).otherwise(F.col("w")).alias("w"))
    return tagged.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("n", "w"))).alias("x")).select("doc_id", F.md5(F.array_join("x.w", " ")).alias("h"))


@query("SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k, event_type AS kind FROM events")
def json_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects with single quotes, bare keys and trailing commas inside prose, read again."""
    said = F.concat(F.lit("Sure: "), F.regexp_replace(F.regexp_replace("props", '"k"', "k"), "}", ", 'kind': '"), F.col("event_type"), F.lit("',} done"))
    e = table(spark, sf_dir, "events").select("event_id", said.alias("said"))
    return e.select("event_id", jsontext.field(F.col("said"), "k").cast("bigint").alias("k"), jsontext.field(F.col("said"), "kind").alias("kind"))


@query("SELECT o_orderkey, c_name AS subject, o_orderstatus AS relation, o_orderpriority AS object FROM orders JOIN customer ON o_custkey = c_custkey")
def bracket_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Triples written in brackets within prose, parsed back."""
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    said = F.concat(F.lit("Triples: ["), "c_name", F.lit(", "), "o_orderstatus", F.lit(",  "), "o_orderpriority", F.lit("] and [no triple]"))
    return o.select("o_orderkey", F.explode(jsontext.bracket_triples(said)).alias("t")).select("o_orderkey", "t.*")


@query("SELECT o_orderkey, c_name AS subject, o_orderstatus AS relation, o_orderpriority AS object FROM orders JOIN customer ON o_custkey = c_custkey")
def open_ie_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    said = F.concat(F.lit("[SUBJECT: "), "c_name", F.lit(" ] [RELATION: "), "o_orderstatus", F.lit("] [OBJECT: "), "o_orderpriority", F.lit("]"))
    return o.select("o_orderkey", F.explode(jsontext.labelled_triples(said)).alias("t")).select("o_orderkey", "t.*")


@query("SELECT p_partkey, p_brand AS arg0, 'makes' AS v, p_name AS arg1 FROM part")
def srl_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Role descriptions into a map; the first of a role wins."""
    said = F.concat(F.lit("[ARG0: "), "p_brand", F.lit("] [V: makes] [ARG1: "), "p_name", F.lit("] [ARG1: other]"))
    m = table(spark, sf_dir, "part").select("p_partkey", jsontext.role_map(said).alias("m"))
    return m.select("p_partkey", F.col("m")["ARG0"].alias("arg0"), F.col("m")["V"].alias("v"), F.col("m")["ARG1"].alias("arg1"))


@query("SELECT s.s_suppkey, CASE s.s_suppkey % 5 WHEN 0 THEN 'definition' WHEN 1 THEN 'apposition' WHEN 2 THEN 'naming' WHEN 3 THEN 'short' ELSE 'relation' END AS kind, (CASE s.s_suppkey % 5 WHEN 0 THEN 5 WHEN 1 THEN 4 WHEN 2 THEN 3 WHEN 3 THEN 2 ELSE 1 END)::INT AS weight FROM supplier s")
def evidence_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences built to say a supplier's name in five ways."""
    k, name = F.col("s_suppkey") % 5, F.col("s_name")
    long = F.concat(F.lit("who met "), name, F.lit(" " + "again and " * 20))
    said = F.when(k == 0, F.concat(name, F.lit(" is a firm"))).when(k == 1, F.concat(name, F.lit(", a firm"))).when(k == 2, F.concat(F.lit("so the "), name, F.lit(" said"))).when(k == 3, F.concat(F.lit("met "), name)).otherwise(long)
    s = table(spark, sf_dir, "supplier").select("s_suppkey", text.evidence_kind(name, said).alias("kind"))
    return s.withColumn("weight", text.evidence_weight(F.col("kind")))


@query(r"WITH s AS (SELECT conv_id, turn, list_distinct(list_filter(string_split(trim(regexp_replace(lower(text), '[^\p{L}\p{N}_]+', ' ', 'g')), ' '), lambda t: t <> '')) AS tok FROM conversations), n AS (SELECT DISTINCT conv_id, unnest(tok) AS name FROM s WHERE turn = 0) SELECT s.conv_id, s.turn, count(*) AS names FROM s JOIN n ON s.conv_id = n.conv_id AND list_contains(s.tok, n.name) WHERE s.turn > 0 GROUP BY 1, 2")
def entity_in_sentence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names (words of a conversation's first turn) that its later turns hold as whole words; an equi join on the token."""
    t = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.explode(text.tokens(F.col("text"))).alias("name"))
    names = t.where("turn = 0").select("conv_id", "name").distinct()
    return t.where("turn > 0").join(names, ["conv_id", "name"]).groupBy("conv_id", "turn").agg(F.count("*").alias("names"))


@query("SELECT o_orderkey, CASE WHEN regexp_matches(v, '^[0-9]{4}-[0-9]{2}-[0-9]{2}') THEN 'dateTime' WHEN regexp_matches(v, '^[+-]?[0-9]+$') THEN 'integer' WHEN lower(v) IN ('true', 'false') THEN 'boolean' ELSE 'string' END AS kind FROM (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN o_custkey::VARCHAR WHEN 2 THEN 'True' ELSE o_orderpriority END AS v FROM orders)")
def infer_datatype(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey") % 4
    v = F.when(k == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).when(k == 1, F.col("o_custkey").cast("string")).when(k == 2, "True").otherwise(F.col("o_orderpriority"))
    return table(spark, sf_dir, "orders").select("o_orderkey", text.infer_datatype(v).alias("kind"))


@query(r"SELECT event_id, lpad((s // 3600)::VARCHAR, 2, '0') || ':' || lpad((s // 60 % 60)::VARCHAR, 2, '0') || ':' || lpad((s % 60)::VARCHAR, 2, '0') AS hms FROM (SELECT event_id, floor(value * 60)::BIGINT AS s FROM events)")
def duration_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.floor(F.col("value") * 60)
    return table(spark, sf_dir, "events").select("event_id", F.format_string("%02d:%02d:%02d", F.expr("floor(value * 60) div 3600"), F.expr("floor(value * 60) div 60 % 60"), s % 60).alias("hms"))


@query(r"SELECT s_suppkey, 'http://' || lower(s_name) || '.com/a@b' AS armed FROM supplier")
def ioc_rearm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Disarmed addresses are written out again."""
    said = F.concat(F.lit("hxxp://"), F.lower("s_name"), F.lit("[.]com/a[at]b"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", text.defang(said).alias("armed"))


@query("SELECT l_orderkey, l_linenumber, l_returnflag AS e1, l_linestatus AS e2 FROM lineitem")
def entity_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two marked entities of a sentence."""
    said = F.concat(F.lit("a <e1>"), "l_returnflag", F.lit("</e1> b <e2>"), "l_linestatus", F.lit("</e2>"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.regexp_extract(said, "<e1>(.*)</e1>", 1).alias("e1"), F.regexp_extract(said, "<e2>(.*)</e2>", 1).alias("e2"))

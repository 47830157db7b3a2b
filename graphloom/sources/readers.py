"""Readers. Every schema is stated, so that an empty array or a missing key never changes a type."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.jsontext import bracket_triples

ENTITY = "struct<entity_id:int,entity_name:string,entity_type:string,mentions:array<string>>"
#: Ends of implicit triples are objects or plain strings, so they are read as JSON text.
TRIPLE = "struct<subject:string,relation:string,object:string>"
GOLD = f"text string, entities array<{ENTITY}>, explicit_triplets array<{TRIPLE}>, implicit_triplets array<{TRIPLE}>"
ONTOLOGIES = ("uco", "stix", "malont")
PREDICTION = (
    "file string, text string, ontology string, error string, extracted_entities array<struct<name:string,class:string>>, "
    "extracted_triplets array<struct<subject:string,relation:string,relation_class:string,object:string>>"
)


def stem(path: Column) -> Column:
    """File name without folder and last extension."""
    return F.regexp_replace(F.substring_index(path, "/", -1), r"\.[^.]*$", "")


def entity_ref(x: Column) -> Column:
    """The text of an entity reference that is a string or {entity_id, entity_text}."""
    return F.coalesce(F.get_json_object(x, "$.entity_text"), x)


def gold(spark: SparkSession, path: str, typed: bool = False) -> DataFrame:
    """One row per annotation file, with its id. typed: *_typed.json files with types per ontology."""
    schema = GOLD
    if typed:
        kinds = ",".join(f"entity_{o}_type:struct<name:string,uri:string>" for o in ONTOLOGIES)
        relations = ",".join(f"relation_{o}_type:struct<name:string,uri:string,is_inverse:boolean>" for o in ONTOLOGIES)
        schema = f"text string, entities array<struct<entity_id:int,entity_name:string,entity_type:string,mentions:array<string>,{kinds}>>, explicit_triplets array<struct<subject:string,relation:string,object:string,{relations}>>, implicit_triplets array<struct<subject:string,relation:string,object:string,{relations}>>"
    reader = spark.read.schema(schema).option("multiLine", True)
    rows = reader.option("pathGlobFilter", "*_typed.json" if typed else "*.json").json(path).withColumn("doc_id", stem(F.col("_metadata.file_path")))
    return rows.withColumn("doc_id", F.regexp_replace("doc_id", "_typed$", "")) if typed else rows.where(~F.col("doc_id").endswith("_typed"))


def gold_preferring_plain(spark: SparkSession, path: str) -> DataFrame:
    """Plain files, and the typed files whose id has none; text and untyped fields only."""
    plain = gold(spark, path)
    typed = gold(spark, path, typed=True)
    bare = typed.select(
        "text",
        F.transform("entities", lambda e: F.struct(e["entity_id"], e["entity_name"], e["entity_type"], e["mentions"])).alias("entities"),
        *[F.transform(c, lambda t: F.struct(t["subject"], t["relation"], t["object"])).cast(f"array<{TRIPLE}>").alias(c) for c in ("explicit_triplets", "implicit_triplets")],
        "doc_id",
    ).withColumn("entities", F.col("entities").cast(f"array<{ENTITY}>"))
    return plain.unionByName(bare.join(plain.select("doc_id"), "doc_id", "left_anti"))


def gold_entities(docs: DataFrame) -> DataFrame:
    """(doc_id, j, name, type): nameless ones go before names are trimmed."""
    rows = docs.select("doc_id", F.posexplode("entities").alias("j", "e")).where("e.entity_name <> ''")
    return rows.select("doc_id", "j", F.trim("e.entity_name").alias("name"), F.col("e.entity_type").alias("type"))


def gold_triples(docs: DataFrame) -> DataFrame:
    """(doc_id, j, subject, relation, object, scope) of explicit and implicit triples; those without both ends go."""

    def of(column: str, scope: str) -> DataFrame:
        t = docs.select("doc_id", F.posexplode(column).alias("j", "t"))
        return t.select("doc_id", "j", entity_ref(F.col("t.subject")).alias("subject"), F.coalesce("t.relation", F.lit("")).alias("relation"), entity_ref(F.col("t.object")).alias("object"), F.lit(scope).alias("scope"))

    both = of("explicit_triplets", "explicit").unionByName(of("implicit_triplets", "implicit"))
    return both.where("coalesce(subject, '') <> '' OR coalesce(object, '') <> ''")


def predictions(spark: SparkSession, path: str) -> DataFrame:
    """Prediction rows without those that failed, with the run's name and the document's id."""
    rows = spark.read.schema(PREDICTION).option("multiLine", True).option("pathGlobFilter", "*_results.json").json(path)
    return rows.where("error IS NULL").withColumns({"run": F.regexp_replace(stem(F.col("_metadata.file_path")), "_results$", ""), "doc_id": stem(F.col("file"))})


def ontology_of(x: Column, override: str | None = None) -> Column:
    """Strict: the override or the row's own, one of the three, else an error."""
    named = F.lit(override) if override else F.lower(F.trim(x))
    return F.when(named.isin(*ONTOLOGIES), named).otherwise(F.raise_error(F.concat(F.lit("unknown ontology: "), F.coalesce(named, F.lit("none")))))


def behaviours(spark: SparkSession, path: str) -> DataFrame:
    """CSV of sentences: Behavior TRUE and at least one [Subject, Verb, Object]; numbered after that filter.

    Order is that of the file, which one task reads."""
    rows = spark.read.option("header", True).option("multiLine", True).csv(path).withColumn("n", F.monotonically_increasing_id())
    kept = rows.where(F.upper(F.trim("Behavior")) == "TRUE").withColumn("triples", bracket_triples(F.coalesce("Ground_Truth", F.lit("")))).where(F.size("triples") > 0)
    return kept.withColumn("id", F.row_number().over(Window.orderBy("n")) - 1).drop("n")


def ontology_rows(spark: SparkSession, path: str) -> DataFrame:
    """The 18-column CSV for BM25, Latin-1, nulls empty."""
    return spark.read.option("header", True).option("encoding", "ISO-8859-1").csv(path).na.fill("")


def conll(spark: SparkSession, path: str) -> DataFrame:
    """(file, sent_id, pos, token, tag): token first and tag last on a line, blank lines between sentences."""
    whole = spark.read.text(path, wholetext=True).select(stem(F.col("_metadata.file_path")).alias("file"), F.col("value"))
    sentences = whole.select("file", F.posexplode(F.filter(F.split("value", r"\n[ \t\r]*\n"), lambda s: F.trim(s) != "")).alias("sent_id", "s"))
    lines = sentences.select("file", "sent_id", F.posexplode(F.filter(F.split("s", "\r?\n"), lambda s: F.trim(s) != "")).alias("pos", "line"))
    parts = F.split(F.trim("line"), r"\s+")
    return lines.select("file", "sent_id", "pos", F.element_at(parts, 1).alias("token"), F.element_at(parts, -1).alias("tag"))


def labelled_lines(spark: SparkSession, path: str) -> DataFrame:
    """(text, label) from a tab-separated file."""
    return spark.read.option("sep", "\t").schema("text string, label int").csv(path)

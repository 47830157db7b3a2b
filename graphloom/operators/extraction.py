"""From extracted mentions and triples to result rows, and the filters on the way. All are functions of DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stem import stem
from ..functions.text import short_name


def entities_output(mentions: DataFrame) -> DataFrame:
    """(doc, name, cls) from (doc, ord, name, cls, literal): the first class of a name in order; literals are left
    out, and a missing class is the empty string."""
    own = mentions.where(~F.coalesce(F.col("literal"), F.lit(False)) & F.col("name").isNotNull())
    return own.groupBy("doc", "name").agg(F.coalesce(F.min_by("cls", "ord"), F.lit("")).alias("cls"))


def triplets_output(triples: DataFrame) -> DataFrame:
    """(doc, subject, relation, object) from explicit triples: fields projected, relations by their short names."""
    return triples.where(~F.coalesce(F.col("implicit"), F.lit(False))).select("doc", "subject", short_name(F.col("relation")).alias("relation"), "object")


def normalised_candidates(candidates: DataFrame) -> DataFrame:
    """Property candidates (key, prop, kind, inverse, ord): inverse data properties go, and of equal ones the first
    stays. Adds ``rank`` from 0."""
    own = candidates.where(~(F.col("inverse") & (F.col("kind") == "data")))
    first = own.groupBy("key", "prop", "inverse").agg(F.min_by("kind", "ord").alias("kind"), F.min("ord").alias("ord"))
    return first.withColumn("rank", F.row_number().over(Window.partitionBy("key").orderBy("ord")) - 1)


def type_matched(triples: DataFrame, indicators: DataFrame, entities: DataFrame, allowed: DataFrame) -> DataFrame:
    """Triples (id, s, p, o) with the class of both ends (an indicator's before an entity's) and whether the ontology
    allows that predicate between them. indicators, entities: (name, cls); allowed: (s_cls, p, o_cls)."""
    classes = indicators.select("name", "cls", F.lit(0).alias("prio")).union(entities.select("name", "cls", F.lit(1)))
    classes = classes.groupBy("name").agg(F.min_by("cls", F.struct("prio", "cls")).alias("cls"))
    side = lambda k: classes.select(F.col("name").alias(k), F.col("cls").alias(f"{k}_cls"))
    typed = triples.join(side("s"), "s", "left").join(side("o"), "o", "left")
    return typed.join(allowed.withColumn("matched", F.lit(True)).distinct(), ["s_cls", "p", "o_cls"], "left").withColumn("matched", F.coalesce("matched", F.lit(False)))


def flagged(entities: DataFrame, indicators: DataFrame) -> DataFrame:
    """Entities (name, ...) with ``is_ioc`` and ``ioc_type``; unknown names get false and the empty string."""
    return entities.join(indicators.select("name", F.lit(True).alias("is_ioc"), "ioc_type"), "name", "left").withColumns({"is_ioc": F.coalesce("is_ioc", F.lit(False)), "ioc_type": F.coalesce("ioc_type", F.lit(""))})


def described(kinds: DataFrame, mapping: DataFrame, default: str, kind: str = "kind") -> DataFrame:
    """``kinds`` with ``description`` from a table (kind, description); kinds that it lacks get the default."""
    return kinds.join(mapping.select(F.col("kind").alias(kind), "description"), kind, "left").withColumn("description", F.coalesce("description", F.lit(default)))


def first_files(files: DataFrame, n: int, order: str) -> DataFrame:
    """The first ``n`` inputs in file order, before anything is filtered."""
    return files.orderBy(order).limit(n)


def sequential_ids(rows: DataFrame, document: str, chunk: str, position: str) -> DataFrame:
    """Rows with ``id``: 0, 1, ... over (chunk, position) within each document."""
    return rows.withColumn("id", F.row_number().over(Window.partitionBy(document).orderBy(chunk, position)) - 1)


def without_later_arguments(vectors: DataFrame) -> DataFrame:
    """(doc, ord, words) without the words that a later vector of the document has too."""
    each = vectors.select("doc", "ord", F.explode("words").alias("word")).groupBy("doc", "word").agg(F.max("ord").alias("last"))
    kept = vectors.select("doc", "ord", F.posexplode("words").alias("i", "word")).join(each, ["doc", "word"]).where("ord = last")
    left = kept.groupBy("doc", "ord").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "word"))), lambda x: x["word"]).alias("left"))
    return vectors.select("doc", "ord").join(left, ["doc", "ord"], "left").select("doc", "ord", F.coalesce("left", F.array().cast("array<string>")).alias("words"))


def attack_vector(arguments: Column) -> Column:
    """Whether a map of semantic roles is worth a step: not negated, not the authors' own doing, more than one argument."""
    values = F.map_filter(arguments, lambda k, v: k.startswith("ARG") & (F.length(F.trim(v)) > 0))
    return ~F.map_contains_key(arguments, "ARGM-NEG") & (F.coalesce(F.lower(F.try_element_at(arguments, F.lit("ARG0"))), F.lit("")) != "we") & (F.size(values) > 1)


def with_known_verb(steps: DataFrame, verbs: DataFrame, verb: str = "verb") -> DataFrame:
    """Steps whose stemmed verb is among the stemmed verbs of a list (verb)."""
    known = verbs.select(stem(F.lower("verb")).alias("_stem")).distinct()
    return steps.join(known, stem(F.lower(F.col(verb))) == F.col("_stem"), "left_semi")


def bag_of_words(fields: list[Column]) -> Column:
    """The distinct stemmed words of several text fields, in order of first occurrence; null fields have none."""
    words = F.flatten(F.array(*[F.split(F.lower(F.coalesce(f, F.lit(""))), "[^a-z0-9]+") for f in fields]))
    return F.array_distinct(F.transform(F.filter(words, lambda w: w != ""), stem))


def response_triples(response: Column) -> Column:
    """The JSON array of triples in an answer, by whichever key it is under."""
    return F.coalesce(*[F.get_json_object(response, f"$.{k}") for k in ("tagged_triples", "triplets", "triples", "values")], F.lit("[]"))


def evidence_lines(evidence: DataFrame, n: int = 2) -> DataFrame:
    """(entity, texts): the ``n`` best pieces of evidence (entity, text, score) joined, best first, then by text."""
    ranked = evidence.withColumn("r", F.row_number().over(Window.partitionBy("entity").orderBy(F.desc("score"), "text"))).where(F.col("r") <= n)
    return ranked.groupBy("entity").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("r", "text"))), lambda x: x["text"]), " | ").alias("texts"))

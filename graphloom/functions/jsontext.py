"""JSON found in free text, and triples written in brackets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def embedded_object(x: Column) -> Column:
    """From the first { to the last }, or null."""
    found = F.regexp_extract(x, r"(?s)\{.*\}", 0)
    return F.when(found != "", found)


def embedded_array(x: Column) -> Column:
    found = F.regexp_extract(x, r"(?s)\[.*\]", 0)
    return F.when(found != "", found)


def repaired(x: Column) -> Column:
    """Single quotes, bare keys and trailing commas put right."""
    double = F.regexp_replace(x, "'", '"')
    keys = F.regexp_replace(double, r"([{,]\s*)([A-Za-z_][A-Za-z0-9_]*)\s*:", '$1"$2":')
    return F.regexp_replace(keys, r",\s*([}\]])", "$1")


def field(x: Column, name: str) -> Column:
    """A field of the object in a text; if the object doesn't parse, of its repaired form; else null."""
    own = embedded_object(x)
    return F.coalesce(F.get_json_object(own, f"$.{name}"), F.get_json_object(repaired(own), f"$.{name}"))


def bracket_triples(x: Column) -> Column:
    """[subject, relation, object] groups as an array of structs, trimmed."""
    pattern = r"\[([^,\]]+),\s*([^,\]]+),\s*([^\]]+)\]"
    parts = [F.transform(F.regexp_extract_all(x, F.lit(pattern), F.lit(i)), lambda v: F.trim(v)) for i in (1, 2, 3)]
    return F.arrays_zip(parts[0].alias("subject"), parts[1].alias("relation"), parts[2].alias("object"))


def labelled_triples(x: Column) -> Column:
    """[SUBJECT: a] [RELATION: b] [OBJECT: c] groups as an array of structs."""
    pattern = r"\[SUBJECT:\s*([^\]]*)\]\s*\[RELATION:\s*([^\]]*)\]\s*\[OBJECT:\s*([^\]]*)\]"
    parts = [F.transform(F.regexp_extract_all(x, F.lit(pattern), F.lit(i)), lambda v: F.trim(v)) for i in (1, 2, 3)]
    return F.arrays_zip(parts[0].alias("subject"), parts[1].alias("relation"), parts[2].alias("object"))


def role_map(x: Column) -> Column:
    """[ROLE: words] groups as a map; the first of a role wins."""
    pairs = F.arrays_zip(
        F.transform(F.regexp_extract_all(x, F.lit(r"\[([A-Z0-9-]+):\s*([^\]]*)\]"), F.lit(1)), lambda v: F.trim(v)).alias("k"),
        F.transform(F.regexp_extract_all(x, F.lit(r"\[([A-Z0-9-]+):\s*([^\]]*)\]"), F.lit(2)), lambda v: F.trim(v)).alias("v"),
    )
    once = F.aggregate(pairs, F.array().cast("array<struct<k:string,v:string>>"), lambda acc, p: F.when(F.exists(acc, lambda q: q["k"] == p["k"]), acc).otherwise(F.concat(acc, F.array(p))))
    return F.map_from_entries(once)

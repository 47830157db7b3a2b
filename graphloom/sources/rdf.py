"""A tolerant reader of the RDF that ontology files use: RDF/XML, and Turtle with prefixes, lists of objects and
blank nodes. Files are read whole and parsed by tasks, one file a row; a file that doesn't parse is counted."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ElementTree

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
_TOKEN = re.compile(r'#[^\n]*|"""(?:[^\\]|\\.)*?"""|"(?:[^"\\\n]|\\.)*"|<[^>]*>|@prefix|@base|PREFIX|BASE|\^\^|@[A-Za-z-]+|[;,.\[\]()](?=\s|$|[\[\]();,.])|[^\s;,\[\]()"<>]+?(?=[;,\[\]()]|\.?\s|\.?$)|[;,.\[\]()]', re.S)


def turtle(text: str) -> list[tuple[str, str, str, str]]:
    """(s, p, o, kind): kind is uri, literal or blank."""
    tokens = [t for t in _TOKEN.findall(text) if not t.startswith("#")]
    prefixes: dict[str, str] = {}
    out, at, blank = [], 0, 0

    def name(t: str) -> str:
        if t.startswith("<"):
            return t[1:-1]
        if t == "a":
            return RDF + "type"
        head, _, tail = t.partition(":")
        return prefixes.get(head, head + ":") + tail

    def term() -> tuple[str, str]:
        nonlocal at, blank
        t = tokens[at]
        at += 1
        if t == "[":
            blank += 1
            own = f"_:b{blank}"
            body(own, "]")
            return own, "blank"
        if t == "(":
            blank += 1
            own = first = f"_:b{blank}"
            if tokens[at] == ")":
                at += 1
                return RDF + "nil", "uri"
            while True:
                o, kind = term()
                out.append((own, RDF + "first", o, kind))
                if tokens[at] == ")":
                    at += 1
                    out.append((own, RDF + "rest", RDF + "nil", "uri"))
                    return first, "blank"
                blank += 1
                out.append((own, RDF + "rest", f"_:b{blank}", "blank"))
                own = f"_:b{blank}"
        if t.startswith('"'):
            value = t[3:-3] if t.startswith('"""') else t[1:-1]
            if at < len(tokens) and tokens[at] == "^^":
                at += 2
            elif at < len(tokens) and re.fullmatch(r"@[A-Za-z-]+", tokens[at]):
                at += 1
            return re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t", "r": "\r"}.get(m[1], m[1]), value), "literal"
        if t.startswith("_:"):
            return t, "blank"
        if re.fullmatch(r"[+-]?[0-9.]+|true|false", t):
            return t, "literal"
        return name(t), "uri"

    def body(s: str, end: str) -> None:
        nonlocal at
        while tokens[at] != end:
            if tokens[at] == ";":
                at += 1
                continue
            p = name(tokens[at])
            at += 1
            while True:
                o, kind = term()
                out.append((s, p, o, kind))
                if tokens[at] != ",":
                    break
                at += 1
        at += 1

    while at < len(tokens):
        if tokens[at] in ("@prefix", "PREFIX"):
            prefixes[tokens[at + 1].rstrip(":").split(":")[0]] = tokens[at + 2][1:-1]
            at += 4 if at + 3 < len(tokens) and tokens[at + 3] == "." else 3
        elif tokens[at] in ("@base", "BASE"):
            at += 3 if at + 2 < len(tokens) and tokens[at + 2] == "." else 2
        elif tokens[at] == ".":
            at += 1
        else:
            body(term()[0], ".")
    return out


def rdf_xml(text: str) -> list[tuple[str, str, str, str]]:
    """(s, p, o, kind) from RDF/XML, with entities of the document type resolved."""
    for key, value in re.findall(r'<!ENTITY\s+(\S+)\s+"([^"]*)"', text):
        text = text.replace(f"&{key};", value)
    root = ElementTree.fromstring(re.sub(r"<!DOCTYPE[^\[>]*(\[.*?\])?\s*>", "", text, flags=re.S))
    base = root.get("{http://www.w3.org/XML/1998/namespace}base", "")
    out, blank = [], 0
    uri = lambda tag: "".join(tag[1:].split("}", 1)) if tag.startswith("{") else tag

    def full(x: str) -> str:
        return base + x if x.startswith("#") else x

    def node(e) -> str:
        nonlocal blank
        s = e.get(f"{{{RDF}}}about")
        if s is None and e.get(f"{{{RDF}}}ID") is not None:
            s = "#" + e.get(f"{{{RDF}}}ID")
        if s is None:
            blank += 1
            s = f"_:b{blank}"
        s = full(s)
        if uri(e.tag) != RDF + "Description":
            out.append((s, RDF + "type", uri(e.tag), "uri"))
        for p in e:
            o = p.get(f"{{{RDF}}}resource")
            if o is not None:
                out.append((s, uri(p.tag), full(o), "uri"))
            elif len(p):
                for child in p:
                    own = node(child)
                    out.append((s, uri(p.tag), own, "blank" if own.startswith("_:") else "uri"))
            else:
                out.append((s, uri(p.tag), (p.text or "").strip(), "literal"))
        return s

    for e in root:
        node(e)
    return out


def triples(spark: SparkSession, path: str) -> DataFrame:
    """(file, s, p, o, kind, error) of all .ttl, .owl and .rdf files below a folder; one error row per bad file.

    A file is parsed by one task, as its prefixes require; many files are read side by side."""
    rows = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.{ttl,owl,rdf}").text(path, wholetext=True)

    def parse(batches):
        import pandas as pd

        for b in batches:
            out = []
            for file, value in zip(b["file"], b["value"]):
                try:
                    found = turtle(value) if file.endswith(".ttl") else rdf_xml(value)
                    out += [(file, *t, None) for t in found]
                except (ElementTree.ParseError, IndexError, KeyError, ValueError) as e:
                    out.append((file, None, None, None, None, str(e)[:200]))
            yield pd.DataFrame(out, columns=["file", "s", "p", "o", "kind", "error"])

    return rows.select(F.col("_metadata.file_path").alias("file"), "value").mapInPandas(parse, "file string, s string, p string, o string, kind string, error string")


def schema_tables(rows: DataFrame) -> dict[str, DataFrame]:
    """classes, subclass_edges, properties, prop_domain, prop_range from (s, p, o)."""
    ends = lambda c, *names: F.col(c).rlike("[#/](" + "|".join(names) + ")$")
    label = rows.where(ends("p", "label")).groupBy("s").agg(F.min("o").alias("name"))
    comment = rows.where(ends("p", "comment")).groupBy("s").agg(F.min("o").alias("comment"))
    typed = lambda *names: rows.where(ends("p", "type") & ends("o", *names) & ~F.col("s").startswith("_:"))
    described = lambda df: df.join(label, "s", "left").join(comment, "s", "left").withColumnRenamed("s", "uri")
    classes = described(typed("Class", "NodeShape").select("s").distinct())
    kind = F.when(ends("o", "ObjectProperty"), "ObjectProperty").otherwise("DatatypeProperty")
    properties = described(typed("ObjectProperty", "DatatypeProperty", "DataProperty").groupBy("s").agg(F.max(kind).alias("type")))
    link = lambda p, a, b: rows.where(ends("p", p) & ~F.col("o").startswith("_:") & ~F.col("s").startswith("_:")).select(F.col("s").alias(a), F.col("o").alias(b)).distinct()
    known = classes.select("uri")
    edges = link("subClassOf", "child", "parent").where("child <> parent")
    edges = edges.join(known.withColumnRenamed("uri", "child"), "child", "left_semi").join(known.withColumnRenamed("uri", "parent"), "parent", "left_semi")
    return {"classes": classes, "subclass_edges": edges, "properties": properties, "prop_domain": link("domain", "uri", "class_uri"), "prop_range": link("range", "uri", "class_uri")}

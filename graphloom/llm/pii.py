"""Personal data: exact base patterns, and information-theoretic sanitisation of terms that give entities away.

DataFrame functions only. Base spans are leftmost, non-overlapping matches of four patterns with their checks
(octets up to 255, 14 to 19 digits passing Luhn, 10 to 15 digits).

The method follows the disclosure-control literature on automatic sanitisation: each distinct base value is a
protected entity e, and so is the pool that it shares with others (an address's domain, a network, a card's issuer, a
dialling prefix), since most values occur in one text only; words within ``CONTEXT`` code points of it are its
candidate terms t. Over the whole corpus, counting each distinct text once,
    information of e        IC(e)    = log2(N / n(e))
    what t reveals about e  PMI(e;t) = log2(N * n(e,t) / (n(e) * n(t)))
and t discloses e when PMI(e;t) >= ``DISCLOSED`` * IC(e), with n(e,t) >= ``SUPPORT`` texts behind the estimate
(without it every word seen once would disclose its neighbour). Every occurrence of a disclosing term in the
corpus is a span of kind ``term``; sanitising generalises base spans to their kind and removes terms.

Movement: entities and (entity, term) pairs are counted with partial aggregation; words are counted only for
candidate terms, which are broadcast while they are few (``maybe_broadcast``) and joined by shuffle beyond; texts
themselves never shuffle unless the documents with disclosing terms outgrow that bound.

Defined results: null text = empty text = no spans; ties and repeated rows give equal spans; documents may share
a doc_id (terms are joined on doc_id and text hash); extra columns stay; an empty table gives an empty table.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, documents, forget, let, maybe_broadcast, running, written

KINDS = ("email", "ip", "card", "phone", "term")
CONTEXT = 64
SUPPORT = 3
DISCLOSED = 0.8
#: Shortest word that counts as a term.
LETTERS = 3

WORD = r"\p{L}\p{N}_"
# The same matches as the plain patterns, in linear time: a run of leading characters fails or succeeds as a
# whole, so a match starts where the run starts or where the last match ended (\G), and runs aren't given back.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9]++(?:[\x20-][0-9]++)*+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def _valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        small = lambda p: (F.length(p) < 3) | ((F.length(p) == 3) & (p <= F.lit("255")))
        return F.forall(F.transform(F.split(m, r"\."), lambda p: F.regexp_replace(p, "^0+", "")), small)
    if kind == "card":
        digits = F.regexp_replace(m, "[^0-9]", "")
        return F.length(digits).between(14, 19) & F.coalesce(F.call_function("luhn_check", digits), F.lit(False))
    if kind == "phone":
        return F.length(F.regexp_replace(m, "[^0-9]", "")).between(10, 15)
    return F.lit(True)


def _worth(kind: str, text: Column) -> Column:
    """A cheap test that a text without spans of this kind mostly fails."""
    return {
        "email": text.contains("@"),
        "ip": text.contains(".") & text.rlike("[0-9]"),
        "card": text.rlike("[0-9]"),
        "phone": text.contains("+"),
    }[kind]


_EMPTY = "array<struct<start:int,no:int,end:int,value:string>>"


def _located(kind: str, parts: Column, matches: Column) -> Column:
    """Spans from the texts between matches and the matches, by running code-point sums."""
    pairs = F.arrays_zip(F.slice(parts, 1, F.size(matches)).alias("part"), matches.alias("match"))
    before = running(F.transform(pairs, lambda x: F.length(x["part"]) + F.length(x["match"])), lambda a, b: a + b)

    def span(x: Column, at: Column) -> Column:
        start = at + F.length(x["part"])
        return F.when(_valid(kind, x["match"]), F.struct(start.alias("start"), F.lit(KINDS.index(kind)).alias("no"), (start + F.length(x["match"])).alias("end"), x["match"].alias("value")))

    return F.filter(F.zip_with(pairs, before, span), lambda x: x.isNotNull()).cast(_EMPTY)


def with_base_spans(packed: DataFrame) -> DataFrame:
    """Adds ``base``, the sorted spans of the four kinds, to rows that have a non-null ``text``."""
    text = F.col("text")
    cut = {}
    for kind, pattern in PATTERNS.items():
        none = F.array().cast("array<string>")
        cut[f"p_{kind}"] = F.when(_worth(kind, text), F.split(text, pattern, -1)).otherwise(none)
        cut[f"m_{kind}"] = F.when(_worth(kind, text), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(none)
    found = packed.withColumns(cut)
    # Most texts have no match at all; the folds below then run over nothing.
    spans = [F.when(F.size(f"m_{kind}") > 0, _located(kind, F.col(f"p_{kind}"), F.col(f"m_{kind}"))).otherwise(F.array().cast(_EMPTY)) for kind in PATTERNS]
    return found.withColumn("base", F.array_sort(F.concat(*spans))).drop(*cut)


def _packed(docs: DataFrame, text: str) -> DataFrame:
    whole = F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("id"), whole.alias("text"), F.xxhash64(whole).alias("h"))


def _context(own: Column, first: Column, x: Column, length: Column) -> Column:
    """Words near a span, lower-cased and distinct. A word that the window's outer edge may cut is left out; the
    text's own edges cut none. ``own`` is the text from code point ``first`` on."""
    left = F.substring(own, F.greatest(x["start"] - CONTEXT, F.lit(0)) - first + 1, F.least(x["start"], F.lit(CONTEXT)))
    right = F.substring(own, x["end"] - first + 1, F.lit(CONTEXT))
    left = F.when(x["start"] <= CONTEXT, F.concat(F.lit(" "), left)).otherwise(left)
    right = F.when(x["end"] + CONTEXT >= length, F.concat(right, F.lit(" "))).otherwise(right)
    before = F.regexp_extract_all(left, F.lit(f"(?<=[^{WORD}])[{WORD}]{{{LETTERS},}}"), F.lit(0))
    after = F.regexp_extract_all(right, F.lit(f"[{WORD}]{{{LETTERS},}}(?=[^{WORD}])"), F.lit(0))
    return F.array_distinct(F.transform(F.concat(before, after), F.lower))


def _contexts(text: Column, base: Column) -> Column:
    """(entities, terms) of each span. The text is cut for many neighbouring spans at once, as each cut counts code
    points from its text's beginning."""
    first = lambda g: F.greatest(F.get(g, F.lit(0))["start"] - CONTEXT, F.lit(0))
    parts = F.transform(chunks(base), lambda g: F.struct(g.alias("g"), first(g).alias("first"), (F.array_max(F.transform(g, lambda x: x["end"])) + CONTEXT).alias("end")))
    parts = F.transform(parts, lambda p: F.struct(p["g"].alias("g"), p["first"].alias("first"), F.substring(text, p["first"] + 1, p["end"] - p["first"]).alias("own")))

    def listed(length: Column) -> Column:
        of = lambda p: F.transform(p["g"], lambda x: F.struct(_entities(x).alias("entities"), _context(p["own"], p["first"], x, length).alias("terms")))
        return F.flatten(F.transform(parts, of))

    return let(F.length(text), listed)


def _entities(x: Column) -> Column:
    """What a span protects: its value, and the pool that it shares with others of its kind. Most values occur in one
    text only, where nothing can be estimated; their domain, network, issuer or dialling prefix occurs in many."""
    value = F.lower(x["value"])
    digits = F.regexp_replace(value, "[^0-9]", "")
    pool = F.when(x["no"] == 0, F.substring_index(value, "@", -1)).when(x["no"] == 1, F.substring_index(value, ".", 2)).when(x["no"] == 2, F.substring(digits, 1, 6)).otherwise(F.substring(digits, 1, 5))
    return F.array(F.concat_ws(":", x["no"], value), F.concat_ws(":", x["no"], F.lit("pool"), pool))


def words(text: Column) -> Column:
    """The distinct lower-cased words of a text that may be terms."""
    return F.filter(F.array_distinct(F.split(F.lower(text), f"[^{WORD}]+")), lambda w: F.length(w) >= LETTERS)


def disclosing_terms(packed: DataFrame) -> DataFrame:
    """A written table (term) of the words that disclose some protected entity."""
    spark = packed.sparkSession
    seen = (
        with_base_spans(packed.select("text", "h"))
        .where(F.size("base") > 0)
        .select("h", F.explode(_contexts(F.col("text"), F.col("base"))).alias("x"))
        .select("h", F.explode("x.entities").alias("e"), "x.terms")
    )
    seen = written(seen, "pii-seen")
    known = seen.groupBy("e").agg(F.count_distinct("h").alias("n_e")).where(F.col("n_e") >= SUPPORT)
    known = written(known, "pii-entities")
    near = seen.join(maybe_broadcast(known.select("e"), 300_000), "e").select("e", "h", F.explode("terms").alias("term"))
    pairs = written(near.groupBy("e", "term").agg(F.count_distinct("h").alias("n_et")).where(F.col("n_et") >= SUPPORT), "pii-pairs")
    if not pairs.head(1):
        return spark.createDataFrame([], "term string")
    n = F.lit(float(packed.select(F.count_distinct("h")).first()[0]))
    reveals = lambda n_t: F.log2(n * F.col("n_et") / (F.col("n_e") * F.col(n_t)))
    information = F.log2(n / F.col("n_e"))
    # A term occurs in at least the texts that have it near some entity. What fails with that count fails with
    # the true one as well, so that only words rare near entities are counted over the corpus.
    near_any = seen.select("h", F.explode("terms").alias("term")).groupBy("term").agg(F.count_distinct("h").alias("least"))
    pairs = pairs.join(known, "e").join(near_any, "term").where((information > 0) & (reveals("least") >= DISCLOSED * information))
    pairs = written(pairs, "pii-candidates")
    wanted = written(pairs.select("term").distinct(), "pii-words")
    occurring = packed.select("h", F.explode(words(F.col("text"))).alias("term")).join(maybe_broadcast(wanted, 300_000), "term")
    counts = occurring.groupBy("term").agg(F.count_distinct("h").alias("n_t"))
    judged = pairs.join(counts, "term").where(reveals("n_t") >= DISCLOSED * information)
    terms = written(judged.select("term").distinct(), "pii-terms")
    for old in (seen, known, pairs, wanted):
        forget(old)
    return terms


def find(docs: DataFrame, text: str = "text") -> DataFrame:
    """(row, text, spans): each row of ``docs`` as a struct, its whole text and all its spans in order."""
    packed = _packed(docs, text)
    terms = disclosing_terms(packed)
    based = with_base_spans(packed)
    if not terms.head(1):
        return based.select("row", "text", F.col("base").alias("spans"))
    holding = packed.select("id", "h", F.explode(words(F.col("text"))).alias("term")).join(maybe_broadcast(terms, 300_000), "term")
    holding = written(holding.groupBy("id", "h").agg(F.collect_set("term").alias("terms")), "pii-holding").withColumnsRenamed({"id": "id2", "h": "h2"})
    joined = based.join(maybe_broadcast(holding, 200_000), F.col("id").eqNullSafe(F.col("id2")) & (F.col("h") == F.col("h2")), "left")
    # Terms are words, so that the alternation needs no escaping.
    pattern = F.concat(F.lit(f"(?iu)(?<![{WORD}])(?:"), F.array_join("terms", "|"), F.lit(f")(?![{WORD}])"))
    cut = joined.withColumns({"p": F.when(F.col("terms").isNotNull(), F.split("text", pattern, -1)), "m": F.when(F.col("terms").isNotNull(), F.regexp_extract_all("text", pattern, F.lit(0)))})
    located = F.when(F.size("m") > 0, _located("term", F.col("p"), F.col("m"))).otherwise(F.array().cast(_EMPTY))
    found = cut.withColumn("located", located).select("row", "text", "base", F.when(F.size("located") > 0, F.array_sort(F.concat("base", "located"))).alias("all"))
    return found.select("row", "text", F.when(F.col("all").isNotNull(), _clear(F.col("all"))).otherwise(F.col("base")).alias("spans"))


def _clear(spans: Column) -> Column:
    """Sorted spans without the terms that overlap a base span. Terms don't overlap one another, so that a base span
    overlaps a term when it ends after the term's start and comes before it, or comes next and starts before its end."""
    is_term = lambda x: x["no"] == KINDS.index("term")
    reach = running(F.transform(spans, lambda x: F.when(is_term(x), 0).otherwise(x["end"])), F.greatest)
    following = F.concat(F.slice(spans, 2, F.greatest(F.size(spans) - 1, F.lit(0))), F.array(F.lit(None).cast(_EMPTY[6:-1])))
    near = F.arrays_zip(spans.alias("x"), reach.alias("reach"), following.alias("next"))
    hit = lambda z: is_term(z["x"]) & ((z["reach"] > z["x"]["start"]) | F.coalesce(~is_term(z["next"]) & (z["next"]["start"] < z["x"]["end"]), F.lit(False)))
    return F.transform(F.filter(near, lambda z: ~hit(z)), lambda z: z["x"])


def _listed(spans: Column) -> Column:
    name = lambda no: reduce(lambda c, k: c.when(no == k[0], k[1]), enumerate(KINDS), F)
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", name(x["no"]), x["start"], x["end"])), ",")


def sanitised(text: Column, spans: Column) -> Column:
    """The text with base spans generalised to [KIND] and terms removed; overlapping spans go as one."""
    label = lambda no: reduce(lambda c, k: c.when(no == k[0], f"[{k[1].upper()}]"), enumerate(KINDS[:4]), F).otherwise("")
    reach = running(F.transform(spans, lambda x: x["end"]), F.greatest)
    zipped = F.zip_with(spans, reach, lambda x, at: F.struct(at.alias("at"), x["start"].alias("start"), label(x["no"]).alias("label")))
    # Texts are cut in two steps, as each cut counts code points from its text's beginning.
    groups = let(F.filter(zipped, lambda z: z["start"] >= z["at"]), chunks)
    parts = F.transform(groups, lambda g: F.struct(g.alias("g"), F.get(g, F.lit(0))["at"].alias("base"), F.element_at(g, -1)["start"].alias("end")))
    parts = F.transform(parts, lambda p: F.struct(p["g"].alias("g"), p["base"].alias("base"), F.substring(text, p["base"] + 1, p["end"] - p["base"]).alias("own")))
    cut = F.transform(parts, lambda p: F.array_join(F.transform(p["g"], lambda z: F.concat(F.substring(p["own"], z["at"] - p["base"] + 1, z["start"] - z["at"]), z["label"])), ""))
    return F.concat(F.array_join(cut, ""), F.substring(text, F.array_max(F.transform(spans, lambda x: x["end"])) + 1, F.length(text)))


def sanitise(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with its text sanitised; other columns, null texts and texts without spans stay as they are."""
    found = find(docs, text)
    new = F.when(F.size("spans") > 0, sanitised(F.col("text"), F.col("spans"))).otherwise(F.col(f"row.`{text}`"))
    return found.select(*[new.alias(c) if c == text else F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(documents(spark, sf_dir).select("doc_id", "text"))
    base = F.filter("spans", lambda x: x["no"] < 4)
    count = lambda no: F.size(F.filter("spans", lambda x: x["no"] == no)).cast("bigint")
    return found.select(
        F.col("row.doc_id").alias("doc_id"),
        *[count(i).alias(f"n_{k}") for i, k in enumerate(KINDS[:4])],
        F.sha2(_listed(base).cast("binary"), 256).alias("base_sha256"),
        _listed(F.col("spans")).alias("spans"),
    )


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: texts are sanitised, and n_chars follows."""
    out = sanitise(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out

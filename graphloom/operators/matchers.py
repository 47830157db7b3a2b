"""Matchers behind one interface: each gives the pairs (doc, i, j, score) of predictions and gold rows that match."""

from __future__ import annotations

from collections.abc import Callable
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.similarity import jaccard
from ..functions.text import blank_tokens
from .graph import written


class Matcher(Protocol):
    def match_entities(self, predicted: DataFrame, gold: DataFrame) -> DataFrame:
        """(doc, i, name) and (doc, j, name) -> (doc, i, j, score)."""

    def match_triples(self, predicted: DataFrame, gold: DataFrame) -> DataFrame:
        """(doc, i, subject, relation, object) and the same with j -> (doc, i, j, score)."""


def _sides(predicted: DataFrame, gold: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    p = predicted.select("doc", "i", *[F.col(f).alias(f"p_{f}") for f in fields])
    return p.join(gold.select("doc", "j", *[F.col(f).alias(f"g_{f}") for f in fields]), "doc")


class _Scored:
    """Rows of one document whose score, a function of both sides' fields, reaches the bar."""

    def __init__(self, entity: Callable[[Column, Column], Column], triple: Callable[[dict, dict], tuple[Column, Column]], bar: float):
        self.entity, self.triple, self.bar = entity, triple, bar

    def match_entities(self, predicted: DataFrame, gold: DataFrame) -> DataFrame:
        scored = _sides(predicted, gold, ("name",)).withColumn("score", self.entity(F.col("p_name"), F.col("g_name")))
        return scored.where(F.col("score") >= self.bar).select("doc", "i", "j", "score")

    def match_triples(self, predicted: DataFrame, gold: DataFrame) -> DataFrame:
        fields = ("subject", "relation", "object")
        of = lambda k: {f: F.col(f"{k}_{f}") for f in fields}
        score, accepted = self.triple(of("p"), of("g"))
        return _sides(predicted, gold, fields).where(accepted).withColumn("score", score).select("doc", "i", "j", "score")


def _overlap(a: Column, b: Column) -> Column:
    return jaccard(blank_tokens(a), blank_tokens(b))


def exact() -> Matcher:
    same = lambda a, b: (F.lower(F.trim(a)) == F.lower(F.trim(b))).cast("double")
    every = lambda p, g: same(p["subject"], g["subject"]) * same(p["relation"], g["relation"]) * same(p["object"], g["object"])
    return _Scored(same, lambda p, g: (every(p, g), every(p, g) > 0), 1.0)


def token_overlap(bar: float = 0.5) -> Matcher:
    """Jaccard similarity of the whole triple's tokens."""
    line = lambda x: F.concat_ws(" ", x["subject"], x["relation"], x["object"])
    return _Scored(_overlap, lambda p, g: (_overlap(line(p), line(g)), _overlap(line(p), line(g)) >= bar), bar)


def independent_slots(bar: float = 0.5) -> Matcher:
    """Subject and object must each reach the bar by themselves; the score is their mean."""

    def triple(p: dict, g: dict) -> tuple[Column, Column]:
        s, o = _overlap(p["subject"], g["subject"]), _overlap(p["object"], g["object"])
        return (s + o) / 2, (s >= bar) & (o >= bar)

    return _Scored(_overlap, triple, bar)


def similar_sets(sets: DataFrame, bar: float) -> DataFrame:
    """(x, y, score) for all ordered pairs of distinct token sets, x = y included, whose Jaccard similarity is at least
    ``bar``. sets: (x, tokens), x the sorted tokens as text. Two such sets share one of the first n - ceil(bar * n) + 1
    tokens in any fixed order, here from the rarest; sets without tokens meet by an empty one."""
    each = sets.select("x", F.size("tokens").alias("n"), F.explode(F.when(F.size("tokens") == 0, F.array(F.lit(""))).otherwise(F.col("tokens"))).alias("t"))
    df = each.groupBy("t").agg(F.count("*").alias("df"))
    ordered = each.join(df, "t").groupBy("x", "n").agg(F.sort_array(F.collect_list(F.struct("df", "t"))).alias("ts"))
    cut = F.greatest(F.col("n") - F.ceil(F.col("n") * bar - 1e-9).cast("int") + 1, F.lit(1))
    first = ordered.select("x", "n", F.explode(F.slice("ts", F.lit(1), cut)).alias("t")).select("x", "n", "t.t")
    close = F.least("n", "m") >= bar * F.greatest("n", "m") - 1e-9
    met = first.join(first.select(F.col("x").alias("y"), F.col("n").alias("m"), "t"), "t").where(close).select("x", "y").distinct()
    mine, other = sets.select("x", F.col("tokens").alias("p")), sets.select(F.col("x").alias("y"), F.col("tokens").alias("g"))
    scored = met.join(mine, "x").join(other, "y").select("x", "y", jaccard(F.col("p"), F.col("g")).alias("score"))
    return scored.where(F.col("score") >= bar)


def slot_pairs(predicted: DataFrame, gold: DataFrame, s_bar: float, o_bar: float) -> DataFrame:
    """(doc, i, j, score): rows of one document whose subjects' tokens agree to ``s_bar`` and objects' to ``o_bar``.

    (doc, i, s, o) and (doc, j, s, o), s and o arrays of distinct tokens. Similarities are computed once for each two
    distinct token sets, then for classes of equal rows; rows meet only in pairs that are part of the result."""
    text = lambda c: F.array_join(F.sort_array(c), " ")
    keyed = lambda df, k: df.where("doc IS NOT NULL AND s IS NOT NULL AND o IS NOT NULL").select("doc", k, text("s").alias("sx"), text("o").alias("ox"), "s", "o")
    p, g = keyed(predicted, "i"), keyed(gold, "j")
    sets = lambda c: p.select(F.col(f"{c}x").alias("x"), F.col(c).alias("tokens")).union(g.select(f"{c}x", c)).groupBy("x").agg(F.first("tokens").alias("tokens"))
    near = lambda c, bar: written(similar_sets(written(sets(c)), bar)).select(F.col("x").alias(f"p{c}"), F.col("y").alias(f"g{c}"), F.col("score").alias(f"{c}_score"))
    s, o = near("s", s_bar), near("o", o_bar)
    own = lambda df, k: df.select("doc", F.col("sx").alias(f"{k}s"), F.col("ox").alias(f"{k}o"))
    classes = own(p, "p").distinct().join(s, "ps").join(own(g, "g").distinct(), ["doc", "gs"]).join(o, ["po", "go"])
    score = ((F.col("s_score") + F.col("o_score")) / 2).alias("score")
    links = classes.select("doc", "ps", "po", "gs", "go", score)
    mine = p.select("doc", F.col("sx").alias("ps"), F.col("ox").alias("po"), "i")
    other = g.select("doc", F.col("sx").alias("gs"), F.col("ox").alias("go"), "j")
    return links.join(mine, ["doc", "ps", "po"]).select("doc", "gs", "go", "i", "score").join(other, ["doc", "gs", "go"]).select("doc", "i", "j", "score")


MODES: dict[str, Callable[..., Matcher]] = {"exact": exact, "jaccard": token_overlap, "slots": independent_slots}


def matcher(mode: str, **arguments) -> Matcher:
    """The matcher of a mode; an unknown mode is an error that lists the known ones."""
    if mode not in MODES:
        raise ValueError(f"unknown matcher {mode!r}: one of {', '.join(sorted(MODES))}")
    return MODES[mode](**arguments)


def judged_pairs(pairs: DataFrame, once: bool) -> DataFrame:
    """Accepted pairs (doc, i, j) of a judge. ``once``: a gold row counts for its first prediction only, as triples do;
    else every pair stays, as entities do before typing."""
    own = pairs.select("doc", "i", "j").distinct()
    return own.groupBy("doc", "j").agg(F.min("i").alias("i")).select("doc", "i", "j") if once else own


def decided(candidates: DataFrame, decisions: DataFrame) -> DataFrame:
    """Candidates (doc, i, j, rank) after a person's decisions (doc, i, answer): ``y`` takes the best candidate, a number
    that candidate (from 1), ``n`` and ``s`` none; ``a`` takes the best one here and for all later predictions of the
    document without an answer; ``q`` ends it, so that what follows is undecided. Returns (doc, i, j, state)."""
    marks = decisions.groupBy("doc").agg(F.min(F.when(F.col("answer") == "a", F.col("i"))).alias("all_from"), F.min(F.when(F.col("answer") == "q", F.col("i"))).alias("quit_at"))
    own = candidates.groupBy("doc", "i").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "j"))), lambda x: x["j"]).alias("choices"))
    own = own.join(decisions, ["doc", "i"], "left").join(marks, "doc", "left")
    stopped = F.coalesce(F.col("i") >= F.col("quit_at"), F.lit(False))
    answer = F.when(stopped, "q").otherwise(F.coalesce("answer", F.when(F.col("i") > F.col("all_from"), "y")))
    number = F.when(answer.rlike("^[1-9][0-9]{0,8}$"), answer.cast("int"))
    j = F.when(answer.isin("y", "a"), F.get("choices", F.lit(0))).when(number.isNotNull(), F.get("choices", number - 1))
    state = F.when(j.isNotNull(), "matched").when(answer.isin("n", "s"), "rejected").when(number.isNotNull(), "rejected").otherwise("undecided")
    return own.select("doc", "i", j.alias("j"), state.alias("state"))

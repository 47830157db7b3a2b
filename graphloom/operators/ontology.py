"""Ontology tables: classes, subclass edges, properties with domains and ranges, shapes. All are data-sized."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import written

#: Rows of a table of classes that is broadcast at most, and rows of data that a task gets on average at most.
FEW = 100_000
TASK_ROWS = 1_000_000


def subclass_edges(triples: DataFrame) -> DataFrame:
    """(child, parent) from (s, p, o): local names, no loops, no blank nodes."""
    name = lambda c: F.lower(F.substring_index(F.substring_index(c, "/", -1), "#", -1))
    own = triples.where(F.col("p").endswith("subClassOf")).select(name("s").alias("child"), name("o").alias("parent"))
    return own.where((F.col("child") != F.col("parent")) & ~F.col("child").rlike("^n[0-9a-f]{24,}$") & ~F.col("parent").rlike("^n[0-9a-f]{24,}$")).distinct()


def bounded_closure(edges: DataFrame, depth: int = 2) -> DataFrame:
    """(child, ancestor, depth): shortest distance up to ``depth``, each class at distance 0 of itself."""
    nodes = edges.select(F.explode(F.array("child", "parent")).alias("child")).distinct()
    levels = [nodes.select("child", F.col("child").alias("ancestor"), F.lit(0).alias("depth"))]
    step = edges.select(F.col("child").alias("ancestor"), "parent")
    for d in range(1, depth + 1):
        levels.append(levels[-1].join(step, "ancestor").select("child", F.col("parent").alias("ancestor"), F.lit(d).alias("depth")).distinct())
    return reduce(DataFrame.union, levels).groupBy("child", "ancestor").agg(F.min("depth").alias("depth"))


def closure(edges: DataFrame) -> DataFrame:
    """(child, ancestor, depth) of any distance, self included; cycles end. Paths double each round."""
    nodes = edges.select(F.explode(F.array("child", "parent")).alias("child")).distinct()
    own = nodes.select("child", F.col("child").alias("ancestor"), F.lit(0).alias("depth"))
    known = written(own.union(edges.select("child", F.col("parent").alias("ancestor"), F.lit(1).alias("depth"))).groupBy("child", "ancestor").agg(F.min("depth").alias("depth")))
    count = known.count()
    while True:
        far = known.select(F.col("child").alias("ancestor"), F.col("ancestor").alias("top"), F.col("depth").alias("more"))
        known = written(known.join(far, "ancestor").select("child", F.col("top").alias("ancestor"), (F.col("depth") + F.col("more")).alias("depth")).groupBy("child", "ancestor").agg(F.min("depth").alias("depth")))
        if known.count() == count:
            return known
        count = known.count()


def distance(pairs: DataFrame, bounded: DataFrame) -> DataFrame:
    """Pairs (pred, gold) with the distance between them up or down the hierarchy, -1 when there is none."""
    up = bounded.select(F.col("child").alias("pred"), F.col("ancestor").alias("gold"), F.col("depth").alias("up"))
    down = bounded.select(F.col("ancestor").alias("pred"), F.col("child").alias("gold"), F.col("depth").alias("down"))
    joined = pairs.join(up, ["pred", "gold"], "left").join(down, ["pred", "gold"], "left")
    found = F.when(F.col("pred") == F.col("gold"), 0).otherwise(F.coalesce(F.least("up", "down"), F.lit(-1)))
    return joined.withColumn("depth", found).drop("up", "down")


def properties_for(classes: DataFrame, known: DataFrame, domain: DataFrame, properties: DataFrame) -> DataFrame:
    """(cls, prop): properties whose domain is empty or holds the class or an ancestor of it."""
    free = properties.select("prop").join(domain.select("prop").distinct(), "prop", "left_anti")
    open_ = classes.select("cls").crossJoin(F.broadcast(free))  # free: the few properties without a domain
    up = classes.join(known.select(F.col("child").alias("cls"), "ancestor"), "cls")
    bound = up.join(domain.select("prop", F.col("cls").alias("ancestor")), "ancestor").select("cls", "prop")
    return open_.select("cls", "prop").union(bound).distinct()


def violations(shapes: DataFrame, instances: DataFrame, values: DataFrame, known: DataFrame) -> DataFrame:
    """Instances with fewer or more values than a shape of their class or its ancestors allows.

    shapes: (target, path, min_count, max_count); instances: (s, cls); values: (s, path)."""
    bounds = written(known.select(F.col("child").alias("cls"), F.col("ancestor").alias("target")).join(shapes, "target").select("cls", "path", "min_count", "max_count").distinct())
    wanted = instances.join(F.broadcast(bounds) if bounds.count() <= FEW else bounds, "cls").select("s", "path", "min_count", "max_count")
    # Both sides lie by key in as many partitions as their rows need, so that a task's memory doesn't grow with them.
    rows, cores = instances.count() + values.count(), max(instances.sparkSession.sparkContext.defaultParallelism, 2)
    parts = max(min(cores, -(-rows // 50_000)), -(-rows // TASK_ROWS), 1)
    key = F.struct(F.col("s"), F.col("path")).alias("key")  # one column, so that constant paths don't cost another shuffle
    n = values.where("s IS NOT NULL AND path IS NOT NULL").select(key).repartition(parts, "key").groupBy("key").agg(F.count("*").alias("n"))
    counted = wanted.select(key, "min_count", "max_count").repartition(parts, "key").join(n, "key", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    kind = F.when(F.col("n") < F.col("min_count"), "too few").when(F.col("n") > F.col("max_count"), "too many")
    found = counted.withColumn("violation", kind).where("violation IS NOT NULL").distinct()
    return found.select("key.s", "key.path", "min_count", "max_count", "n", "violation")


def roots(classes: DataFrame, edges: DataFrame) -> DataFrame:
    """Classes without a known parent."""
    return classes.join(edges.select(F.col("child").alias("cls")).distinct(), "cls", "left_anti")


def _holding(bounds: DataFrame, known: DataFrame) -> DataFrame:
    """(prop, cls): each class at or below a class that bounds a property."""
    return bounds.select("prop", F.col("cls").alias("ancestor")).join(known.select(F.col("child").alias("cls"), "ancestor"), "ancestor").select("prop", "cls").distinct()


def properties_into(known: DataFrame, ranges: DataFrame) -> DataFrame:
    """(cls, prop): properties whose range holds the class or an ancestor of it; one without a range holds none."""
    return _holding(ranges, known).select("cls", "prop")


def validated(uses: DataFrame, known: DataFrame, domain: DataFrame, ranges: DataFrame) -> DataFrame:
    """``uses`` (subject, prop, object: class names) with ``domain_ok``, ``range_ok`` and ``valid``. No domain or no
    range means that any class will do."""

    def side(df: DataFrame, bounds: DataFrame, column: str, to: str) -> DataFrame:
        bound = bounds.select("prop", F.lit(True).alias("_bound")).distinct()
        hit = _holding(bounds, known).select("prop", F.col("cls").alias(column), F.lit(True).alias("_hit"))
        return df.join(bound, "prop", "left").join(hit, ["prop", column], "left").withColumn(to, F.col("_bound").isNull() | F.col("_hit").isNotNull()).drop("_bound", "_hit")

    both = side(side(uses, domain, "subject", "domain_ok"), ranges, "object", "range_ok")
    return both.withColumn("valid", F.col("domain_ok") & F.col("range_ok"))


def augmented(domain: DataFrame, shapes: DataFrame) -> DataFrame:
    """(prop, cls): the domains, and for each shape's path its target class."""
    return domain.select("prop", "cls").union(shapes.select(F.col("path").alias("prop"), F.col("target").alias("cls"))).distinct()


def shacl_shapes(triples: DataFrame) -> DataFrame:
    """(target, path, min_count, max_count, node) of the property shapes among (s, p, o) triples."""
    name = lambda c: F.lower(F.substring_index(F.substring_index(c, "/", -1), "#", -1))
    of = lambda p, to: triples.where(F.col("p").endswith("#" + p)).select("s", F.col("o").alias(to))
    held = of("targetClass", "target").join(of("property", "shape"), "s").select("target", F.col("shape").alias("s"))
    for p, to in (("path", "path"), ("minCount", "min_count"), ("maxCount", "max_count"), ("node", "node")):
        held = held.join(of(p, to), "s", "inner" if p == "path" else "left")
    return held.select(name("target").alias("target"), name("path").alias("path"), F.col("min_count").cast("int"), F.col("max_count").cast("int"), name("node").alias("node"))


def facets_of(known: DataFrame, facet_ranges: DataFrame, subproperties: DataFrame, shapes: DataFrame, facets: DataFrame) -> DataFrame:
    """(cls, facet) by four ways, united: the range of a facet property whose domain holds the class; the same for a
    property below one; a shape's node; a shape's path that names a facet. facet_ranges: (prop, domain, facet);
    subproperties: (prop, parent); shapes: (target, path, node); facets: (facet)."""
    up = known.select(F.col("child").alias("cls"), F.col("ancestor"))
    direct = facet_ranges.select("prop", F.col("domain").alias("ancestor"), "facet")
    below = subproperties.join(direct.withColumnRenamed("prop", "parent"), "parent").select("prop", "ancestor", "facet")
    own = shapes.select(F.col("target").alias("ancestor"), "path", "node")
    by_node = own.join(facets, own["node"] == facets["facet"]).select("ancestor", "facet")
    by_path = own.join(facets, own["path"] == facets["facet"]).select("ancestor", "facet")
    found = direct.select("ancestor", "facet").union(below.select("ancestor", "facet")).union(by_node).union(by_path)
    return up.join(found, "ancestor").select("cls", "facet").distinct()


def between(pairs: DataFrame, known: DataFrame, domain: DataFrame, ranges: DataFrame) -> DataFrame:
    """(s, o, prop, way) for pairs of classes: direct, inverse, and either with one side taken from its domain or range
    alone; of several ways to one property the first stays."""
    dom, ran = _holding(domain, known), _holding(ranges, known)
    side = lambda df, to: df.select("prop", F.col("cls").alias(to))
    ways = [
        pairs.join(side(dom, "s"), "s").join(side(ran, "o"), ["prop", "o"]),
        pairs.join(side(dom, "o"), "o").join(side(ran, "s"), ["prop", "s"]),
        pairs.join(side(dom, "s"), "s"),
        pairs.join(side(ran, "o"), "o"),
    ]
    found = reduce(DataFrame.union, [w.select("s", "o", "prop", F.lit(i + 1).alias("way")) for i, w in enumerate(ways)])
    return found.groupBy("s", "o", "prop").agg(F.min("way").alias("way"))

"""Graphs of (src, dst) edges: components, main nodes, alignment."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder the session shares: spark.checkpoint.dir. Only in local mode is one made where it is unset; on a
    cluster that is an error, as other machines don't see a local folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="graphloom-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def written(df: DataFrame) -> DataFrame:
    """Write to the shared folder and read back."""
    path = f"{shared_folder(df.sparkSession)}/graph-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def components(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(node, component): the smallest node that is connected with each node.

    Minimum-label propagation with pointer jumping: rounds grow with the logarithm of a path's length, and each
    round is written, so that plans stay short and lost executors cost one round."""
    ways = F.explode(F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst"))))  # edges are made once
    both = written(edges.where("src <> dst").select(ways.alias("e")).select("e.src", "e.dst").distinct())
    all_nodes = both.select(F.col("src").alias("node")).distinct()
    if nodes is not None:
        all_nodes = all_nodes.union(nodes.select("node")).distinct()
    labels = written(all_nodes.select("node", F.col("node").alias("component")))
    while True:
        near = both.join(labels.select(F.col("node").alias("dst"), "component"), "dst").groupBy(F.col("src").alias("node")).agg(F.min("component").alias("m"))
        step = labels.join(near, "node", "left").select("node", F.col("component").alias("old"), F.least("component", F.coalesce("m", "component")).alias("mid"))
        jump = labels.select(F.col("node").alias("mid"), F.col("component").alias("up"))
        new = written(step.join(jump, "mid").select("node", "old", F.least("mid", "up").alias("component")))
        labels = new.select("node", "component")
        if not new.where("old <> component").head(1):
            return labels


def degrees(edges: DataFrame) -> DataFrame:
    """Edge ends at each node; a loop counts twice."""
    return edges.select(F.explode(F.array("src", "dst")).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))


def main_nodes(labels: DataFrame, degree: DataFrame) -> DataFrame:
    """Per component its size and the node of the highest degree, the smallest of ties."""
    ranked = labels.join(degree, "node", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    return ranked.groupBy("component").agg(F.count("*").alias("size"), F.max_by("node", F.struct("degree", -F.col("node"))).alias("main_node"), F.max("degree").alias("degree"))


def prune_islands(labels: DataFrame, min_size: int = 1) -> DataFrame:
    """Nodes of components of over ``min_size`` nodes."""
    size = labels.groupBy("component").agg(F.count("*").alias("size")).where(F.col("size") > min_size)
    return labels.join(size, "component")


def align(mentions: DataFrame, pairs: DataFrame) -> DataFrame:
    """(mention, entity): each mention's cluster is itself and its direct neighbours; equal clusters are one
    entity, entities are numbered by their smallest mention (then by members), and of several clusters with a
    mention the last one wins. Clusters are not merged transitively.

    mentions: (kind, mention); pairs: (kind, a, b) with both directions."""
    near = mentions.select("kind", F.col("mention").alias("a"), F.col("mention").alias("b")).union(pairs.select("kind", "a", "b"))
    clusters = near.groupBy("kind", "a").agg(F.array_sort(F.collect_set("b")).alias("members")).select("kind", "members").distinct()
    member = clusters.select("kind", F.explode("members").alias("mention"), F.struct(F.element_at("members", 1).alias("first"), "members").alias("order"))
    last = member.groupBy("kind", "mention").agg(F.max("order").alias("order"))
    return last.select("kind", "mention", F.col("order.first").alias("entity"), F.size("order.members").alias("cluster_size"))

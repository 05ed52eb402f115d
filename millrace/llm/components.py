"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .workspace import Workspace


def components(nodes: DataFrame, links: DataFrame, space: Workspace) -> DataFrame:
    """(node, label): the smallest starting label among all nodes that links reach.

    ``nodes`` has (node, label), one row per node; ``links`` (a, b) may name nodes in any order and repeat itself.
    Nodes without links are not touched. Each round gives every linked node the smallest label of its neighbours, and
    then the label of the node that this label came from, so that the distance covered doubles; the rounds
    end when no label changes. Every round only moves the linked nodes and is written to the shared folder.
    """
    both = space.keep(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct())
    linked = both.select(F.col("a").alias("node")).distinct()
    # The smallest name so far and the node that it came from; a null is larger than any name.
    label = F.struct(F.col("label").isNull().alias("none"), F.col("label").alias("name"), F.col("node").alias("at"))
    now = space.keep(nodes.join(linked, "node").select("node", label.alias("label")))
    while True:
        near = both.join(now.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        step = now.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        parent = now.select(F.col("node").alias("at"), F.col("label").alias("far"))
        new = space.keep(step.withColumn("at", F.col("label.at")).join(parent, "at").select(
            "node", F.least("label", "far").alias("label"), (F.least("label", "far") < F.col("old")).alias("changed")))
        moved = new.where("changed").limit(1).count()
        now = new.select("node", "label")
        if not moved:
            return now.select("node", F.col("label.name").alias("label"))

"""Connected components of an edge table by distributed hooking, pointer jumping and contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txsentinel.session import materialize


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): every node of ``edges`` with the smallest node it reaches.

    Edges with a null end link nothing; an edge from a node to itself lists the node.  A round
    hooks every node to its smallest neighbour (partial aggregation, so a node with many edges
    costs one row per task), follows the hooks to their roots by doubling, and replaces the edges
    by the distinct edges between roots.  Edges shrink fast, and rounds end when none is left.
    Every step is a table in the shared folder.
    """
    low, high = F.least(F.col(a), F.col(b)), F.greatest(F.col(a), F.col(b))
    links = materialize(edges.where(F.col(a).isNotNull() & F.col(b).isNotNull())
                        .select(low.alias("a"), high.alias("b")).distinct(), "cc-edges")
    labels = None
    while True:
        hooks = (links.select(F.col("a").alias("node"), F.col("b").alias("next"))
                 .unionByName(links.select(F.col("b").alias("node"), F.col("a").alias("next")))
                 .groupBy("node").agg(F.min("next").alias("next"))
                 .select("node", F.least("node", "next").alias("root")))
        hooks = _roots(materialize(hooks, "cc-hooks"))
        if labels is None:
            labels = hooks.select("node", F.col("root").alias("component"))
        else:
            up = hooks.select(F.col("node").alias("component"), "root")
            labels = materialize(labels.join(up, "component", "left").select(
                "node", F.coalesce("root", "component").alias("component")), "cc-labels")
        links = materialize(
            links.join(hooks.select(F.col("node").alias("a"), F.col("root").alias("x")), "a")
            .join(hooks.select(F.col("node").alias("b"), F.col("root").alias("y")), "b")
            .where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(),
            "cc-edges")
        if links.limit(1).count() == 0:
            return labels


def _roots(hooks: DataFrame) -> DataFrame:
    """Follow (node, root) hooks, which never point upwards, until every root is its own."""
    while True:
        up = hooks.select(F.col("node").alias("root"), F.col("root").alias("above"))
        jumped = materialize(hooks.join(up, "root").select(
            "node", F.col("above").alias("root"), (F.col("above") != F.col("root")).alias("moved")), "cc-hooks")
        hooks = jumped.select("node", "root")
        if jumped.where("moved").limit(1).count() == 0:
            return hooks

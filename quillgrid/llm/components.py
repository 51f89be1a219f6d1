"""Connected components of a link table, by labels that shrink and jump."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgrid.llm.common import materialise


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, root)`` for every node of a link; ``root`` is the component's least node.

    Each round takes the least label among a node's neighbours and then the label of that
    label, so that chains shorten by half. Labels are written each round; minima combine
    before the shuffle and joins on a hub are split as skewed ones. Null ends are ignored;
    repeated links and links to oneself do no harm; an empty table gives an empty one.
    """
    ends = links.select(F.col(a).alias("u"), F.col(b).alias("v")).dropna()
    edges = materialise(ends.union(ends.select("v", "u")).distinct(), "edges")
    labels = materialise(edges.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.least("u", "m").alias("root")), "labels")
    while True:
        near = edges.join(labels, edges["v"] == labels["node"]).groupBy("u").agg(F.min("root").alias("m"))
        lower = labels.join(near, labels["node"] == near["u"]).select("node", F.col("root").alias("was"), F.least("root", "m").alias("root"))
        jump = labels.select(F.col("node").alias("root"), F.col("root").alias("next"))
        moved = materialise(lower.join(jump, "root").select("node", "was", F.least("root", "next").alias("root")), "labels")
        labels = moved.select("node", "root")
        if moved.filter(F.col("root") != F.col("was")).isEmpty():
            return labels


def name_components(roots: DataFrame, names: DataFrame, name_col: str) -> DataFrame:
    """``(node, root, name)``: the least name in each component, over ``names`` (node, name).

    The names of components are written before nodes are joined to them: that join then
    reads plain tables, so that the planner can broadcast the names or split a component
    that holds many nodes.
    """
    held = roots.join(names, "node")
    least = materialise(held.groupBy("root").agg(F.min(name_col).alias("name")), "component-names")
    return roots.join(least, "root").select("node", "root", "name")

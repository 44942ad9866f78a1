"""Connected components of edge tables by repeated joins; nothing but counts reaches the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import stored


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of the edges; the component is its smallest node.

    Each turn takes the least label among a node's neighbours and then that label's own label, so that labels travel
    twice as far each time; it ends when none changes. Tables are stored between turns.
    """
    both = edges.select(F.col(a).alias("node"), F.col(b).alias("other")).union(edges.select(F.col(b).alias("node"), F.col(a).alias("other"))).filter("node <> other")
    both = stored(both.distinct(), "cc-edges")
    labels = stored(both.groupBy("node").agg(F.min("other").alias("least")).select("node", F.least("node", "least").alias("component")), "cc-labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("other"), "component"), "other").groupBy("node").agg(F.min("component").alias("near"))
        stepped = labels.join(near, "node").select("node", F.col("component").alias("was"), F.least("component", "near").alias("component"))
        jump = labels.select(F.col("node").alias("component"), F.col("component").alias("further"))
        stepped = stepped.join(jump, "component", "left").select("node", "was", F.least("component", F.coalesce("further", "component")).alias("component"))
        stepped = stored(stepped, "cc-labels")
        if stepped.filter("component <> was").isEmpty():
            return stepped.drop("was")
        labels = stepped.drop("was")

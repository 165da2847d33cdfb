"""Connected components of a sparse graph, by least labels and pointer jumps.

In each round a node takes the least of its label, its neighbours' labels and
the label of the node that its label names. Every round is one job over the
edges, its result a table in the shared folder, so lineage stays short and a
lost executor costs one round at most. Labels are combined before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from anualia.llm.common import salted_join
from anualia.scratch import materialize


def least_labels(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, label) for every node that has an edge.

    ``edges`` has a and b, both directions. ``nodes`` has node and label; a label
    is a struct in whose order the least wins and whose field ``node`` names the
    node that it comes from.
    """
    linked = edges.select(F.col("a").alias("node")).distinct()
    labels = materialize(nodes.join(linked, "node").select("node", "label"), "labels")
    while True:
        held = labels.select(F.col("node").alias("at"), F.col("label").alias("offer"))
        own = labels.select("node", "label", F.col("label").alias("old"))
        near = edges.join(held, F.col("b") == F.col("at")).select(F.col("a").alias("node"), F.col("offer").alias("label"))
        # All nodes of a large component name the same node, whose label is looked up once for each name.
        named = labels.select(F.col("label.node").alias("at")).distinct().join(held, "at")
        asking = labels.select("node", F.col("label.node").alias("at"))
        far = salted_join(asking, named, "at", F.col("node")).select("node", F.col("offer").alias("label"))
        offers = own.unionByName(near, allowMissingColumns=True).unionByName(far, allowMissingColumns=True)
        best = offers.groupBy("node").agg(F.min("label").alias("label"), F.min("old").alias("old"))
        labels = materialize(best.select("node", "label", (F.col("label") != F.col("old")).alias("moved")), "labels")
        if not labels.where("moved").limit(1).count():
            return labels.select("node", "label")

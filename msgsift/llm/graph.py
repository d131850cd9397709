"""Connected components of an edge table, as Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, comp): comp is the smallest node reachable. Nodes without an edge are not listed.

    Each round takes the smallest label among a node's neighbours and then
    jumps to the label of the label, so long chains take a logarithmic number
    of rounds. Every round is written to the shared folder: a lost executor
    costs one round's tasks.
    """
    one = edges.select(F.col(a).alias("src"), F.col(b).alias("dst")).where("src <> dst")
    both = materialize(one.unionByName(one.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct(),
                       "cc-edges")
    labels = materialize(both.groupBy(F.col("src").alias("node")).agg(F.min("dst").alias("m"))
                         .select("node", F.least("node", "m").alias("comp")), "cc-labels")
    while True:
        near = (both.join(labels, both["src"] == labels["node"]).groupBy(F.col("dst").alias("node"))
                .agg(F.min("comp").alias("near")))
        step = labels.join(near, "node").select("node", F.col("comp").alias("old"),
                                                F.least("comp", "near").alias("comp"))
        step = materialize(step, "cc-step")
        up = step.select(F.col("node").alias("comp"), F.col("comp").alias("up"))
        new = materialize(step.join(up, "comp").select("node", "old", F.least("comp", "up").alias("comp")), "cc-labels")
        if new.where("comp <> old").isEmpty():
            return new.select("node", "comp")
        labels = new.select("node", "comp")

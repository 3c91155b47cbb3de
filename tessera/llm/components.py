"""Connected components of a link table, by least labels and pointer jumping.

Each round a node takes the least label among its own and its neighbours', then the
label of its label. Rounds are joins and grouped minima over (node, label) and
(src, dst) tables, written to the shared folder; a few rounds suffice, as the
distance to the least node halves at least when labels are followed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.text import materialize


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label): label is the least node reachable, for each node that has a link. Nulls aren't nodes."""
    src = links.select(F.col(a).alias("src"), F.col(b).alias("dst")).where("src IS NOT NULL AND dst IS NOT NULL AND src <> dst")
    edges = materialize(src.unionByName(src.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct(), "edges")
    labels = materialize(edges.groupBy("src").agg(F.least(F.min("dst"), F.col("src")).alias("label")).withColumnRenamed("src", "node"), "labels")
    while True:
        near = edges.join(labels, F.col("dst") == F.col("node")).groupBy("src").agg(F.min("label").alias("near"))
        step = labels.join(near, F.col("node") == F.col("src")).select("node", F.least("label", "near").alias("label"), F.col("label").alias("old"))
        step = materialize(step, "labels")
        up = step.select(F.col("node").alias("up"), F.col("label").alias("up_label"))
        after = materialize(step.join(up, F.col("label") == F.col("up")).select("node", F.col("up_label").alias("label"), "old"), "labels")
        if after.where("label <> old").isEmpty():
            return after.select("node", "label")
        labels = after.select("node", "label")

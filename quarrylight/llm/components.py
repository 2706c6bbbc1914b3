"""Connected components of a link table by min-label propagation with pointer jumping; nothing comes to the driver but counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylight.llm.common import materialise


def components(links: DataFrame) -> DataFrame:
    """(node, comp) for every node of ``links`` (a, b): comp is the smallest node that can be reached.

    Each round every node takes the smallest label around it, then the label of that label; a written table cuts the
    lineage. The rounds number about the logarithm of the longest shortest path.
    """
    both = links.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(links.select(F.col("b").alias("node"), F.col("a").alias("other"))).distinct()
    both = materialise(both, "links")
    labels = materialise(both.groupBy("node").agg(F.least(F.col("node"), F.min("other")).alias("comp")), "labels")
    while True:
        around = both.join(labels.select(F.col("node").alias("other"), F.col("comp").alias("near")), "other").groupBy("node").agg(F.min("near").alias("near"))
        taken = labels.join(around, "node", "left").select("node", F.col("comp").alias("was"), F.least("comp", F.coalesce("near", "comp")).alias("comp"))
        jump = labels.select(F.col("node").alias("comp"), F.col("comp").alias("further"))
        taken = materialise(taken.join(jump, "comp", "left").select("node", "was", F.least("comp", F.coalesce("further", "comp")).alias("comp")), "labels")
        labels = taken.select("node", "comp")
        if taken.where("comp <> was").isEmpty():
            return labels

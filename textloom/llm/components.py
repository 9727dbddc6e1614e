"""Connected components over tables of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.workspace import freeze


def components(links: DataFrame) -> DataFrame:
    """``(node, label)`` for every node of ``links`` (columns ``a``, ``b``): the smallest node that
    it reaches. Labels spread to neighbours and then jump to their label's label, so
    the number of rounds grows with the logarithm of the longest path. Each round is a
    written table; nothing but the number of changes comes to the driver."""
    both = freeze(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
                  .where("a <> b").distinct(), "links")
    labels = freeze(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "labels")
    while True:
        near = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("label").alias("_near"))
        spread = labels.join(near, F.col("node") == F.col("a")).select(
            "node", F.least("label", "_near").alias("_label"), F.col("label").alias("_old"))
        heads = spread.select(F.col("node").alias("_head"), F.col("_label").alias("_to"))
        new = freeze(spread.join(heads, F.col("_label") == F.col("_head")).select(
            "node", F.least("_label", "_to").alias("label"), "_old"), "labels")
        changed = new.where("label <> _old").limit(1).count()
        labels = new.select("node", "label")
        if not changed:
            return labels

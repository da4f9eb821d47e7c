"""Connected components of links by least labels on written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from srcweave.session import write_counted, write_once


def connected(links: DataFrame) -> DataFrame:
    """``node`` and ``label``, the least node reachable, of the nodes of ``links`` (``a``, ``b``, longs).

    Each round takes the least label of the neighbours and then the label of the label,
    so chains settle in few rounds; a round is one written table.
    """
    both = write_once(
        links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    )
    labels = write_once(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")))
    while True:
        known = labels.select(F.col("node").alias("b"), F.col("label").alias("near"))
        least = both.join(known, "b").groupBy(F.col("a").alias("node")).agg(F.min("near").alias("near"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("far"))
        stepped = labels.join(least, "node").join(jump, "label", "left").select(
            "node", "label", F.least("label", "near", "far").alias("new")
        )
        stepped, changes = write_counted(stepped, F.sum((F.col("new") < F.col("label")).cast("long")))
        labels = stepped.select("node", F.col("new").alias("label"))
        if not changes:
            return labels

"""Connected components of a link table, by joins and aggregates alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.shared import settle


def roots(links: DataFrame) -> DataFrame:
    """``node, root``: the smallest node that each node of ``links`` (columns ``a``, ``b``) reaches.

    Each round takes the smallest label among a node's neighbours and then the label of that label, so a
    chain of n links takes about log n rounds and a star two. Labels are written to the shared folder
    between rounds. Loops, repeated links and an empty table are fine; nulls are no links.
    """
    links = links.filter("a is not null and b is not null and a != b").select("a", "b")
    both = settle(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = settle(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("_b")).select("node", F.least("node", "_b").alias("root")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "root"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("_near"))
        low = labels.join(near, "node").select("node", F.col("root").alias("_old"), F.least("root", "_near").alias("_low"))
        jump = low.join(labels.select(F.col("node").alias("_low"), F.col("root").alias("_far")), "_low", "left")
        moved = settle(jump.select("node", F.least("_low", "_far").alias("root"), (F.least("_low", "_far") != F.col("_old")).alias("_moved")), "labels")
        labels = moved.select("node", "root")
        if moved.filter("_moved").limit(1).count() == 0:
            return labels

"""Connected components by Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import stored


def components(links: DataFrame) -> DataFrame:
    """links (a long, b long) -> (node, comp) for every node of a link; comp is the least node of its component.

    Each round takes the least label among the neighbours and then the label of that label, so paths shrink by half
    at least. Every round is written out, so that small ones are joined by broadcast and read in few tasks; nothing is
    collected but a count.
    """
    edges = stored(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = stored(edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("comp")))
    while True:
        near = edges.join(labels, edges["b"] == labels["node"]).groupBy("a").agg(F.min("comp").alias("m"))
        hooked = labels.join(near, labels["node"] == near["a"]).select("node", F.col("comp").alias("old"), F.least("comp", "m").alias("up"))
        over = labels.select(F.col("node").alias("up"), F.col("comp").alias("top"))
        fresh = stored(hooked.join(over, "up").select("node", "old", F.least("up", "top").alias("comp")))
        changed = fresh.filter("comp <> old").limit(1).count()
        labels = fresh.select("node", "comp")
        if not changed:
            return labels

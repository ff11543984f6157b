"""Connected components of a table of links, by label propagation with shortcuts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.session import drop_stored, stored


def components(links: DataFrame) -> DataFrame:
    """node, component (the least node reachable) for every node of links (a, b).

    Each round points every node's neighbours, and the node, at the least of them (hash to
    min), which halves distances; it ends when no link changes. Rounds are written to the
    shared folder. Sums of a hub's links are taken before they are shuffled.
    """
    both = links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = stored(both)
    n, total = edges.count(), None
    while n:
        ways = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = ways.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        # Every link's upper end, and the link's lower end, now point at the lower end's least.
        pointed = edges.join(least.withColumnRenamed("a", "b"), "b").select("a", "b", "m")
        upper = edges.join(least, "a").select("a", "b", "m")
        new = (
            pointed.select("a", F.col("m").alias("b"))
            .unionByName(upper.select(F.col("b").alias("a"), F.col("m").alias("b")))
            .unionByName(least.select("a", F.col("m").alias("b")))
            .filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
        )
        new = stored(new)
        now = new.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        drop_stored(edges)
        edges = new
        if tuple(now) == total:
            break
        total, n = tuple(now), now[0]
    labels = edges.groupBy("a").agg(F.min("b").alias("m"))
    nodes = links.filter("a <> b").select(F.explode(F.array("a", "b")).alias("node")).distinct()
    return nodes.join(labels, nodes["node"] == labels["a"], "left").select("node", F.coalesce("m", "node").alias("component"))

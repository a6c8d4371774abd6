"""Connected components of a link table by alternating star contractions, all in Spark joins.

Each round writes the links to the shared work folder, so lineage stays short and a lost executor
costs one round at most. Nothing but a count comes to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bellwire.session import materialise


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node``, ``component`` (the smallest node reachable) for every node that has a link.

    Self-links, repeated links and nulls are ignored. Each node keeps one row per distinct smaller
    neighbour while the stars shrink. A hub with very many links is met by partial aggregation; the
    smallest neighbours are written before they are joined, as adaptive execution splits a hub's rows in such
    a join but not in one that shares its shuffle with the aggregation.
    """
    links = links.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).where("hi > lo").distinct()
    links = materialise(links, "links")
    while True:
        # Large star: larger neighbours move to the smallest neighbour of the node.
        both = links.select(F.col("hi").alias("n"), F.col("lo").alias("m")).unionByName(
            links.select(F.col("lo").alias("n"), F.col("hi").alias("m"))
        )
        least = both.groupBy("n").agg(F.min("m").alias("least")).select("n", F.least("n", "least").alias("least"))
        least = materialise(least, "least")
        large = both.where("m > n").join(least, "n").select(F.col("m").alias("hi"), F.col("least").alias("lo")).distinct()
        large = materialise(large, "links")
        # Small star: smaller neighbours and the node itself move to the smallest one.
        low = large.groupBy("hi").agg(F.min("lo").alias("least"), F.count("*").alias("k"))
        low = materialise(low, "least")
        moved = large.join(low.where("k > 1"), "hi").where("lo > least").select(F.col("lo").alias("hi"), F.col("least").alias("lo"))
        small = materialise(low.select("hi", F.col("least").alias("lo")).unionByName(moved).distinct(), "links")
        # Settled once every node has one smaller neighbour and no such neighbour has one itself.
        deep = small.select("hi").intersect(small.select(F.col("lo").alias("hi")))
        links = small
        if deep.isEmpty() and small.groupBy("hi").count().where("count > 1").isEmpty():
            break
    roots = links.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct()
    return links.select(F.col("hi").alias("node"), F.col("lo").alias("component")).unionByName(roots)

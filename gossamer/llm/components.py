"""Connected components by contraction, distributed, with stored rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node in links (a, b); root is the smallest node that links reach.

    Each round, every node points to its smallest neighbour if that is smaller;
    pointers are followed to their ends and the graph shrinks to the ends. At
    least every other node of a component that isn't a least one goes each round,
    so rounds are logarithmic. Only counts reach the driver.
    """
    edges = cut(links.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "cc-links")
    nodes = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    roots = cut(nodes.withColumn("root", F.col("node")), "cc-roots")
    while not edges.isEmpty():
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        to = cut(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("to")).withColumn("to", F.least("node", "to")), "cc-pointers")
        while True:  # pointers only fall, so following them ends
            nearer = to.alias("x").join(to.select(F.col("node").alias("to"), F.col("to").alias("next")).alias("y"), "to", "left")
            jumped = cut(nearer.select("node", F.col("to").alias("was"), F.coalesce("next", "to").alias("to")), "cc-jump")
            to = jumped.select("node", "to")
            if jumped.filter("was <> to").isEmpty():
                break
        roots = cut(roots.join(to.withColumnRenamed("node", "root"), "root", "left").select("node", F.coalesce("to", "root").alias("root")), "cc-roots")
        ends = lambda side: to.select(F.col("node").alias(side), F.col("to").alias(f"{side}_to"))  # noqa: B023,E731
        moved = edges.join(ends("a"), "a").join(ends("b"), "b").select(F.least("a_to", "b_to").alias("a"), F.greatest("a_to", "b_to").alias("b"))
        edges = cut(moved.filter("a <> b").distinct(), "cc-links")
    return roots

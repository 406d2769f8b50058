"""Connected components of a link table by rounds of contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradus.llm.common import written


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """``node, root`` for every node of at least one link; nodes of a component share the root, one of them.

    Each round, every node points to the neighbour that comes first in an order drawn anew by hashing, or to itself;
    links are carried over to what their ends point to, and equal ones merge. The expected number of nodes with links
    falls by a constant factor a round. The pointers of all rounds are then followed from the last round back.
    """
    edges = written(links.select(F.col(a).alias("x"), F.col(b).alias("y")).where("x <> y").distinct())
    pointers = []
    while not edges.isEmpty():
        order = F.xxhash64(F.col("y"), F.lit(len(pointers)))
        both = edges.unionByName(edges.select(F.col("y").alias("x"), F.col("x").alias("y")))
        selves = both.select("x", F.col("x").alias("y"))
        points = written(both.unionByName(selves).groupBy("x").agg(F.min_by("y", F.struct(order, "y")).alias("to")))
        pointers.append(points)
        target = lambda c: points.select(F.col("x").alias(c), F.col("to").alias(f"{c}_to"))
        moved = edges.join(target("x"), "x").join(target("y"), "y")
        edges = written(
            moved.select(F.least("x_to", "y_to").alias("x"), F.greatest("x_to", "y_to").alias("y")).where("x <> y").distinct()
        )
    if not pointers:
        return edges.select(F.col("x").alias("node"), F.col("y").alias("root"))
    found = pointers.pop().select(F.col("x").alias("node"), F.col("to").alias("root"))
    while pointers:
        points = pointers.pop()
        upper = found.select(F.col("node").alias("to"), "root")
        found = written(points.join(upper, "to", "left").select(F.col("x").alias("node"), F.coalesce("root", "to").alias("root")))
    return found

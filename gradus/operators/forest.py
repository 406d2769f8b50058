"""Following parent links to the top."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradus.session import cut_lineage

SMALL = 100_000


def roots(links: DataFrame, small: int = SMALL) -> DataFrame:
    """``node, root`` for links ``node, parent`` without cycles.

    A counted small table is followed in memory; otherwise every pass lets each node point
    to its parent's parent, so the passes grow with the logarithm of the depth.
    """
    links = links.select("node", "parent")
    spark = links.sparkSession
    if links.limit(small + 1).count() <= small:
        table = links.toPandas()
        node, parent = table["node"].to_numpy(np.int64), table["parent"].to_numpy(np.int64)
        ids, inverse = np.unique(np.concatenate([node, parent]), return_inverse=True)
        up = np.arange(len(ids))
        up[inverse[: len(node)]] = inverse[len(node) :]
        while not np.array_equal(up[up], up):
            up = up[up]
        frame = pd.DataFrame({"node": node, "root": ids[up[inverse[: len(node)]]]}).astype("int64")
        return spark.createDataFrame(frame, "node BIGINT, root BIGINT")
    current = cut_lineage(links)
    while True:
        above = current.select(F.col("node").alias("parent"), F.col("parent").alias("above"))
        following = cut_lineage(
            current.join(above, "parent", "left").select(
                "node", F.coalesce("above", "parent").alias("parent"), F.col("above").isNotNull().alias("moved")
            )
        )
        current = following.select("node", "parent")
        if following.where("moved").isEmpty():
            return current.withColumnRenamed("parent", "root")


def components(links: DataFrame) -> DataFrame:
    """``node, root`` for every end of links ``x, y``; nodes that links connect share their root, one of them.

    Every round each node turns to the neighbour, or itself, that is first in an order drawn anew; links between what nodes
    turned to go on. The number of linked nodes falls by a constant share a round.
    """
    edges = cut_lineage(links.select("x", "y").where("x <> y").distinct())
    turns = []
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("y").alias("x"), F.col("x").alias("y")))
        choices = both.unionByName(both.select("x", F.col("x").alias("y")))
        drawn = F.struct(F.xxhash64("y", F.lit(len(turns))), "y")
        turn = cut_lineage(choices.groupBy("x").agg(F.min_by("y", drawn).alias("to")))
        turns.append(turn.select(F.col("x").alias("node"), F.col("to").alias("parent")))
        for c in ("x", "y"):
            edges = edges.join(turn.select(F.col("x").alias(c), F.col("to").alias(f"_{c}")), c).drop(c).withColumnRenamed(f"_{c}", c)
        edges = cut_lineage(edges.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).where("x <> y").distinct())
    if not turns:
        return edges.select(F.col("x").alias("node"), F.col("y").alias("root"))
    found = turns.pop().withColumnRenamed("parent", "root")
    while turns:
        upper = found.select(F.col("node").alias("parent"), "root")
        found = cut_lineage(turns.pop().join(upper, "parent", "left").select("node", F.coalesce("root", "parent").alias("root")))
    return found


def topmost(tree: DataFrame, small: int = SMALL) -> DataFrame:
    """``node, top``: the highest marked node among each node and its ancestors, or NULL.

    ``tree`` has ``node, parent`` (NULL at the top) and ``marked``.
    """
    spark = tree.sparkSession
    if tree.limit(small + 1).count() <= small:
        table = tree.select("node", "parent", "marked").toPandas()
        parent_of = dict(zip(table["node"], table["parent"]))
        marked = dict(zip(table["node"], table["marked"]))
        top: dict[int, int | None] = {}
        for start in parent_of:
            path, at = [], start
            while at not in top and not pd.isna(at):
                path.append(at)
                at = parent_of.get(at)
            best = None if pd.isna(at) else top[at]
            for node in reversed(path):
                best = best if best is not None else (node if marked[node] else None)
                top[node] = best
        rows = [(int(n), None if t is None else int(t)) for n, t in top.items()]
        return spark.createDataFrame(rows, "node BIGINT, top BIGINT")
    current = cut_lineage(
        tree.select("node", F.col("parent").alias("jump"), F.when(F.col("marked"), F.col("node")).alias("top"))
    )
    while not current.where("jump IS NOT NULL").isEmpty():
        upper = current.select(F.col("node").alias("jump"), F.col("jump").alias("_jump"), F.col("top").alias("_top"))
        current = cut_lineage(
            current.join(upper, "jump", "left").select(
                "node", F.col("_jump").alias("jump"), F.coalesce("_top", "top").alias("top")
            )
        )
    return current.select("node", "top")

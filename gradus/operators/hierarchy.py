"""Condensed hierarchy of a weighted tree: merges in stretches solved by tasks, joined by what passes from one to the next.

Edges are sorted and cut into stretches. Halving the sorted edges again and again tells what each stretch's edges join when it
begins: the components that lighter edges have made, by rounds of contraction on all stretches of a level together. So
every stretch is merged on its own. What it can't know, the cluster that a component brought along, stays a name; names are
resolved afterwards by doubling pointers from stretch to stretch. Nothing but row counts passes the driver, unless a table is
counted to be small.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gradus.operators import forest
from gradus.operators.ranking import global_index
from gradus.session import cut_lineage

STRETCH = 1_000_000
SHORTEST = 1e-12
TIED = 1e-9  # stabilities that differ by less than this part of themselves are equal: rounding of sums in another order

_TOLD = (
    "kind STRING, stretch BIGINT, name BIGINT, size BIGINT, last BIGINT, cluster BIGINT, brought BIGINT, parent BIGINT, "
    "amount DOUBLE"
)


def stretches(edges: DataFrame, n_edges: int, stretch: int) -> DataFrame:
    """``stretch, position, w, a, a_size, b, b_size`` for edges ``position, lo, hi, w``.

    ``a`` and ``b`` are the components that an edge's ends are in when its stretch begins, named by their least keys.
    """
    ends = ["a", "b"]
    rows = edges.select(
        "position", "w", F.col("lo").alias("a"), F.lit(1).cast("bigint").alias("a_size"), F.col("hi").alias("b"),
        F.lit(1).cast("bigint").alias("b_size"),
    )
    length = stretch
    while length < n_edges:
        length *= 2
    while length > stretch:
        half = length // 2
        rows = rows.withColumn("_part", F.col("position").cast("bigint") - F.col("position") % length)
        late = F.col("position") % length >= half
        at = lambda c: F.struct("_part", F.col(c).alias("name"))
        joined = forest.components(rows.where(~late).select(at("a").alias("x"), at("b").alias("y")))
        early = rows.where(~late)
        sizes = early.select(at("a").alias("node"), F.col("a_size").alias("size")).unionByName(
            early.select(at("b").alias("node"), F.col("b_size").alias("size"))
        ).distinct()
        member = cut_lineage(joined.join(sizes, "node"))
        whole = member.groupBy("root").agg(F.min("node.name").alias("_name"), F.sum("size").alias("_size"))
        moved = cut_lineage(member.join(whole, "root").select("node._part", F.col("node.name").alias("_from"), "_name", "_size"))
        right = rows.where(late)
        for c in ends:
            right = right.join(moved.withColumnRenamed("_from", c), ["_part", c], "left").select(
                *[x for x in right.columns if x not in (c, f"{c}_size")],
                F.coalesce("_name", c).alias(c), F.coalesce("_size", f"{c}_size").alias(f"{c}_size"),
            )
        rows = cut_lineage(early.unionByName(right).drop("_part"))
        length = half
    return rows.withColumn("stretch", F.expr(f"position div {stretch}"))


def _merged(table: pd.DataFrame, min_size: int) -> pd.DataFrame:
    """All merges of one stretch.

    A component has a cluster (its own number, or None with the name it was brought under) or is loose: the components it
    was made of, which wait for a cluster to enter. A cluster's stability grows by its size times the fall of the level since
    its last merge, so that it is zero where the level did not fall, and not the rounding of a difference. ``amount`` of a
    part is the level of its first merge, of an end the level of its last.
    """
    table = table.sort_values("position")
    stretch = int(table["stretch"].iloc[0])
    rows: list[tuple] = []
    size: dict[int, int] = {}
    cluster: dict[int, tuple] = {}
    loose: dict[int, list[int]] = {}
    entered: dict[int, tuple] = {}
    grown: dict[tuple, float] = {}
    at: dict[int, float] = {}
    first: dict[int, float] = {}
    above: dict[int, int] = {}
    began: dict[int, int] = {}

    def find(x: int) -> int:
        while x in above:
            if above[x] in above:
                above[x] = above[above[x]]
            x = above[x]
        return x

    def come(name: int, n: int) -> None:
        if name in began:
            return
        began[name] = size[name] = n
        if n >= max(min_size, 2):
            cluster[name] = (None, name)
        else:
            loose[name] = [name]

    columns = [table[c].tolist() for c in ("position", "w", "a", "a_size", "b", "b_size")]
    for position, w, a, a_size, b, b_size in zip(*columns):
        come(a, a_size)
        come(b, b_size)
        a, b = sorted((find(a), find(b)))
        level, total = 1.0 / max(w, SHORTEST), size[a] + size[b]
        known = [cluster.pop(x, None) for x in (a, b)]
        for which, x in zip(known, (a, b)):
            if which and x in at:
                grown[which] = grown.get(which, 0.0) + size[x] * (at.pop(x) - level)
            elif which:
                first[x] = level
        if all(known):
            for child in known:
                rows.append(("split", stretch, None, None, None, *child, position, None))
            cluster[a] = (position, None)
            grown[cluster[a]] = 0.0
        elif any(known):
            cluster[a] = known[0] or known[1]
            falling = b if known[0] else a
            entered.update(dict.fromkeys(loose.pop(falling), cluster[a]))
        elif total >= min_size:
            cluster[a] = (position, None)
            grown[cluster[a]] = 0.0
            entered.update(dict.fromkeys(loose.pop(a) + loose.pop(b), cluster[a]))
        else:
            loose[a] = loose.pop(a) + loose.pop(b)
        if a in cluster:
            at[a] = level
        size[a] = total
        del size[b]
        above[b] = a
    for name, n in began.items():
        rows.append(("part", stretch, name, n, find(name), *entered.get(name, (None, None)), None, first.get(name)))
    for name, which in cluster.items():
        rows.append(("end", stretch, name, size[name], None, *which, None, at[name]))
    for which, amount in grown.items():
        rows.append(("grown", stretch, None, None, None, *which, None, amount))
    out = pd.DataFrame(rows, columns=["kind", "stretch", "name", "size", "last", "cluster", "brought", "parent", "amount"])
    return out.astype({c: "Int64" for c in ("stretch", "name", "size", "last", "cluster", "brought", "parent")})


def _resolved(told: DataFrame, parts: DataFrame, small: int) -> DataFrame:
    """``id, cluster, amount`` for every part that brought a cluster along: the number it was made under, and by how much
    its stability grew from the last merge before the part's stretch to the first in it."""
    ends = told.where("kind = 'end'").select(
        "stretch", "name", F.lit(1).alias("_late"), "cluster", "brought", F.lit(None).cast("bigint").alias("id"), "size", "amount"
    )
    asking = parts.where("is_cluster").select(
        "stretch", "name", F.lit(0).alias("_late"), F.lit(None).cast("bigint").alias("cluster"),
        F.lit(None).cast("bigint").alias("brought"), "id", "size", "amount",
    )
    # one component's rows: at most two a stretch
    before = Window.partitionBy("name").orderBy("stretch", "_late").rowsBetween(Window.unboundedPreceding, -1)
    made = F.last(F.when(F.col("_late") == 1, F.struct("stretch", "cluster", "brought", "amount")), ignorenulls=True).over(before)
    found = ends.unionByName(asking).withColumn("_made", made).where("_late = 0")
    fallen = F.col("size") * (F.col("_made.amount") - F.col("amount"))
    found = cut_lineage(
        found.select("id", "_made.stretch", "_made.cluster", F.col("_made.brought").alias("name"), fallen.alias("amount"))
    )
    to = parts.select(F.col("id").alias("parent"), "stretch", "name")
    links = found.where("cluster IS NULL").join(to, ["stretch", "name"]).select(F.col("id").alias("node"), "parent")
    top = forest.roots(links, small).select(F.col("node").alias("id"), "root")
    known = found.where("cluster IS NOT NULL").select("id", "cluster")
    all_known = known.unionByName(top.join(known.withColumnRenamed("id", "root"), "root").select("id", "cluster"))
    return cut_lineage(all_known.join(found.select("id", "amount"), "id"))


def _entered(parts: DataFrame, of_part: DataFrame, small: int) -> DataFrame:
    """``key, cluster`` for every key that ever enters a cluster: loose components are followed to the part that does."""
    waiting = parts.where("NOT is_cluster AND cluster IS NULL AND brought IS NULL")
    none = F.lit(None).cast("bigint")
    asking = waiting.select(F.col("last").alias("name"), "stretch", F.lit(1).alias("_late"), "id", none.alias("next"))
    there = parts.select("name", "stretch", F.lit(0).alias("_late"), none.alias("id"), F.col("id").alias("next"))
    after = Window.partitionBy("name").orderBy("stretch", "_late").rowsBetween(1, Window.unboundedFollowing)
    found = asking.unionByName(there).withColumn("_next", F.first("next", ignorenulls=True).over(after))
    links = found.where("_late = 1 AND _next IS NOT NULL").select(F.col("id").alias("node"), F.col("_next").alias("parent"))
    top = forest.roots(links, small).select(F.col("node").alias("id"), "root")
    points = parts.where("size = 1").select(F.col("name").alias("key"), "id").join(top, "id", "left")
    points = points.select("key", F.coalesce("root", "id").alias("id"))
    reached = points.join(parts.select("id", "stretch", "cluster", "brought"), "id")
    return _with_cluster(reached, parts, of_part).where("cluster IS NOT NULL").select("key", "cluster")


def _with_cluster(rows: DataFrame, parts: DataFrame, of_part: DataFrame) -> DataFrame:
    """Rows of ``stretch, cluster, brought`` with the cluster's number where only the name it was brought under is known."""
    named = parts.where("is_cluster").select("stretch", F.col("name").alias("brought"), F.col("id").alias("_id")).join(
        of_part.select(F.col("id").alias("_id"), F.col("cluster").alias("_cluster")), "_id"
    )
    joined = rows.join(named.drop("_id"), ["stretch", "brought"], "left")
    return joined.withColumn("cluster", F.coalesce("cluster", "_cluster")).drop("_cluster")


def stable(clusters: DataFrame, small: int = forest.SMALL) -> DataFrame:
    """``node, parent, marked`` of ``node, parent, stability``: marked if as stable as the best choice below it together.

    The best of a node is ``max(stability, sum of its children's best)``; equal means equal but for rounding. A counted small table is settled in memory.
    Otherwise each round adds up finished children, and a node with one unfinished child left stands for a function
    ``max(a, b + x)`` of it; such functions are chained by doubling, so rounds grow with the logarithm of the nodes.
    """
    spark = clusters.sparkSession
    if clusters.limit(small + 1).count() <= small:
        rows = clusters.select("node", "parent", "stability").toPandas().sort_values("node")
        below: dict[int, float] = {}
        out = []
        for node, parent, own in zip(rows["node"].tolist(), rows["parent"].tolist(), rows["stability"].tolist()):
            under = below.get(node, 0.0)  # children have lower numbers
            top = pd.isna(parent)
            out.append((node, None if top else int(parent), bool(own >= under * (1 - TIED) and not top)))
            if not top:
                below[int(parent)] = below.get(int(parent), 0.0) + max(own, under)
        return spark.createDataFrame(out, "node BIGINT, parent BIGINT, marked BOOLEAN")
    null = F.lit(None).cast("double")
    state = cut_lineage(
        clusters.select(
            "node", "parent", "stability", null.alias("best"), null.alias("a"), null.alias("b"),
            F.lit(None).cast("bigint").alias("on"), null.alias("under"),
        )
    )
    while not state.where("best IS NULL").isEmpty():
        below = state.where("parent IS NOT NULL").groupBy(F.col("parent").alias("node")).agg(
            F.coalesce(F.sum("best"), F.lit(0.0)).alias("_done"), F.count_if(F.col("best").isNull()).alias("_open"),
            F.min(F.when(F.col("best").isNull(), F.col("node"))).alias("_child"),
        )
        seen = state.join(below, "node", "left")
        done, open_ = F.coalesce("_done", F.lit(0.0)), F.coalesce("_open", F.lit(0))
        alone = F.col("best").isNull() & F.col("on").isNull() & (open_ == 1)
        seen = seen.select(
            "node", "parent", "stability", F.when(open_ == 0, done).otherwise(F.col("under")).alias("under"),
            F.when(open_ == 0, F.greatest("stability", done)).otherwise(F.col("best")).alias("best"),
            F.when(alone, F.col("stability")).otherwise(F.col("a")).alias("a"),
            F.when(alone, done).otherwise(F.col("b")).alias("b"), F.when(alone, F.col("_child")).otherwise(F.col("on")).alias("on"),
        )
        seen = cut_lineage(seen)
        next_ = seen.select(
            F.col("node").alias("on"), F.col("best").alias("_best"), F.col("a").alias("_a"), F.col("b").alias("_b"), F.col("on").alias("_on")
        )
        chained = seen.join(next_, "on", "left")
        ready = F.col("best").isNull() & F.col("_best").isNotNull()
        jump = F.col("best").isNull() & F.col("_best").isNull() & F.col("_on").isNotNull()
        state = cut_lineage(
            chained.select(
                "node", "parent", "stability", "under",
                F.when(ready, F.greatest("a", F.col("b") + F.col("_best"))).otherwise(F.col("best")).alias("best"),
                F.when(jump, F.greatest("a", F.col("b") + F.col("_a"))).otherwise(F.col("a")).alias("a"),
                F.when(jump, F.col("b") + F.col("_b")).otherwise(F.col("b")).alias("b"),
                F.when(jump, F.col("_on")).otherwise(F.col("on")).alias("on"),
            )
        )
    total = state.where("parent IS NOT NULL").groupBy(F.col("parent").alias("node")).agg(F.sum("best").alias("_under"))
    marked = F.col("parent").isNotNull() & (F.col("stability") >= F.coalesce("_under", F.lit(0.0)) * (1 - TIED))
    return state.join(total, "node", "left").select("node", "parent", marked.alias("marked"))


def condensed_clusters(
    points: DataFrame, tree: DataFrame, min_size: int = 2, stretch: int = STRETCH, small: int = forest.SMALL
) -> DataFrame:
    """``key, label`` with the selected cluster of every row, -1 for noise; ``tree`` has ``lo, hi, w`` and no circle.

    Edges count in the order of weight, lower key, higher key. A cluster is named by the place of the edge that made it.
    """
    edges = cut_lineage(global_index(tree, [F.col("w"), F.col("lo"), F.col("hi")], "position"))
    dealt = stretches(edges, edges.count(), stretch)
    told = dealt.groupBy("stretch").applyInPandas(lambda t: _merged(t, min_size), _TOLD)
    told = cut_lineage(told.withColumn("id", F.monotonically_increasing_id()))
    parts = told.where("kind = 'part'").withColumn("is_cluster", F.col("size") >= max(min_size, 2))
    of_part = _resolved(told, parts, small)
    grown = _with_cluster(told.where("kind = 'grown'").select("stretch", "cluster", "brought", "amount"), parts, of_part)
    grown = grown.select("cluster", "amount").unionByName(of_part.select("cluster", "amount"))
    grown = grown.groupBy("cluster").agg(F.sum("amount").alias("stability"))
    split = told.where("kind = 'split'").select("stretch", "cluster", "brought", "parent")
    split = _with_cluster(split, parts, of_part).select("cluster", "parent")
    clusters = grown.join(split, "cluster", "left").select(F.col("cluster").alias("node"), "parent", "stability")
    top = forest.topmost(cut_lineage(stable(cut_lineage(clusters), small)), small).withColumnRenamed("node", "cluster")
    labelled = _entered(parts, of_part, small).join(top, "cluster", "left")
    return points.select("key").join(labelled, "key", "left").select("key", F.coalesce("top", F.lit(-1)).alias("label"))

"""Exact Ward clustering by rounds of merging.

Ward's criterion never brings a merged pair closer to a third group, so all pairs that are
each other's nearest can merge in the same round and the tree is the one a strictly
sequential run builds. Nearest groups come from blocks of matrices; when few groups are
left, their summaries are merged in memory.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradus.operators import blocks, cells, forest
from gradus.operators.kmeans import KS
from gradus.operators.ranking import rank_in_key, relabel_by_median
from gradus.operators.silhouette import silhouette_scores
from gradus.session import cut_lineage

_NEAREST = "node BIGINT, other BIGINT, cost DOUBLE"
_MERGES = "left BIGINT, right BIGINT, distance DOUBLE, size BIGINT"
FEW = 1024


def _nearest(groups: pa.Table, others: pa.Table) -> pa.Table:
    """Cheapest partner of every group within a block; ties go to the lower number."""
    x, y = blocks.matrix(groups["vec"]), blocks.matrix(others["vec"])
    node, other = (blocks.numbers(t["node"], np.int64) for t in (groups, others))
    n, m = (blocks.numbers(t["size"]) for t in (groups, others))
    x32, y32 = cells.apart(x, y)
    n32, m32 = (1 / n).astype(np.float32), (1 / m).astype(np.float32)
    place = cells.places(other, node)

    def hopes(rows, left, right, out):
        np.matmul(x32[rows], y32[:, left:right], out=out)
        out /= n32[rows, None] + m32[None, left:right]
        cells.hide(out, place[rows], left, right)

    def scores(rows, columns):
        diff = x[rows] - y[columns]
        cost = n[rows] * m[columns] / (n[rows] + m[columns]) * np.einsum("ij,ij->i", diff, diff)
        return np.where(place[rows] == columns, -np.inf, -cost)

    rows, columns, score = cells.best_columns(len(node), len(other), 1, hopes, scores, other)
    return pa.table({"node": node[rows], "other": other[columns], "cost": -score})


def _cheapest(found: pa.Table) -> pa.Table:
    """Cheapest partner of every group of a merged result."""
    node, other, cost = (found[c].to_numpy() for c in ("node", "other", "cost"))
    order = np.lexsort((other, cost, node))
    return found.take(order[np.unique(node[order], return_index=True)[1]])


def _finish(groups: pd.DataFrame) -> pd.DataFrame:
    """Remaining merges of a small number of groups: follow nearest neighbours until two
    groups are each other's nearest, merge them, go on from where the chain was."""
    groups = groups.sort_values("node").reset_index(drop=True)
    node, size = groups["node"].to_numpy(np.int64), groups["size"].to_numpy(float)
    center = np.stack(groups["vec"].to_numpy()) if len(groups) else np.zeros((0, 1))
    alive = np.ones(len(node), dtype=bool)
    rows, chain = [], []
    for _ in range(len(node) - 1):
        if not chain:
            chain.append(int(np.argmax(alive)))
        while True:
            i = chain[-1]
            diff = center - center[i]
            cost = size * size[i] / (size + size[i]) * np.einsum("ij,ij->i", diff, diff)
            cost[~alive] = np.inf
            cost[i] = np.inf
            j = int(np.argmin(cost))
            if len(chain) > 1 and cost[chain[-2]] <= cost[j]:
                j = chain[-2]
                break
            chain.append(j)
        del chain[-2:]
        a, b = min(i, j), max(i, j)
        rows.append((node[a], node[b], np.sqrt(2 * cost[j]), int(size[a] + size[b])))
        center[a] = (size[a] * center[a] + size[b] * center[b]) / (size[a] + size[b])
        size[a] += size[b]
        alive[b] = False
    return pd.DataFrame(rows, columns=["left", "right", "distance", "size"])


def ward_merges(
    df: DataFrame, key: str, vec: str, width: int, few: int = FEW,
    held_bytes: int = blocks.HELD_BYTES, block_rows: int | None = None,
) -> DataFrame:
    """Merge table ``left, right, distance, size``: two groups, each named by its lowest
    member, the height of the merge and the size after it."""
    spark = df.sparkSession
    points = df.select(F.col(key).alias("node"), F.col(vec).alias("vec"))
    # Equal vectors merge at height 0 first: a group of copies must not take a round each.
    groups = cut_lineage(
        points.groupBy("vec").agg(F.min("node").alias("node"), F.count("*").alias("size"))
    )
    copies = groups.where("size > 1").select("vec", F.col("node").alias("left"))
    ranked = rank_in_key(points.join(copies, "vec").select("left", "node"), ["left"], "node", "_r")
    merges = [
        ranked.where("node <> left").select(
            "left", F.col("node").alias("right"), F.lit(0.0).alias("distance"), (F.col("_r") + 1).alias("size")
        )
    ]
    n = groups.count()
    known = None  # nearest partners that still hold
    while n > few:
        # A merged group is no closer to a third one than the nearer of its two parts was, so only groups that merged, or
        # whose partner did, look anew.
        asking = groups if known is None else cut_lineage(groups.join(known.select("node"), "node", "left_anti"))
        found = blocks.all_against_all(
            asking, groups, "node", "node", width, _nearest, _NEAREST,
            held_bytes=held_bytes, block_rows=block_rows, cut=_cheapest, counts=(n if known is None else asking.count(), n),
        )
        nearest = found.groupBy("node").agg(F.min(F.struct("cost", "other")).alias("b")).select("node", "b.other", "b.cost")
        nearest = cut_lineage(nearest if known is None else nearest.unionByName(known))
        pair = [F.least("node", "other").alias("left"), F.greatest("node", "other").alias("right")]
        mutual = cut_lineage(
            nearest.groupBy(*pair).agg(F.count("*").alias("_n"), F.min("cost").alias("cost")).where("_n = 2")
        )
        merging = mutual.select(F.explode(F.array("left", "right")).alias("node"))
        known = nearest.join(merging, "node", "left_anti").join(
            merging.withColumnRenamed("node", "other"), "other", "left_anti"
        ).select("node", "other", "cost")
        gone = mutual.join(groups, F.col("right") == F.col("node")).select(
            "left", "right", "cost", F.col("vec").alias("_v"), F.col("size").alias("_s")
        )
        merged_center = F.zip_with(
            "vec", "_v", lambda a, b: (a * F.col("size") + b * F.col("_s")) / (F.col("size") + F.col("_s"))
        )
        # Survivors of a merge, then everyone else.
        joined = (
            groups.join(mutual.select(F.col("right").alias("node")), "node", "left_anti")
            .join(gone.withColumnRenamed("left", "node"), "node", "left")
            .select(
                "node", F.coalesce(merged_center, "vec").alias("vec"),
                (F.col("size") + F.coalesce("_s", F.lit(0))).alias("size"), "right", "cost",
            )
        )
        joined = cut_lineage(joined)
        merges.append(
            joined.where("right IS NOT NULL").select(
                F.col("node").alias("left"), "right", F.sqrt(2 * F.col("cost")).alias("distance"), "size"
            )
        )
        groups = joined.select("node", "vec", "size")
        n -= mutual.count()
    merges.append(spark.createDataFrame(_finish(groups.toPandas()), _MERGES))
    out = merges[0]
    for part in merges[1:]:
        out = out.unionByName(part)
    return out


def cut_tree(merges: DataFrame, keys: DataFrame, ks: tuple[int, ...], small: int = forest.SMALL) -> DataFrame:
    """``node`` with a column ``k<k>`` per number of groups: the lowest member of its group."""
    most = max(ks)
    order = ["distance", "left", "right"]
    undone = merges.orderBy(*[F.desc(c) for c in order]).limit(most - 1).collect()
    undone = sorted(undone, key=lambda r: (r["distance"], r["left"], r["right"]))
    cut = [r["right"] for r in undone]
    links = merges.where(~F.col("right").isin(cut)) if cut else merges
    top = forest.roots(links.select(F.col("right").alias("node"), F.col("left").alias("parent")), small)
    labelled = cut_lineage(
        keys.join(top, "node", "left").select("node", F.coalesce("root", "node").alias("root"))
    )
    ends = {x for r in undone for x in (r["left"], r["right"])}
    root_of = {r["node"]: r["root"] for r in labelled.where(F.col("node").isin(list(ends))).collect()} if ends else {}
    # The undone merges join at most `most` groups: redo them one by one for smaller numbers.
    name = {root: root for root in root_of.values()}
    columns = {}
    for done, k in enumerate(range(most, 0, -1)):
        if done:
            r = undone[done - 1] if done <= len(undone) else None
            if r is not None:
                a, b = name[root_of[r["left"]]], name[root_of[r["right"]]]
                name = {x: (min(a, b) if y in (a, b) else y) for x, y in name.items()}
        if k in ks:
            column = F
            for x, y in name.items():
                column = column.when(F.col("root") == x, F.lit(y))
            columns[f"k{k}"] = column.otherwise(F.col("root")) if name else F.col("root")
    return labelled.select("node", *[c.cast("bigint").alias(n) for n, c in columns.items()])


def ward_sweep(
    df: DataFrame, key: str, vec: str, wage: str, width: int, ks: tuple[int, ...] = KS,
    out: str = "cluster_agglom", few: int = FEW, **limits,
) -> tuple[DataFrame, dict]:
    """Labels ``key, out`` by rising median wage, k chosen by silhouette, and the merge table."""
    merges = cut_lineage(ward_merges(df, key, vec, width, few, **limits))
    groups = cut_tree(merges, df.select(F.col(key).alias("node")), ks)
    points = cut_lineage(df.select(key, vec, wage).join(groups.withColumnRenamed("node", key), key))
    found = silhouette_scores(points, key, vec, [f"k{k}" for k in ks], width, **limits)
    scores = {k: found[f"k{k}"] for k in ks}
    best = max(ks, key=lambda k: (scores[k], -ks.index(k)))
    renumbered = relabel_by_median(points, f"k{best}", wage, out)
    return renumbered.select(key, out), {
        "silhouette": scores[best], "n_clusters": best, "scores": scores, "merges": merges,
    }

"""Density clustering: mutual-reachability tree, condensed hierarchy, stability selection.

The tree is exact: every round each component looks for its shortest edge to another
component over blocks of matrices. ``hierarchy`` reads the clusters off its sorted edges.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradus.operators import blocks, cells, forest
from gradus.operators.hierarchy import STRETCH, condensed_clusters
from gradus.operators.ranking import relabel_by_median
from gradus.operators.silhouette import silhouette_score
from gradus.session import cut_lineage

ROWS_AT_ONCE = 4096  # of a block, before its components' shortest edges so far are looked at again


# -- Mutual-reachability tree -------------------------------------------------


def core_distances(points: DataFrame, width: int, min_samples: int, count_self: bool = False, **limits) -> DataFrame:
    """``key, core``: Euclidean distance to the ``min_samples``-th nearest other row."""
    k = min_samples - 1 if count_self else min_samples

    def kernel(a: pa.Table, b: pa.Table) -> pa.Table:
        x, y = blocks.matrix(a["vec"]), blocks.matrix(b["vec"])
        key, other = (blocks.numbers(t["key"], np.int64) for t in (a, b))
        x32, y32 = cells.apart(x, y)
        place = cells.places(other, key)

        def hopes(rows, left, right, out):
            np.matmul(x32[rows], y32[:, left:right], out=out)
            cells.hide(out, place[rows], left, right)

        def scores(rows, columns):
            return np.where(place[rows] == columns, -np.inf, -blocks.exact_distances(x[rows], y[columns]) ** 2)

        rows, columns, _ = cells.best_columns(len(key), len(other), k, hopes, scores, other)
        return pa.table({"key": key[rows], "distance": blocks.exact_distances(x[rows], y[columns])})

    if k < 1:
        return points.select("key", F.lit(0.0).alias("core"))
    found = blocks.all_against_all(points, points, "key", "key", width, kernel, "key BIGINT, distance DOUBLE", **limits)
    # At most k distances per row and block.
    return found.groupBy("key").agg(
        F.get(F.sort_array(F.collect_list("distance")), F.least(F.lit(k), F.count("*").cast("int")) - 1).alias("core")
    )


def _shortest_exits(a: pa.Table, b: pa.Table) -> pa.Table:
    """Shortest edge from every component of one block into another component of the other."""
    # By component: rows of one lie together, and what they must not meet is one stretch of columns.
    a, b = (t.take(np.argsort(t["comp"].to_numpy(), kind="stable")) for t in (a, b))
    x, y = blocks.matrix(a["vec"]), blocks.matrix(b["vec"])
    key, other = (blocks.numbers(t["key"], np.int64) for t in (a, b))
    comp, other_comp = (blocks.numbers(t["comp"], np.int64) for t in (a, b))
    core, other_core = (blocks.numbers(t["core"]) for t in (a, b))
    x32, y32 = cells.apart(x, y)
    core32, other32 = ((-(c * c) * (1 - 1e-6)).astype(np.float32) for c in (core, other_core))
    begin, end = (np.searchsorted(other_comp, comp, side=s) for s in ("left", "right"))
    name, group = np.unique(comp, return_inverse=True)
    best = np.full(len(name), np.inf)
    parts = []
    for start in range(0, len(key), ROWS_AT_ONCE):
        # No edge of a row is shorter than its core distance.
        asking = start + np.flatnonzero(core[start : start + ROWS_AT_ONCE] <= best[group[start : start + ROWS_AT_ONCE]])

        def hopes(rows, left, right, out, asking=asking):
            mine = asking[rows]
            np.matmul(x32[mine], y32[:, left:right], out=out)
            np.minimum(out, np.minimum(core32[mine, None], 0), out=out)
            np.minimum(out, other32[None, left:right], out=out)
            np.negative(np.sqrt(np.negative(out, out=out), out=out), out=out)
            met = np.flatnonzero((begin[mine] < right) & (end[mine] > left))
            if len(met):
                # Rows come by component, so those of one are neighbours.
                cuts = np.flatnonzero(np.diff(group[mine[met]])) + 1
                for run in np.split(met, cuts):
                    out[run, max(begin[mine[run[0]]] - left, 0) : max(end[mine[run[0]]] - left, 0)] = -np.inf

        def scores(rows, columns, asking=asking):
            mine = asking[rows]
            w = np.maximum(blocks.exact_distances(x[mine], y[columns]), np.maximum(core[mine], other_core[columns]))
            return np.where(comp[mine] == other_comp[columns], -np.inf, -w)

        rows, cols, score = cells.best_columns(len(asking), len(other), 1, hopes, scores, other, None, -best[group[asking]])
        rows = asking[rows]
        lo, hi = np.minimum(key[rows], other[cols]), np.maximum(key[rows], other[cols])
        order = np.lexsort((hi, lo, -score, group[rows]))
        pick = order[np.unique(group[rows][order], return_index=True)[1]]
        best[group[rows[pick]]] = np.minimum(best[group[rows[pick]]], -score[pick])
        parts.append(pa.table({"comp": comp[rows[pick]], "w": -score[pick], "lo": lo[pick], "hi": hi[pick], "target": other_comp[cols[pick]]}))
    if not parts:
        return pa.table({c: pa.array([], pa.float64() if c == "w" else pa.int64()) for c in ("comp", "w", "lo", "hi", "target")})
    return _of_components(pa.concat_tables(parts))


def _of_components(found: pa.Table) -> pa.Table:
    """Shortest edge of every component of a merged result."""
    comp, w, lo, hi = (found[c].to_numpy() for c in ("comp", "w", "lo", "hi"))
    order = np.lexsort((hi, lo, w, comp))
    return found.take(order[np.unique(comp[order], return_index=True)[1]])


def reachability_tree(
    df: DataFrame, key: str, vec: str, width: int, min_samples: int = 2, count_self: bool = False,
    small: int = forest.SMALL, **limits,
) -> DataFrame:
    """Minimum spanning tree ``lo, hi, w`` of the mutual-reachability graph.

    Edges are compared by (weight, lower key, higher key), so the tree is unique. The
    number of components at least halves every round.
    """
    points = df.select(F.col(key).cast("bigint").alias("key"), F.col(vec).alias("vec"))
    n = points.count()
    points = cut_lineage(
        points.join(core_distances(points, width, min_samples, count_self, counts=(n, n), **limits), "key")
    )
    comps = points.select("key", F.col("key").alias("comp"))
    edges = None
    while True:
        state = points.join(comps, "key")
        exits = blocks.all_against_all(
            state, state, "key", "key", width, _shortest_exits,
            "comp BIGINT, w DOUBLE, lo BIGINT, hi BIGINT, target BIGINT", counts=(n, n), cut=_of_components, **limits,
        )
        picks = cut_lineage(
            exits.groupBy("comp").agg(F.min(F.struct("w", "lo", "hi", "target")).alias("e")).select("comp", "e.*")
        )
        if picks.isEmpty():
            break
        # Two components that picked the same edge: the lower one stays the root.
        twice = picks.groupBy("lo", "hi").agg(F.count("*").alias("_n"), F.min("comp").alias("_first"), F.first("w").alias("w"))
        new = twice.select("lo", "hi", "w")
        edges = new if edges is None else edges.unionByName(new)
        links = (
            picks.join(twice.select("lo", "hi", "_n", "_first"), ["lo", "hi"])
            .where("NOT (_n = 2 AND comp = _first)")
            .select(F.col("comp").alias("node"), F.col("target").alias("parent"))
        )
        above = forest.roots(links, small).withColumnRenamed("node", "comp")
        comps = cut_lineage(comps.join(above, "comp", "left").select("key", F.coalesce("root", "comp").alias("comp")))
    if edges is None:
        return df.sparkSession.createDataFrame([], "lo BIGINT, hi BIGINT, w DOUBLE")
    return edges


# -- Labels ------------------------------------------------------------------


def density_clusters(
    df: DataFrame, key: str, vec: str, wage: str, width: int, min_cluster_size: int = 2, min_samples: int = 2,
    count_self: bool = False, out: str = "cluster_hdbscan", stretch: int = STRETCH, small: int = forest.SMALL, **limits,
) -> tuple[DataFrame, dict]:
    """Labels ``key, out`` by rising median wage, -1 for noise."""
    tree = cut_lineage(reachability_tree(df, key, vec, width, min_samples, count_self, small, **limits))
    points = df.select(F.col(key).cast("bigint").alias("key"))
    labels = condensed_clusters(points, tree, min_cluster_size, stretch, small)
    labelled = cut_lineage(df.select(key, vec, wage).join(labels.withColumnRenamed("key", key), key))
    score = silhouette_score(labelled, key, vec, "label", width, **limits)
    found = labelled.where("label <> -1").agg(F.countDistinct("label")).first()[0]
    renumbered = relabel_by_median(labelled, "label", wage, out)
    return renumbered.select(key, out), {
        "silhouette": score, "n_clusters": found, "n_noise": labelled.where("label = -1").count(), "tree": tree,
    }

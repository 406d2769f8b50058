"""K-means with the number of groups chosen by silhouette, many starts side by side."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradus.operators import blocks, sums
from gradus.operators.ranking import relabel_by_median
from gradus.operators.silhouette import silhouette_scores
from gradus.session import cut_lineage

KS = (3, 4, 5)
STARTS = 10
REFIT_STARTS = 15


def _drawn(hashes: np.ndarray, seed: int) -> np.ndarray:
    """Numbers between 0 and 1 for rows, the same wherever a row is read."""
    with np.errstate(over="ignore"):
        x = hashes.astype(np.uint64) + np.uint64(seed) * np.uint64(0x9E3779B97F4A7C15)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
        x ^= x >> np.uint64(31)
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) / (1 << 53)


def spread_starts(df: DataFrame, key: str, vec: str, asked: list[tuple[int, int]]) -> list[np.ndarray]:
    """First centers of every ``(k, seed)``, drawn one by one from all rows, farther rows likelier.

    One scan draws the next center of all starts: a row with weight w, its squared distance to the centers so far, and a
    number u drawn by its key's hash has the score log(u) / w, and the greatest score is as likely a row's as its share of
    the weights. Only each task's best row a start moves.
    """
    rows = df.select(F.xxhash64(key).alias("h"), F.col(vec).alias("vec"))
    chosen: list[list[np.ndarray]] = [[] for _ in asked]

    def scan(turn: int, open_: list[int]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best: dict[int, tuple] = {}
            for batch in batches:
                if batch.num_rows == 0:
                    continue
                x, h = blocks.matrix(pa.Table.from_batches([batch])["vec"]), batch.column("h").to_numpy()
                for i in open_:
                    far = blocks.square_distances(x, np.stack(chosen[i])).min(1) if turn else np.ones(len(x))
                    with np.errstate(divide="ignore"):
                        score = np.log(_drawn(h, asked[i][1] * 1009 + turn)) / far
                    at = np.lexsort((h, score))[-1]
                    if far[at] > 0 and (i not in best or (score[at], h[at]) > best[i][:2]):
                        best[i] = (float(score[at]), int(h[at]), x[at].tolist())
            found = [(i, *b) for i, b in best.items()]
            columns = [pa.array([f[j] for f in found], t) for j, t in enumerate((pa.int32(), pa.float64(), pa.int64(), pa.list_(pa.float64())))]
            yield pa.RecordBatch.from_arrays(columns, names=["start", "score", "h", "vec"])

        return run

    for turn in range(max(k for k, _ in asked)):
        open_ = [i for i, (k, _) in enumerate(asked) if k > turn]
        told = rows.mapInArrow(scan(turn, open_), "start INT, score DOUBLE, h BIGINT, vec ARRAY<DOUBLE>")
        won = told.groupBy("start").agg(F.max_by("vec", F.struct("score", "h")).alias("vec"))
        found = {r["start"]: np.array(r["vec"]) for r in won.collect()}  # a row a start
        for i in open_:
            chosen[i].append(found[i] if i in found else chosen[i][-1])  # no row is apart from all centers
    return [np.stack(c) for c in chosen]


def _passed(points: DataFrame, starts: list[np.ndarray]) -> list[tuple[float, np.ndarray, np.ndarray]]:
    """Per start: squared distances to the nearest centers, rows per center, sums per center; one scan for all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            x = blocks.matrix(pa.Table.from_batches([batch])["vec"])
            parts = []
            for centers in starts:
                far = blocks.square_distances(x, centers)
                label = far.argmin(1)
                one = np.zeros_like(far)
                one[np.arange(len(x)), label] = 1.0
                parts += [[np.maximum(far[np.arange(len(x)), label], 0).sum()], one.sum(0), (one.T @ x).ravel()]
            part = np.concatenate(parts)
            held = part if held is None else held + part
        if held is not None:
            yield sums.as_row(held)

    total = sums.added(points.select("vec").mapInArrow(run, "sums BINARY"))
    out, at = [], 0
    for centers in starts:
        k, d = centers.shape
        out.append((float(total[at]), total[at + 1 : at + 1 + k], total[at + 1 + k : at + 1 + k + k * d].reshape(k, d)))
        at += 1 + k + k * d
    return out


def fit_centers(points: DataFrame, starts: list[np.ndarray], max_iter: int = 300, tol: float = 1e-4) -> list[tuple[float, np.ndarray]]:
    """Inertia and centers of every start once its centers hardly move; ``points`` has ``vec``.

    All starts move in the same scans. A center without rows stays where it is.
    """
    current, open_ = [c.copy() for c in starts], set(range(len(starts)))
    inertia = [np.inf] * len(starts)
    spread = None
    for _ in range(max_iter + 1):
        asked = sorted(open_)
        for i, (total, n, sums_) in zip(asked, _passed(points, [current[i] for i in asked])):
            if spread is None:
                spread = max(total / max(n.sum(), 1), 1e-30)
            inertia[i] = total
            moved = np.where(n[:, None] > 0, sums_ / np.maximum(n, 1)[:, None], current[i])
            if np.square(moved - current[i]).sum() <= tol * 1e-2 * spread:
                open_.discard(i)
            current[i] = moved
        if not open_:
            break
    return list(zip(inertia, current))


def nearest_center(df: DataFrame, vec: str, centers: np.ndarray, out: str) -> DataFrame:
    """All columns and the number of the nearest center, the first of several as near."""
    listed = F.array(*[F.array(*[F.lit(float(v)) for v in row]) for row in centers])
    apart = lambda c: F.aggregate(F.zip_with(vec, c, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)
    far = F.transform(listed, lambda c: F.round(apart(c), 12))
    return df.withColumn("_far", far).withColumn(out, (F.array_position("_far", F.array_min("_far")) - 1).cast("int")).drop("_far")


def kmeans_sweep(
    df: DataFrame, key: str, vec: str, wage: str, width: int, ks: tuple[int, ...] = KS, seed: int = 42,
    out: str = "cluster_kmeans", starts: int = STARTS, refit_starts: int = REFIT_STARTS, **limits,
) -> tuple[DataFrame, dict]:
    """Labels ``key, out`` numbered by rising median wage, and what the sweep found.

    Every k has ``starts`` starts, the best by inertia counts; the chosen k is fitted anew from ``refit_starts``. The
    silhouette must improve strictly, so the smallest k wins ties. ``df`` should be cut or cached: every pass reads it.
    """
    points = df.select(key, F.col(vec).alias("vec"), wage)
    asked = [(k, seed + i) for k in ks for i in range(starts)]
    fitted = fit_centers(points, spread_starts(points, key, "vec", asked))
    best_of = {k: min((f for (j, _), f in zip(asked, fitted) if j == k), key=lambda f: f[0]) for k in ks}
    placed = points
    for k in ks:
        placed = nearest_center(placed, "vec", best_of[k][1], f"_k{k}")
    found = silhouette_scores(cut_lineage(placed), key, "vec", [f"_k{k}" for k in ks], width, **limits)
    scores = {k: found[f"_k{k}"] for k in ks}
    k = max(ks, key=lambda j: (scores[j], -j))
    again = fit_centers(points, spread_starts(points, key, "vec", [(k, seed + 1000 + i) for i in range(refit_starts)])) if refit_starts else []
    inertia, centers = min([best_of[k], *again], key=lambda f: f[0])
    labelled = nearest_center(points, "vec", centers, "_label").select(key, wage, "_label")
    renumbered = relabel_by_median(labelled, "_label", wage, out)
    order = renumbered.select("_label", out).distinct().orderBy(out).collect()
    return renumbered.select(key, out), {
        "silhouette": scores[k], "n_clusters": k, "scores": scores, "inertia": inertia,
        "centers": [centers[r["_label"]].tolist() for r in order],
    }

"""Gaussian mixtures with full, regularised covariances.

Models for all numbers of components are fitted side by side: each iteration reads the data
once, sums sufficient statistics in the tasks and moves only those sums.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType

from gradus.operators import blocks, kmeans, sums
from gradus.operators.kmeans import KS
from gradus.operators.ranking import relabel_by_median
from gradus.operators.silhouette import silhouette_scores
from gradus.session import cut_lineage


@dataclass
class Mixture:
    weights: np.ndarray
    means: np.ndarray
    precisions: np.ndarray  # inverse lower Cholesky factors of the covariances

    @property
    def k(self) -> int:
        return len(self.weights)

    def log_joint(self, x: np.ndarray) -> np.ndarray:
        """Log density of every row under every weighted component."""
        d = x.shape[1]
        out = np.empty((len(x), self.k))
        for j in range(self.k):
            z = (x - self.means[j]) @ self.precisions[j].T
            out[:, j] = (
                -0.5 * (d * math.log(2 * math.pi) + (z * z).sum(1))
                + np.log(np.diag(self.precisions[j])).sum()
                + math.log(self.weights[j])
            )
        return out

    def free_parameters(self) -> int:
        d = self.means.shape[1]
        return self.k * d + self.k * d * (d + 1) // 2 + self.k - 1


def _log_sum(log_joint: np.ndarray) -> np.ndarray:
    top = log_joint.max(axis=1, keepdims=True)
    return (top + np.log(np.exp(log_joint - top).sum(axis=1, keepdims=True)))[:, 0]


def _nearest_center(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    r = np.zeros((len(x), len(centers)))
    r[np.arange(len(x)), blocks.square_distances(x, centers).argmin(1)] = 1.0
    return r


def _sums(points: DataFrame, states: dict, shift: np.ndarray) -> dict:
    """Per state: log likelihood, component weights, first and second moments about ``shift``.

    A state is a mixture, or bare centers for hard first assignments. Of the symmetric second moments one half travels.
    """
    upper = np.triu_indices(len(shift))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            x = blocks.matrix(pa.Table.from_batches([batch])["vec"])
            y = x - shift
            parts = []
            for state in states.values():
                if isinstance(state, np.ndarray):
                    r, ll = _nearest_center(x, state), 0.0
                else:
                    joint = state.log_joint(x)
                    norm = _log_sum(joint)
                    r, ll = np.exp(joint - norm[:, None]), norm.sum()
                parts += [[ll], r.sum(0), (r.T @ y).ravel(), *(((y * r[:, [j]]).T @ y)[upper] for j in range(r.shape[1]))]
            part = np.concatenate(parts)
            held = part if held is None else held + part
        if held is not None:
            yield sums.as_row(held)

    total = sums.added(points.select("vec").mapInArrow(run, "sums BINARY"))
    out, at, d = {}, 0, len(shift)
    for name, state in states.items():
        k = len(state) if isinstance(state, np.ndarray) else state.k
        head, half = 1 + k + k * d, len(upper[0])
        second = np.zeros((k, d, d))
        for j in range(k):
            start = at + head + j * half
            second[j][upper] = total[start : start + half]
            second[j] = second[j] + second[j].T - np.diag(np.diag(second[j]))
        out[name] = np.concatenate([total[at : at + head], second.ravel()])
        at += head + k * half
    return out


def _maximise(sums: np.ndarray, k: int, d: int, shift: np.ndarray, reg: float) -> Mixture:
    nk = sums[1 : 1 + k] + 10 * np.finfo(float).eps
    first = sums[1 + k : 1 + k + k * d].reshape(k, d) / nk[:, None]
    second = sums[1 + k + k * d :].reshape(k, d, d) / nk[:, None, None]
    precisions = np.empty_like(second)
    for j in range(k):
        cov = second[j] - np.outer(first[j], first[j]) + reg * np.eye(d)
        lower = np.linalg.cholesky(cov)
        precisions[j] = np.linalg.inv(lower)
    return Mixture(nk / nk.sum(), first + shift, precisions)


def fit_mixtures(
    points: DataFrame, starts: dict[int, np.ndarray], width: int, n: int,
    reg: float = 1e-6, tol: float = 1e-3, max_iter: int = 100,
) -> dict[int, tuple[Mixture, float]]:
    """Expectation-maximisation for several starting centers at once.

    Returns the mixture and mean log likelihood per start; a start whose covariance cannot
    be factored is left out.
    """
    shift = points.select(Summarizer.mean(array_to_vector("vec"))).first()[0].toArray()
    current: dict = dict(starts)
    fitted, last = {}, {}
    for iteration in range(max_iter + 1):
        found = _sums(points, current, shift)
        following = {}
        for name, state in current.items():
            bound = found[name][0] / n
            if iteration and name in last and abs(bound - last[name]) < tol:
                fitted[name] = (state, bound)
                continue
            if iteration:
                last[name] = bound
                if iteration == max_iter:
                    fitted[name] = (state, bound)
                    continue
            try:
                following[name] = _maximise(found[name], len(starts[name]), width, shift, reg)
            except np.linalg.LinAlgError:
                continue
        current = following
        if not current:
            break
    return fitted


def next_mixture(points: DataFrame, mixture: Mixture, n: int, reg: float = 1e-6) -> Mixture:
    """The mixture after one expectation and maximisation over all rows of ``vec``."""
    shift = np.zeros(mixture.means.shape[1])
    found = _sums(points, {0: mixture}, shift)[0]
    return _maximise(found, mixture.k, len(shift), shift, reg)


def memberships(
    df: DataFrame, key: str, vec: str, mixture: Mixture, out: str, label: str, carried: list[str] | None = None
) -> DataFrame:
    """``key``, the vector and carried columns, membership probabilities and most likely component."""
    carried = carried or []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            joint = mixture.log_joint(blocks.matrix(pa.Table.from_batches([batch])[vec]))
            p = np.exp(joint - _log_sum(joint)[:, None])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(p.tolist(), pa.list_(pa.float64())), pa.array(joint.argmax(1), pa.int32())],
                names=[*batch.schema.names, out, label],
            )

    rows = df.select(key, vec, *carried)
    schema = StructType([*rows.schema.fields, StructField(out, ArrayType(DoubleType())), StructField(label, IntegerType())])
    return rows.mapInArrow(run, schema)


def better(bic: float, score: float, best_bic: float, best_score: float, by_size: bool = False) -> bool:
    """Criterion under 0.99 times the best one, or within one percent of it and a better silhouette.

    Under a negative criterion that factor asks for less, not more, than the best; ``by_size`` asks for one percent of its
    size below it instead.
    """
    if math.isinf(best_bic):
        return True
    close = abs(bic - best_bic) / max(abs(best_bic), 1.0) < 0.01
    clearly = bic < best_bic - 0.01 * abs(best_bic) if by_size else bic < 0.99 * best_bic
    return clearly or (close and score > best_score)


def mixture_sweep(
    df: DataFrame, key: str, vec: str, wage: str, width: int, ks: tuple[int, ...] = KS, n_init: int = 5,
    seed: int = 42, reg: float = 1e-6, out: str = "cluster_gmm", probability: str = "membership", refit: int = 10,
    by_size: bool = False, **limits,
) -> tuple[DataFrame, dict]:
    """Labels ``key, out`` by rising median wage with membership probabilities, k chosen by
    the Bayesian information criterion.

    Every k has ``n_init`` starts from k-means; the chosen k is fitted anew from ``refit`` starts. The likeliest counts.
    """
    points = df.select(key, F.col(vec).alias("vec"), wage)
    n = points.count()

    def fitted(asked: list[tuple[int, int]]) -> dict[int, list[tuple[Mixture, float]]]:
        centers = kmeans.fit_centers(points, kmeans.spread_starts(points, key, "vec", asked))
        found = fit_mixtures(points, {i: c for i, (_, c) in enumerate(centers)}, width, n, reg)
        return {k: [found[i] for i in found if asked[i][0] == k] for k in {k for k, _ in asked}}

    runs = fitted([(k, seed + i) for k in ks for i in range(n_init)])
    best, best_bic, best_score = None, math.inf, -1.0
    found = {}
    fits = {k: max(runs[k], key=lambda run: run[1]) for k in ks if runs[k]}
    placed, names = points, []
    for k, (mixture, _) in fits.items():
        names.append(f"_k{k}")
        placed = memberships(placed, key, "vec", mixture, probability, names[-1], [wage, *names[:-1]]).drop(probability)
    scores = silhouette_scores(cut_lineage(placed), key, "vec", names, width, **limits)
    for k, (mixture, bound) in fits.items():
        bic = -2 * bound * n + mixture.free_parameters() * math.log(n)
        score = scores[f"_k{k}"]
        found[k] = {"bic": bic, "silhouette": score}
        if better(bic, score, best_bic, best_score, by_size):
            best, best_bic, best_score, best_bound = mixture, bic, score, bound
    if refit:
        again = fitted([(best.k, seed + 1000 + i) for i in range(refit)])[best.k]
        best, best_bound = max([(best, best_bound), *again], key=lambda run: run[1])
        best_bic = -2 * best_bound * n + best.free_parameters() * math.log(n)
    labelled = memberships(points, key, "vec", best, probability, "_label", [wage])
    renumbered = relabel_by_median(labelled, "_label", wage, out)
    return renumbered.select(key, out, probability), {
        "silhouette": best_score, "n_clusters": best.k, "bic": best_bic, "scores": found, "model": best,
    }

"""Latent Dirichlet allocation by variational inference: only terms a document has are met, documents side by side, topics on the
driver."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradus.operators import blocks, sums
from gradus.session import cut_lineage

PACKED = 1 << 15  # documents a stored row
SIDE, CELLS = 1 << 11, 1 << 19  # documents inferred side by side, and their terms
WIDTHS = [8, 12, 16, 24, 32, 48, 64, 96, 128, 192, 256, 384, 512, 768, 1024]  # terms that documents of a group have at most
FULL = 4  # documents with over one in so many of all terms are met with all of them
DENSE = 256  # of those, whose counts stay in the cache
INNER, CHANGE = 100, 1e-3
OFFSET, DECAY = 10.0, 0.7  # of the steps
TINY = 1e-100
_PACKS = "n INT, start BINARY, term BINARY, value BINARY"


def _below_log(x: np.ndarray) -> np.ndarray:
    """By how much the digamma function is below ``log(x + 6)``; the six steps up are one fraction."""
    u, y = x * (x + 5), x + 6
    z = 1 / (y * y)
    out = 0.5 / y + z * (1 / 12 - z * (1 / 120 - z * (1 / 252 - z * (1 / 240 - z / 132))))
    out += (2 * x + 5) * ((3 * u + 20) * u + 24) / (u * (u + 4) * (u + 6))
    return out


def digamma(x: np.ndarray) -> np.ndarray:
    return np.log(x + 6) - _below_log(x)


def _log_gamma(x: np.ndarray) -> np.ndarray:
    return np.vectorize(math.lgamma, otypes=[np.float64])(x)


def _expected_log(strength: np.ndarray) -> np.ndarray:
    """Expected logarithms of the shares of Dirichlet draws, a draw a row."""
    return digamma(strength) - digamma(strength.sum(1, keepdims=True))


def _topic_weights(gamma: np.ndarray) -> np.ndarray:
    """Exponents of ``_expected_log``, of a document a row."""
    k = gamma.shape[1]
    both = np.empty((len(gamma), k + 1))
    both[:, :k], both[:, k] = gamma, gamma @ np.ones(k)
    weight = np.exp(-_below_log(both))
    weight *= both + 6
    return weight[:, :k] / weight[:, k:]


@dataclass
class TopicModel:
    """Dirichlet strengths of every topic's terms and the priors they were fitted with."""

    strengths: np.ndarray
    alpha: float
    eta: float

    def words(self) -> np.ndarray:
        return np.exp(_expected_log(self.strengths))


@dataclass
class Counts:
    """Non-zero counts of documents one after another; document i has those from ``start[i]`` to ``start[i + 1]``."""

    start: np.ndarray
    term: np.ndarray
    value: np.ndarray

    @staticmethod
    def of(x: np.ndarray) -> Counts:
        row, term = np.nonzero(x)
        return Counts(np.searchsorted(row, np.arange(len(x) + 1)).astype(np.int32), term.astype(np.int32), x[row, term])

    @staticmethod
    def joined(parts: list[Counts]) -> Counts:
        before = np.cumsum([0, *[len(p.term) for p in parts]])
        start = np.concatenate([[0], *[p.start[1:] + b for p, b in zip(parts, before)]]).astype(np.int32)
        return Counts(start, *[np.concatenate([getattr(p, c) for p in parts]) for c in ("term", "value")])

    def __len__(self) -> int:
        return len(self.start) - 1

    def as_row(self) -> pa.RecordBatch:
        told = [pa.array([b.tobytes()], pa.binary()) for b in (self.start, self.term, self.value)]
        return pa.RecordBatch.from_arrays([pa.array([len(self)], pa.int32()), *told], names=["n", "start", "term", "value"])

    @property
    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self)), np.diff(self.start))

    def dense(self, docs: np.ndarray, terms: int) -> np.ndarray:
        """Counts of all terms in some documents, a row each."""
        term, value = self.side_by_side(docs, int((self.start[docs + 1] - self.start[docs]).max(initial=0)), terms)
        out = np.zeros((len(docs), terms + 1))
        np.put_along_axis(out, term, value, 1)
        return out[:, :terms]

    def side_by_side(self, docs: np.ndarray, width: int, blank: int) -> tuple[np.ndarray, np.ndarray]:
        """Terms and counts of some documents, a row each; behind the last stands term ``blank`` with no count."""
        there = np.arange(width) < (self.start[docs + 1] - self.start[docs])[:, None]
        at = (self.start[docs][:, None] + np.arange(width))[there]
        term, value = np.full(there.shape, blank), np.zeros(there.shape)
        term[there], value[there] = self.term[at], self.value[at]
        return term, value

    def expected(self, theta: np.ndarray, words: np.ndarray) -> np.ndarray:
        """Weight of every non-zero count's term in its document."""
        return np.einsum("ij,ij->i", theta[self.rows], np.ascontiguousarray(words.T)[self.term]) + TINY


def _inferred(counts: Counts, words: np.ndarray, alpha: float) -> np.ndarray:
    """Dirichlet strengths of every document's topics; a document leaves once it hardly moves.

    Documents of all lengths stand side by side, in groups of like lengths; others of the group take the places of those that
    left. Of most groups only the documents' own terms are met; those of long documents meet all terms, which are then read once
    for many of them.
    """
    k, terms = words.shape
    of_term = np.vstack([words.T, np.zeros((1, k))])
    size = np.diff(counts.start)
    order = np.argsort(size, kind="stable")
    limits = [w for w in WIDTHS if FULL * w <= terms]
    split = np.split(order, np.searchsorted(size[order], limits, side="right"))
    waiting = [w for w in split if len(w)]
    full = len(split[-1]) > 0
    share = min(1.0, SIDE / max(1, len(order)), CELLS / max(1, size.sum()))
    places = [math.ceil(len(w) * share) for w in waiting]
    groups = [(np.zeros((p, max(1, size[w[-1]]))), np.zeros((p, max(1, size[w[-1]]), k))) for p, w in zip(places, waiting)]
    if full:
        groups[-1] = (np.zeros((places[-1], terms)), None)
    edges = np.cumsum([0, *places])
    out = np.empty((len(counts), k))
    doc, turns, going, gamma = (np.zeros(s, t) for s, t in ((edges[-1], int), (edges[-1], int), (edges[-1], bool), ((edges[-1], k), float)))
    gamma += 1
    evenly = np.full(k, 1 / k)
    while True:
        if 8 * np.count_nonzero(going) <= 7 * len(going):
            for i, (n, near) in enumerate(groups):
                free = np.flatnonzero(~going[edges[i] : edges[i + 1]]) if len(waiting[i]) else waiting[i]
                if len(free):
                    new, waiting[i] = np.split(waiting[i], [len(free)])
                    free = free[: len(new)]
                    if near is None:
                        n[free] = counts.dense(new, terms)
                    else:
                        term, n[free] = counts.side_by_side(new, n.shape[1], terms)
                        near[free] = of_term[term]
                    at = edges[i] + free
                    doc[at], turns[at], going[at] = new, 0, True
                    gamma[at] = (alpha + n[free].sum(1) / k)[:, None]
            if not going.any():
                return out
            if 4 * np.count_nonzero(going) <= 3 * len(going):
                kept = [going[a:b] for a, b in zip(edges, edges[1:])]
                groups = [(n[g], near if near is None else near[g]) for (n, near), g in zip(groups, kept)]
                edges = np.cumsum([0, *[np.count_nonzero(g) for g in kept]])
                doc, turns, gamma, going = doc[going], turns[going], gamma[going], going[going]
        theta = _topic_weights(gamma)
        moved = np.empty_like(theta)
        for start, end, (n, near) in zip(edges, edges[1:], groups):
            if near is None:
                for at in range(0, end - start, DENSE):
                    rows = slice(start + at, min(start + at + DENSE, end))
                    part = theta[rows] @ words
                    part += TINY
                    np.divide(n[at : at + DENSE], part, out=part)
                    np.matmul(part, words.T, out=moved[rows])
            elif start < end:
                part = np.matmul(near, theta[start:end, :, None])[:, :, 0]
                part += TINY
                np.divide(n, part, out=part)
                np.matmul(part[:, None, :], near, out=moved[start:end, None, :])
        moved *= theta
        moved += alpha
        turns += 1
        gamma -= moved
        left = going & (~(np.abs(gamma) @ evenly > CHANGE) | (turns >= INNER))
        out[doc[left]] = moved[left]
        going &= ~left
        gamma = moved


def _packed(counted: DataFrame, counts: str) -> DataFrame:
    """Non-zero counts of thousands of documents a row, so that a pass reads little."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[Counts] = []
        for batch in batches:
            x = blocks.matrix(pa.Table.from_batches([batch])["x"])
            for at in range(0, len(x), PACKED):
                held.append(Counts.of(x[at : at + PACKED]))
                if sum(map(len, held)) >= PACKED:
                    yield Counts.joined(held).as_row()
                    held = []
        if held:
            yield Counts.joined(held).as_row()

    return counted.select(vector_to_array(counts).alias("x")).mapInArrow(run, _PACKS)


def _unpacked(batch: pa.RecordBatch) -> Iterator[Counts]:
    for start, term, value in zip(*[batch[c].to_pylist() for c in ("start", "term", "value")]):
        yield Counts(np.frombuffer(start, np.int32), np.frombuffer(term, np.int32), np.frombuffer(value, np.float64))


def fit(counted: DataFrame, counts: str, terms: int, k: int, max_iter: int, seed: int, alpha: float = 0.1, eta: float = 0.01) -> TopicModel:
    """Topics after ``max_iter`` passes; every pass infers every document and moves the topics a step towards what it found."""
    packs = cut_lineage(_packed(counted, counts))
    tasks = packs.rdd.getNumPartitions()
    model = TopicModel(np.random.default_rng(seed).gamma(100.0, 0.01, (k, terms)), alpha, eta)
    for turn in range(1, max_iter + 1):
        words = model.words()

        def pass_(batches: Iterator[pa.RecordBatch], words=words) -> Iterator[pa.RecordBatch]:
            total = None
            for batch in batches:
                for x in _unpacked(batch):
                    theta = _topic_weights(_inferred(x, words, alpha))
                    share, rows = x.value / x.expected(theta, words), x.rows
                    part = np.array([np.bincount(x.term, share * t[rows], terms) for t in theta.T])
                    total = part if total is None else total + part
            if total is not None:
                yield sums.as_row(total.ravel())

        found = sums.added(packs.mapInArrow(pass_, "sums BINARY"), tasks=tasks)
        if found is None:  # no document
            break
        step = (OFFSET + turn) ** -DECAY
        model.strengths = (1 - step) * model.strengths + step * (eta + found.reshape(k, terms) * words)
    return model


def weights(model: TopicModel, counted: DataFrame, counts: str, out: str) -> DataFrame:
    """All columns and the topic weights of every row; rows without any term have zeros."""
    words, alpha = model.words(), model.alpha

    def infer(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            x = blocks.matrix(pa.chunked_array([column]))
            gamma = _inferred(Counts.of(x), words, alpha) if len(x) else x
            share = gamma / gamma.sum(1, keepdims=True) * x.any(1)[:, None] if len(x) else gamma
            yield pa.array(share.tolist(), pa.list_(pa.float64()))

    inferred = F.arrow_udf(infer, "array<double>", F.ArrowUDFType.SCALAR_ITER)
    return counted.withColumn(out, inferred(vector_to_array(counts)))


def log_perplexity(model: TopicModel, counted: DataFrame, counts: str) -> float:
    """Minus the variational bound of all documents' likelihood, a term occurrence."""
    words, alpha, eta, k = model.words(), model.alpha, model.eta, len(model.strengths)

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(2)
        for batch in batches:
            x = Counts.of(blocks.matrix(pa.Table.from_batches([batch])["x"]))
            if not len(x):
                continue
            gamma = _inferred(x, words, alpha)
            log_theta = _expected_log(gamma)
            told = (x.value * np.log(x.expected(np.exp(log_theta), words))).sum() + ((alpha - gamma) * log_theta).sum()
            told += _log_gamma(gamma).sum() - _log_gamma(gamma.sum(1)).sum() + len(x) * (math.lgamma(k * alpha) - k * math.lgamma(alpha))
            total += [told, x.value.sum()]
        yield sums.as_row(total)

    found = sums.added(counted.select(vector_to_array(counts).alias("x")).mapInArrow(bound, "sums BINARY"))
    told, n = (0.0, 0.0) if found is None else found
    s = model.strengths
    of_topics = ((eta - s) * _expected_log(s)).sum() + _log_gamma(s).sum() - _log_gamma(s.sum(1)).sum()
    of_topics += k * math.lgamma(s.shape[1] * eta) - s.size * math.lgamma(eta)
    return -(told + of_topics) / max(n, 1.0)

"""Vocabulary, term weights and topic models."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import IDF, CountVectorizerModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gradus import fixed
from gradus.functions import text
from gradus.functions.vectors import shares, unit
from gradus.operators import blocks, lda, sums
from gradus.session import cut_lineage

N_TOPICS = 8
N_TERMS = 300
FREQUENT = 600  # words whose pairs are counted in one array


def term_counts(docs: DataFrame, column: str, terms: str = "terms") -> DataFrame:
    """Corpus frequency of every single word and word pair."""
    return _counted(docs.select(text.topic_tokens(F.col(column)).alias("tokens")))


def _counted(listed: DataFrame) -> DataFrame:
    terms = listed.select(F.explode(text.uni_and_bigrams(F.col("tokens"))).alias("term"))
    return terms.groupBy("term").agg(F.count("*").alias("n"))


def token_lists(docs: DataFrame, column: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """Columns ``keep`` and the ``tokens`` of every text, found once and written to the shared folder."""
    return cut_lineage(docs.select(*keep, text.topic_tokens(F.col(column)).alias("tokens")))


def vocabulary(docs: DataFrame, column: str, size: int = N_TERMS) -> list[str]:
    """The most frequent terms, ties alphabetical, listed alphabetically."""
    return common_terms(token_lists(docs, column), size)


def common_terms(listed: DataFrame, size: int = N_TERMS, frequent: int = FREQUENT) -> list[str]:
    """``vocabulary`` of token lists.

    A pair is no more frequent than either of its words, so that only pairs of words as frequent as the ``size``-th word can
    be among the first ``size`` terms. Where more than ``frequent`` words are, all pairs are counted by grouping.
    """
    words = listed.select(F.explode("tokens").alias("term")).groupBy("term").agg(F.count("*").alias("n"))
    top = words.orderBy(F.desc("n"), "term").limit(max(frequent, size) + 1).collect()
    least = top[size - 1]["n"] if len(top) >= size else 0
    top = [(r["n"], r["term"]) for r in top if r["n"] >= least]
    if len(top) > frequent:
        found = _counted(listed).orderBy(F.desc("n"), "term").limit(size).collect()
        return sorted(r["term"] for r in found)
    names = [t for _, t in top]

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(names) ** 2, np.int64)
        for b in batches:
            _, _, first, second = _places(b["tokens"], names)
            total += np.bincount(first * len(names) + second, minlength=len(total))
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"pair": met, "n": total[met]})

    met = listed.select("tokens").mapInArrow(pairs, "pair BIGINT, n BIGINT").groupBy("pair").agg(F.sum("n").alias("n"))
    for r in met.where(F.col("n") >= least).collect():
        top.append((r["n"], f"{names[r['pair'] // len(names)]} {names[r['pair'] % len(names)]}"))
    return sorted(t for _, t in sorted(top, key=lambda x: (-x[0], x[1]))[:size])


def _places(lists: pa.Array, words: list[str]) -> tuple[np.ndarray, ...]:
    """Row and place among ``words`` of every token that is one of them, those tokens' places in the flat list ahead of
    another such token of the row as pairs: ``(rows, places, first, second)``; rows of the pairs come last in ``rows``."""
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    flat = lists.flatten()
    place = pc.fill_null(pc.index_in(flat, value_set=pa.array(words, flat.type)), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    row = np.repeat(np.arange(len(lists)), sizes)
    there = np.flatnonzero(place >= 0)
    ahead = np.flatnonzero((place[:-1] >= 0) & (place[1:] >= 0) & (row[:-1] == row[1:]))
    return np.concatenate([row[there], row[ahead]]), place[there], place[ahead], place[ahead + 1]


@dataclass
class TermCounter:
    """Counts of a fixed vocabulary of words and pairs in batches of token lists."""

    words: list[str]
    single: np.ndarray
    double: np.ndarray
    size: int

    @staticmethod
    def of(vocab: list[str]) -> TermCounter:
        parts = [t.split(" ") for t in vocab]
        words = sorted({w for p in parts for w in p})
        at = {w: i for i, w in enumerate(words)}
        single, double = np.full(len(words), -1), np.full((len(words), len(words)), -1)
        for i, p in enumerate(parts):
            if len(p) == 1:
                single[at[p[0]]] = i
            else:
                double[at[p[0]], at[p[1]]] = i
        return TermCounter(words, single, double, len(vocab))

    def counts(self, lists: pa.Array) -> np.ndarray:
        """Rows by terms."""
        rows, places, first, second = _places(lists, self.words)
        term = np.concatenate([self.single[places], self.double[first, second]])
        kept = term >= 0
        flat = np.bincount(rows[kept] * self.size + term[kept], minlength=len(lists) * self.size)
        return flat.reshape(len(lists), self.size)


def count_vectors(docs: DataFrame, column: str, vocab: list[str], out: str = "counts") -> DataFrame:
    """Sparse term counts over a fixed vocabulary, counted within each row."""
    # Tokens in a column of their own: as an expression they would be worked out at every use.
    tokens = docs.withColumn("_tokens", text.topic_tokens(F.col(column)))
    return count_lists(tokens, vocab, "_tokens", out)


def count_lists(listed: DataFrame, vocab: list[str], tokens: str = "tokens", out: str = "counts") -> DataFrame:
    """``count_vectors`` of token lists, which go."""
    terms = listed.withColumn("_terms", text.uni_and_bigrams(F.col(tokens)))
    model = CountVectorizerModel.from_vocabulary(vocab, inputCol="_terms", outputCol=out)
    return model.transform(terms).drop(tokens, "_terms")


@dataclass
class TermWeights:
    """Sublinear counts times smooth inverse document frequency, unit length."""

    idf: list[float]

    @staticmethod
    def fit(counted: DataFrame, counts: str = "counts") -> TermWeights:
        model = IDF(inputCol=counts, outputCol="_w").fit(counted)
        n = model.numDocs
        return TermWeights([math.log((1 + n) / (1 + df)) + 1 for df in model.docFreq])

    @staticmethod
    def of_lists(listed: DataFrame, vocab: list[str]) -> TermWeights:
        """``fit`` on token lists."""
        counter = TermCounter.of(vocab)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(counter.size + 1)
            for b in batches:
                total += np.append((counter.counts(b["tokens"]) > 0).sum(0), b.num_rows)
            yield sums.as_row(total)

        *found, n = sums.added(listed.select("tokens").mapInArrow(run, "sums BINARY"))
        return TermWeights([math.log((1 + n) / (1 + df)) + 1 for df in found])

    def of_counts(self, counts: np.ndarray) -> np.ndarray:
        """``apply`` on rows of counts."""
        raw = np.where(counts > 0, (1 + np.log(np.maximum(counts, 1))) * np.array(self.idf), 0.0)
        length = np.sqrt((raw * raw).sum(1, keepdims=True))
        return raw / np.where(length > 0, length, 1.0)

    def apply(self, counted: DataFrame, counts: str = "counts", out: str = "weights") -> DataFrame:
        idf = F.array(*[F.lit(x) for x in self.idf])
        raw = F.zip_with(
            vector_to_array(counts), idf, lambda x, w: F.when(x > 0, (1 + F.ln(x)) * w).otherwise(F.lit(0.0))
        )
        return counted.withColumn("_raw", raw).withColumn(out, unit(F.col("_raw"))).drop("_raw")


def long_weights(weighted: DataFrame, key: str, vocab: list[str], weights: str = "weights") -> DataFrame:
    """Non-zero term weights as ``key, term, weight``."""
    terms = F.array(*[F.lit(t) for t in vocab])
    return (
        weighted.select(key, F.posexplode_outer(weights).alias("_i", "weight"))
        .where("weight > 0")
        .select(key, F.get(terms, F.col("_i")).alias("term"), "weight")
    )


# -- Latent Dirichlet allocation ---------------------------------------------


def fit_lda(counted: DataFrame, terms: int, counts: str = "counts", k: int = N_TOPICS, max_iter: int = 100, seed: int = 42):
    """Online LDA with sparse document and topic priors; every pass sees all documents."""
    return lda.fit(counted, counts, terms, k, max_iter, seed)


def lda_weights(model: lda.TopicModel, counted: DataFrame, out: str = "lda_weights") -> DataFrame:
    return lda.weights(model, counted, "counts", out)


def lda_terms(model, vocab: list[str], n: int = 10) -> DataFrame:
    """``topic_id, rank, term, weight`` of the n heaviest terms of every topic."""
    return top_terms(SparkSession.active(), model.strengths, vocab, n)


# -- Non-negative factorisation ----------------------------------------------


@dataclass
class Factors:
    """Topic-by-term matrix and the penalties it was fitted with."""

    h: np.ndarray
    l1_w: float
    l2_w: float
    error: float
    errors: list[float]


def _solve_rows(x: np.ndarray, h: np.ndarray, l1: float, l2: float, sweeps: int) -> np.ndarray:
    """Best non-negative topic weights of every row for fixed topics, coordinate by coordinate."""
    gram, cross = h @ h.T, x @ h.T
    diagonal = np.maximum(np.diag(gram) + l2, 1e-12)
    w = np.maximum(cross - l1, 0) / np.maximum(gram.sum(1) + l2, 1e-12)
    for _ in range(sweeps):
        for j in range(len(h)):
            rest = cross[:, j] - w @ gram[:, j] + w[:, j] * gram[j, j]
            w[:, j] = np.maximum(rest - l1, 0) / diagonal[j]
    return w


def _start(points: DataFrame, k: int) -> tuple[np.ndarray, int]:
    """Deterministic start from the leading singular vectors, zeros filled with the mean.

    The term-by-term product matrix is summed in the tasks; the sizes of the positive and
    negative parts of the left vectors take a second pass.
    """

    def gram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n, s = None, 0, 0.0
        for b in batches:
            if b.num_rows:
                x = blocks.matrix(pa.Table.from_batches([b])["x"])
                g = x.T @ x
                total, n, s = (g if total is None else total + g), n + len(x), s + x.sum()
        if total is not None:
            yield sums.as_row(np.append(total, [n, s]))

    *product, n, total = sums.added(points.mapInArrow(gram, "sums BINARY"))
    size = math.isqrt(len(product))
    values, vectors = np.linalg.eigh(np.reshape(product, (size, size)))
    pick = np.argsort(values)[::-1][:k]
    singular, right = np.sqrt(np.maximum(values[pick], 0)), vectors[:, pick].T
    mean = total / (n * size)
    safe = np.where(singular > 0, singular, 1.0)

    def halves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plus = minus = None
        for b in batches:
            if b.num_rows:
                u = blocks.matrix(pa.Table.from_batches([b])["x"]) @ right.T / safe
                p, m = (np.maximum(u, 0) ** 2).sum(0), (np.maximum(-u, 0) ** 2).sum(0)
                plus, minus = (p, m) if plus is None else (plus + p, minus + m)
        if plus is not None:
            yield sums.as_row(np.concatenate([plus, minus]))

    both = sums.added(points.mapInArrow(halves, "sums BINARY"))
    u_plus, u_minus = np.sqrt(both[:k]), np.sqrt(both[k:])
    h = np.zeros((k, size))
    h[0] = np.sqrt(singular[0]) * np.abs(right[0])
    for j in range(1, k):
        plus, minus = np.maximum(right[j], 0), np.maximum(-right[j], 0)
        up, down = u_plus[j] * np.linalg.norm(plus), u_minus[j] * np.linalg.norm(minus)
        part, weight = (plus, up) if up > down else (minus, down)
        h[j] = np.sqrt(singular[j] * weight) * part / max(np.linalg.norm(part), 1e-12)
    h[h < 1e-6] = mean
    return h, int(n)


def fit_nmf(
    weighted: DataFrame, weights: str = "weights", k: int = N_TOPICS, max_iter: int = 500, tol: float = 1e-4,
    alpha: float = 0.0, l1_ratio: float = 0.5, sweeps: int = 20,
) -> Factors:
    """Alternating non-negative least squares with the topics on the driver.

    Row weights are solved anew in every pass, so a pass depends on the data and the small
    topic matrix alone; sums of k*k and k*terms numbers leave the tasks and meet in a tree. ``alpha`` penalises
    both sides; the customary 0.1 shrinks every factor of unit-length rows to zero, hence 0.
    """
    points = weighted.select(F.col(weights).alias("x"))
    tasks = points.rdd.getNumPartitions()
    h, n = _start(points, k)
    terms = h.shape[1]
    l1_w, l2_w = terms * alpha * l1_ratio, terms * alpha * (1 - l1_ratio)
    l1_h, l2_h = n * alpha * l1_ratio, n * alpha * (1 - l1_ratio)
    errors: list[float] = []
    for _ in range(max_iter):

        def products(batches: Iterator[pa.RecordBatch], h=h) -> Iterator[pa.RecordBatch]:
            total, s = None, 0.0
            for b in batches:
                if b.num_rows:
                    x = blocks.matrix(pa.Table.from_batches([b])["x"])
                    w = _solve_rows(x, h, l1_w, l2_w, sweeps)
                    part = np.concatenate([(w.T @ w).ravel(), (w.T @ x).ravel()])
                    total = part if total is None else total + part
                    s += ((x - w @ h) ** 2).sum()
            if total is not None:
                yield sums.as_row(np.append(total, s))

        out = sums.added(points.mapInArrow(products, "sums BINARY"), tasks=tasks)
        errors.append(math.sqrt(max(out[-1], 0.0)))
        if len(errors) > 1 and errors[-2] - errors[-1] < tol * errors[0]:
            break
        ww, wx = out[: k * k].reshape(k, k), out[k * k : -1].reshape(k, terms)
        h = h.copy()
        for _ in range(sweeps):
            for j in range(k):
                rest = wx[j] - ww[j] @ h + ww[j, j] * h[j]
                h[j] = np.maximum(rest - l1_h, 0) / max(ww[j, j] + l2_h, 1e-12)
    return Factors(h, l1_w, l2_w, errors[-1], errors)


def nmf_weights(
    factors: Factors, weighted: DataFrame, keep: list[str], weights: str = "weights", out: str = "nmf_weights",
    sweeps: int = 20,
) -> DataFrame:
    """Columns ``keep`` and the topic weights of every row, scaled to sum to one; rows
    without any stay zero."""

    return _solved(factors, weighted.select(*keep, weights), keep, blocks.matrix, out, sweeps)


def nmf_weights_of_lists(
    factors: Factors, listed: DataFrame, keep: list[str], vocab: list[str], weights: TermWeights, out: str = "nmf_weights",
    sweeps: int = 20,
) -> DataFrame:
    """``nmf_weights`` of token lists; counts and term weights stay in the tasks."""
    counter = TermCounter.of(vocab)

    def matrix(lists: pa.ChunkedArray) -> np.ndarray:
        return weights.of_counts(counter.counts(lists.combine_chunks()))

    return _solved(factors, listed.select(*keep, "tokens"), keep, matrix, out, sweeps)


def _solved(factors: Factors, rows: DataFrame, keep: list[str], matrix, out: str, sweeps: int) -> DataFrame:
    """Columns ``keep`` and the shares of the topics, from the rows that ``matrix`` reads off the last column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows == 0:
                continue
            x = matrix(pa.Table.from_batches([b]).column(len(keep)))
            w = _solve_rows(x, factors.h, factors.l1_w, factors.l2_w, sweeps)
            solved = pa.array(w.tolist(), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], solved], names=[*keep, out])

    kept = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes[: len(keep)])
    return rows.mapInArrow(run, f"{kept}, {out} ARRAY<DOUBLE>").withColumn(out, shares(F.col(out)))


# -- Reading topics ----------------------------------------------------------


def top_terms(spark, matrix: np.ndarray, vocab: list[str], n: int = 10) -> DataFrame:
    """``topic_id, rank, term, weight``; equal weights put the later term first."""
    long = spark.createDataFrame(
        [(t, vocab[i], float(w)) for t, row in enumerate(matrix) for i, w in enumerate(row)],
        "topic_id INT, term STRING, weight DOUBLE",
    )
    w = Window.partitionBy("topic_id").orderBy(F.desc("weight"), F.desc("term"))
    return long.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def top_topics(weights, labels: dict[int, str] = fixed.TOPIC_LABELS, k: int = 3, digits: int = 3):
    """The k heaviest topics of a weight array as structs; equal weights put the later
    topic first."""
    column = F.col(weights) if isinstance(weights, str) else weights
    names = F.array(*[F.lit(labels[i]) for i in sorted(labels)])
    keyed = F.transform(column, lambda w, i: F.struct((-w).alias("w"), (-i).alias("i")))
    return F.transform(
        F.slice(F.sort_array(keyed), 1, k),
        lambda s: F.struct(
            (-s["i"]).alias("topic_id"),
            F.coalesce(F.get(names, -s["i"]), F.concat(F.lit("Topic "), (-s["i"]).cast("string"))).alias("label"),
            F.bround(-s["w"], digits).alias("weight"),
        ),
    )

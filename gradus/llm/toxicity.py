"""Toxicity from subword-bag embeddings averaged into a linear softmax."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradus.llm.common import as_text, documents, row_and, slices

GRAMS = (3, 4, 5)  # characters of a subword, word edges included
BUCKETS = 1 << 20
WIDTH = 16
WINDOW = 3  # words averaged together
# Bound of the sample the model is fitted on: labelled rows of each class, those with the least key hashes.
SAMPLE_ROWS = 2000
EPOCHS = 25
SHRINK = 0.03  # share of every vector that a step takes away
FOLDS = 3  # parts of the sample that are scored by a model of the others, to set where the line of 0.7 lies
ALARMS = 0.01  # share of the clean texts of those parts that may lie above it
SEEDS = (0, 1, 2)  # beginnings whose models are averaged
LINE = 0.7
RATES = (0.3, 0.1, 0.1)  # of vectors, softmax rows and bias
DAMPING = 1e-8  # what every sum of squared slopes begins with
_MIX = np.uint64(0x9E3779B97F4A7C15)


def words_of(column: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct lower-case words between ASCII spaces, the word of every occurrence, and where rows begin."""
    listed = pc.ascii_split_whitespace(column)
    flat = listed.flatten()
    at = listed.offsets.to_numpy() - listed.offsets[0].as_py()
    real = pc.not_equal(flat, "")  # a row that begins or ends with spaces has empty pieces
    at = np.concatenate([[0], np.cumsum(real.to_numpy(zero_copy_only=False))])[at]
    coded = flat.filter(real).dictionary_encode()
    return [w.lower() for w in coded.dictionary.to_pylist()], coded.indices.to_numpy(zero_copy_only=False), at


def subwords(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all subwords of each word, and where each word's begin; every word has one at least."""
    whole = "".join(f"<{w}>\n" for w in words)
    code = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    ends = np.flatnonzero(code == 10)
    at = np.concatenate([[0], ends + 1])
    size = np.diff(at) - 1
    found, owner = [], []
    power = code
    for n in range(2, max(GRAMS) + 1):
        power = power[:-1] * np.uint64(0x100000001B3) + code[n - 1 :]
        if n in GRAMS:
            count = np.maximum(size - n + 1, 0)
            word = np.repeat(np.arange(len(words)), count)
            place = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + at[word]
            found.append(power[place])
            owner.append(word)
    # a word too short for any subword is one by itself
    short = np.flatnonzero(size < min(GRAMS))
    found.append(code[at[short] + 1] + np.uint64(1))
    owner.append(short)
    h, owner = np.concatenate(found), np.concatenate(owner)
    h = (h ^ (h >> np.uint64(32))) * _MIX
    h ^= h >> np.uint64(29)
    order = np.argsort(owner, kind="stable")
    return (h[order] % np.uint64(BUCKETS)).astype(np.int32), np.searchsorted(owner[order], np.arange(len(words) + 1))


def subwords_of_many(words: list[str], some: int = 20_000) -> tuple[np.ndarray, np.ndarray]:
    """The same for a long list, some words at a time."""
    parts = [subwords(words[i : i + some]) for i in range(0, len(words), some)]
    sizes = np.concatenate([np.diff(begin) for _, begin in parts]) if parts else np.zeros(0, np.int64)
    grams = np.concatenate([g for g, _ in parts]) if parts else np.zeros(0, np.int32)
    return grams, np.concatenate([[0], np.cumsum(sizes)])


@dataclass
class Model:
    """Vectors of the subword buckets that the sample has, and the softmax's two rows; only their difference decides."""

    seen: np.ndarray
    vectors: np.ndarray
    weights: np.ndarray
    bias: np.ndarray

    @classmethod
    def fit(cls, texts: pa.Array, toxic: np.ndarray, epochs: int = EPOCHS, seed: int = 7) -> Model:
        """Vectors and softmax together, by gradient steps over all texts of the sample.

        A label belongs to a text, not to a place in it: in each step a text stands for its window of words that is toxic
        most likely. Classes weigh the same; vectors shrink a little with every step.
        """
        random = np.random.default_rng(seed)
        model = cls(np.zeros(0, np.int32), np.zeros((0, WIDTH), np.float32), random.normal(0, 0.3, (2, WIDTH)), np.zeros(2))
        if not len(toxic):
            return model
        words, order, at = words_of(texts)
        grams, begin = subwords_of_many(words)
        seen = np.unique(grams)
        local = np.searchsorted(seen, grams).astype(np.int32)
        del grams, words
        size = np.diff(begin)
        vectors = random.normal(0, 0.1, (len(seen), WIDTH)).astype(np.float32)
        weight = np.where(toxic == 1, 0.5 / max(1, np.sum(toxic == 1)), 0.5 / max(1, np.sum(toxic == 0)))
        steps = [np.full_like(vectors, DAMPING), np.full_like(model.weights, 1e-8), np.full_like(model.bias, 1e-8)]
        for _ in range(epochs):
            side = (model.weights[1] - model.weights[0]).astype(np.float32)
            scored = np.add.reduceat((vectors @ side)[local], begin[:-1]) / size
            value, first, count = best_windows(scored[order].astype(np.float64), at)
            p = 1 / (1 + np.exp(-np.clip(value + model.bias[1] - model.bias[0], -30, 30)))
            error = (p - toxic) * weight
            # every word of a chosen window takes an equal part, and so does every subword of a word
            row = np.repeat(np.arange(len(count)), count)
            place = np.repeat(first, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            word = order[place]
            part = (error / np.maximum(count, 1))[row] / size[word]
            gram = local[np.repeat(begin[word], size[word]) + _steps(size[word])]
            force = np.bincount(gram, np.repeat(part, size[word]), len(seen)).astype(np.float32)
            pulls = np.outer(force, side), force @ vectors, error.sum()
            slopes = pulls[0], np.stack([-pulls[1], pulls[1]]), np.array([-pulls[2], pulls[2]])
            for held, past, slope, rate in zip((vectors, model.weights, model.bias), steps, slopes, RATES):
                past += slope**2
                held -= rate * slope / np.sqrt(past)
            vectors *= 1 - SHRINK
        model.seen, model.vectors = seen, vectors
        return model



@dataclass
class Scorer:
    """What every bucket adds to the log odds, and what stands before; unknown buckets speak for neither class."""

    adds: np.ndarray
    bias: float

    @classmethod
    def mean(cls, texts: pa.Array, toxic: np.ndarray) -> Scorer:
        """The mean of models from several beginnings: which windows a fit settles on depends on where it begins."""
        adds, bias = np.zeros(BUCKETS), 0.0
        for seed in SEEDS:
            model = Model.fit(texts, toxic, seed=seed)
            adds[model.seen] += model.vectors @ (model.weights[1] - model.weights[0]) / len(SEEDS)
            bias += float(model.bias[1] - model.bias[0]) / len(SEEDS)
        return cls(adds, bias)

    @classmethod
    def fit(cls, texts: pa.Array, toxic: np.ndarray) -> Scorer:
        """``mean``, moved so that ``LINE`` lets pass what it should.

        A model scores texts it has not learned from lower and more alike than its own. So each of ``FOLDS`` parts is scored by
        a model of the other parts, and the score that ``ALARMS`` of their clean texts exceed becomes the line.
        """
        model = cls.mean(texts, toxic)
        if min(np.sum(toxic == 1), np.sum(toxic == 0)) < 2 * FOLDS:
            return model
        turn = np.empty(len(toxic), np.int64)
        for c in (0, 1):
            turn[toxic == c] = np.arange(np.sum(toxic == c)) % FOLDS
        clean = []
        for f in range(FOLDS):
            part = cls.mean(texts.filter(pa.array(turn != f)), toxic[turn != f])
            clean.append(part.log_odds(texts.filter(pa.array((turn == f) & (toxic == 0)))))
        line = np.quantile(np.concatenate(clean), 1 - ALARMS)
        return cls(model.adds, float(model.bias + np.log(LINE / (1 - LINE)) - line))

    def log_odds(self, texts: pa.Array) -> np.ndarray:
        parts = [log_odds(texts.slice(i, 256), self.adds, self.bias) for i in range(0, len(texts), 256)]
        return np.concatenate(parts) if parts else np.zeros(0)


def log_odds(texts: pa.Array, adds: np.ndarray, bias: float) -> np.ndarray:
    """Log odds of whole texts, from the mean of their most toxic window of words; without words the bias, at most 0."""
    words, order, at = words_of(texts)
    value = np.zeros(len(texts))
    if len(words):
        grams, begin = subwords(words)
        scored = np.add.reduceat(adds[grams], begin[:-1]) / np.diff(begin)
        value = best_windows(scored[order], at)[0]
    return np.where(np.diff(at) > 0, value + bias, min(bias, 0.0))


def _steps(size: np.ndarray) -> np.ndarray:
    return np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)


def best_windows(values: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each row, the greatest mean of ``WINDOW`` values in a run (all values, if it has fewer), where, and how many."""
    n = np.diff(at)
    best, first = np.zeros(len(n)), at[:-1].copy()
    sums = np.concatenate([[0.0], np.cumsum(values)])
    short = n < WINDOW
    best[short] = (sums[at[1:]] - sums[at[:-1]])[short] / np.maximum(n[short], 1)
    long = np.flatnonzero(~short)
    if len(long):
        mean = np.append((sums[WINDOW:] - sums[:-WINDOW]) / WINDOW, np.full(WINDOW - 1, -np.inf))
        owner = np.repeat(np.arange(len(n)), n)
        mean[np.arange(len(values)) + WINDOW > at[owner + 1]] = -np.inf
        best[long] = np.maximum.reduceat(mean, at[:-1][long]) if len(long) == len(n) else _row_maxima(mean, at, long)
        hit = np.flatnonzero((mean == best[owner]) & ~short[owner])
        rows, where = np.unique(owner[hit], return_index=True)
        first[rows] = hit[where]
    return best, first, np.minimum(n, WINDOW)


def _row_maxima(mean: np.ndarray, at: np.ndarray, rows: np.ndarray) -> np.ndarray:
    edges = np.stack([at[rows], at[rows + 1]], axis=1).ravel()
    padded = np.append(mean, -np.inf)
    return np.maximum.reduceat(padded, edges)[::2]


def fit(docs: DataFrame, labels: DataFrame, learn: Column, key: str = "doc_id", text: str = "text", label: str = "toxic", rows: int = SAMPLE_ROWS) -> Scorer:
    """A model from at most ``rows`` labelled texts of each class among those where ``learn``, of the key, holds.

    The sample is those with the least key hashes, so it does not depend on the order of rows. Labels other than 0 and 1 are
    not used.
    """
    known = labels.select(F.col(key).alias("_key"), F.col(label).cast("int").alias("_label"))
    known = known.withColumnRenamed("_key", key).where(learn & F.col(key).isNotNull()).withColumnRenamed(key, "_key").distinct()
    order = F.xxhash64("_key"), F.col("_key")
    some = [known.where(F.col("_label") == c).orderBy(*order).limit(rows) for c in (0, 1)]
    # at most 2 * rows keys
    chosen = F.broadcast(some[0].unionByName(some[1]))
    table = docs.select(F.col(key).alias("_key"), as_text(text).alias("_text")).join(chosen, "_key").orderBy("_key", "_label", F.xxhash64("_text")).select("_text", "_label").toArrow()
    if not table.num_rows:
        return Scorer.fit(pa.array([], pa.string()), np.zeros(0))
    return Scorer.fit(table.column("_text").combine_chunks(), table.column("_label").to_numpy().astype(float))


def score(docs: DataFrame, model: Scorer, text: str = "text") -> DataFrame:
    """The columns of ``docs`` but the text in struct ``_row``, with ``score`` (0 to 1) from its most toxic window of words.

    A text without a word, or null, has the score of the softmax's bias alone, at most one half.
    """
    held = docs.sparkSession.sparkContext.broadcast((model.adds, model.bias))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        adds, bias = held.value
        for batch in slices(batches, "_text"):
            out = 1 / (1 + np.exp(-np.clip(log_odds(batch.column("_text"), adds, bias), -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column("_row"), pa.array(out)], names=["_row", "score"])

    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text])
    taken = docs.select(row.alias("_row"), as_text(text).alias("_text"))
    return taken.mapInArrow(each, row_and(taken, "score double"))


def op1_toxicity(spark, sf_dir: str) -> DataFrame:
    """Toxicity of every document by a model of the labels of two thirds of the keys."""
    docs = documents(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 3 == 1
    model = fit(docs, labels, ~held_out)
    out = score(docs.select("doc_id", held_out.alias("held_out"), "text"), model)
    return out.select("_row.doc_id", "_row.held_out", "score", (F.col("score") >= LINE).cast("int").alias("predicted"))


QUERIES = {"op1_toxicity": op1_toxicity}
SQL: dict[str, str] = {}

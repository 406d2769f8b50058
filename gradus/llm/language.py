"""Language by interpolated Kneser-Ney models of characters."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradus.llm.common import as_text, documents, row_and, slices
from gradus.operators import sums

ORDER = 4
_BITS = 6  # of a symbol: a grams's number has 24 bits, which bounds a language's model by 2**24 grams
_START, _END = 62, 63
UNDECIDED = "und"
SHARPNESS = [2.0**k for k in range(-2, 8)]


@lru_cache(maxsize=1)
def _classes() -> tuple[np.ndarray, np.ndarray]:
    """Symbol of every code point, -1 outside of words; and whether it is a letter. a to z have symbols of their own, other
    letters and marks share the rest by a rule."""
    symbol = np.full(0x110000, -1, np.int8)
    letter = np.zeros(0x110000, bool)
    for c in range(0x110000):
        kind = unicodedata.category(chr(c))[0]
        if kind in "LM":
            symbol[c] = c - 97 if 97 <= c <= 122 else 26 + c * 7 % 36
            letter[c] = kind == "L"
    return symbol, letter


@dataclass
class Pieces:
    """Grams of the distinct pieces of some rows, and which pieces each row has."""

    grams: np.ndarray  # by piece
    begin: np.ndarray  # where a piece's grams begin
    letters: np.ndarray  # letters of each piece
    order: np.ndarray  # piece of every occurrence, row after row
    at: np.ndarray  # where a row's occurrences begin


def pieces(column: pa.Array) -> Pieces:
    listed = pc.ascii_split_whitespace(column)
    coded = listed.flatten().dictionary_encode()
    at = listed.offsets.to_numpy()
    # lower case may change a piece's length; it never makes or takes a line end
    whole = "\n".join(coded.dictionary.to_pylist()).lower() + "\n"
    code = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
    symbol, letter = _classes()
    kind = symbol[code].astype(np.int32)
    ends = np.flatnonzero(code == 10)
    piece = np.searchsorted(ends, np.arange(len(code)), "left").astype(np.int32)
    inside = kind >= 0
    before = np.concatenate([[False], inside[:-1]])
    used = np.flatnonzero(inside | before)
    sym = np.where(inside[used], kind[used], _END)
    head = inside[used] & ~before[used]
    place = np.arange(len(used)) - np.maximum.accumulate(np.where(head, np.arange(len(used)), 0))
    gram = sym.copy()
    for j in range(1, ORDER):
        past = np.full(len(sym), _START, sym.dtype)
        past[j:] = np.where(place[j:] >= j, sym[:-j], _START)
        gram |= past << (_BITS * j)
    n = len(coded.dictionary)
    return Pieces(
        gram, np.searchsorted(piece[used], np.arange(n + 1)), np.bincount(piece, letter[code], n)[:n],
        coded.indices.to_numpy(zero_copy_only=False), at - at[0],
    )


def gram_counts(docs: DataFrame, lang: str, text: str) -> DataFrame:
    """``lang, gram, n`` over all texts with a language: how often each gram of characters within words occurs."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for batch in slices(batches, "_text"):
            p = pieces(batch.column("_text"))
            langs = batch.column("_lang").dictionary_encode()
            row_lang = np.repeat(langs.indices.to_numpy(zero_copy_only=False), np.diff(p.at))
            for i, name in enumerate(langs.dictionary.to_pylist()):
                times = np.bincount(p.order[row_lang == i], minlength=len(p.begin) - 1)
                weight = np.repeat(times, np.diff(p.begin))
                some = weight > 0
                old = held.get(name, (np.zeros(0, np.int32), np.zeros(0)))
                grams, inverse = np.unique(np.concatenate([old[0], p.grams[some]]), return_inverse=True)
                held[name] = grams.astype(np.int32), np.bincount(inverse, np.concatenate([old[1], weight[some]]))
        for name, (grams, n) in held.items():
            columns = [pa.array([name] * len(grams)), pa.array(grams), pa.array(n.astype(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, names=["lang", "gram", "n"])

    learn = docs.select(F.col(lang).alias("_lang"), as_text(text).alias("_text")).where("_lang IS NOT NULL")
    counted = learn.mapInArrow(each, "lang string, gram int, n bigint")
    return counted.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


class Models:
    """Kneser-Ney models of several languages in shared sorted arrays of gram numbers, one for each order."""

    def __init__(self, counts: dict[str, tuple[np.ndarray, np.ndarray]]):
        self.langs = sorted(counts)
        self.sharpness, self.limits = 1.0, np.full(len(self.langs), np.inf)
        tables = [self._orders(*counts[name]) for name in self.langs]
        self.grams, self.share, self.contexts, self.rest = [], [], [], []
        for n in range(ORDER):
            for names, values, at, missing in ((self.grams, self.share, 0, 0.0), (self.contexts, self.rest, 2, 1.0)):
                keys = np.unique(np.concatenate([t[n][at] for t in tables])) if tables else np.zeros(0, np.int32)
                matrix = np.full((len(keys) + 1, len(tables)), missing, np.float32)  # the last row is for what is not listed
                for j, t in enumerate(tables):
                    matrix[np.searchsorted(keys, t[n][at]), j] = t[n][at + 1]
                names.append(keys)
                values.append(matrix)

    @staticmethod
    def _orders(grams: np.ndarray, n: np.ndarray) -> list[tuple]:
        """For orders 1 to the highest: grams, their discounted shares, contexts, the shares left to the next lower order."""
        out = []
        for order in range(ORDER, 0, -1):
            once, twice = np.sum(n == 1), np.sum(n == 2)
            discount = once / (once + 2 * twice) if once and twice else 0.5
            context, at = np.unique(grams >> _BITS, return_inverse=True)
            total, kinds = np.bincount(at, n), np.bincount(at)
            out.append((grams, np.maximum(n - discount, 0) / total[at], context, discount * kinds / total))
            # how many grams end in each of the next lower order
            grams, n = np.unique(grams & ((1 << _BITS * (order - 1)) - 1), return_counts=True)
        return out[::-1]

    def surprise(self, grams: np.ndarray) -> np.ndarray:
        """Bits of the last symbol of each gram after the others, by language."""
        distinct, at = np.unique(grams, return_inverse=True)
        p = np.full((len(distinct), len(self.langs)), 1 / (_END + 1), np.float32)
        for n in range(ORDER):
            gram = distinct & ((1 << _BITS * (n + 1)) - 1)
            p = self._of(self.grams[n], self.share[n], gram) + self._of(self.contexts[n], self.rest[n], gram >> _BITS) * p
        return -np.log2(p)[at]

    @staticmethod
    def _of(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        at = np.searchsorted(keys, wanted)
        at[at < len(keys)] = np.where(keys[at[at < len(keys)]] == wanted[at < len(keys)], at[at < len(keys)], len(keys))
        return values[at]

    def entropies(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Bits a symbol of every row by language, and whether the row has a letter."""
        p = pieces(column)
        size = np.diff(p.begin)
        sums = np.concatenate([np.zeros((1, len(self.langs))), np.cumsum(self.surprise(p.grams), axis=0, dtype=np.float64)])
        bits = sums[p.begin[1:]] - sums[p.begin[:-1]]
        row = np.repeat(np.arange(len(p.at) - 1), np.diff(p.at))
        count = lambda w: np.bincount(row, w[p.order], len(p.at) - 1)
        symbols = np.maximum(count(size), 1)
        each = [count(bits[:, j]) / symbols for j in range(len(self.langs))]
        return np.stack(each, axis=1) if each else np.zeros((len(symbols), 0)), count(p.letters) > 0

    def confidence(self, entropy: np.ndarray, sharpness: float) -> np.ndarray:
        z = -(entropy - entropy.min(axis=1, keepdims=True)) * sharpness
        return 1 / np.exp(z).sum(axis=1)

    def tally(self, column: pa.Array, truth: list[str]) -> np.ndarray:
        """What ``calibrate`` needs of some rows: the log likelihood at each sharpness, then by language the rows with a letter,
        their entropies under it and the squares of these."""
        entropy, letters = self.entropies(column)
        best = np.array([self.langs.index(t) for t in truth], int)
        entropy, best = entropy[letters], best[letters]
        out = np.zeros(len(SHARPNESS) + 3 * len(self.langs))
        if len(best):
            own = entropy[np.arange(len(best)), best]
            z = (own - entropy.min(axis=1)).sum()
            likely = [np.log(self.confidence(entropy, s)).sum() - s * z for s in SHARPNESS]
            by_lang = [np.bincount(best, w, len(self.langs)) for w in (np.ones(len(own)), own, own * own)]
            out = np.concatenate([likely, *by_lang])
        return out

    def calibrate(self, tallied: np.ndarray) -> None:
        """Sets how sharply entropies become a confidence, by likelihood, and above which entropy a text is rejected: three
        deviations over the mean of its language's texts."""
        likely, (n, total, squares) = tallied[: len(SHARPNESS)], tallied[len(SHARPNESS) :].reshape(3, -1)
        if not n.any():
            return
        self.sharpness = SHARPNESS[int(np.argmax(likely))]
        some = np.maximum(n, 1)
        deviation = np.sqrt(np.maximum(squares / some - (total / some) ** 2, 0))
        self.limits = np.where(n > 0, total / some + 3 * deviation, np.inf)


def fit(docs: DataFrame, learn: Column, lang: str = "lang", text: str = "text") -> Models:
    """Models of all languages from every row where ``learn`` holds and the language is known.

    Counts and calibration cover all those rows, in a pass each. Driver and tasks hold at most 2**24 grams of each language.
    """
    seen = docs.where(learn & F.col(lang).isNotNull())
    table = gram_counts(seen, lang, text).toPandas()
    models = Models(
        {name: (g["gram"].to_numpy()[o], g["n"].to_numpy(float)[o]) for name, g in table.groupby("lang") for o in [np.argsort(g["gram"].to_numpy())]}
    )
    held = docs.sparkSession.sparkContext.broadcast(models)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in slices(batches, "_text"):
            # a language whose texts have no word has no model
            batch = batch.filter(pc.is_in(batch.column("_lang"), value_set=pa.array(held.value.langs, pa.string())))
            if batch.num_rows:
                part = held.value.tally(batch.column("_text"), batch.column("_lang").to_pylist())
                total = part if total is None else total + part
        if total is not None:
            yield sums.as_row(total)

    tallied = sums.added(seen.select(F.col(lang).alias("_lang"), as_text(text).alias("_text")).mapInArrow(each, "sums BINARY"))
    if tallied is not None and models.langs:
        models.calibrate(tallied)
    return models


def predict(docs: DataFrame, models: Models, text: str = "text") -> DataFrame:
    """The columns of ``docs`` but the text in struct ``_row``, with ``lang_pred``, ``score`` and ``rejected``.

    The language of the least cross-entropy a symbol over the whole text is taken; the score is its calibrated confidence. A
    null text, or one without a letter, is ``und`` with score zero and counts as rejected; so does a text that is as
    surprising for its language as hardly any of that language. Without any model every text is ``und``.
    """
    held = docs.sparkSession.sparkContext.broadcast(models)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        names = np.array([*m.langs, UNDECIDED], object)
        for batch in slices(batches, "_text"):
            entropy, letters = m.entropies(batch.column("_text"))
            known = letters & (len(m.langs) > 0)
            best = np.where(known, entropy.argmin(axis=1), len(m.langs)) if len(m.langs) else np.full(len(letters), 0)
            score = np.where(known, m.confidence(entropy, m.sharpness), 0.0) if len(m.langs) else np.zeros(len(letters))
            least = entropy.min(axis=1) if len(m.langs) else np.zeros(len(letters))
            rejected = ~known | (least > np.append(m.limits, np.inf)[best])
            columns = [batch.column("_row"), pa.array(names[best].tolist(), pa.string()), pa.array(score), pa.array(rejected)]
            yield pa.RecordBatch.from_arrays(columns, names=["_row", "lang_pred", "score", "rejected"])

    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text])
    taken = docs.select(row.alias("_row"), as_text(text).alias("_text"))
    return taken.mapInArrow(each, row_and(taken, "lang_pred string, score double, rejected boolean"))


def op5_language(spark, sf_dir: str) -> DataFrame:
    """Language of every document from models of three quarters of them."""
    docs = documents(spark, sf_dir)
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 4 == 2
    models = fit(docs, ~held_out)
    out = predict(docs.select("doc_id", held_out.alias("held_out"), "text"), models)
    return out.select("_row.doc_id", "_row.held_out", "lang_pred", "score", "rejected")


QUERIES = {"op5_language": op5_language}
SQL: dict[str, str] = {}

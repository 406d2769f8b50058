"""Name matching: equality or containment, the earliest right-hand entry wins."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

STRETCH = 1 << 20  # characters looked at together
SLICE = 512  # texts taken out of an Arrow batch at a time
MOST_BITS = 1 << 26  # of either filter
_BASE = 0x9E3779B97F4A7C15  # odd, so that it has an inverse modulo 2^64
_MIX = 0xD6E8FEB86659FD93
_START, _WHOLE, _LENGTH = 0, 1, 2
_OTHER = np.uint64(32)  # starts go by other bits of a hash, so that the tables err apart


class _Pieces:
    """Hashes of pieces of one string, all of a length at once: sums of characters by powers, divided by the first power."""

    def __init__(self, text: str, powers: np.ndarray, backs: np.ndarray):
        codes = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)
        self.sums = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum((codes + np.uint64(1)) * powers[: len(codes)], out=self.sums[1:])
        self.backs = backs

    def hashes(self, at: np.ndarray, size: int) -> np.ndarray:
        h = (self.sums[at + size] - self.sums[at]) * self.backs[at] + np.uint64(size)
        h = (h ^ (h >> np.uint64(32))) * np.uint64(_MIX)
        return h ^ (h >> np.uint64(32))


def _powers(base: int, n: int) -> np.ndarray:
    steps = np.full(n, base, np.uint64)
    steps[:1] = 1
    return np.cumprod(steps, dtype=np.uint64)


def _both_powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    return _powers(_BASE, n), _powers(pow(_BASE, -1, 1 << 64), n)


def _strings(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, list]]:
    for batch in batches:
        for start in range(0, batch.num_rows, SLICE):
            part = batch.slice(start, SLICE)
            yield part, part.column(column).to_pylist()


class _Filter:
    """Which starts and which whole names there may be, as bits, and the lengths of names from ``size`` characters on."""

    def __init__(self, names: DataFrame, size: int):
        n = names.count()
        bits = min(max(1 << (16 * n).bit_length(), 1 << 16), MOST_BITS)
        self.size, self.bits, self.starts, self.wholes = size, bits, np.zeros(bits // 64, np.uint64), np.zeros(bits // 64, np.uint64)
        rows = names.select("_name").mapInArrow(self._places(), "kind INT, word INT, bit BIGINT")
        told = rows.groupBy("kind", "word").agg(F.bit_or("bit").alias("bit")).toArrow()
        kind, word, bit = (told[c].to_numpy() for c in ("kind", "word", "bit"))
        for of, where in ((_START, self.starts), (_WHOLE, self.wholes)):
            where[word[kind == of]] = bit[kind == of].view(np.uint64)
        self.lengths = np.sort(word[kind == _LENGTH]).tolist()

    def _places(self):
        size, bits = self.size, np.uint64(self.bits - 1)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            powers = backs = np.zeros(0, np.uint64)
            zero = np.zeros(1, np.int64)
            for _, names in _strings(batches, 0):
                if (longest := max(map(len, names))) >= len(powers):
                    powers, backs = _both_powers(longest + 1)
                kinds, places = [], []
                for name in names:
                    told = _Pieces(name, powers, backs)
                    kinds.append(_WHOLE)
                    places.append(told.hashes(zero, len(name))[0] & bits)
                    if len(name) >= size:
                        kinds += [_START, _LENGTH]
                        places += [told.hashes(zero, size)[0] >> _OTHER & bits, np.uint64(len(name) * 64)]
                places = np.array(places, np.uint64)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.array(kinds, np.int32)), pa.array((places >> np.uint64(6)).astype(np.int32)),
                        pa.array((np.uint64(1) << (places & np.uint64(63))).view(np.int64)),
                    ],
                    names=["kind", "word", "bit"],
                )

        return run

    def may_be(self, words: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        places = hashes & np.uint64(self.bits - 1)
        return (words[places >> np.uint64(6)] >> (places & np.uint64(63))) & np.uint64(1) == 1

    def pieces(self, text: str, lengths: list[int], powers: np.ndarray, backs: np.ndarray) -> Iterator[tuple[int, str]]:
        """Place and piece of ``text``, several texts of the given lengths end to end, that may be names."""
        told = _Pieces(text, powers, backs)
        ends = np.cumsum(lengths)
        short = np.flatnonzero(np.array(lengths) < self.size)
        for i in short:  # only a whole text can equal a name below the least length
            at = np.array([ends[i] - lengths[i]])
            if self.may_be(self.wholes, told.hashes(at, lengths[i]))[0]:
                yield int(i), text[at[0] : ends[i]]
        left = np.repeat(ends, lengths) - np.arange(len(text))  # characters from here to the end of the same text
        at = np.flatnonzero(left >= self.size)
        at = at[self.may_be(self.starts, told.hashes(at, self.size) >> _OTHER)]
        for n in self.lengths:
            at = at[left[at] >= n] if len(at) else at
            if not len(at):
                break
            found = at[self.may_be(self.wholes, told.hashes(at, n))]
            for i, a in zip(np.searchsorted(ends, found, "right").tolist(), found.tolist()):
                yield i, text[a : a + n]


def _stretches(texts: list, stretch: int, overlap: int) -> Iterator[tuple[list[int], list[str]]]:
    """Texts put together up to ``stretch`` characters; a longer one in parts that overlap by the longest name.

    No part of a longer text is as short as a name that must be all of its text.
    """
    rows, parts, size = [], [], 0
    for row, text in enumerate(texts):
        for start in range(0, max(len(text), 1), stretch) if text is not None else ():
            part = text[start : start + stretch + overlap]
            if start and len(part) <= overlap:  # lies in the part before
                break
            if parts and size + len(part) > stretch:
                yield rows, parts
                rows, parts, size = [], [], 0
            rows, parts, size = [*rows, row], [*parts, part], size + len(part)
    if parts:
        yield rows, parts


def probable_names(texts: DataFrame, names: DataFrame, size: int, stretch: int = STRETCH) -> DataFrame:
    """``_lid, _name``: pieces of the texts (``_lid, _text``) that may be one of ``names`` (``_name``, distinct, not NULL).

    From ``size`` characters on a name may stand anywhere in a text, a shorter one must be all of it. Every task holds two
    bit tables of at most ``MOST_BITS`` bits, made from the names' starts and the whole names. Where a start may begin, the
    pieces as long as some name are looked up; only those found leave the task, each once a text and stretch. The tables
    miss none, and let one in sixteen pass by mistake at most, of those whose start passed, up to ``MOST_BITS / 16`` names;
    with more names more pieces leave, the join with the names decides the same.
    """
    known = _Filter(names, size)
    overlap = known.lengths[-1] if known.lengths else size
    held = texts.sparkSession.sparkContext.broadcast(known)
    schema = StructType([texts.schema["_lid"], StructField("_name", StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = held.value
        powers = backs = np.zeros(0, np.uint64)
        for batch, rows in _strings(batches, 1):
            for numbers, parts in _stretches(rows, stretch, overlap):
                joined = "".join(parts)
                if len(joined) >= len(powers):
                    powers, backs = _both_powers(2 * len(joined) + 1)
                lengths = [len(p) for p in parts]
                found = {(numbers[i], piece) for i, piece in known.pieces(joined, lengths, powers, backs)}
                if found:
                    lids = batch.column(0).take(pa.array([i for i, _ in found]))
                    yield pa.RecordBatch.from_arrays([lids, pa.array([p for _, p in found], pa.string())], names=["_lid", "_name"])

    return texts.select("_lid", "_text").mapInArrow(run, schema)


def first_match(
    left: DataFrame,
    right: DataFrame,
    left_id: str,
    left_text: str,
    right_name: str,
    right_value: str,
    ordinal: str,
    out: str,
    min_length: int = 6,
    stretch: int = STRETCH,
) -> DataFrame:
    """Attach the value of the earliest right row whose name equals the left text or, from
    ``min_length`` characters on, is contained in it; NULL when there is none.

    Texts are compared as they are: normalise both sides first. Texts are read once and stay where they are; what meets
    the names is their pieces that may be names.
    """
    names = (
        right.where(F.col(right_name).isNotNull())
        .groupBy(F.col(right_name).alias("_name"))
        .agg(F.min(ordinal).alias("_ord"), F.min_by(right_value, ordinal).alias("_value"))
    )
    texts = left.select(F.col(left_id).alias("_lid"), F.col(left_text).alias("_text"))
    # An empty name is contained in every text, so one character is the least.
    pieces = probable_names(texts, names, max(min_length, 1), stretch)
    best = pieces.join(names.select("_name", "_ord"), "_name").groupBy("_lid").agg(F.min("_ord").alias("_ord"))
    values = names.select("_ord", F.col("_value").alias(out))
    return (
        left.join(best.join(values, "_ord"), F.col(left_id) == F.col("_lid"), "left").drop("_lid", "_ord")
    )

"""Near duplicates by SimHash: fingerprints joined by walking a binary trie against itself."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradus.llm.common import SPACES, as_text, documents, slices, text_bytes, word_places, written
from gradus.llm.components import components

SEED = 42
BITS = 64
# A-Z to a-z, and every ASCII space to one kind.
_LOWERED = bytes(32 if SPACES[b] else b + 32 if 65 <= b <= 90 else b for b in range(256))


def shingle_hashes(column: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 of every shingle of every row, and the n + 1 places where rows begin."""
    data, at = text_bytes(column)
    data = np.frombuffer(data.tobytes().translate(_LOWERED), np.uint8)
    inside = data != 32
    keep = inside.copy()
    keep[1:] |= inside[:-1]  # one space behind each word
    moved = np.concatenate([[0], np.cumsum(keep)])
    data, at = data[keep], moved[at]
    starts, ends, first = word_places(data, at)
    n = np.diff(first)
    shingles = np.where(n > 0, np.maximum(n - words + 1, 1), 0)
    begin = np.concatenate([[0], np.cumsum(shingles)])
    lead = np.repeat(first[:-1] - begin[:-1], shingles) + np.arange(begin[-1])
    last = np.minimum(lead + words - 1, np.repeat(first[1:] - 1, shingles))
    held, digest = data.tobytes(), xxhash.xxh64_intdigest
    places = zip(starts[lead].tolist(), ends[last].tolist())
    return np.fromiter((digest(held[a:b], SEED) for a, b in places), np.uint64, int(begin[-1])), begin


def majority_bits(hashes: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """For each row the 64 bits that over half of its hashes have set; zero for a row without hashes."""
    out = np.zeros(len(begin) - 1, np.uint64)
    n = np.diff(begin)
    rows = np.flatnonzero(n)
    if len(rows):
        bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones = np.add.reduceat(bits, begin[rows], axis=0, dtype=np.int64)
        out[rows] = np.packbits(2 * ones > n[rows, None], axis=1, bitorder="little").view("<u8").ravel()
    return out


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 3) -> DataFrame:
    """``key, fingerprint`` (bigint holding 64 bits) of whole texts; nulls and texts without a word have zero."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text):
            value = majority_bits(*shingle_hashes(part.column(text), words)).view(np.int64)
            yield pa.RecordBatch.from_arrays([part.column(key), pa.array(value)], names=[key, "fingerprint"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(each, f"`{key}` {kind}, fingerprint bigint")


def trie_links(values: np.ndarray, begin: np.ndarray, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of places within ``budget`` bits of each other, for each of several sorted runs of distinct values.

    A sorted run is its own binary trie: a node is the stretch of values with the same leading bits. Pairs of nodes go
    down one bit at a time, from every root with itself; a pair is dropped once its leading bits differ in more than
    ``budget`` places, and a pair of single values is settled at once.
    """
    a0, a1 = begin[:-1].astype(np.int64), begin[1:].astype(np.int64)
    b0, b1, apart = a0, a1, np.zeros(len(a0), np.int64)
    left, right = [], []
    for bit in range(BITS - 1, -2, -1):
        single = (a1 - a0 == 1) & (b1 - b0 == 1)
        x, y = a0[single], b0[single]
        near = (x != y) & (np.bitwise_count(values[x] ^ values[y]) <= budget)
        left.append(x[near])
        right.append(y[near])
        a0, a1, b0, b1, apart = (v[~single] for v in (a0, a1, b0, b1, apart))
        if not len(a0) or bit < 0:
            break
        ones = np.concatenate([[0], np.cumsum((values >> np.uint64(bit)) & np.uint64(1), dtype=np.int64)])
        am, bm = a1 - (ones[a1] - ones[a0]), b1 - (ones[b1] - ones[b0])
        twin = a0 == b0
        a0, a1, b0, b1, apart, keep = (
            np.concatenate(parts)
            for parts in (
                (a0, am, a0, am), (am, a1, am, a1), (b0, bm, bm, b0), (bm, b1, b1, bm),
                (apart, apart, apart + 1, apart + 1),
                (np.ones(2 * len(a0), bool), np.ones(len(a0), bool), ~twin),
            )
        )
        keep = keep & (a0 < a1) & (b0 < b1) & (apart <= budget) & ~((a0 == b0) & (a1 - a0 == 1))
        a0, a1, b0, b1, apart = (v[keep] for v in (a0, a1, b0, b1, apart))
    return np.concatenate(left), np.concatenate(right)


def local_roots(n: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Smallest place reachable from each of n places over the pairs x, y."""
    root = np.arange(n)
    while True:
        a, b = root[x], root[y]
        open_ = a != b
        if not open_.any():
            return root
        np.minimum.at(root, np.maximum(a[open_], b[open_]), np.minimum(a[open_], b[open_]))
        while not np.array_equal(root[root], root):
            root = root[root]


def _cut(mask: int, parts: int) -> list[int]:
    """The free bits of a mask dealt to ``parts`` masks, each with the fixed bits set too."""
    free = [b for b in range(BITS) if not mask >> b & 1]
    size = -(-len(free) // parts)
    return [mask | sum(1 << b for b in free[i : i + size]) for i in range(0, len(free), size)]


def _signed(mask: int) -> int:
    return mask - (1 << BITS) if mask >> (BITS - 1) else mask


def _cells(rows: DataFrame, masks: list[int], parts: int) -> DataFrame:
    """Each row once for every part of its mask's free bits: values within the budget agree in one part at least."""
    table = F.create_map(*[x for m in masks for x in (F.lit(_signed(m)), F.array(*[F.lit(_signed(c)) for c in _cut(m, parts)]))])
    return rows.select("value", F.explode(table[F.col("mask")]).alias("mask")).withColumn(
        "cell", F.col("value").bitwiseAND(F.col("mask"))
    )


def links(values: DataFrame, budget: int, group: int = 2048) -> DataFrame:
    """``a, b``: links enough to connect all distinct ``value`` within ``budget`` bits of each other.

    Values are dealt to cells by the bits of one of budget + 1 parts. A cell of over ``group`` values is dealt on by
    its free bits in the same way, until every cell is small; none is left out. In a cell the trie is walked, and of
    its links a forest is kept.
    """
    parts, masks = budget + 1, [0]
    group = max(group, 1 << budget)  # a cell that is dealt on has more free bits than the budget
    rows = values.select(F.col("value").cast("bigint"), F.lit(0).cast("bigint").alias("mask"))
    found = None
    while rows is not None:
        dealt = _cells(rows, masks, parts)
        if len(masks) > 1:  # a value may come to a cell by several ways
            dealt = dealt.distinct()
        masks = sorted({c for m in masks for c in _cut(m, parts)})
        counted = dealt.groupBy("mask", "cell").agg(F.count("*").alias("_n")).where("_n > 1")
        sized = written(dealt.join(counted, ["mask", "cell"]))
        small, rows = sized.where(F.col("_n") <= group), sized.where(F.col("_n") > group)
        pairs = _cell_links(small, budget)
        found = pairs if found is None else found.unionByName(pairs)
        rows = None if rows.isEmpty() else rows.select("value", "mask")
    return found


def _cell_links(rows: DataFrame, budget: int) -> DataFrame:
    def settle(mask: np.ndarray, cell: np.ndarray, value: np.ndarray) -> Iterator[pa.RecordBatch]:
        order = np.lexsort((value, cell, mask))
        mask, cell, value = mask[order], cell[order], value[order]
        new = np.flatnonzero((np.diff(mask) != 0) | (np.diff(cell) != 0)) + 1
        begin = np.concatenate([[0], new, [len(value)]])
        work = np.cumsum(np.diff(begin).astype(np.float64) ** 2)
        cuts = [0, *(np.flatnonzero(np.diff(work // 4e6) > 0) + 1).tolist(), len(begin) - 1]
        for i, j in zip(cuts[:-1], cuts[1:]):
            part = value[begin[i] : begin[j]]
            root = local_roots(len(part), *trie_links(part, begin[i : j + 1] - begin[i], budget))
            moved = np.flatnonzero(root != np.arange(len(part)))
            ends = [pa.array(part[w].view(np.int64)) for w in (root[moved], moved)]
            yield pa.RecordBatch.from_arrays(ends, names=["a", "b"])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)]
        for batch in batches:
            got = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("mask", "cell", "value")]
            got[2] = got[2].view(np.uint64)
            rest = [np.concatenate(pair) for pair in zip(rest, got)]
            if not len(rest[0]):
                continue
            # the last cell may go on in the next batch
            end = np.flatnonzero((rest[0] != rest[0][-1]) | (rest[1] != rest[1][-1]))
            done = int(end[-1]) + 1 if len(end) else 0
            if done:
                yield from settle(*(v[:done] for v in rest))
                rest = [v[done:] for v in rest]
        if len(rest[0]):
            yield from settle(*rest)

    dealt = rows.select("mask", "cell", "value").repartition("mask", "cell").sortWithinPartitions("mask", "cell")
    return dealt.mapInArrow(each, "a bigint, b bigint")


def near_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 3, budget: int = 2) -> DataFrame:
    """``key, fingerprint, component``: the smallest key among all rows that chains of links of at most ``budget`` differing bits reach.

    Nulls and texts without a word have fingerprint zero and link like any other; equal texts always share a component.
    Repeated keys give repeated rows; an empty table gives none. Other columns are not read.
    """
    printed = written(fingerprints(docs, key, text, words))
    least = written(printed.groupBy(F.col("fingerprint").alias("value")).agg(F.min(key).alias("_least")))
    joined = components(links(least, budget), "a", "b")
    named = least.join(joined.withColumnRenamed("node", "value"), "value", "left").withColumn("root", F.coalesce("root", "value"))
    smallest = named.groupBy("root").agg(F.min("_least").alias("component"))
    named = named.join(smallest, "root").select(F.col("value").alias("fingerprint"), "component")
    return printed.join(named, "fingerprint").select(key, "fingerprint", "component")


def first_rows(docs: DataFrame, key: str, text: str, firsts: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The rows of ``docs`` whose ``_o, _t`` are in ``firsts`` of their keys and texts, ``_k, _text``; of equal rows, any."""
    body = as_text(text)
    order = F.coalesce(F.col(key).cast("bigint"), F.lit((1 << 63) - 1))
    names = docs.columns
    marked = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)], order.alias("_o"), F.xxhash64(body).alias("_t"))
    keyed = docs.select(F.struct(order.alias("_o"), F.xxhash64(body).alias("_t")).alias("_k"), body.alias("_text"))
    kept = marked.join(firsts(keyed), ["_o", "_t"], "left_semi").dropDuplicates(["_o", "_t"])
    return kept.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)])


def first_of_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 3, budget: int = 2) -> DataFrame:
    """The rows of ``docs`` that come first in their group of near duplicates, all columns as they are.

    First is the smallest integer key, null last; of rows with one key, the one with the least text hash; of equal rows, any.
    """

    def firsts(keyed: DataFrame) -> DataFrame:
        return near_groups(keyed, "_k", "_text", words, budget).select("component._o", "component._t").distinct()

    return first_rows(docs, key, text, firsts)


def op10_simhash(spark, sf_dir: str) -> DataFrame:
    """Fingerprint of every document and the smallest document its chain of near fingerprints reaches."""
    found = near_groups(documents(spark, sf_dir))
    return found.select(
        "doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), F.col("component").alias("component_id")
    )


QUERIES = {"op10_simhash": op10_simhash}
SQL: dict[str, str] = {}

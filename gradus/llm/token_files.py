"""Token ids in binary files: Re-Pair grammars with expansion lengths, decoded from any place."""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradus.llm.bpe import tokenizer_path
from gradus.llm.common import as_text, documents, shared_folder, slices, worker_store

BLOCK_IDS = 1 << 19  # ids that one grammar covers; a shard is one block, or those of one longer document
LEAST_PAIRS = 32  # a pair that occurs less often gets no rule
END = 1
_MAGIC = b"RPID"
_HEADER = "<4sIIIIQ"  # magic, alphabet, rules, symbols, bytes a symbol, ids
_LETTER = "[A-Za-zÀ-ÖØ-öø-ÿ]"
_REMEMBERED = 2_000_000  # pieces a task remembers; all are dropped when there are more
_SLICE_BYTES = 4 << 20
_BAND = 32
_BUCKET_BITS = 18
_LEFT, _RIGHT = np.uint32(2654435769), np.uint32(2246822519)
_ODD = np.int64(-7046029254386353131)  # multiplies numbers into a hashed order


def paired(ids: np.ndarray, least: int = LEAST_PAIRS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``alphabet, rules, body`` of a sequence: its distinct ids, pairs of symbols, and the symbols left.

    Symbols below ``len(alphabet)`` stand for ids, the next for rules, each of two earlier symbols. Pairs are replaced most
    frequent first: in each round all that are within a factor of ``_BAND`` of the most frequent one, in that order where
    they overlap, from left to right where a pair overlaps itself; until none occurs ``least`` times. Pairs are counted in
    hashed buckets first, so that only places of pairs that may be frequent are sorted.
    """
    alphabet, body = np.unique(ids, return_inverse=True)
    body, rules, named, limit = body.astype(np.uint32), [], len(alphabet), len(ids)
    while len(body) > 1:
        bucket = ((body[:-1] * _LEFT) ^ (body[1:] * _RIGHT)) >> np.uint32(32 - _BUCKET_BITS)
        held = np.bincount(bucket, minlength=1 << _BUCKET_BITS).astype(np.int32)
        limit = max(least, min(limit, int(held.max()) // _BAND))
        at = np.flatnonzero(held[bucket] >= limit)
        kinds, kind, times = np.unique(body[at].astype(np.int64) << 32 | body[at + 1], return_inverse=True, return_counts=True)
        rank = np.empty(len(kinds), np.int64)
        # equally frequent pairs in a hashed order: ranks that rise along a passage would be settled one by one
        rank[np.lexsort((kinds * _ODD, -times))] = np.arange(len(kinds))
        often = (times >= limit)[kind]
        at, kind = at[often], kind[often]
        taken = _apart(at, rank[kind])
        at, kind = at[taken], kind[taken]
        used = np.bincount(kind, minlength=len(kinds))
        kept = used >= 2
        if not kept.any():
            if limit <= least:
                break
            limit //= 2
            continue
        chosen = kept[kind]
        new = named + np.cumsum(kept) - 1
        rules.append(kinds[kept])
        named += int(kept.sum())
        at = at[chosen]
        body[at] = new[kind[chosen]]
        left = np.ones(len(body), bool)
        left[at + 1] = False
        body = body[left]
    found = np.concatenate(rules) if rules else np.zeros(0, np.int64)
    return alphabet.astype(np.uint32), np.column_stack([found >> 32, found & 0xFFFFFFFF]).astype(np.uint32), body


def _apart(at: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Of places in rising order, those taken when the least rank goes first, the leftmost of equals, and its neighbours go."""
    taken = np.zeros(len(at), bool)
    alike = np.concatenate([[False], (at[1:] == at[:-1] + 1) & (rank[1:] == rank[:-1])])
    lead = np.maximum.accumulate(np.where(alike, 0, np.arange(len(at))))
    open_ = np.flatnonzero((np.arange(len(at)) - lead) % 2 == 0)
    while len(open_):
        p, r = at[open_], rank[open_]
        beside = p[1:] == p[:-1] + 1
        after_less = np.concatenate([[False], beside & (r[:-1] <= r[1:])])
        before_less = np.concatenate([beside & (r[1:] < r[:-1]), [False]])
        first = ~after_less & ~before_less
        taken[open_[first]] = True
        near = np.concatenate([[False], beside & first[:-1]]) | np.concatenate([beside & first[1:], [False]])
        open_ = open_[~first & ~near]
    return taken


def _lengths(rules: np.ndarray, alphabet: int) -> np.ndarray:
    """How many ids each rule stands for; rules are of earlier symbols only."""
    length = np.ones(alphabet + len(rules), np.int64)
    done = 0
    while done < len(rules):
        open_ = rules[done:].max(axis=1) >= alphabet + done
        stop = done + (int(np.argmax(open_)) if open_.any() else len(open_))
        length[alphabet + done : alphabet + stop] = length[rules[done:stop]].sum(axis=1)
        done = stop
    return length[alphabet:]


def packed(ids: np.ndarray, least: int = LEAST_PAIRS) -> bytes:
    """One block: header, alphabet, rules, expansion lengths, symbols; little-endian numbers of 32 bits, or 16 where they fit."""
    alphabet, rules, body = paired(ids, least)
    width = 2 if len(alphabet) + len(rules) <= 1 << 16 else 4
    parts = [alphabet.astype("<u4"), rules.astype("<u4"), _lengths(rules, len(alphabet)).astype("<u4"), body.astype(f"<u{width}")]
    head = struct.pack(_HEADER, _MAGIC, len(alphabet), len(rules), len(body), width, len(ids))
    return head + b"".join(p.tobytes() for p in parts)


class Block:
    """A block read back: ``ids(start, stop)`` expands only the symbols that cover those places."""

    def __init__(self, image: bytes | memoryview, at: int = 0):
        magic, letters, rules, symbols, width, self.n = struct.unpack_from(_HEADER, image, at)
        if magic != _MAGIC:
            raise ValueError("not a block of token ids")

        def numbers(kind: str, count: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(image, kind, count, at)
            at += out.nbytes
            return out

        at += struct.calcsize(_HEADER)
        self.alphabet, self.rules = numbers("<u4", letters), numbers("<u4", 2 * rules).reshape(-1, 2)
        self.length = np.concatenate([np.ones(letters, np.int64), numbers("<u4", rules).astype(np.int64)])
        self.body = numbers(f"<u{width}", symbols).astype(np.int64)
        self.end = at
        self.places = np.concatenate([[0], np.cumsum(self.length[self.body])])

    def ids(self, start: int = 0, stop: int | None = None) -> np.ndarray:
        start, stop = max(start, 0), self.n if stop is None else min(stop, self.n)
        if start >= stop:
            return np.zeros(0, np.uint32)
        a = int(np.searchsorted(self.places, start, "right")) - 1
        b = int(np.searchsorted(self.places, stop, "left"))
        used, symbols = np.unique(self.body[a:b], return_inverse=True)
        flat, size = self._expanded(used), self.length[used]
        begin = np.cumsum(size) - size
        lead = self.places[a:b] - self.places[a]
        out = flat[np.arange(int(self.places[b] - self.places[a])) + np.repeat(begin[symbols] - lead, size[symbols])]
        first = int(self.places[a])
        return out[start - first : stop - first]

    def _expanded(self, symbols: np.ndarray) -> np.ndarray:
        """What the symbols stand for, end to end."""
        letters = len(self.alphabet)
        while True:
            rule = symbols >= letters
            if not rule.any():
                return self.alphabet[symbols]
            width = 1 + rule
            at = np.cumsum(width) - width
            out = np.empty(int(width.sum()), np.int64)
            out[at[~rule]] = symbols[~rule]
            both = self.rules[symbols[rule] - letters]
            out[at[rule]], out[at[rule] + 1] = both[:, 0], both[:, 1]
            symbols = out


def blocks(image: bytes) -> Iterator[Block]:
    at = 0
    while at < len(image):
        block = Block(image, at)
        yield block
        at = block.end


class Pieces:
    """Ids of the pieces of text a task has met, from the tokenizers library."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        path = tokenizer_path(path)
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        end, vocab = model.get("end_of_word_suffix"), model["vocab"]
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        if end:
            self.ends[[i for s, i in vocab.items() if s.endswith(end)]] = True
        self.forget()

    def forget(self) -> None:
        self.known = pa.array([], pa.string())
        self.size, self.flat = np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def of(self, words: pa.Array) -> np.ndarray:
        """Numbers of distinct words among the known ones; new ones become known."""
        found = pc.index_in(words, value_set=self.known) if len(self.known) else pa.nulls(len(words), pa.int32())
        if len(self.known) + found.null_count > _REMEMBERED:
            self.forget()
            found = pa.nulls(len(words), pa.int32())
        missing = found.is_null()
        numbers, places, before = found.fill_null(-1).to_numpy().astype(np.int64), [], len(self.known)
        new = words.filter(missing)
        # a word of letters alone ends with the one token that carries an end mark, so many take one call
        plain = pc.match_substring_regex(new, f"^{_LETTER}+$") if self.ends.any() else pa.repeat(pa.scalar(False), len(new))
        for part, listed in ((new.filter(plain), False), (new.filter(pc.invert(plain)), True)):
            texts = part.to_pylist()
            if not texts:
                continue
            coded = self.library.encode_batch_fast(texts if listed else [" ".join(texts)], add_special_tokens=False)
            ids = [np.array(c.ids, np.uint32) for c in coded]
            if listed:
                size = np.fromiter(map(len, ids), np.int64, len(ids))
            else:
                size = np.diff(np.flatnonzero(self.ends[ids[0]]), prepend=-1)
                if len(size) != len(texts):
                    raise ValueError("a word of letters has more than one end mark")
            places.append(np.flatnonzero(missing)[np.flatnonzero(pc.invert(plain) if listed else plain)])
            self.known = pa.concat_arrays([self.known, part])
            self.size, self.flat = np.concatenate([self.size, size]), np.concatenate([self.flat, *ids])
        if places:
            numbers[np.concatenate(places)] = np.arange(before, len(self.known))
        return numbers


def _pieces(path: str) -> Pieces:
    held = worker_store().setdefault("pieces", {})
    if path not in held:
        held[path] = Pieces(path)
    return held[path]


def encoded(column: pa.Array, path: str, end: int | None = END) -> tuple[np.ndarray, np.ndarray]:
    """Ids of every row end to end with the end id behind each, and the n + 1 places where rows begin.

    The library encodes each distinct piece once a task. Pieces end at ASCII spaces and between a letter and one of ,.;:!? as
    words do in such a tokenizer, whatever stands beside them.
    """
    known = _pieces(path)
    listed = pc.ascii_split_whitespace(pc.replace_substring_regex(column, f"({_LETTER})([,.;:!?])", r"\1 \2"))
    coded = listed.flatten().dictionary_encode()
    numbers = known.of(coded.dictionary)
    size, flat = np.append(known.size, end is not None), known.flat if end is None else np.append(known.flat, np.uint32(end))
    begin = np.cumsum(size) - size
    at = listed.offsets.to_numpy().astype(np.int64)
    codes = numbers[coded.indices.to_numpy(zero_copy_only=False)[: at[-1] - at[0]]]
    codes = np.insert(codes, at[1:] - at[0], len(known.size))  # the end id behind each row
    n = size[codes]
    stops = np.concatenate([[0], np.cumsum(n)])
    out = flat[np.arange(stops[-1]) + np.repeat(begin[codes] - stops[:-1], n)]
    return out, stops[at - at[0] + np.arange(len(at))]


SHARDS = "part int, first bigint, n_ids bigint, keys array<{key}>, n_tokens array<bigint>, image binary"


def write_ids(
    docs: DataFrame, folder: str, key: str = "doc_id", text: str = "text", path: str = "word_bpe_49k.json",
    block_ids: int = BLOCK_IDS, least: int = LEAST_PAIRS, end: int | None = END, parts: int | None = None,
) -> None:
    """Writes shards of whole documents in rising key order (null first, equal keys by a hash of their texts) to ``folder``.

    Rows are shards: ``part`` and ``first`` (ids of the part before it) give its place, ``keys`` and ``n_tokens`` its
    documents, ``image`` the blocks. A shard ends before the document that would overfill it; a longer document has one alone,
    in several blocks. A null or empty text is the end id alone. Parts are ranges of keys, dealt on the texts as they are;
    Spark's file commit leaves a task's shards there once, however often it ran. An empty table writes no shard.
    """
    spark = docs.sparkSession
    parts = parts or max(docs.rdd.getNumPartitions(), int(spark.conf.get("spark.sql.shuffle.partitions")))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before = TaskContext.get().partitionId(), 0
        keys, sizes, held = [], [], []

        def shard() -> pa.RecordBatch:
            nonlocal before
            ids = np.concatenate(held)
            cuts = range(0, len(ids), block_ids)
            image = b"".join(packed(ids[a : a + block_ids], least) for a in cuts)
            named = pa.concat_arrays(keys)
            row = [
                pa.array([part], pa.int32()), pa.array([before]), pa.array([len(ids)]),
                pa.ListArray.from_arrays([0, len(named)], named),
                pa.array([np.concatenate(sizes)], pa.list_(pa.int64())), pa.array([image], pa.binary()),
            ]
            before += len(ids)
            keys.clear(), sizes.clear(), held.clear()
            return pa.RecordBatch.from_arrays(row, names=["part", "first", "n_ids", "keys", "n_tokens", "image"])

        filled = 0
        for rows in slices(batches, "_text", _SLICE_BYTES):
            ids, at = encoded(rows.column("_text"), path, end)
            row = 0
            while row < rows.num_rows:
                stop = int(np.searchsorted(at, at[row] + block_ids - filled, "right")) - 1
                if stop <= row and filled:
                    yield shard()
                    filled = 0
                    continue
                stop = max(stop, row + 1)
                keys.append(rows.column("_key").slice(row, stop - row))
                sizes.append(np.diff(at[row : stop + 1]))
                held.append(ids[at[row] : at[stop]])
                filled, row = filled + int(at[stop] - at[row]), stop
        if keys:
            yield shard()

    taken = docs.select(F.col(key).alias("_key"), as_text(text).alias("_text"))
    tie = F.xxhash64("_text")
    ordered = taken.repartitionByRange(parts, F.col("_key").asc_nulls_first(), tie).sortWithinPartitions(F.col("_key").asc_nulls_first(), tie)
    kind = taken.schema["_key"].dataType.simpleString()
    shards = ordered.mapInArrow(each, SHARDS.format(key=kind))
    shards.write.option("parquet.block.size", 16 << 20).option("compression", "none").parquet(folder)


def read_ids(spark, folder: str) -> DataFrame:
    """``key, start, ids``: every document's ids from the files, and how many ids come before it in all of them."""
    return _documents(spark, folder, lambda ids: ids.astype("<u4").tobytes(), pa.binary(), "ids", "binary")


def _documents(spark, folder: str, of_ids, kind: pa.DataType, name: str, sql: str) -> DataFrame:
    shards = spark.read.parquet(folder)
    key = shards.schema["keys"].dataType.elementType.simpleString()

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                image = batch.column("image")[i].as_py()
                ids = np.concatenate([b.ids() for b in blocks(image)])
                sizes = batch.column("n_tokens")[i].values.to_numpy()
                at = np.concatenate([[0], np.cumsum(sizes)])
                first = batch.column("first")[i].as_py()
                out = [of_ids(ids[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
                part = pa.array(np.full(len(sizes), batch.column("part")[i].as_py(), np.int32))
                columns = [part, batch.column("keys")[i].values, pa.array(first + at[:-1]), pa.array(sizes), pa.array(out, kind)]
                yield pa.RecordBatch.from_arrays(columns, names=["part", "key", "start", "n_tokens", name])

    # one row a part, and parts are as many as the writer was told
    totals = shards.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = totals.select("part", F.expr("sum(n) over (order by part) - n").alias("_before"))
    rows = shards.select("part", "first", "keys", "n_tokens", "image")
    rows = rows.mapInArrow(each, f"part int, key {key}, start bigint, n_tokens bigint, {name} {sql}")
    placed = rows.join(F.broadcast(before), "part")
    return placed.select("key", (F.col("start") + F.col("_before")).alias("start"), "n_tokens", name)


def op12_token_files(spark, sf_dir: str) -> DataFrame:
    """Place, number and checksum of every document's ids, from the files they were written to."""
    folder = shared_folder(spark)
    write_ids(documents(spark, sf_dir), folder)
    checked = _documents(spark, folder, lambda ids: zlib.crc32(ids.astype("<u4").tobytes()), pa.int64(), "ids_crc32", "bigint")
    return checked.withColumnRenamed("key", "doc_id")


QUERIES = {"op12_token_files": op12_token_files}
SQL: dict[str, str] = {}

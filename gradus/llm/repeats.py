"""Repeated passages by longest previous factors in suffix order."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradus.llm.common import as_text, documents, row_and, slices, text_bytes, written

_BASE = 0x100000001B3
_MIX = np.uint64(0x9E3779B97F4A7C15)
_STEP = 1 << 19  # bytes hashed at a time
_HELD = 4 << 20  # text bytes whose anchors are compared in one task before they are sent
_PART = 2 << 20  # text bytes whose pieces are compared
_SUFFIXES = 200_000  # suffixes sorted at a time
_LAST = (1 << 63) - 1


@dataclass(frozen=True)
class Scale:
    """``length``: bytes of a repeat. ``gram``: bytes of an anchor. Past ``local`` documents with one anchor in one stretch of
    text, or ``cell`` places in all, its windows are dealt by their own content instead of the anchor's; results are the same."""

    length: int = 50
    gram: int = 20
    local: int = 64
    cell: int = 4096

    @property
    def span(self) -> int:
        return self.length - self.size + 1

    @property
    def size(self) -> int:
        return max(min(self.gram, self.length), self.length - 59)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _MIX
    return h ^ (h >> np.uint64(29))


def _gram_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """A hash of the ``size`` bytes from every place, put together from hashes of powers of two."""
    power, span, out, held = data.astype(np.uint64) + np.uint64(1), 1, None, 0
    factor = lambda n: np.uint64(pow(_BASE, n, 1 << 64))
    while True:
        if size & span:
            if out is None:
                out, held = power, span
            else:
                n = len(power) - held
                out, held = out[:n] * factor(span) + power[held : held + n], held + span
        if 2 * span > size:
            return _mixed(out)
        power, span = power[:-span] * factor(span) + power[span:], 2 * span


def _sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    power, span, out, held = values, 1, None, 0
    while True:
        if width & span:
            if out is None:
                out, held = power, span
            else:
                n = len(power) - held
                out, held = np.minimum(out[:n], power[held : held + n]), held + span
        if 2 * span > width:
            return out
        power, span = np.minimum(power[:-span], power[span:]), 2 * span


def anchors(data: np.ndarray, at: np.ndarray, scale: Scale) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows of ``length`` bytes with the same least gram: its hash, row, first window (place in the row), windows.

    Equal windows have equal least grams, so they get the same hash in whatever document they stand.
    """
    out = []
    for low in range(0, max(len(data) - scale.length + 1, 0), _STEP):
        part = data[low : low + _STEP + scale.length - 1]
        least = _sliding_least(_gram_hashes(part, scale.size), scale.span)
        first, last = np.searchsorted(at, [low, low + len(least) - 1], "right") - 1
        edge = np.clip(at[first : last + 2] - low, 0, len(least))
        row = np.repeat(np.arange(first, last + 1), np.diff(edge))
        place = np.flatnonzero(np.arange(low, low + len(least)) + scale.length <= at[row + 1])
        if not len(place):
            continue
        least, row = least[place], row[place]
        new = np.ones(len(place), bool)
        new[1:] = (least[1:] != least[:-1]) | (row[1:] != row[:-1])
        begin = np.flatnonzero(new)
        new[(np.arange(len(place)) - np.repeat(begin, np.diff(np.append(begin, len(place))))) % scale.span == 0] = True
        begin = np.flatnonzero(new)
        count = np.diff(np.append(begin, len(place)))
        out.append((least[begin], row[begin], place[begin] + low - at[row[begin]], count))
    if not out:
        return np.zeros(0, np.uint64), *(np.zeros(0, np.int64) for _ in range(3))
    return tuple(np.concatenate(parts) for parts in zip(*out))


_KEPT = [("low", "<u8", 4), ("o", "<i8", 8), ("part", "<i8", 8), ("place", "<i4", 4), ("count", "u1", 1), ("hot", "u1", 1)]
_STEPS = ("o", "place")


def _packed(columns: dict[str, np.ndarray]) -> bytes:
    """Byte planes of the columns, keys and places as steps from row to row; mostly zeros, so they compress well."""
    planes = []
    for name, kind, width in _KEPT:
        values = columns[name]
        if name in _STEPS:
            values = np.diff(values, prepend=0)
        planes.append(np.ascontiguousarray(values.astype(kind)).view(np.uint8).reshape(len(values), -1)[:, :width].T.tobytes())
    return pa.compress(b"".join(planes), codec="zstd", asbytes=True)


def _unpacked(blob: bytes, n: int) -> dict[str, np.ndarray]:
    raw = np.frombuffer(pa.decompress(blob, n * sum(w for _, _, w in _KEPT), codec="zstd", asbytes=True), np.uint8)
    out, start = {}, 0
    for name, kind, width in _KEPT:
        wide = np.zeros((n, np.dtype(kind).itemsize), np.uint8)
        wide[:, :width] = raw[start : start + n * width].reshape(width, n).T
        out[name], start = wide.view(kind).ravel(), start + n * width
    for name in _STEPS:
        out[name] = np.cumsum(out[name], dtype=out[name].dtype)
    return out


def _groups(keys: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Order of the rows by the keys, and where in it each group of equal keys begins."""
    order = np.lexsort(keys[::-1]) if len(keys) > 1 else np.argsort(keys[0], kind="stable")
    new = np.ones(len(order), bool)
    new[1:] = np.logical_or.reduce([k[order][1:] != k[order][:-1] for k in keys])
    return order, np.flatnonzero(new)


def _spread_over(values: np.ndarray, begin: np.ndarray, n: int) -> np.ndarray:
    return np.repeat(values, np.diff(np.append(begin, n)))


def _doc_counts(order: np.ndarray, begin: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row in order: whether its group has two documents, and how many rows of it begin a new document."""
    held = docs[order]
    least, most = np.minimum.reduceat(held, begin), np.maximum.reduceat(held, begin)
    new = np.ones(len(held), np.int64)
    new[1:] = held[1:] != held[:-1]
    new[begin] = 1
    return _spread_over(most > least, begin, len(held)), _spread_over(np.add.reduceat(new, begin), begin, len(held))


def _ask(scale: Scale, buckets: int):
    """First pass: anchors of every text, packed by bucket. Of an anchor that many documents here have, one place is sent to
    meet those of other tasks and the rest, known to be shared and frequent, only pass through."""

    def packed(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        h, o, part, place, count = (np.concatenate(c) for c in zip(*held))
        if not len(h):
            return
        order, begin = _groups([h, o])
        # the groups of one anchor, whatever the document
        new = np.ones(len(order), bool)
        new[1:] = h[order][1:] != h[order][:-1]
        _, docs = _doc_counts(order, np.flatnonzero(new), o)
        hot = docs > scale.local
        passing = np.zeros(len(h), bool)
        passing[order] = hot & ~new
        frequent = np.zeros(len(h), bool)
        frequent[order] = hot
        bucket = ((h >> np.uint64(40)) * np.uint64(buckets)) >> np.uint64(24)
        home = bucket.astype(np.int64)
        home[passing] = (o[passing] + place[passing]) % buckets  # may wait anywhere
        low = h & np.uint64((1 << 32) - 1)  # enough to tell apart the anchors of one bucket
        columns = {"low": low, "o": o, "part": part, "place": place, "count": count, "hot": frequent.astype(np.uint8)}
        sent = np.lexsort((np.arange(len(h)), bucket, passing, home))
        # rows that pass are sent apart, by the bucket they belong to
        same = np.ones(len(sent), bool)
        same[1:] = (home[sent][1:] != home[sent][:-1]) | (passing[sent][1:] != passing[sent][:-1]) | (
            passing[sent][1:] & (bucket[sent][1:] != bucket[sent][:-1])
        )
        starts = np.flatnonzero(same)
        rows = [[], [], [], [], []]
        for i, j in zip(starts, np.append(starts[1:], len(sent))):
            at = sent[i:j]
            for held_row, value in zip(
                rows, (int(home[at[0]]), int(bucket[at[0]]), bool(passing[at[0]]), len(at), _packed({k: v[at] for k, v in columns.items()}))
            ):
                held_row.append(value)
        yield pa.RecordBatch.from_arrays(
            [pa.array(rows[0], pa.int32()), pa.array(rows[1], pa.int32()), pa.array(rows[2]), pa.array(rows[3], pa.int32()), pa.array(rows[4], pa.binary())],
            names=["home", "bucket", "passing", "n", "blob"],
        )

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in slices(batches, "_text", _PART):
            data, at = text_bytes(batch.column("_text"))
            h, row, place, count = anchors(data, at, scale)
            keys = [batch.column(c).to_numpy(zero_copy_only=False)[row] for c in ("_o", "_part")]
            held.append((h, *keys, place, count))
            size += len(data)
            if size >= _HELD:
                yield from packed(held)
                held, size = [], 0
        if held:
            yield from packed(held)

    return each


def _answer(scale: Scale):
    """Second pass: of the anchors that met in a bucket, those of two documents or more, and whether they are frequent."""

    def rows(cell, c, hot) -> pa.RecordBatch:
        # the place, the number of windows (under 64) and the mark in one number
        place = (c["place"].astype(np.int64) << 8) | (c["count"].astype(np.int64) << 1) | hot.astype(np.int64)
        arrays = [pa.array(v) for v in (c["o"], c["part"], cell, place)]
        return pa.RecordBatch.from_arrays(arrays, names=["_o", "_part", "cell", "place"])

    def cells(low: np.ndarray) -> np.ndarray:
        # 32 bits bring equal anchors together; where different ones share them, suffix order keeps them apart
        return low.astype(np.uint32).view(np.int32)

    def settle(held: list[dict]) -> Iterator[pa.RecordBatch]:
        c = {k: np.concatenate([x[k] for x in held]) for k in held[0]}
        order, _ = _groups([c["low"], c["o"]])
        low = c["low"][order]
        new = np.ones(len(order), bool)
        new[1:] = low[1:] != low[:-1]
        begin = np.flatnonzero(new)
        shared, docs = _doc_counts(order, begin, c["o"])
        hot = _spread_over(np.maximum.reduceat(c["hot"][order], begin) > 0, begin, len(order)) | (docs > scale.cell)
        shared |= hot
        c = {k: v[order][shared] for k, v in c.items()}
        yield rows(cells(c["low"]), c, hot[shared])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            for row in batch.to_pylist():
                c = _unpacked(row["blob"], row["n"])
                if row["passing"]:
                    yield rows(cells(c["low"]), c, np.ones(row["n"], bool))
                    continue
                if row["bucket"] != now and held:
                    yield from settle(held)
                    held = []
                now = row["bucket"]
                held.append(c)
        if held:
            yield from settle(held)

    return each


def _words_at(data: np.ndarray, starts: np.ndarray, length: int) -> list[np.ndarray]:
    """The ``length`` bytes from every start as numbers that sort as the bytes do, eight bytes each."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(data) + 1,), ">u8", padded, 0, (1,))  # overlapping, so nothing is copied
    out = []
    for i in range(0, length, 8):
        word = eight[starts + min(i, max(length - 8, 0))].astype(np.uint64)
        out.append(word if length >= 8 else word >> np.uint64(8 * (8 - length)))
    return out


def _bodies(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    at = np.repeat(starts - offsets[:-1], sizes) + np.arange(offsets[-1])
    return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data[at])])


def _deal(scale: Scale):
    """Third pass: the text around every shared anchor goes to the anchor's cell; that around a frequent one goes window by
    window to cells of the windows' own hashes. Of equal pieces in the stretch of text at hand only those of the first
    document are sent; the others are found to be repeats right here."""

    def rows(cell, o, part, place, count, body) -> pa.RecordBatch:
        arrays = [pa.array(v) for v in (cell, o, part, place.astype(np.int32), count.astype(np.int32))]
        return pa.RecordBatch.from_arrays([*arrays, body], names=["cell", "_o", "_part", "place", "count", "body"])

    def sent(data, cell, o, part, place, start, count) -> Iterator[pa.RecordBatch]:
        first, last = (_words_at(data, s, scale.length) for s in (start, start + count - 1))
        body = np.zeros(len(start), np.uint64)
        for word in (*first, *last, count.astype(np.uint64)):
            body = _mixed(body * np.uint64(_BASE) + word)
        order, begin = _groups([cell, body, o])
        new = np.ones(len(order), bool)
        new[1:] = (cell[order][1:] != cell[order][:-1]) | (body[order][1:] != body[order][:-1])
        first_at = np.flatnonzero(new)
        later = np.zeros(len(o), bool)
        later[order] = o[order] > _spread_over(o[order][first_at], first_at, len(order))
        ask = np.flatnonzero(~later)
        for i in range(0, len(ask), 200_000):
            s = ask[i : i + 200_000]
            yield rows(cell[s], o[s], part[s], place[s], count[s], _bodies(data, start[s], count[s] + scale.length - 1))
        # what is settled passes through any cell, as runs of windows
        s = np.flatnonzero(later)
        if len(s):
            s = s[np.argsort(start[s], kind="stable")]
            new = np.ones(len(s), bool)
            new[1:] = start[s][1:] != (start + count)[s][:-1]
            new[1:] |= (o[s][1:] != o[s][:-1]) | (part[s][1:] != part[s][:-1])
            head = np.flatnonzero(new)
            run = np.add.reduceat(count[s], head)
            s = s[head]
            none = pa.array([b""] * len(s), pa.binary())
            yield rows(((o[s] * 31 + place[s]) & 0x7FFFFFFF).astype(np.int32), o[s], part[s], place[s], run, none)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text", _PART):
            data, at = text_bytes(batch.column("_text"))
            listed = batch.column("_asked")
            row = np.repeat(np.arange(batch.num_rows), listed.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
            flat = listed.flatten()
            cell, packed = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(2))
            if not len(cell):
                continue
            o, part = (batch.column(c).to_numpy(zero_copy_only=False)[row] for c in ("_o", "_part"))
            place, count, hot = packed >> 8, (packed >> 1) & 127, (packed & 1).astype(bool)
            start = at[row] + place
            cold = ~hot
            if cold.any():
                yield from sent(data, *(v[cold] for v in (cell, o, part, place, start, count)))
            if hot.any():
                # at most 64 windows for each anchor, some at a time
                for i in range(0, int(hot.sum()), 100_000):
                    some = np.flatnonzero(hot)[i : i + 100_000]
                    n = count[some]
                    step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                    each_row = np.repeat(some, n)
                    begin = start[each_row] + step
                    own = np.zeros(len(begin), np.uint64)
                    for word in _words_at(data, begin, scale.length):
                        own = _mixed(own * np.uint64(_BASE) + word)
                    yield from sent(data, (own >> np.uint64(32)).astype(np.uint32).view(np.int32), o[each_row], part[each_row], place[each_row] + step, begin, np.ones(len(begin), np.int64))

    return each


def previous_factors(words: list[np.ndarray], docs: np.ndarray) -> np.ndarray:
    """Whether the longest previous factor of each suffix, from an earlier document, has at least the length the words cover.

    Suffixes are put in order by those bytes, ties by document. With the previous and the next place of a smaller document
    in that order, the longest previous factor is the better of the two least common prefixes on the way there. Within a
    stretch of suffixes that agree in all the bytes, documents do not fall: the next smaller one lies outside, with a
    shorter match, and the previous smaller one lies inside just if the stretch begins with an earlier document.
    """
    order = np.lexsort((docs, *words[::-1]))
    agree = np.ones(len(order), bool)
    for word in words:
        held = word[order]
        agree[1:] &= held[1:] == held[:-1]
    agree[:1] = False
    begin = np.flatnonzero(~agree)
    held = docs[order]
    out = np.zeros(len(order), bool)
    out[order] = held > _spread_over(held[begin], begin, len(order))
    return out


def _settle(scale: Scale):
    """Fourth pass: suffix order over the pieces of each cell, and from it the windows that an earlier document has too."""

    def found(o, part, place, count) -> pa.RecordBatch:
        arrays = [pa.array(v) for v in (o, part, place.astype(np.int32), count.astype(np.int32))]
        return pa.RecordBatch.from_arrays(arrays, names=["_o", "_part", "place", "count"])

    def settle(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        o, part, place, count = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("_o", "_part", "place", "count"))
        data, at = text_bytes(batch.column("body"))
        passed = np.flatnonzero(np.diff(at) == 0)
        yield found(o[passed], part[passed], place[passed], count[passed])
        asked = np.flatnonzero(np.diff(at) > 0)
        if not len(asked):
            return
        n = count[asked].astype(np.int64)
        row = np.repeat(asked, n)
        step = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        earlier = previous_factors(_words_at(data, at[row] + step, scale.length), o[row])
        head = earlier.copy()
        head[1:] &= ~(earlier[:-1] & (row[1:] == row[:-1]))
        begin = np.flatnonzero(head)
        run = np.add.reduceat(earlier.astype(np.int64), begin) if len(begin) else begin
        yield found(o[row[begin]], part[row[begin]], place[row[begin]] + step[begin], run)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            n += batch.num_rows
            if n * scale.span < _SUFFIXES:
                continue
            whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            cell = whole.column("cell").to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero(cell[1:] != cell[:-1]) + 1
            start = 0
            # pieces of about the wanted number of suffixes, cut between cells; the last cell may go on
            while len(cuts) and cuts[-1] > start:
                wanted = cuts[np.searchsorted(cuts, start + _SUFFIXES // scale.span, "left") :]
                if not len(wanted) and start:
                    break
                stop = int(wanted[0]) if len(wanted) else int(cuts[-1])
                yield from settle(whole.slice(start, stop - start))
                start = stop
            rest = whole.slice(start)
            held, n = [rest], rest.num_rows
        if held:
            yield from settle(pa.Table.from_batches(held).combine_chunks().to_batches()[0])

    return each


def _remove(scale: Scale, whole_characters: bool):
    """Last pass: bytes that no found window covers, and the runs of those that one does."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text"):
            data, at = text_bytes(batch.column("_text"))
            size = np.diff(at)
            copy = batch.column("_copy").to_numpy(zero_copy_only=False) & (size >= scale.length)
            listed = batch.column("_found")
            row = np.repeat(np.arange(batch.num_rows), listed.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
            flat = listed.flatten()
            place, count = (flat.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(2))
            steps = np.zeros(len(data) + 1, np.int32)
            np.add.at(steps, at[row] + place, 1)
            np.subtract.at(steps, at[row] + place + count + scale.length - 1, 1)
            gone = (np.cumsum(steps[:-1]) > 0) | np.repeat(copy, size)
            if whole_characters and len(data):
                head = np.flatnonzero((data & 0xC0) != 0x80)
                gone = _spread_over(np.logical_and.reduceat(gone, head), head, len(data))
            edge = np.zeros(len(data) + 1, bool)
            edge[at] = True
            head = np.flatnonzero(gone & (edge[:-1] | ~np.concatenate([[False], gone[:-1]])))
            tail = np.flatnonzero(gone & (edge[1:] | ~np.concatenate([gone[1:], [False]]))) + 1
            owner = np.searchsorted(at, head, "right") - 1
            kept_at = np.concatenate([[0], np.cumsum(~gone)])[at]
            spans = pa.StructArray.from_arrays([pa.array(head - at[owner]), pa.array(tail - at[owner])], names=["start", "stop"])
            listed_at = np.searchsorted(owner, np.arange(batch.num_rows + 1)).astype(np.int32)
            kept = pa.Array.from_buffers(
                pa.binary(), batch.num_rows, [None, pa.py_buffer(kept_at.astype(np.int32)), pa.py_buffer(data[~gone])]
            )
            yield pa.RecordBatch.from_arrays(
                [batch.column("_row"), pa.array(size), pa.ListArray.from_arrays(pa.array(listed_at), spans), kept],
                names=["_row", "n_bytes", "spans", "kept"],
            )

    return each


def remove_repeats(
    docs: DataFrame, key: str = "doc_id", text: str = "text", scale: Scale = Scale(), whole_characters: bool = False
) -> DataFrame:
    """Every row of ``docs`` as struct ``_row`` of all columns but the text, with ``n_bytes``, ``spans`` (array of start, stop in bytes) and ``kept`` (binary).

    A byte goes if a string of ``length`` bytes that covers it also starts in the text of a row with a smaller key. Strings
    are judged on the input; matches never cross rows. A null text is empty. A null key counts as larger than all others;
    rows with equal keys do not count as earlier than one another. The key is an integer. Other columns stay in ``_row``.
    With ``whole_characters`` a character of several bytes goes only if all of them do, so ``kept`` is UTF-8 again.

    Whole copies of an earlier text are found by digest. In the other texts every window of ``length`` bytes is known by its
    least gram; where two documents have that gram, the text around it goes to the gram's cell, and suffix order within the
    cell tells which windows an earlier document has.
    """
    spark = docs.sparkSession
    kinds = dict(docs.dtypes)
    if kinds[key] not in ("bigint", "int", "smallint", "tinyint"):
        raise TypeError("the key must be an integer")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text])
    body = as_text(text)
    dealt = docs.select(
        F.coalesce(F.col(key).cast("bigint"), F.lit(_LAST)).alias("_o"), F.xxhash64(body).alias("_t"), row.alias("_row"), body.alias("_text")
    )
    listed = docs.select(
        F.coalesce(F.col(key).cast("bigint"), F.lit(_LAST)).alias("_o"), F.xxhash64(body).alias("_t"), F.unhex(F.md5(body.cast("binary"))).alias("_m"), F.octet_length(body).alias("_size")
    ).where(F.col("_size") >= scale.length)
    firsts = listed.groupBy("_m", "_size").agg(F.min(F.struct("_o", "_t")).alias("_f")).select("_f._o", "_f._t", "_size")
    # texts of one key are told apart by a number that is zero for most keys
    least = firsts.groupBy("_o").agg(F.min("_t").alias("_least"))
    firsts = written(firsts.join(least, "_o").withColumn("_part", F.col("_t").bitwiseXOR(F.col("_least"))).select("_o", "_t", "_part", "_size"))
    total = firsts.agg(F.sum("_size")).first()[0] or 0
    buckets = max(256, int(total * 2 / (scale.span + 1) / 500_000))

    # row columns go along so that all passes read one exchange of the texts
    asks = dealt.join(firsts.drop("_size"), ["_o", "_t"]).select("_o", "_part", "_row", "_text")
    asks = asks.mapInArrow(_ask(scale, buckets), "home int, bucket int, passing boolean, n int, blob binary")
    met = asks.repartition("home").sortWithinPartitions("bucket", "passing")
    answers = met.mapInArrow(_answer(scale), "_o bigint, _part bigint, cell int, place bigint")
    asked = answers.groupBy("_o", "_part").agg(F.collect_list(F.struct("cell", "place")).alias("_asked"))
    asked = firsts.drop("_size").join(asked, ["_o", "_part"])
    pieces = dealt.join(asked, ["_o", "_t"]).select("_o", "_part", "_row", "_text", "_asked")
    pieces = pieces.mapInArrow(_deal(scale), "cell int, _o bigint, _part bigint, place int, count int, body binary")
    windows = pieces.repartition("cell").sortWithinPartitions("cell").mapInArrow(
        _settle(scale), "_o bigint, _part bigint, place int, count int"
    )
    found = windows.groupBy("_o", "_part").agg(F.collect_list(F.struct("place", "count")).alias("_found"))
    found = firsts.drop("_size").join(found, ["_o", "_part"], "left").select("_o", "_t", F.coalesce("_found", F.array()).alias("_found"))
    whole = dealt.join(found, ["_o", "_t"], "left").select(
        "_row", "_text", F.col("_found").isNull().alias("_copy"), "_found"
    )
    more = "n_bytes bigint, spans array<struct<start:bigint,stop:bigint>>, kept binary"
    return whole.mapInArrow(_remove(scale, whole_characters), row_and(whole, more))


def op7_repeats(spark, sf_dir: str) -> DataFrame:
    """Bytes of every document that stay once passages of fifty bytes from earlier documents go."""
    out = remove_repeats(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select(
        "_row.doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"),
        F.size("spans").cast("bigint").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


QUERIES = {"op7_repeats": op7_repeats}
SQL: dict[str, str] = {}

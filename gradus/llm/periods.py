"""Periodic runs of words: tiles for every octave of periods, solved one by one, their intervals stitched by document and period."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gradus.llm.common import SPACES, as_text, documents, pieces, slices, text_bytes, word_places, written

LEAST_WORDS, LEAST_PERIODS = 6, 4
LONG_BYTES = 4 << 20  # longer texts are cut into panels that go to tasks of their own
PANEL_WORDS = 1 << 16
# Words before and behind a tile's boundary that its octave's intervals may reach, in least periods.
_BEFORE, _BEHIND = 2, 6


def _ragged(begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of the listed stretches each place belongs to, and the places, end to end."""
    of = np.repeat(np.arange(len(size)), size)
    return of, np.arange(len(of)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(begin, size)


def intervals(codes: np.ndarray, begin: np.ndarray, low: np.ndarray, high: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple:
    """``row, period, start, stop``: where words agree with the word a period later, for periods that repeat.

    Rows are stretches of word codes. For octave k, periods 2^k to 2^(k + 1) - 1 and ``low <= k < high``, tiles of the row
    overlap: their boundaries are 2^k words apart from ``first`` to ``last``, and a run of four periods or more holds whole
    blocks of 2^k words behind some. A tile looks at the periods at which the block behind its boundary recurs, and
    takes both Z values there: how far the words behind (fewer than 2^(k + 2)) and before the boundary (fewer than
    2^(k + 1)) agree with those a period later. They are read off names of windows of 2^j words: equal words, equal names.
    Intervals of neighbouring tiles overlap, so their union is the whole interval of a run.
    """
    order = np.argsort(-np.diff(begin), kind="stable")
    size = np.diff(begin)[order]
    _, place = _ragged(begin[:-1][order], size)
    begin = np.concatenate([[0], np.cumsum(size)])
    low, high, first, last = (v[order] for v in (low, high, first, last))
    end = np.repeat(begin[1:], size)
    names, found, k = [np.ascontiguousarray(codes[place], np.int32)], [], 0
    while True:
        step = 1 << k
        rows = int(np.searchsorted(-size, -max(LEAST_WORDS, LEAST_PERIODS * step), "right"))
        if not rows:
            break
        total = int(begin[rows])
        whole = np.flatnonzero(np.arange(2 * step, total + 2 * step) <= end[:total])
        both = names[k][whole].astype(np.int64) << 32 | names[k][whole + step]
        name = np.full(total, -1, np.int32)
        name[whole] = np.unique(both, return_inverse=True)[1]
        names.append(name)
        here = np.flatnonzero((low[:rows] <= k) & (k < high[:rows]))
        lead = -(-first[here] // step) * step
        tiles = np.maximum(0, -((lead - np.minimum(last[here], size[here] - 2 * step + 1)) // step))
        of, turn = _ragged(np.zeros(len(here), np.int64), tiles)
        row = here[of]
        x = begin[row] + lead[of] + turn * step
        padded = np.concatenate([names[k][:total], np.full(2 * step, -1, np.int32)])
        later = np.lib.stride_tricks.sliding_window_view(padded, step)
        most = max(1, (1 << 22) // step)
        for a in range(0, len(x), most):
            t, p = np.nonzero(later[x[a : a + most] + step] == padded[x[a : a + most], None])
            t, p = t + a, p + step
            inside = x[t] + p + step <= begin[row[t] + 1]
            t, p = t[inside], p[inside]
            found.append((row[t], p, *_z_values(names, k, x[t], p, begin[row[t]], begin[row[t] + 1])))
        k += 1
    if not found:
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    row, period, start, stop = (np.concatenate(v) for v in zip(*found))
    row, period, start, stop = stitched(row, period, start, stop)
    return order[row], period, start - begin[row], stop - begin[row]


def _z_values(names: list[np.ndarray], k: int, x: np.ndarray, p: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple:
    """First and last place of the words about the boundaries x that agree with those p later."""
    stop = x.copy()
    for j in range(k + 1, -1, -1):
        whole = stop + p + (1 << j) <= end
        at = np.where(whole, stop, x)
        stop += (whole & (names[j][at] == names[j][at + np.where(whole, p, 0)])).astype(np.int64) << j
    start = x.copy()
    for j in range(k, -1, -1):
        whole = start - (1 << j) >= begin
        at = np.where(whole, start - (1 << j), x)
        start -= (whole & (names[j][at] == names[j][at + p])).astype(np.int64) << j
    return start, stop


def stitched(row: np.ndarray, period: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple:
    """Intervals of one row and period that overlap or touch as one, by row, period and start."""
    order = np.lexsort((start, period, row))
    row, period, start, stop = row[order], period[order], start[order], stop[order]
    other = np.concatenate([[True], (row[1:] != row[:-1]) | (period[1:] != period[:-1])]) if len(row) else np.zeros(0, bool)
    group = np.cumsum(other)
    far = int(stop.max(initial=0)) + 1
    reach = np.maximum.accumulate(stop + group * far) - group * far
    new = other.copy()
    new[1:] |= start[1:] > reach[:-1]
    lead = np.flatnonzero(new)
    tail = np.concatenate([lead[1:], [len(row)]]) - 1 if len(lead) else lead
    return row[lead], period[lead], start[lead], reach[tail]


def _runs_of_wholes(row: np.ndarray, period: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple:
    """Intervals long enough for a run, the least period only where several span the same words."""
    length = stop - start + period
    keep = length >= np.maximum(LEAST_WORDS, LEAST_PERIODS * period)
    row, period, start, length = row[keep], period[keep], start[keep], length[keep]
    order = np.lexsort((period, length, start, row))
    row, period, start, length = row[order], period[order], start[order], length[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (start[1:] != start[:-1]) | (length[1:] != length[:-1])
    return row[new], period[new], start[new], (start + length - period)[new]


_FOUND = "array<struct<period:bigint,start:bigint,stop:bigint>>"
_FOUND_TYPE = pa.struct([("period", pa.int64()), ("start", pa.int64()), ("stop", pa.int64())])


def _listed(rows: int, row: np.ndarray, period: np.ndarray, start: np.ndarray, stop: np.ndarray) -> pa.Array:
    """One list of intervals a row; rows come in rising order."""
    at = np.searchsorted(row, np.arange(rows + 1)).astype(np.int32)
    values = pa.StructArray.from_arrays([pa.array(v.astype(np.int64)) for v in (period, start, stop)], fields=list(_FOUND_TYPE))
    return pa.ListArray.from_arrays(at, values)


Repeat = Callable[[object, int], "tuple[int, int] | None"]


def _read(part: pa.RecordBatch, repeat: Repeat | None) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Word codes of a batch end to end, where rows begin, and every row's words joined by one space."""
    data, at = text_bytes(part.column("_text"))
    starts, ends, first = word_places(data, at)
    inside = ~SPACES[data]
    coded = pieces(data, inside, starts, ends) if len(starts) else None
    codes = coded.indices.to_numpy().astype(np.int32) if len(starts) else np.zeros(0, np.int32)
    keep = inside.copy()
    keep[1:] |= inside[:-1] & SPACES[data[1:]]
    keep[at[(at > 0) & (at < len(data))]] = inside[at[(at > 0) & (at < len(data))]]  # never the space after another row's word
    moved = np.concatenate([[0], np.cumsum(keep)])[at]
    spaced = np.where(inside, data, 32)[keep].tobytes()
    joined = [spaced[a:b].rstrip(b" ") for a, b in zip(moved[:-1].tolist(), moved[1:].tolist())]
    if repeat is not None:
        held = coded.dictionary.to_pylist() if len(starts) else []
        for i, key in enumerate(part.column("_key").to_pylist()):
            a, b = int(first[i]), int(first[i + 1])
            again = repeat(key, b - a) if b > a else None
            if again is not None:
                begin, period = again
                codes[a + begin : b] = codes[a + begin : a + begin + period][np.arange(b - a - begin) % period]
                joined[i] = b" ".join(map(held.__getitem__, codes[a:b].tolist()))
    return codes, first, joined


def _solve(repeat: Repeat | None) -> Callable:
    """Whole documents: their intervals, number of words, digest of the words and, where an interval is, the words."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "_text"):
            codes, begin, joined = _read(part, repeat)
            n = np.diff(begin)
            zero = np.zeros(len(n), np.int64)
            found = _runs_of_wholes(*intervals(codes, begin, zero, zero + 64, zero, n))
            some = np.bincount(found[0], minlength=len(n)) > 0
            columns = [
                part.column("_id"), part.column("_key"), pa.array(n.astype(np.int64)),
                pa.array([hashlib.sha256(w).hexdigest() for w in joined]),
                pa.array([w if s else None for w, s in zip(joined, some.tolist())], pa.binary()).cast(pa.string()),
                _listed(len(n), *found),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["_id", "_key", "n_words", "words_sha256", "words", "found"])

    return each


def panels(n: int) -> Iterator[tuple[int, int, int, int, int]]:
    """``low, high, begin, first, end`` for a document of n words: octaves, place of the panel, its first boundary and its end.

    Octaves of short periods share panels of ``PANEL_WORDS``; each longer octave has panels of 32 least periods.
    """
    low, high = 0, max(1, (PANEL_WORDS // 32).bit_length())
    while LEAST_PERIODS << low <= n:
        unit = 1 << (high - 1)
        core = max(PANEL_WORDS, 32 * unit) - (_BEFORE + _BEHIND) * unit
        for first in range(0, n, core):
            yield low, high, max(0, first - _BEFORE * unit), first, min(n, first + core + _BEHIND * unit)
        low, high = high, high + 1


def _cut(repeat: Repeat | None) -> Callable:
    """Long documents: a row with their words, and their panels."""
    names = ["_id", "_key", "n_words", "words_sha256", "words", "low", "high", "begin", "first", "_text"]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "_text", 1):
            _, begin, joined = _read(part, repeat)
            for i, words in enumerate(joined):
                n = int(begin[i + 1] - begin[i])
                space = np.flatnonzero(np.frombuffer(words, np.uint8) == 32)
                at = np.concatenate([[0], space + 1, [len(words) + 1]])
                ids = part.slice(i, 1).columns
                text = pa.array([words], pa.binary()).cast(pa.string())
                digest = pa.array([hashlib.sha256(words).hexdigest()])
                none = pa.nulls(1, pa.int64())
                whole = [ids[0], ids[1], pa.array([n]), digest, text, none, none, none, none, pa.nulls(1, pa.string())]
                yield pa.RecordBatch.from_arrays(whole, names=names)
                for low, high, start, first, end in panels(n):
                    piece = pa.array([words[at[start] : at[end] - 1]], pa.binary()).cast(pa.string())
                    numbers = [pa.array([v]) for v in (low, high, start, first)]
                    row = [ids[0], ids[1], pa.array([n]), pa.nulls(1, pa.string()), pa.nulls(1, pa.string()), *numbers, piece]
                    yield pa.RecordBatch.from_arrays(row, names=names)

    return each


def _solve_panels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches, "_text", 1):
        codes, begin, _ = _read(part, None)
        low, high, start, first = (part.column(c).to_numpy().astype(np.int64) for c in ("low", "high", "begin", "first"))
        unit = np.int64(1) << (high - 1)
        core = np.maximum(PANEL_WORDS, 32 * unit) - (_BEFORE + _BEHIND) * unit
        found = intervals(codes, begin, low, high, first - start, first - start + core)
        row, period, a, b = found
        columns = [part.column("_id").take(pa.array(row)), pa.array(period), pa.array(a + start[row]), pa.array(b + start[row])]
        yield pa.RecordBatch.from_arrays(columns, names=["_id", "period", "start", "stop"])


def _collapsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for words, listed in zip(batch.column("words").to_pylist(), batch.column("runs").to_pylist()):
            held = words.split(" ")
            change = np.zeros(len(held) + 1, np.int64)
            for r in listed:
                change[r["start"] + r["period"]] += 1
                change[r["start"] + r["length"]] -= 1
            kept = np.cumsum(change[:-1]) == 0
            out.append(" ".join([w for w, k in zip(held, kept.tolist()) if k]))
        columns = [batch.column(c) for c in ("_key", "n_words", "runs", "words_sha256")] + [pa.array(out, pa.string())]
        yield pa.RecordBatch.from_arrays(columns, names=["_key", "n_words", "runs", "words_sha256", "collapsed"])


_RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


def find_runs(docs: DataFrame, key: str = "doc_id", text: str = "text", repeat: Repeat | None = None, long_bytes: int = LONG_BYTES) -> DataFrame:
    """``key, n_words, runs, words_sha256, collapsed`` for every row of ``docs``.

    ``runs`` are all stretches of words with smallest period q, at least ``max(6, 4 q)`` words long, that no neighbouring word
    extends, by start and period. ``collapsed`` is the words without those that some run holds after its first q, joined by one
    space; null if there is no run, when it is the words as they are, whose digest is ``words_sha256``. ``repeat(key, n)`` may
    name a place a and a number p for a document of n words: words from a on then go through words a to a + p - 1 over and over.

    Null and empty texts have no words and no runs; repeated rows and keys stay apart, other columns are not read, an
    empty table gives no rows. A task holds some 60 bytes a word of the texts it solves. Texts above ``long_bytes`` are dealt to
    tasks by panels; only for periods of a 32nd of a text and more is its panel most of the text.
    """
    marked = docs.select(F.col(key).alias("_key"), as_text(text).alias("_text"), F.monotonically_increasing_id().alias("_id"))
    marked = marked.select("_id", "_key", "_text")
    kind = marked.schema["_key"].dataType.simpleString()
    about = f"_id bigint, _key {kind}, n_words bigint, words_sha256 string, words string"
    short = marked.where(F.octet_length("_text") <= long_bytes)
    solved = written(short.mapInArrow(_solve(repeat), f"{about}, found {_FOUND}"))
    cut = marked.where(F.octet_length("_text") > long_bytes).mapInArrow(
        _cut(repeat), f"{about}, low bigint, high bigint, begin bigint, first bigint, _text string"
    )
    cut = written(cut)
    parts = cut.where("_text is not null").select("_id", "_key", "low", "high", "begin", "first", "_text")
    spread = parts.repartition("_id", "low", "begin")
    pieces_ = spread.mapInArrow(_solve_panels, "_id bigint, period bigint, start bigint, stop bigint")
    inner = solved.where("words is not null").select("_id", F.inline("found")).unionByName(pieces_)
    before = Window.partitionBy("_id", "period").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("_id", "period").orderBy("start").rowsBetween(Window.unboundedPreceding, 0)
    opened = inner.withColumn("_new", F.when(F.col("start") <= F.max("stop").over(before), 0).otherwise(1))
    whole = opened.withColumn("_turn", F.sum("_new").over(upto)).groupBy("_id", "period", "_turn")
    whole = whole.agg(F.min("start").alias("start"), (F.max("stop") - F.min("start") + F.col("period")).alias("length"))
    least = F.greatest(F.lit(LEAST_WORDS), LEAST_PERIODS * F.col("period"))
    runs = whole.where(F.col("length") >= least).groupBy("_id", "start", "length").agg(F.min("period").alias("period"))
    listed = runs.groupBy("_id").agg(F.sort_array(F.collect_list(F.struct("start", "length", "period"))).alias("runs"))
    # fewer runs than words: a document's list is no longer than its text
    known = solved.where("words is not null").drop("found").unionByName(cut.where("_text is null").select(*solved.drop("found").columns))
    joined = known.join(listed, "_id", "left").withColumn("runs", F.coalesce("runs", F.array().cast(_RUNS)))
    columns = f"_key {kind}, n_words bigint, runs {_RUNS}, words_sha256 string, collapsed string"
    some = joined.where("size(runs) > 0").select("_key", "n_words", "runs", "words_sha256", "words").mapInArrow(_collapsed, columns)
    none = known.join(listed, "_id", "left_anti").unionByName(solved.where("words is null").drop("found"))
    none = none.select("_key", "n_words", F.array().cast(_RUNS).alias("runs"), "words_sha256", F.lit(None).cast("string").alias("collapsed"))
    return some.unionByName(none).withColumnRenamed("_key", key)


def planted(key, n: int) -> tuple[int, int] | None:
    """Place and number of the words that a tenth of the documents repeat to their end."""
    h = zlib.crc32(str(key).encode())
    if key is None or h % 10:
        return None
    g = h // 10
    a = g % n
    return a, 1 + (n - a) // (3 + g % 8)


def op13_periodic_runs(spark, sf_dir: str) -> DataFrame:
    """Number of runs of every document, the run with the greatest exponent, digests of all runs and of the collapsed words."""
    found = find_runs(documents(spark, sf_dir), repeat=planted)
    more = lambda r, b: (  # noqa: E731  exact: products of word numbers fit 64 bits
        (r["length"] * b["period"] > b["length"] * r["period"])
        | ((r["length"] * b["period"] == b["length"] * r["period"]) & (r["start"] < b["start"]))
    )
    best = F.aggregate("runs", F.try_element_at("runs", F.lit(1)), lambda b, r: F.when(more(r, b), r).otherwise(b))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    text = F.concat(F.array_join(lines, "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    told = found.withColumn("_best", best)
    return told.select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), "_best.start", "_best.length", "_best.period",
        F.expr("1000 * _best.length div _best.period").alias("exponent_milli"),
        F.sha2(text.cast("binary"), 256).alias("runs_sha256"),
        F.coalesce(F.sha2(F.col("collapsed").cast("binary"), 256), "words_sha256").alias("collapsed_sha256"),
    )


QUERIES = {"op13_periodic_runs": op13_periodic_runs}
SQL: dict[str, str] = {}

"""Spelling variants: the vocabulary's acceptor composed with one edit and with itself, cell by cell."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradus.llm.common import documents, pieces, runs, slices, text_bytes, written

LETTERS = np.zeros(256, bool)
LETTERS[97:123] = True
_LOWERED = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_LEAD = 0xC3  # with the byte after it, U+00C0 to U+00FF
# Words of a cell that one task takes; cells of one place of edit have at most 90 + 90 * 90 words.
CELL_WORDS = 16_384
_TOGETHER = 32_768  # words of several cells worked at once


def counted(docs: DataFrame, key: str = "doc_id", text: str = "text", every: int = 97, least: int = 5) -> DataFrame:
    """``word, n``: how often every word of ``least`` letters or more occurs in whole texts.

    Words are runs of A-Z, a-z and U+00C0 to U+00FF with A-Z lowered. With h the crc32 of ``key:word``, a run with
    ``every`` dividing h loses its code point h % length before it counts; 0 changes none. A null key reads as empty
    text, a null text has no words, repeated rows count as often as they are there.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "_text"):
            data, at = text_bytes(part.column("_text"))
            data = np.frombuffer(data.tobytes().translate(_LOWERED), np.uint8)
            lead = data == _LEAD
            inside = LETTERS[data] | lead
            inside[1:] |= lead[:-1]
            starts, ends, first = runs(inside, at)
            if not len(starts):
                continue
            coded = pieces(data, inside, starts, ends)
            held = coded.dictionary.to_pylist()
            row = np.repeat(np.arange(part.num_rows), np.diff(first))
            pair, times = np.unique(row * len(held) + coded.indices.to_numpy(), return_counts=True)
            row, code = np.divmod(pair, len(held))
            changed = {}
            if every:
                seeds = [zlib.crc32(f"{k}:".encode()) for k in part.column("_key").to_pylist()]
                found = map(zlib.crc32, map(held.__getitem__, code.tolist()), map(seeds.__getitem__, row.tolist()))
                hashes = np.fromiter(found, np.uint32, len(code))
                cut = np.flatnonzero(hashes % every == 0)
                for c, h, n in zip(code[cut].tolist(), hashes[cut].tolist(), times[cut].tolist()):
                    word = held[c].decode()
                    word = word[: h % len(word)] + word[h % len(word) + 1 :]
                    changed[word] = changed.get(word, 0) + n
                times[cut] = 0
            total = np.bincount(code, times, len(held)).astype(np.int64)
            words = pa.concat_arrays([coded.dictionary.cast(pa.large_string()), pa.array(list(changed), pa.large_string())])
            out = pa.table([words.cast(pa.string()), np.concatenate([total, np.array(list(changed.values()), np.int64)])], names=["word", "n"])
            wanted = pc.and_(pc.greater_equal(pc.utf8_length(out["word"]), least), pc.greater(out["n"], 0))
            yield from out.filter(wanted).combine_chunks().to_batches()

    taken = docs.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("_key"), F.col(text).alias("_text"))
    return taken.mapInArrow(each, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


class Acceptor:
    """The minimised acceptor of several cells of sorted distinct words, each entered from its own root.

    ``data, at`` are the words as Latin-1 bytes end to end. States are the trie's nodes with equal right languages as one;
    ``step[state, letter]`` is a transition or -1, ``to`` its target, ``skip`` how many words of the state come before those
    that take it: the sum along a path is the word's number.
    """

    def __init__(self, cell: np.ndarray, data: np.ndarray, at: np.ndarray):
        self.cell, length = cell, np.diff(at)
        shared = np.where(np.concatenate([[True], cell[1:] != cell[:-1]]), -1, 0)
        open_, depth = np.flatnonzero(shared == 0), 0
        while len(open_):
            open_ = open_[(length[open_] > depth) & (length[open_ - 1] > depth)]
            open_ = open_[data[at[open_] + depth] == data[at[open_ - 1] + depth]]
            depth += 1
            shared[open_] = depth
        node, total = np.zeros(len(cell), np.int64), 0
        first, above, letter, final, level = [], [], [], [], [0]
        for depth in range(int(length.max(initial=0)) + 1):
            here = np.flatnonzero(length >= depth)
            new = shared[here] < depth
            lead = here[new]
            first.append(lead)
            above.append(node[lead] if depth else np.full(len(lead), -1))
            letter.append(data[at[lead] + depth - 1] if depth else np.zeros(len(lead), np.uint8))
            node[here] = total + np.cumsum(new) - 1
            ends = np.zeros(len(lead), bool)
            ends[node[here[length[here] == depth]] - total] = True
            final.append(ends)
            total += len(lead)
            level.append(total)
        self.first, above, letter, final = (np.concatenate(v) for v in (first, above, letter, final))
        self.depth = np.repeat(np.arange(len(level) - 1), np.diff(level))
        self._minimise(above, letter, final, level)

    def _minimise(self, above: np.ndarray, letter: np.ndarray, final: np.ndarray, level: list[int]) -> None:
        total = len(above)
        height = np.zeros(total, np.int64)
        for a, b in zip(level[-2:0:-1], level[:1:-1]):
            np.maximum.at(height, above[a:b], height[a:b] + 1)
        fan = np.bincount(above[above >= 0], minlength=total)
        child = level[1] + np.concatenate([[0], np.cumsum(fan)[:-1]])  # nodes stand by level, so children stand by parent
        name, named = final.astype(np.int64), 2
        order = np.argsort(height, kind="stable")
        cuts = np.searchsorted(height[order], np.arange(1, height.max(initial=0) + 2))
        for a, b in zip(cuts[:-1], cuts[1:]):
            part = order[a:b]
            for i in range(int(fan[part].max())):
                part = part[fan[part] > i]
                below = child[part] + i
                known, place = np.unique(name[part] << 34 | name[below] << 8 | letter[below], return_inverse=True)
                name[part] = named + place
                named += len(known)
        _, lead, self.state = np.unique(name, return_index=True, return_inverse=True)
        used = np.unique(letter[level[1] :])
        place = np.zeros(256, np.int64)
        place[used] = np.arange(len(used))
        self.final, self.fan = final[lead], fan[lead]
        self.begin = np.concatenate([[0], np.cumsum(self.fan)])
        source = np.repeat(np.arange(len(lead)), self.fan)
        below = child[lead][source] + np.arange(self.begin[-1]) - self.begin[source]
        self.source, self.letter, self.to = source, place[letter[below]], self.state[below]
        self.skip = self.first[below] - self.first[lead][source]
        self.step = np.full((len(lead), max(1, len(used))), -1, np.int32)
        self.step[source, self.letter] = np.arange(len(source))
        # letters that lead on, and lengths of what is accepted from here (63 and more as one), as bits
        self.opens = np.where(self.final, np.uint64(1), np.uint64(0))
        self.lengths = np.zeros(len(lead), np.uint64)
        np.bitwise_or.at(self.opens, source, np.uint64(1) << (1 + self.letter % 63).astype(np.uint64))
        sizes = np.where(final, np.uint64(1), np.uint64(0))
        for a, b in zip(level[-2:0:-1], level[:1:-1]):
            np.bitwise_or.at(sizes, above[a:b], sizes[a:b] << np.uint64(1) | sizes[a:b] & np.uint64(1 << 63))
        self.lengths = sizes[lead]

    def _out(self, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Every transition of every listed state: place in the list, transition."""
        n = self.fan[state]
        at = np.repeat(np.arange(len(state)), n)
        return at, np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n) + self.begin[state][at]

    def composed(self, states: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``state, i, j``: the i-th and j-th word from each of the states that differ by one edit made right there.

        These are the accepting paths of acceptor, one-edit transducer and acceptor composed, from configurations where no edit
        has been made: two letters for one, or one letter more, and from then on the same letters on both sides. A letter more
        must not be the other side's next one, so that each pair has one path.
        """
        found = []

        def go_on(rows: tuple) -> tuple:
            root, x, y, i, j = rows
            live = (self.opens[x] & self.opens[y] != 0) & (self.lengths[x] & self.lengths[y] != 0)
            root, x, y, i, j = (v[live] for v in rows)
            both = self.final[x] & self.final[y]
            found.append((root[both], i[both], j[both]))
            at, t = self._out(x)
            u = self.step[y[at], self.letter[t]]
            at, t, u = (v[u >= 0] for v in (at, t, u))
            return root[at], self.to[t], self.to[u], i[at] + self.skip[t], j[at] + self.skip[u]

        at, t = self._out(states)
        root = states[at]
        last, level = self.begin[self.source[t] + 1], []
        for gap in range(1, int(self.fan[states].max(initial=0))):
            a = t[t + gap < last]
            b = a + gap
            level.append((self.source[a], self.to[a], self.to[b], self.skip[a], self.skip[b]))
        more = self.final[root] & self.final[self.to[t]]
        found.append((root[more], np.zeros(int(more.sum()), np.int64), self.skip[t[more]]))
        at, u = self._out(self.to[t])
        v = self.step[root[at], self.letter[u]]
        keep = (v >= 0) & (self.letter[u] != self.letter[t[at]])
        at, u, v = at[keep], u[keep], v[keep]
        level.append((root[at], self.to[v], self.to[u], self.skip[v], self.skip[t[at]] + self.skip[u]))
        while level:
            level = [rows for rows in map(go_on, level) if len(rows[0])]
        return tuple(np.concatenate(v) for v in zip(*found))

    def pairs(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of all pairs of words of a cell one edit apart whose first differing place is in the cell's ``low..high - 1``."""
        cell = self.cell[self.first]
        nodes = np.flatnonzero((self.depth >= low[cell]) & (self.depth < high[cell]))
        root, i, j = self.composed(np.unique(self.state[nodes]))
        order = np.argsort(root, kind="stable")
        root, i, j = root[order], i[order], j[order]
        a, b = (np.searchsorted(root, self.state[nodes], side) for side in ("left", "right"))
        at = np.repeat(np.arange(len(nodes)), b - a)
        place = np.arange(len(at)) - np.repeat(np.cumsum(b - a) - (b - a), b - a) + a[at]
        base = self.first[nodes][at]
        return base + i[place], base + j[place]


def _halves(rows: DataFrame) -> DataFrame:
    """Each row once for either half of the places ``low..high - 1`` where an edit may be."""
    middle = F.expr("low + (high - low + 1) div 2")
    halves = F.array(F.struct(F.col("low"), middle.alias("high")), F.struct(middle.alias("low"), F.col("high")))
    split = rows.select("word", "n", "shorter", F.explode(halves).alias("_half"))
    split = split.select("word", "n", "shorter", "_half.low", "_half.high")
    ends = F.expr("right(word, greatest(shorter - high, 0))")
    cell = F.concat_ws(" ", "shorter", "low", "high", F.expr("left(word, low)"), ends)
    return split.withColumn("cell", cell)


def _most(cell_words: int) -> int:
    """At least what a cell of one place may hold, which can't be halved."""
    return max(cell_words, 90 + 90 * 90)


def near_words(vocabulary: DataFrame, cell_words: int = CELL_WORDS) -> DataFrame:
    """``word, n_near, best_n, best``: for every ``word`` with words one inserted, deleted or replaced letter away, how many
    they are, and of those the most frequent (the first in order among equals) with its ``n``.

    Two words m and m or m + 1 letters long share what is before and behind their edit. A word is dealt to cells by m, a half
    of the places where the edit may be, and its letters outside them: words of a cell have come through the acceptor to the
    same state. A cell of over ``cell_words`` is halved on, so any cell is small in the end and no pair is lost; each pair is
    in exactly one cell that holds its first differing place.
    """
    most = _most(cell_words)
    size = F.length("word")
    rows = vocabulary.select("word", "n", F.explode(F.array(size - 1, size)).alias("shorter"))
    rows = rows.where("shorter > 0").select("*", F.lit(0).alias("low"), F.expr("shorter + 1").alias("high"))
    found = None
    while rows is not None:
        dealt = _halves(rows)
        short = F.count_if(F.length("word") == F.col("shorter"))
        sizes = dealt.groupBy("cell").agg(F.count("*").alias("_n"), short.alias("_short")).where("_n > 1 and _short > 0")
        sized = written(dealt.join(sizes.select("cell", "_n"), "cell"))
        part = _solved(sized.where(F.col("_n") <= most))
        found = part if found is None else found.unionByName(part)
        large = sized.where(F.col("_n") > most)
        rows = None if large.isEmpty() else large.select("word", "n", "shorter", "low", "high")
    first = F.min_by("best", F.struct(-F.col("best_n"), "best")).alias("best")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.max("best_n").alias("best_n"), first)


def _solved(rows: DataFrame) -> DataFrame:
    """Near words of each cell, brought together a word and batch of cells."""

    def settle(table: pa.Table, cell: np.ndarray) -> pa.RecordBatch:
        words = table["word"].combine_chunks()
        held = words.to_pylist()
        data = np.frombuffer("".join(held).encode("latin-1"), np.uint8)
        size = pc.utf8_length(words).to_numpy().astype(np.int64)
        lead = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
        number = np.cumsum(np.concatenate([[0], cell[1:] != cell[:-1]]))
        shorter, low, high = (table[c].to_numpy()[lead] for c in ("shorter", "low", "high"))
        x, y = Acceptor(number, data, np.concatenate([[0], np.cumsum(size)])).pairs(low, high)
        keep = np.minimum(size[x], size[y]) == shorter[number[x]]
        x, y = np.concatenate([x[keep], y[keep]]), np.concatenate([y[keep], x[keep]])
        # words are numbered once however many cells they are in, in code-point order
        rank = pc.rank(words, tiebreaker="dense").to_numpy().astype(np.int64)
        n = table["n"].to_numpy()
        order = np.lexsort((rank[y], -n[y], rank[x]))
        x, y = x[order], y[order]
        begin = np.flatnonzero(np.concatenate([[True], rank[x[1:]] != rank[x[:-1]]])) if len(x) else np.zeros(0, np.int64)
        times = np.diff(np.concatenate([begin, [len(x)]]))
        columns = [words.take(pa.array(x[begin])), pa.array(times), pa.array(n[y[begin]]), words.take(pa.array(y[begin]))]
        return pa.RecordBatch.from_arrays(columns, names=["word", "n_near", "best_n", "best"])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            rest = table if rest is None else pa.concat_tables([rest, table])
            if rest.num_rows < _TOGETHER:
                continue
            cell = rest["cell"].combine_chunks().dictionary_encode().indices.to_numpy()
            done = int(np.searchsorted(cell, cell[-1]))  # the last cell may go on in the next batch
            if done:
                yield settle(rest.slice(0, done), cell[:done])
                rest = rest.slice(done)
        if rest is not None and rest.num_rows:
            yield settle(rest, rest["cell"].combine_chunks().dictionary_encode().indices.to_numpy())

    dealt = rows.select("cell", "word", "n", "shorter", "low", "high").repartition("cell").sortWithinPartitions("cell", "word")
    return dealt.mapInArrow(each, "word string, n_near bigint, best_n bigint, best string")


def roots(forms: DataFrame) -> DataFrame:
    """``word, root`` for each row of ``word, form``: the last word that following forms leads to.

    A form is at least twice as frequent, so chains end and are short; every round doubles how far a row has gone.
    """
    ends = written(forms.select("word", F.col("form").alias("root")))
    while True:
        on = ends.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        gone = written(ends.join(on, "root", "left"))
        moved = not gone.where("_next is not null").isEmpty()
        ends = gone.select("word", F.coalesce("_next", "root").alias("root"))
        if not moved:
            return ends


def variants(vocabulary: DataFrame) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` for every row of ``word, n`` (distinct words of U+00FF and below).

    ``form`` is the most frequent near word (first in code-point order among equals) if it is at least twice as frequent, else
    null; ``root`` the word at the end of the chain of forms. An empty vocabulary gives no rows.
    """
    known = written(vocabulary.select("word", "n"))
    near = known.join(near_words(known), "word", "left")
    enough = F.col("best_n") >= 2 * F.col("n")
    near = written(
        near.select(
            "word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
            F.when(enough, F.col("best")).alias("form"), F.when(enough, F.col("best_n")).alias("form_n"),
        )
    )
    chained = near.join(roots(near.where("form is not null")), "word", "left")
    return chained.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11_spelling_variants(spark, sf_dir: str) -> DataFrame:
    """Near words, form and root of every word of five letters or more that occurs three times or more."""
    return variants(counted(documents(spark, sf_dir)).where("n >= 3"))


QUERIES = {"op11_spelling_variants": op11_spelling_variants}
SQL: dict[str, str] = {}

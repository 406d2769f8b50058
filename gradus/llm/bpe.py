"""BPE encoding over the trie of distinct words, and decoding."""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradus.llm.common import as_text, documents, row_and, slices

_REMEMBERED = 1_000_000  # pairs of tokens, or pieces of text, a task keeps; all are dropped when there are more


class Encoder:
    """Encodes words whose last symbol carries an end mark, from the file of a BPE tokenizer.

    The last token of a word's encoding, for every prefix of it, tells the whole encoding: cutting the last token off leaves a
    prefix whose encoding is known the same way. A token can end a prefix just if it and the last token of what is before it
    stay as they are when they are encoded together, and exactly one does.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        whole = Tokenizer.from_file(path)
        self.normal, self.cut = whole.normalizer, whole.pre_tokenizer
        self.end = spec["model"]["end_of_word_suffix"] or ""
        vocab = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings = {i: s for s, i in (vocab | self.special).items()}
        self.merges = {}
        for rank, (a, b) in enumerate(spec["model"]["merges"]):
            self.merges.setdefault((vocab[a], vocab[b]), (rank, vocab[a + b]))
        self.vocab = vocab
        self.symbols: dict[int, list[int]] = {}
        inner, final = {}, {}
        for s, i in vocab.items():
            marked = bool(self.end) and s.endswith(self.end)
            plain = s.removesuffix(self.end) if marked else s
            parts = [vocab.get(c) for c in plain[:-1]] + [vocab.get(plain[-1:] + (self.end if marked else ""))]
            if plain and None not in parts:
                self.symbols[i] = parts
                if self.merged(parts) == [i]:
                    (final if marked else inner)[plain] = i
        self.inner, self.final = inner, final if self.end else inner
        self.longest = max(map(len, [*inner, *final]), default=1)
        self.pairs: dict[tuple[int, int], bool] = {}
        self.known: dict[str, bytes] = {}
        self.special_pattern = regex.compile("|".join(regex.escape(s) for s in self.special)) if self.special else None

    def merged(self, ids: list[int]) -> list[int]:
        """Plain BPE: the pair of least rank, leftmost first, becomes one token until none is left."""
        ids = list(ids)
        while len(ids) > 1:
            best = min(((self.merges[p][0], i) for i, p in enumerate(zip(ids, ids[1:])) if p in self.merges), default=None)
            if best is None:
                break
            i = best[1]
            ids[i : i + 2] = [self.merges[ids[i], ids[i + 1]][1]]
        return ids

    def stays(self, a: int, b: int) -> bool:
        """Whether two tokens side by side are how their text is encoded."""
        found = self.pairs.get((a, b))
        if found is None:
            if len(self.pairs) >= _REMEMBERED:
                self.pairs.clear()
            found = self.pairs[a, b] = self.merged(self.symbols[a] + self.symbols[b]) == [a, b]
        return found

    def _last(self, word: str, stop: int, tokens: dict[str, int], path: list) -> tuple[int, int]:
        for start in range(max(0, stop - self.longest), stop):
            t = tokens.get(word[start:stop])
            if t is not None and (start == 0 or self.stays(path[start][0], t)):
                return t, start
        raise ValueError(f"no encoding of {word[:stop]!r}")

    def words(self, distinct: list[str]) -> dict[str, list[int]]:
        """Encodings of distinct words by one walk through their trie.

        In sorted order the words are the trie's paths, depth first: a word goes on from the node where it leaves the word
        before, and the last tokens found on the way there hold for both.
        """
        out, path, before = {}, [(-1, 0)], ""
        for word in sorted(distinct):
            shared = 0
            for a, b in zip(before, word[:-1]):
                if a != b:
                    break
                shared += 1
            shared = min(shared, len(path) - 1)
            del path[shared + 1 :]
            for stop in range(shared + 1, len(word)):
                path.append(self._last(word, stop, self.inner, path))
            token, start = self._last(word, len(word), self.final, path)
            ids = [token]
            while start:
                token, start = path[start]
                ids.append(token)
            out[word], before = ids[::-1], word
        return out

    def pieces(self, texts: list[str]) -> list[bytes]:
        """Ids of pieces of text without ASCII space, as little-endian unsigned 32-bit numbers."""
        new = [t for t in texts if t not in self.known]
        if len(self.known) + len(new) > _REMEMBERED:
            self.known.clear()
            new = texts
        listed = []
        for text in new:
            items: list = []
            for part, special in self._parts(text):
                if special is not None:
                    items.append(special)
                elif part:
                    items.extend(w for w, _ in self.cut.pre_tokenize_str(self.normal.normalize_str(part)))
            listed.append(items)
        of = self.words(list({w for items in listed for w in items if isinstance(w, str)}))
        for text, items in zip(new, listed):
            ids = [i for w in items for i in (of[w] if isinstance(w, str) else (w,))]
            self.known[text] = np.array(ids, "<u4").tobytes()
        return [self.known[t] for t in texts]

    def _parts(self, text: str) -> Iterator[tuple[str, int | None]]:
        at = 0
        if self.special_pattern is not None and "<" in text:
            for m in self.special_pattern.finditer(text):
                yield text[at : m.start()], None
                yield "", self.special[m[0]]
                at = m.end()
        yield text[at:], None

    def decoded(self, ids: bytes) -> str:
        return " ".join(map(self.strings.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def tokenizer_path(path: str) -> str:
    """A bare name is one of the public tokenizers' files."""
    if os.path.isabs(path):
        return path
    import public_tokenizers

    return public_tokenizers.path(path)


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One for each task process."""
    return Encoder(tokenizer_path(path))


def encode(docs: DataFrame, text: str = "text", path: str = "word_bpe_49k.json", decode: bool = True) -> DataFrame:
    """The columns of ``docs`` but the text in struct ``_row``, with ``ids`` (little-endian unsigned 32-bit numbers as binary)
    and, if wanted, ``decoded``: the text that decoding the ids gives, special tokens in it.

    Whole texts are encoded without added special tokens; special tokens spelled out in a text are found. A null text is
    empty and has no ids. Every task encodes the distinct pieces between ASCII spaces of some rows at a time, so repeated
    words cost one look-up; no rows move.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = encoder(path)
        for batch in slices(batches, "_text"):
            listed = pc.ascii_split_whitespace(batch.column("_text"))
            coded = listed.flatten().dictionary_encode()
            piece = known.pieces(coded.dictionary.to_pylist())
            at = listed.offsets.to_numpy()
            order = coded.indices.to_numpy(zero_copy_only=False)[: at[-1] - at[0]].tolist()
            at = (at - at[0]).tolist()
            ids = [b"".join(map(piece.__getitem__, order[i:j])) for i, j in zip(at, at[1:])]
            columns, names = [batch.column("_row"), pa.array(ids, pa.binary())], ["_row", "ids"]
            if decode:
                columns.append(pa.array([known.decoded(x) for x in ids], pa.string()))
                names.append("decoded")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text])
    taken = docs.select(row.alias("_row"), as_text(text).alias("_text"))
    return taken.mapInArrow(each, row_and(taken, "ids binary" + ", decoded string" * decode))


def op2_bpe(spark, sf_dir: str) -> DataFrame:
    """Digests of every document's ids and of the text they decode to."""
    out = encode(documents(spark, sf_dir).select("doc_id", "text"))
    return digests(out)


def digests(encoded: DataFrame) -> DataFrame:
    return encoded.select(
        "_row.doc_id",
        (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


QUERIES = {"op2_bpe": op2_bpe}
SQL: dict[str, str] = {}

"""Spelling variants against comparing all words with all."""

import os
import random
from collections import Counter

import numpy as np
import pytest

from gradus.llm import spelling
from tests.llm import brute

SF = "/root/testdata/sf0.001"
NAMES = ("word", "form", "root", "n", "n_near", "form_n")


def _vocabulary(seed, size, letters="abcdéÿ", longest=9):
    rnd = random.Random(seed)
    words = set()
    while len(words) < size:
        w = "".join(rnd.choice(letters) for _ in range(rnd.randint(5, longest)))
        words.add(w)
        for _ in range(rnd.randint(0, 3)):
            i = rnd.randrange(len(w))
            words.add(rnd.choice([w[:i] + w[i + 1 :], w[:i] + rnd.choice(letters) + w[i:], w[:i] + rnd.choice(letters) + w[i + 1 :]]))
    return {w: rnd.choice([3, 3, 4, 6, 8, 16, 40]) for w in sorted(words)}


def _found(frame):
    return Counter(tuple(r[c] for c in NAMES) for r in frame.collect())


@pytest.mark.parametrize("seed", range(3))
def test_variants_of_random_words(spark, seed):
    n = _vocabulary(seed, 400, "ab" if seed == 2 else "abcdéÿ") | {"a" * 70: 5, "a" * 71: 20, "a" * 69 + "b": 3, "ab": 9, "b": 3, "c": 7}
    got = _found(spelling.variants(spark.createDataFrame(list(n.items()), "word string, n bigint")))
    assert got == Counter(brute.variants(n))


def test_large_cells_are_halved_on(spark, monkeypatch):
    """Cells that are cut down to single places give the same pairs."""
    n = _vocabulary(7, 500, "abc", 7)
    frame = spark.createDataFrame(list(n.items()), "word string, n bigint")
    rounds, plain = [], spelling._halves
    monkeypatch.setattr(spelling, "_halves", lambda rows: rounds.append(1) or plain(rows))
    monkeypatch.setattr(spelling, "_most", lambda words: 12)
    got = {r.word: (r.n_near, r.best) for r in spelling.near_words(frame).collect()}
    near = {w: [v for v in n if v != w and brute.one_edit(w, v)] for w in n}
    assert got == {w: (len(v), min(v, key=lambda x: (-n[x], x))) for w, v in near.items() if v}
    assert len(rounds) > 2


def test_acceptor_is_minimal_and_numbers_words():
    words = sorted(_vocabulary(3, 300))
    data = np.frombuffer("".join(words).encode("latin-1"), np.uint8)
    at = np.concatenate([[0], np.cumsum([len(w) for w in words])])
    known = spelling.Acceptor(np.zeros(len(words), np.int64), data, at)
    languages = {w[:i]: frozenset(v[i:] for v in words if v.startswith(w[:i])) for w in words for i in range(len(w) + 1)}
    assert len(known.final) == len(set(languages.values()))
    letters = sorted({int(x) for x in data})
    for number, word in enumerate(words):
        state, sum_ = known.state[0], 0
        for c in word.encode("latin-1"):
            t = known.step[state, letters.index(c)]
            state, sum_ = known.to[t], sum_ + known.skip[t]
        assert known.final[state] and sum_ == number


def test_counts_of_odd_rows(odd, odd_rows):
    for every in (97, 3, 0):
        got = {r.word: r.n for r in spelling.counted(odd, every=every).collect()}
        assert got == brute.counted([r[:2] for r in odd_rows], every)


def test_empty_tables(spark, empty):
    assert spelling.variants(spelling.counted(empty)).count() == 0
    assert spelling.variants(spark.createDataFrame([("alone", 4)], "word string, n bigint")).collect() == [("alone", None, "alone", 4, 0, None)]


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not here")
def test_query(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    n = {w: k for w, k in brute.counted(rows).items() if k >= 3}
    assert _found(spelling.op11_spelling_variants(spark, SF)) == Counter(brute.variants(n))

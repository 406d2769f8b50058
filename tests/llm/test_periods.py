"""Periodic runs against trying every period at every place."""

import os
import random
from collections import Counter

import pytest

from gradus.llm import periods
from tests.llm import brute

SF = "/root/testdata/sf0.001"


def _texts(seed):
    rnd = random.Random(seed)
    out = ["", "a", "a a a a a", "a a a a a a", "a b a b a b a", "a b a b a b a b", " a  b\na\tb a b a b \n", "x " + "a b a c " * 6 + "a b"]
    for _ in range(40):
        words = []
        for _ in range(rnd.randint(1, 5)):
            unit = [rnd.choice("abc") for _ in range(rnd.randint(1, 12))]
            words += (unit * 9)[: rnd.randint(0, 7 * len(unit))]
            if rnd.random() < 0.5:
                words[rnd.randrange(len(words) + 1) :] += ["d"]
        out.append(" ".join(words))
    out += [" ".join(rnd.choice("ab") for _ in range(rnd.randint(0, 60))) for _ in range(60)]
    fibonacci = ["a", "a b"]
    while len(fibonacci) < 13:
        fibonacci.append(fibonacci[-1] + " " + fibonacci[-2])
    out += [fibonacci[-1], "a " * 700, "a b " * 300 + "c " + "a b c " * 200]
    long = [f"w{rnd.randrange(10**6)}" for _ in range(260)]
    out.append(" ".join(long * 5 + long[:17]))
    return out


def _check(rows, texts):
    """Rows in the order of keys 0, 1, ... against the plain version."""
    got = {r.doc_id: r for r in rows}
    assert len(got) == len(rows) == len(texts)
    for i, text in enumerate(texts):
        words = brute.WORD.findall(text or "")
        want = brute.periodic_runs(words)
        assert [tuple(r) for r in got[i].runs] == want, text
        assert got[i].n_words == len(words) and got[i].words_sha256 == brute.sha(" ".join(words).encode())
        assert got[i].collapsed == (brute.collapsed(words, want) if want else None)


@pytest.mark.parametrize("seed", range(2))
def test_runs(spark, seed):
    texts = _texts(seed)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    _check(periods.find_runs(docs).collect(), texts)


def test_long_texts_by_panels(spark, monkeypatch):
    monkeypatch.setattr(periods, "PANEL_WORDS", 64)
    texts = _texts(5)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    assert any(len(list(periods.panels(len(t.split())))) > 20 for t in texts)
    _check(periods.find_runs(docs, long_bytes=40).collect(), texts)


def test_odd_rows(odd, odd_rows):
    got = Counter((r.doc_id, r.n_words, tuple(map(tuple, r.runs)), r.collapsed) for r in periods.find_runs(odd).collect())
    want = Counter()
    for row in odd_rows:
        words = brute.WORD.findall(row[1] or "")
        runs = brute.periodic_runs(words) if len(words) < 2000 else []
        want[row[0], len(words), tuple(runs), brute.collapsed(words, runs) if runs else None] += 1
    assert got == want


def test_empty_table(spark, empty):
    assert periods.find_runs(empty).count() == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not here")
def test_query(spark):
    want = {}
    for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect():
        words = brute.planted(r.doc_id, brute.WORD.findall(r.text or ""))
        runs = brute.periodic_runs(words)
        lines = "".join(f"{s},{n},{p}\n" for s, n, p in runs)
        best = max(runs, key=lambda r: (r[1] * 10**9 // r[2], -r[0], -r[2]), default=None)
        told = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
        want[r.doc_id] = (len(runs), *told, brute.sha(lines.encode()), brute.sha(brute.collapsed(words, runs).encode()))
    got = periods.op13_periodic_runs(spark, SF).collect()
    assert {r.doc_id: (r.n_runs, r.start, r.length, r.period, r.exponent_milli, r.runs_sha256, r.collapsed_sha256) for r in got} == want
    assert len(got) == len(want) and sum(v[0] > 0 for v in want.values()) > 10

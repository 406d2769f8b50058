"""Encoding, language, toxicity, line rules, mixing and chat."""

import re
import os
import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gradus.llm import bpe, chat, common, language, mixing, quality, toxicity
from tests.llm import brute
from tests.llm.conftest import prose

ODD = [
    "", "   ", "a<|endoftext|>b <|startoftext|>", "Ünïcödé ΑΣ ΣΑΣ Σ é", "I'll we've 's'S don't'RE", "x" * 3000, "ab" * 900,
    "日本語 テキスト 한국어", "a b c\x1cd\x85e", "<|endoftext", "!!!???...", "İI ﬁ ß ẞ", "\x00\x01", "123 ½ ² Ⅷ", "a\r\nb\tc\x0b\x0cd", "क्षि नि",
]


@pytest.mark.parametrize("seed", range(2))
def test_encoding_equals_the_library(spark, seed):
    import public_tokenizers
    from tokenizers import Tokenizer

    rnd = random.Random(seed)
    letters = "abcdefghijklmnopqrstuvwxyzéèüñ'’.,-0123"
    texts = ODD + [prose(seed, 60)] + [" ".join("".join(rnd.choices(letters, k=rnd.randint(1, 14))) for _ in range(60)) for _ in range(20)]
    rows = [(i, t, "x", "y") for i, t in enumerate(texts)] + [(900, None, None, None), (None, "null key", None, None)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, ids string, decoded string").repartition(2)
    whole = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = Counter()
    for key, text, *_ in rows:
        ids = whole.encode(text or "", add_special_tokens=False).ids
        want[key, np.array(ids, "<u4").tobytes(), whole.decode(ids, skip_special_tokens=False)] += 1
    assert Counter((r._row.doc_id, bytes(r.ids), r.decoded) for r in bpe.encode(frame).collect()) == want
    assert "decoded" not in bpe.encode(frame, decode=False).columns


def test_encoding_of_odd_rows(odd, odd_rows, empty):
    got = bpe.digests(bpe.encode(odd)).collect()
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in odd_rows)
    assert all(r.ids_sha256 == hashlib.sha256(b"").hexdigest() for r in got if r.n_tokens == 0)
    assert bpe.encode(empty).count() == 0


def test_words_share_what_they_have_in_common():
    known = bpe.encoder("word_bpe_49k.json")
    rnd = random.Random(1)
    words = sorted({"".join(rnd.choices("abestin", k=rnd.randint(1, 9))) for _ in range(400)})
    got = known.words(words)
    for w in words:
        assert got[w] == known.merged([known.vocab[c] for c in w[:-1]] + [known.vocab[w[-1] + known.end]])


LANGS = {"en": "the of and that with ing tion er", "fr": "le la des que ment eau oi eux", "de": "der die und sch ung keit ich"}


def _spoken(lang, rnd, n):
    parts = LANGS[lang].split()
    return " ".join("".join(rnd.choices(parts, k=rnd.randint(1, 3))) for _ in range(n)).capitalize() + "."


def test_language_of_held_out_texts(spark):
    rnd = random.Random(2)
    rows = [(i, _spoken(lang, rnd, rnd.randint(3, 40)), lang) for i, lang in enumerate(rnd.choices(list(LANGS), k=240))]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    models = language.fit(frame, F.col("doc_id") % 4 != 0)
    truth = {r[0]: r[2] for r in rows}
    got = language.predict(frame, models).collect()
    assert all(r.lang_pred == truth[r._row.doc_id] and 0 <= r.score <= 1 for r in got if r._row.doc_id % 4 == 0)
    strange = spark.createDataFrame([(1, "zzqx qqzx xxqz jjqq " * 20)], "doc_id bigint, text string")
    assert language.predict(strange, models).first().rejected


def test_language_is_calibrated_on_all_learning_rows(spark):
    rnd = random.Random(5)
    rows = [(i, _spoken(lang, rnd, rnd.randint(1, 6)), lang) for i, lang in enumerate(rnd.choices(list(LANGS), k=2600))]
    models = language.fit(spark.createDataFrame(rows, "doc_id bigint, text string, lang string").repartition(5), F.lit(True))
    entropy, _ = models.entropies(pa.array([r[1] for r in rows]))
    best = np.array([models.langs.index(r[2]) for r in rows])
    for j in range(len(models.langs)):
        own = entropy[best == j, j]
        assert abs(models.limits[j] - own.mean() - 3 * own.std()) < 1e-9
    z = (entropy[np.arange(len(best)), best] - entropy.min(axis=1)).sum()
    likely = [np.log(models.confidence(entropy, s)).sum() - s * z for s in language.SHARPNESS]
    assert models.sharpness == language.SHARPNESS[int(np.argmax(likely))]


def test_language_of_odd_rows(odd, odd_rows, empty):
    models = language.fit(odd, F.lit(True))
    got = language.predict(odd, models).collect()
    assert Counter(r._row.doc_id for r in got) == Counter(r[0] for r in odd_rows)
    silent = {r[0] for r in odd_rows if not any(c.isalpha() for c in r[1] or "")}
    assert {r._row.doc_id for r in got if r.lang_pred == "und"} == silent
    assert {r.lang_pred for r in got} - {"und"} <= {r[2] for r in odd_rows}
    none = language.fit(empty, F.lit(True))
    assert {(r.lang_pred, r.score) for r in language.predict(odd, none).collect()} == {("und", 0.0)}
    assert language.predict(empty, models).count() == 0


def test_kneser_ney_shares_add_to_one():
    rnd = random.Random(4)
    column = pa.array([_spoken("en", rnd, 80)])
    p = language.pieces(column)
    grams, n = np.unique(p.grams[np.concatenate([np.arange(p.begin[i], p.begin[i + 1]) for i in p.order])], return_counts=True)
    models = language.Models({"en": (grams.astype(np.int32), n.astype(float))})
    for context in np.unique(grams >> 6)[:20]:
        every = (np.int32(context) << 6) | np.arange(64, dtype=np.int32)
        assert abs((2.0 ** -models.surprise(every)).sum() - 1) < 1e-4


def test_toxicity_of_held_out_and_misspelt_words(spark):
    rnd = random.Random(6)
    vile = ["grumbleworst", "snarlfilth", "vexmuck"]
    rows, labels = [], []
    for i in range(300):
        words = prose(1000 + i, rnd.randint(10, 80)).split()
        toxic = int(rnd.random() < 0.4)
        for _ in range(toxic * 2):
            words.insert(rnd.randrange(len(words)), rnd.choice(vile))
        rows.append((i, " ".join(words)))
        labels.append((i, toxic))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    model = toxicity.fit(docs, spark.createDataFrame(labels + [(None, 1), (5, None)], "doc_id bigint, toxic int"), F.col("doc_id") % 3 != 1)
    truth = dict(labels)
    got = toxicity.score(docs, model).collect()
    held = [r for r in got if r._row.doc_id % 3 == 1]
    assert np.mean([(r.score >= 0.7) == truth[r._row.doc_id] for r in held]) > 0.95
    new = spark.createDataFrame([(1, "small river snarlfilthy grumblewurst stone"), (2, "small river winter stone"), (3, ""), (4, None)], "doc_id bigint, text string")
    scores = {r._row.doc_id: r.score for r in toxicity.score(new, model).collect()}
    assert scores[1] > 0.7 > 0.5 >= max(scores[3], scores[4]) and scores[2] < 0.5


def test_toxicity_of_odd_rows(spark, odd, odd_rows, empty):
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)] + [(3, 1), (None, None)], "doc_id bigint, toxic int")
    model = toxicity.fit(odd, labels, F.col("doc_id") > 2)
    got = toxicity.score(odd, model).collect()
    assert Counter(r._row.doc_id for r in got) == Counter(r[0] for r in odd_rows) and all(0 <= r.score <= 1 for r in got)
    none = toxicity.fit(empty, labels, F.lit(True))
    assert toxicity.score(empty, none).count() == 0 and toxicity.score(odd, none).count() == len(odd_rows)


def test_best_windows_against_a_plain_version():
    rnd = np.random.default_rng(3)
    sizes = rnd.integers(0, 9, 60)
    at = np.concatenate([[0], np.cumsum(sizes)])
    values = rnd.integers(-4, 5, at[-1]).astype(float)
    best, first, count = toxicity.best_windows(values, at)
    for i, (a, b) in enumerate(zip(at, at[1:])):
        row = values[a:b]
        runs = [row[j : j + toxicity.WINDOW].mean() for j in range(max(1, len(row) - toxicity.WINDOW + 1))] if len(row) else [0.0]
        assert abs(best[i] - max(runs)) < 1e-9
        assert not len(row) or abs(values[first[i] : first[i] + count[i]].mean() - best[i]) < 1e-9


def test_line_rules_of_odd_rows(odd, odd_rows, empty):
    got = quality.judge(odd).collect()
    fields = lambda r: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)
    assert Counter((r._row.doc_id, *fields(r)) for r in got) == Counter((r[0], *brute.line_counts(r[1])) for r in odd_rows)
    assert not any(r.kept for r in got if r.base_failed)
    assert quality.judge(empty).count() == 0


def test_lines_that_fail_go(spark):
    good = prose(1, 60)
    bad = ["Home | News | Sport | Contact", "ALL OF THIS IS LOUD TODAY!", "Copyright © 2020 Somebody.", "a# b$ c% d& e* f#.", "words " * 20 + "without an end"]
    rows = [(1, "\n".join([good, "", *bad, good[::1]])), (2, "\n".join([prose(2, 30), " | ".join(prose(3, 40).split())])), (3, good)]
    got = {r._row.doc_id: r for r in quality.judge(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got[1].cleaned == f"{good}\n\n{good}" and not got[2].kept
    assert got[3].kept and got[3].cleaned == good


def test_mixture_meets_its_targets(spark):
    rows = [(i, "x" * 40, None if i % 3 == 0 else f"s{i % 3}") for i in range(3000)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    got = mixing.mix(frame, {"s1": 3, "s2": 1}).collect()
    n = Counter(r._row.source for r in got)
    assert n[None] == 0 and abs(n["s1"] / 2250 - 1) < 0.08 and abs(n["s2"] / 750 - 1) < 0.12
    copies = Counter(r._row.doc_id for r in got)
    assert all(sorted(r.copy for r in got if r._row.doc_id == k) == list(range(1, copies[k] + 1)) for k in list(copies)[:20])
    keys = [r.shuffle_key for r in got]
    assert keys == sorted(keys)
    again = mixing.mix(frame.repartition(5), {"s1": 3, "s2": 1}).collect()
    assert Counter((r._row.doc_id, r.copy) for r in again) == Counter((r._row.doc_id, r.copy) for r in got)
    assert mixing.mix(frame, {}).count() == 0


def test_mixture_of_odd_rows(odd, empty):
    got = mixing.mix(odd)
    assert got.select("_row.*").columns == odd.columns and got.count() > 0
    assert mixing.mix(empty).count() == 0


@pytest.mark.parametrize("rate", [0.0, 0.3, 1.0, 7.5, 900.0])
def test_poisson_steps(spark, rate):
    steps = spark.range(1).select(mixing.poisson_steps(F.lit(rate)).alias("s")).first().s
    assert abs(steps[-1] - 1) < 1e-9 and all(a <= b for a, b in zip(steps, steps[1:]))
    mean = sum((b - a) * k for k, (a, b) in enumerate(zip([0.0, *steps], steps)))
    assert abs(mean - rate) < 1e-6 * max(1, rate)


def test_chat_views(spark):
    rows = [
        (1, 0, "system", "be kind"), (1, 1, "ann", "hi"), (1, 2, "bob", "ho"), (1, 3, "ann", None),
        (2, 0, "system", "alone"), (None, None, None, "x"), (3, 1, "ann", "a"), (3, 1, "ann", "a"), (3, 70, "ann", "late"),
    ]
    got = chat.perspectives(spark.createDataFrame(rows, "conv_id bigint, turn int, role string, text string"), page=64).collect()
    by = {(r.conv_id, r.participant, r.page): r for r in got}
    assert set(by) == {(1, "ann", 0), (1, "bob", 0), (None, "unknown", -1), (3, "ann", 0), (3, "ann", 1)}
    ann = by[1, "ann", 0]
    assert ann.rendered == (
        "<|system|>\nbe kind<|end|>\n<|assistant|>\nhi<|end|>\n<|user name=bob|>\nho<|end|>\n<|assistant|>\n<|end|>\n"
    )
    assert [ann.rendered[m.start : m.stop] for m in ann.masks] == ["hi<|end|>\n", "<|end|>\n"]
    assert [by[1, "bob", 0].rendered[m.start : m.stop] for m in by[1, "bob", 0].masks] == ["ho<|end|>\n"]
    assert by[3, "ann", 0].n_turns == 2
    none = spark.createDataFrame([], "conv_id bigint, turn int, role string, text string")
    assert chat.perspectives(none).count() == 0


def test_many_rows_of_one_turn_open_ties(spark):
    rows = [(1, 0, "ann", f"{i:03d}") for i in range(150)]
    got = chat.perspectives(spark.createDataFrame(rows, "conv_id bigint, turn int, role string, text string")).collect()
    assert sorted((r.tie, r.n_turns) for r in got) == [(0, 64), (1, 64), (2, 22)]


def test_toxicity_of_labelled_documents(spark):
    """Held-out rows of the driver's table: some labelled texts show nothing to tell them by, so the bound is on the order of scores."""
    path = "/root/testdata/sf0.01"
    if not os.path.isdir(path):
        pytest.skip("driver tables not here")
    rows = toxicity.op1_toxicity(spark, path).join(spark.read.parquet(f"{path}/labels.parquet"), "doc_id").where("held_out").collect()
    toxic, clean = ([r for r in rows if r.toxic == c] for c in (1, 0))
    assert np.mean([[a.score > b.score for b in clean] for a in toxic]) > 0.8
    assert np.mean([r.predicted for r in toxic]) >= 0.4 and np.mean([r.predicted for r in clean]) <= 0.05
    assert all(r.predicted == (r.score >= 0.7) for r in rows)


def test_toxic_scores_equal_plain_ones(spark):
    """The score of every row from its words and their subwords one by one."""
    model = toxicity.Scorer.mean(pa.array(["you idiot person here now", "a fine day in the town", "idiots all of them"]), np.array([1.0, 0, 1.0]))
    texts = ["what an idiot", "fine town day", "x", "", None, "an IDIOT\tand a fine  day \n town idiots"]
    got = {r._row.i: r.score for r in toxicity.score(spark.createDataFrame(list(enumerate(texts)), "i int, text string"), model).collect()}
    for i, text in enumerate(texts):
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]
        value = [np.mean(model.adds[toxicity.subwords([w.lower()])[0]]) for w in words]
        spans = [np.mean(value[j : j + 3]) for j in range(max(1, len(value) - 2))] if value else [0.0]
        want = max(spans) + model.bias if value else min(model.bias, 0.0)
        assert abs(got[i] - 1 / (1 + np.exp(-want))) < 1e-9


def test_columns_of_any_name(spark):
    """Names with spaces, dashes and dots go through operators that carry the other columns along."""
    from gradus.llm import periods, repeats, token_files

    docs = spark.createDataFrame([(1, "one two three", 4, 5, 6), (2, None, 7, 8, 9)], "doc_id bigint, text string, `odd name` int, `a-b` int, `c.d` int")
    model = toxicity.Scorer.fit(pa.array([], pa.string()), np.zeros(0))
    grams = language.fit(docs.withColumn("lang", F.lit("en")), F.lit(True))
    for out in (bpe.encode(docs), repeats.remove_repeats(docs), toxicity.score(docs, model), language.predict(docs, grams)):
        rows = {r._row.doc_id: r._row.asDict() for r in out.collect()}
        assert rows[2] == {"doc_id": 2, "odd name": 7, "a-b": 8, "c.d": 9}
    keyed = docs.withColumnRenamed("doc_id", "doc id")
    assert sorted(r["doc id"] for r in periods.find_runs(keyed, "doc id").collect()) == [1, 2]
    folder = common.shared_folder(spark)
    token_files.write_ids(keyed, folder, key="doc id")
    assert sorted(r.key for r in token_files.read_ids(spark, folder).collect()) == [1, 2]

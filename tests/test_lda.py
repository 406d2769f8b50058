import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector

from gradus.operators import lda, sums
from gradus.plans import store, topics as plans


def _counted(spark, n, parts):
    rng = np.random.default_rng(2)
    mix = rng.dirichlet([0.1] * 3, n)
    shares = np.kron(np.eye(3), np.full((1, 4), 0.25))  # three topics of four terms each
    x = np.array([rng.multinomial(40, m @ shares) for m in mix], float)
    x[0] = 0
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id int, x array<double>").repartition(parts)
    return mix, df.select("id", array_to_vector("x").alias("counts"))


def test_every_pass_sees_every_document(spark):
    mix, one = _counted(spark, 600, 1)
    many = _counted(spark, 600, 9)[1]
    a, b = (lda.fit(df, "counts", 12, 3, 60, 42) for df in (one, many))
    np.testing.assert_allclose(a.strengths, b.strengths, rtol=1e-6)  # not by chance of where rows lie
    told = np.array([r[0] for r in lda.weights(a, one, "counts", "w").orderBy("id").select("w").collect()])
    assert not told[0].any() and np.allclose(told[1:].sum(1), 1)
    heavy = a.words().reshape(3, 3, 4).sum(2)
    assert sorted(heavy.argmax(1)) == [0, 1, 2]
    assert np.abs(told[1:] - mix[1:, heavy.argmax(1)]).mean() < 0.05
    assert lda.log_perplexity(a, one, "counts") < lda.log_perplexity(lda.fit(one, "counts", 12, 3, 1, 42), one, "counts")


def test_topics_are_stored(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"welding steel frames {w} safety") for i, w in enumerate(["crane", "wiring", "paint"])], "id int, t string")
    found = plans.run_topics(docs, keys=("id",), n_topics=2, max_iter=3, column="t")
    store.save_topics(found, str(tmp_path))
    vocab, model, _ = store.load_topics(spark, str(tmp_path))
    assert vocab == found.vocabulary
    np.testing.assert_allclose(model.strengths, found.lda_model.strengths)


def _plainly(row, words, alpha):
    """One document's strengths, step by step over all terms."""
    gamma = np.full(len(words), alpha + row.sum() / len(words))
    for _ in range(lda.INNER):
        theta = np.exp(lda.digamma(gamma) - lda.digamma(gamma.sum()))
        moved = alpha + theta * ((row / (theta @ words + lda.TINY)) @ words.T)
        if np.abs(moved - gamma).mean() <= lda.CHANGE:
            return moved
        gamma = moved
    return gamma


@pytest.mark.parametrize("side", [1, 7, 4096])
def test_documents_of_all_lengths_side_by_side(monkeypatch, side):
    monkeypatch.setattr(lda, "SIDE", side)
    rng = np.random.default_rng(5)
    shares = rng.dirichlet([0.1] * 60, 4)
    words = lda.TopicModel(shares * 500 + 0.01, 0.1, 0.01).words()
    lengths = [0, 1, 3, 9, 20, 80, 400] * 6
    x = np.array([rng.multinomial(n, rng.dirichlet([0.2] * 4) @ shares) for n in lengths], float)
    x[-1] = 1 + rng.integers(0, 3, 60)  # has every term
    found = lda._inferred(lda.Counts.of(x), words, 0.1)
    np.testing.assert_allclose(found, [_plainly(row, words, 0.1) for row in x], rtol=1e-9)
    assert lda._inferred(lda.Counts.of(x[:0]), words, 0.1).shape == (0, 4)


def test_texts_are_cut_once(spark, monkeypatch):
    cut = []
    whole = plans.topics.text.topic_tokens
    monkeypatch.setattr(plans.topics.text, "topic_tokens", lambda *a: cut.append(a) or whole(*a))
    docs = spark.createDataFrame([(i, f"welding steel frames {w} safety") for i, w in enumerate(["crane", "wiring", "paint"])], "id int, t string")
    plans.run_topics(docs, "lda", keys=("id",), n_topics=2, max_iter=2, column="t")
    assert len(cut) == 1


@pytest.mark.parametrize("tasks", [1, 5, 30])
def test_few_short_rows_are_added_without_a_shuffle(spark, tasks):
    def run(batches):
        yield sums.as_row(np.array([sum(b.num_rows for b in batches), 1.0]))

    rows = spark.range(100).repartition(tasks).mapInArrow(run, "sums binary")
    assert sums.added(rows, tasks=tasks).tolist() == [100, tasks]
    assert sums.added(rows.where("false"), tasks=tasks) is None

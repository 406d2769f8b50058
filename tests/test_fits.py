"""Sums over many tasks, side-by-side starts, stored models, medians with infinities."""

import json
import math
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from gradus.operators import kmeans, mixture, ranking, sums, topics
from gradus.sources import files


@pytest.mark.parametrize("tasks", [1, 3, 70])
def test_sums_meet_in_one_row(spark, tasks):
    def run(batches):
        total = np.zeros(3)
        for b in batches:
            x = b.column(0).to_numpy()
            total += [len(x), x.sum(), (x * x).sum()]
        yield sums.as_row(total)

    got = sums.added(spark.range(200).repartition(tasks).mapInArrow(run, "sums binary"))
    assert got.tolist() == [200, 19900, 2646700]
    assert sums.added(spark.range(0).select(F.lit(b"").alias("sums")).where("false")) is None


def test_starts_move_side_by_side(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(c, 0.2, (40, 3)) for c in (0, 3, 6)])
    points = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<double>").repartition(5)
    starts = [x[:3].copy(), x[[0, 50, 100]].copy()]
    fitted = kmeans.fit_centers(points, starts, max_iter=4, tol=0.0)
    for start, (_, got) in zip(starts, fitted):
        want = start.copy()
        for _ in range(5):
            label = ((x[:, None] - want[None]) ** 2).sum(2).argmin(1)
            want = np.stack([x[label == j].mean(0) if np.any(label == j) else want[j] for j in range(3)])
        np.testing.assert_allclose(got, want, atol=1e-9)
    labels = {r.id: r.label for r in kmeans.nearest_center(points, "vec", fitted[1][1], "label").collect()}
    assert len({labels[i] for i in range(40)}) == 1 and len(set(labels.values())) == 3


def test_mixture_sums_carry_whole_moments(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(0, 1, (90, 4))
    points = spark.createDataFrame([(v.tolist(),) for v in x], "vec array<double>").repartition(7)
    start = mixture.Mixture(np.array([0.4, 0.6]), x[:2], np.stack([np.eye(4)] * 2))
    got = mixture.next_mixture(points, start, len(x))
    joint = start.log_joint(x)
    r = np.exp(joint - np.logaddexp(joint[:, 0], joint[:, 1])[:, None])
    np.testing.assert_allclose(got.weights, r.mean(0), atol=1e-9)
    for j in range(2):
        mean = (r[:, [j]] * x).sum(0) / r[:, j].sum()
        cov = ((x - mean).T * r[:, j]) @ (x - mean) / r[:, j].sum() + 1e-6 * np.eye(4)
        np.testing.assert_allclose(got.means[j], mean, atol=1e-8)
        np.testing.assert_allclose(np.linalg.inv(got.precisions[j].T @ got.precisions[j]), cov, atol=1e-6)


def test_medians_with_infinities_and_extremes(spark):
    inf = math.inf
    data = {
        "a": [float(i) for i in range(21)] + [inf] * 5, "b": [-inf] * 3 + [1e308, -1e308, 5.0, 6.0] + [inf] * 2,
        "c": [2.0] * 9 + [inf], "d": [-inf] * 4 + [inf] * 5,
    }
    df = spark.createDataFrame([(k, v) for k, vs in data.items() for v in vs], "k string, v double")
    got = {r.k: r.m for r in ranking.group_medians(df, ["k"], "v", "m", bound=5, fan=4).collect()}
    assert got == {k: statistics.median(vs) for k, vs in data.items()}


def test_null_fields_and_line_breaks(spark, tmp_path):
    files.write_json(spark.createDataFrame([(1, None)], "a int, b string"), str(tmp_path / "j"))
    assert spark.read.text(str(tmp_path / "j")).first()[0] == '{"a":1,"b":null}'
    sheet = tmp_path / "s.csv"
    sheet.write_text('x,1\n"two\nlines",2\ny,3\n')
    got = files.read_sheet(spark, str(sheet), ["n", "v"]).orderBy("ordinal").collect()
    assert [(r.n, r.v, r.ordinal) for r in got] == [("x", "1", 1), ("two\nlines", "2", 2), ("y", "3", 3)]


def test_topics_do_not_depend_on_tasks(spark):
    x = np.random.default_rng(3).random((210, 12))
    df = spark.createDataFrame([(v.tolist(),) for v in x], "weights array<double>")
    one, many = (topics.fit_nmf(df.repartition(n), k=3, max_iter=5, tol=0.0, sweeps=5) for n in (1, 70))
    np.testing.assert_allclose(one.h, many.h, atol=1e-8)
    np.testing.assert_allclose(one.errors, many.errors, atol=1e-8)


def _odd_texts(spark):
    rng = np.random.default_rng(8)
    words = ["pipe", "beam", "weld", "torch", "Éclair", "crane", "ditch,grade", "x1", "İstanbul", "roof"]
    texts = [" ".join(rng.choice(words, size=n)) for n in rng.integers(0, 30, 60)]
    return spark.createDataFrame(list(enumerate([*texts, "", "weld weld weld", "12 34", "pipe"])), "doc_id long, text string")


@pytest.mark.parametrize("frequent", [topics.FREQUENT, 3])
@pytest.mark.parametrize("size", [1, 4, 25, 300])
def test_common_terms_are_the_most_counted(spark, size, frequent):
    docs = _odd_texts(spark)
    counted = sorted((-r.n, r.term) for r in topics.term_counts(docs, "text").collect())
    assert topics.common_terms(topics.token_lists(docs, "text"), size, frequent) == sorted(t for _, t in counted[:size])


def test_weights_of_lists_are_those_of_vectors(spark):
    docs = _odd_texts(spark).repartition(3)
    vocab = topics.vocabulary(docs, "text", 20)
    counted = topics.count_vectors(docs, "text", vocab)
    fitted = topics.TermWeights.fit(counted)
    listed = topics.token_lists(docs, "text", ("doc_id",))
    np.testing.assert_allclose(topics.TermWeights.of_lists(listed, vocab).idf, fitted.idf, atol=1e-12)
    factors = topics.Factors(np.random.default_rng(9).random((3, 20)), 0.0, 0.0, 0.0, [])
    want = {r[0]: r[1] for r in topics.nmf_weights(factors, fitted.apply(counted), ["doc_id"]).collect()}
    got = {r[0]: r[1] for r in topics.nmf_weights_of_lists(factors, listed, ["doc_id"], vocab, fitted).collect()}
    assert got.keys() == want.keys() and len(got) == 64
    for k in want:
        np.testing.assert_allclose(got[k], want[k], atol=1e-9)


def test_given_topics_cut_texts_once(spark, tmp_path, monkeypatch):
    from catalog import texts as catalog_texts

    _odd_texts(spark).write.parquet(str(tmp_path / "documents.parquet"))
    cuts, cut = [], topics.text.topic_tokens
    monkeypatch.setattr(topics.text, "topic_tokens", lambda c: cuts.append(1) or cut(c))
    assert catalog_texts.nmf_given_topics(spark, str(tmp_path)).count() == 64 * topics.N_TOPICS and len(cuts) == 1


def test_code_map_is_read_in_parts(spark, tmp_path):
    names = [f"n{i} {x}" for i, x in enumerate(['plain', 'a]b', '"quoted"', 'back\\', '], "x": [', 'é😀]', '{}', '[,', '\\"]']) for _ in range(1)]
    told = {f"{n}-{i}": [f"c{i}", "x]y", '"'][: i % 4] for i in range(40) for n in names} | {"no codes": None, "": ["e"]}
    for form, text in enumerate((json.dumps(told), json.dumps(told, indent=2), json.dumps(told, ensure_ascii=False, separators=(",", ":")))):
        path = tmp_path / f"m{form}.json"
        path.write_text(text, encoding="utf-8")
        want = {k: v for k, v in json.loads(text).items() if v is not None}
        with_parts = files.read_code_map(spark, str(path))
        assert {r.employer_name: r.soc_codes for r in with_parts.collect()} == want
        before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
        spark.conf.set("spark.sql.files.maxPartitionBytes", 700)
        spark.conf.set("spark.sql.files.openCostInBytes", 0)
        try:
            assert files.map_parts(spark, str(path)).rdd.getNumPartitions() > 5
            assert {r.employer_name: r.soc_codes for r in files.read_code_map(spark, str(path)).collect()} == want
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
            spark.conf.set("spark.sql.files.openCostInBytes", before[1])
    (tmp_path / "twice.json").write_text('{"a": ["1"], "b": [], "a": ["2"]}')
    assert sorted((r[0], r[1]) for r in files.read_code_map(spark, str(tmp_path / "twice.json")).collect()) == [("a", ["2"]), ("b", [])]
    (tmp_path / "none.json").write_text(" { } \n")
    assert files.read_code_map(spark, str(tmp_path / "none.json")).count() == 0

"""Writing a finished run and reading it back for answering requests."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from gradus.operators import choose
from gradus.operators.lda import TopicModel
from gradus.operators.mixture import Mixture
from gradus.operators.topics import Factors
from gradus.plans.clustering import Clustering, cluster_overview, clustering_meta, tier_map
from gradus.plans.topics import Topics
from gradus.sources import files

VECTORS = ["embedding", "feature_vector", "membership"]


def _models(spark: SparkSession, result: Clustering) -> dict[str, DataFrame]:
    """Numbers of the fitted models as tables of one row per center or component."""
    centers = enumerate(result.details["kmeans"]["centers"])
    fitted = result.details["gmm"]["model"]
    components = [
        (j, float(fitted.weights[j]), fitted.means[j].tolist(), fitted.precisions[j].tolist()) for j in range(fitted.k)
    ]
    return {
        "kmeans_centers": spark.createDataFrame(list(centers), "cluster INT, center ARRAY<DOUBLE>"),
        "mixture": spark.createDataFrame(
            components, "component INT, weight DOUBLE, mean ARRAY<DOUBLE>, precision ARRAY<ARRAY<DOUBLE>>"
        ),
    }


def load_models(spark: SparkSession, folder: str) -> tuple[np.ndarray, Mixture]:
    """The k-means centers by label and the mixture of a stored run."""
    centers = files.read_table(spark, f"{folder}/kmeans_centers").orderBy("cluster").collect()
    rows = files.read_table(spark, f"{folder}/mixture").orderBy("component").collect()
    parts = (np.array([r[c] for r in rows]) for c in ("weight", "mean", "precision"))
    return np.array([r["center"] for r in centers]), Mixture(*parts)


def save_topics(result: Topics, folder: str) -> None:
    """Vocabulary, terms and both fitted models of a topic run."""
    spark = SparkSession.active()
    files.write_table(spark.createDataFrame(list(enumerate(result.vocabulary)), "place INT, term STRING"), f"{folder}/vocabulary")
    if result.lda_model is not None:
        m = result.lda_model
        rows = [(t, row.tolist(), float(m.alpha), float(m.eta)) for t, row in enumerate(m.strengths)]
        schema = "topic_id INT, strengths ARRAY<DOUBLE>, alpha DOUBLE, eta DOUBLE"
        files.write_table(spark.createDataFrame(rows, schema), f"{folder}/lda")
    if result.nmf_factors is not None:
        f = result.nmf_factors
        rows = [(t, row.tolist(), float(f.l1_w), float(f.l2_w), float(f.error)) for t, row in enumerate(f.h)]
        schema = "topic_id INT, terms ARRAY<DOUBLE>, l1 DOUBLE, l2 DOUBLE, error DOUBLE"
        files.write_table(spark.createDataFrame(rows, schema), f"{folder}/nmf")


def load_topics(spark: SparkSession, folder: str) -> tuple[list[str], TopicModel, Factors]:
    vocab = [r["term"] for r in files.read_table(spark, f"{folder}/vocabulary").orderBy("place").collect()]
    rows = files.read_table(spark, f"{folder}/nmf").orderBy("topic_id").collect()
    factors = Factors(np.array([r["terms"] for r in rows]), rows[0]["l1"], rows[0]["l2"], rows[0]["error"], [rows[0]["error"]])
    told = files.read_table(spark, f"{folder}/lda").orderBy("topic_id").collect()
    model = TopicModel(np.array([r["strengths"] for r in told]), told[0]["alpha"], told[0]["eta"])
    return vocab, model, factors


def save_run(result: Clustering, folder: str, encoder_name: str, width: int) -> None:
    """All tables of a clustering run under one folder."""
    files.write_table(result.occupations, f"{folder}/occupations_embedded")
    files.write_csv(result.occupations.drop(*VECTORS), f"{folder}/occupations_clustered")
    files.write_table(result.scores, f"{folder}/scores")
    files.write_table(result.merges, f"{folder}/merges")
    files.write_table(result.neighbours, f"{folder}/neighbours")
    files.write_json(clustering_meta(result, encoder_name, width), f"{folder}/clustering_meta")
    files.write_json(tier_map(result.occupations), f"{folder}/wealth_tier_map")
    files.write_json(cluster_overview(result.occupations), f"{folder}/cluster_overview")
    for name, table in _models(result.occupations.sparkSession, result).items():
        files.write_table(table, f"{folder}/{name}")


def load_run(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, dict[str, str]]:
    """Occupations, scores and the clustering method per mode."""
    scores = files.read_table(spark, f"{folder}/scores")
    return files.read_table(spark, f"{folder}/occupations_embedded"), scores, choose.method_map(scores)

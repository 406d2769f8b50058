"""Embedding, features, four clusterings, their scores and summaries."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradus import fixed
from gradus.functions import numeric
from gradus.operators import choose, density, features, latent, kmeans, mixture, ranking, similarity, ward
from gradus.functions.vectors import entropy
from gradus.schemas import require_columns
from gradus.session import cut_lineage

REQUIRED = ["skill_description", "median_wage_me", "soc_code", "occ_title"]


@dataclass
class Clustering:
    """Result of one run: the enriched occupations and small tables about them."""

    occupations: DataFrame  # with tier, labels, membership, boundary and vectors
    scores: DataFrame  # method, silhouette, n_clusters
    hints: DataFrame  # use, method
    merges: DataFrame  # Ward merge table
    neighbours: DataFrame  # cosine neighbours on the feature vectors
    details: dict


def enrich(occupations: DataFrame, width: int, blend: float = fixed.WAGE_BLEND, encoder=None) -> DataFrame:
    """Add ``ordinal``, ``embedding`` and ``feature_vector``."""
    require_columns(occupations, REQUIRED)
    df = occupations
    if "ordinal" not in df.columns:
        df = ranking.global_index(df, [F.col("soc_code")], "ordinal").withColumn("ordinal", F.col("ordinal").cast("bigint"))
    if "embedding" not in df.columns:
        encoder = encoder or latent.LatentText.fit(df, "skill_description", width)
        df = encoder.encode(df, "skill_description", "embedding")
    return features.blend_with_pay(df, "embedding", "median_wage_me", "feature_vector", width, blend)


def cluster(
    occupations: DataFrame, width: int, blend: float = fixed.WAGE_BLEND, neighbours: int = 6, encoder=None,
    ks: tuple[int, ...] = kmeans.KS, **limits,
) -> Clustering:
    """Run all four methods on the same features and put the labels side by side."""
    ready = cut_lineage(enrich(occupations, width, blend, encoder))
    args = (ready, "ordinal", "feature_vector", "median_wage_me", width)
    runs = {
        "kmeans": kmeans.kmeans_sweep(*args, ks=ks, **limits),
        "gmm": mixture.mixture_sweep(*args, ks=ks, **limits),
        "agglomerative": ward.ward_sweep(*args, ks=ks, **limits),
        "hdbscan": density.density_clusters(*args, **limits),
    }
    spark = ready.sparkSession
    scores = choose.score_table(
        spark,
        {m: info["silhouette"] for m, (_, info) in runs.items()},
        {m: info["n_clusters"] for m, (_, info) in runs.items()},
    )
    labelled = ready.withColumn("wealth_tier", numeric.tier(F.col("median_wage_me")))
    for labels, _ in runs.values():
        labelled = labelled.join(labels, "ordinal", "left")
    labelled = cut_lineage(labelled.withColumn("boundary", entropy(F.col("membership"))))
    return Clustering(
        labelled, scores, choose.hints(scores), runs["agglomerative"][1]["merges"],
        similarity.knn_graph(ready, "ordinal", "feature_vector", width, neighbours, **limits),
        {m: info for m, (_, info) in runs.items()},
    )


# -- Summaries ---------------------------------------------------------------


def by_method(occupations: DataFrame) -> DataFrame:
    """One row per occupation and method with its label there."""
    present = [(m, c) for m, c in fixed.METHOD_COLUMNS.items() if c in occupations.columns]
    pairs = F.array(*[F.struct(F.lit(m).alias("method"), F.col(c).cast("int").alias("cluster_id")) for m, c in present])
    keep = [c for c in occupations.columns if c not in fixed.METHOD_COLUMNS.values()]
    return occupations.select(*keep, F.inline(pairs))


def cluster_overview(occupations: DataFrame, **median_args) -> DataFrame:
    """Size and median wage of every group of every method; noise has no median."""
    long = by_method(occupations.select("median_wage_me", *fixed.METHOD_COLUMNS.values()))
    keys = ["method", "cluster_id"]
    sizes = long.groupBy(*keys).agg(F.count("*").alias("n_occupations"))
    medians = ranking.group_medians(long.where("cluster_id <> -1"), keys, "median_wage_me", "median_wage", **median_args)
    return sizes.join(medians.drop("n_values"), keys, "left").select(
        *keys, (F.col("cluster_id") == -1).alias("is_noise"), "n_occupations", F.bround("median_wage", 0).alias("median_wage")
    )


def member_record() -> Column:
    return F.struct("soc_code", "occ_title", "wealth_tier", "median_wage_me")


def cluster_members(occupations: DataFrame, item: Column | None = None, page_size: int = 1_000) -> DataFrame:
    """Members of every group in order, as pages of at most ``page_size``."""
    return ranking.pages(
        by_method(occupations), ["method", "cluster_id"], "ordinal",
        member_record() if item is None else item, "occupations", page_size,
    )


def tier_map(occupations: DataFrame) -> DataFrame:
    """Code to tier, wage and labels as one key-value row per code."""
    labels = [c for c in fixed.METHOD_COLUMNS.values() if c in occupations.columns]
    return occupations.select("soc_code", F.struct("occ_title", "wealth_tier", "median_wage_me", *labels).alias("entry"))


def clustering_meta(result: Clustering, encoder_name: str, width: int, blend: float = fixed.WAGE_BLEND) -> DataFrame:
    """One nested row about the run, for the JSON sink."""
    n = result.occupations.agg(F.count("*").alias("n_occupations"))
    info = F.struct("silhouette", "n_clusters")
    methods = result.scores.agg(F.map_from_entries(F.collect_list(F.struct("method", info))).alias("methods"))
    hint = result.hints.agg(F.map_from_entries(F.collect_list(F.struct("use", "method"))).alias("best_method_hints"))
    order = choose.ranked_methods(result.scores).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("place", "method"))), lambda s: s["method"]).alias("silhouette_ranking")
    )
    one = F.lit(1).alias("_one")
    tables = [t.select("*", one) for t in (n, methods, hint, order)]
    joined = tables[0]
    for t in tables[1:]:
        joined = joined.join(t, "_one")
    return joined.drop("_one").withColumns(
        {"embedding_model": F.lit(encoder_name), "embedding_dim": F.lit(width), "wage_blend_weight": F.lit(blend)}
    )


def status(occupations: DataFrame, scores: DataFrame, hint_table: DataFrame) -> DataFrame:
    """One row per method with the number of occupations and the overall choice."""
    n = occupations.count()
    overall = hint_table.where("use = 'overall'").first()["method"]
    return scores.select("method", "silhouette", "n_clusters", F.lit(n).alias("occupations"), F.lit(overall).alias("best_overall"))

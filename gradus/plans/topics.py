"""Topic profile of every occupation."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradus import fixed
from gradus.operators import lda, topics
from gradus.session import cut_lineage


@dataclass
class Topics:
    profiles: DataFrame | None  # soc_code, occ_title, lda_topics, nmf_topics; only when both ran
    lda_terms: DataFrame | None
    nmf_terms: DataFrame | None
    vocabulary: list[str]
    lda_perplexity: float | None
    nmf_error: float | None
    lda_model: lda.TopicModel | None = None
    nmf_factors: topics.Factors | None = None


def run_topics(
    occupations: DataFrame, method: str = "both", labels: dict[int, str] = fixed.TOPIC_LABELS,
    keys: tuple[str, ...] = ("soc_code", "occ_title"), n_topics: int = topics.N_TOPICS, max_iter: int = 100,
    column: str = "skill_description",
) -> Topics:
    """Fit LDA, NMF or both on the description texts."""
    if method not in ("lda", "nmf", "both"):
        raise ValueError(f"method is lda, nmf or both, not {method!r}")
    spark = occupations.sparkSession
    listed = topics.token_lists(occupations, column, keys)
    vocab = topics.common_terms(listed)
    counted = cut_lineage(topics.count_lists(listed, vocab))
    out = Topics(None, None, None, vocab, None, None)
    profiled = counted
    if method in ("lda", "both"):
        model = topics.fit_lda(counted, len(vocab), k=n_topics, max_iter=max_iter)
        out.lda_model, out.lda_terms = model, topics.lda_terms(model, vocab)
        out.lda_perplexity = lda.log_perplexity(model, counted, "counts")
        profiled = topics.lda_weights(model, profiled)
    if method in ("nmf", "both"):
        weighter = topics.TermWeights.fit(counted)
        factors = topics.fit_nmf(cut_lineage(weighter.apply(counted).select("weights")), k=n_topics)
        out.nmf_factors, out.nmf_terms = factors, topics.top_terms(spark, factors.h, vocab)
        out.nmf_error = factors.error
        carried = [*keys, *(["lda_weights"] if method == "both" else [])]
        profiled = topics.nmf_weights(factors, weighter.apply(profiled), carried)
    if method == "both":
        out.profiles = profiled.select(
            *keys, topics.top_topics("lda_weights", labels).alias("lda_topics"),
            topics.top_topics("nmf_weights", labels).alias("nmf_topics"), "lda_weights", "nmf_weights",
        )
    return out


def topic_meta(result: Topics, method: str, labels: dict[int, str] = fixed.TOPIC_LABELS) -> DataFrame:
    """One row per model and topic: its label and heaviest terms in order."""
    parts = [(m, t) for m, t in (("lda", result.lda_terms), ("nmf", result.nmf_terms)) if t is not None]
    names = F.create_map(*[x for i, l in labels.items() for x in (F.lit(i), F.lit(l))])
    out = None
    for model, terms in parts:
        listed = terms.groupBy("topic_id").agg(
            F.transform(F.sort_array(F.collect_list(F.struct("rank", "term"))), lambda s: s["term"]).alias("top_words")
        )
        listed = listed.select(F.lit(model).alias("model"), "topic_id", F.try_element_at(names, "topic_id").alias("label"), "top_words")
        out = listed if out is None else out.unionByName(listed)
    return out.withColumn("method", F.lit(method))

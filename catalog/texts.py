"""Vocabulary and topic queries over whole documents."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from catalog.tables import table
from gradus import fixed
from gradus.functions import vectors
from gradus.operators import topics
from gradus.plans import topics as plans


def term_counts(spark, sf):
    return topics.term_counts(table(spark, sf, "documents"), "text")


def vocabulary(spark, sf):
    listed = topics.vocabulary(table(spark, sf, "documents"), "text")
    return spark.createDataFrame(list(enumerate(listed)), "place BIGINT, term STRING")


def tfidf_smooth_l2(spark, sf):
    docs = table(spark, sf, "documents")
    vocab = topics.vocabulary(docs, "text")
    counted = topics.count_vectors(docs.select("doc_id", "text"), "text", vocab)
    weighted = topics.TermWeights.fit(counted).apply(counted)
    return topics.long_weights(weighted, "doc_id", vocab).withColumn("weight", F.round("weight", 6))


def _run(spark, sf, method: str, **args):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return plans.run_topics(docs, method, keys=("doc_id",), column="text", **args)


def lda_topics(spark, sf):
    return _run(spark, sf, "lda").lda_terms


def nmf_topics(spark, sf):
    return _run(spark, sf, "nmf").nmf_terms


def document_topics(spark, sf):
    """Both topic profiles of every document."""
    out = _run(spark, sf, "both").profiles
    label = lambda c: F.array_join(F.transform(c, lambda s: s["label"]), ";")
    return out.select("doc_id", label("lda_topics").alias("lda"), label("nmf_topics").alias("nmf"))


def topic_profile(spark, sf):
    """Three heaviest components of every vector, its squares read as topic weights."""
    e = table(spark, sf, "embeddings")
    squares = F.transform(F.col("embedding").cast("array<double>"), lambda x: x * x)
    return e.select("vec_id", F.explode(topics.top_topics(squares)).alias("t")).select(
        "vec_id", "t.topic_id", "t.label", F.round("t.weight", 3).alias("weight")
    )


def nmf_given_topics(spark, sf):
    """Weights of every document for eight given topics: the vocabulary's terms in turn, each with weight one."""
    listed = topics.token_lists(table(spark, sf, "documents"), "text", ("doc_id",))
    vocab = topics.common_terms(listed)
    weights = topics.TermWeights.of_lists(listed, vocab)
    h = np.zeros((topics.N_TOPICS, len(vocab)))
    h[np.arange(len(vocab)) % topics.N_TOPICS, np.arange(len(vocab))] = 1.0
    found = topics.nmf_weights_of_lists(topics.Factors(h, 0.0, 0.0, 0.0, []), listed, ["doc_id"], vocab, weights)
    return found.select("doc_id", F.posexplode("nmf_weights").alias("topic_id", "weight")).withColumn("weight", F.round("weight", 5))


def vector_shares(spark, sf):
    """Squares of every vector over their sum."""
    squares = F.transform(F.col("embedding").cast("array<double>"), lambda x: x * x)
    e = table(spark, sf, "embeddings").select("vec_id", F.posexplode(vectors.shares(squares)).alias("place", "share"))
    return e.withColumn("share", F.round("share", 6))


QUERIES = {
    f.__name__: f
    for f in (
        term_counts, vocabulary, tfidf_smooth_l2, lda_topics, nmf_topics, document_topics, topic_profile, nmf_given_topics,
        vector_shares,
    )
}

_STOP = ", ".join(f"'{w}'" for w in fixed.TOPIC_STOPWORDS)
_SPACES = r"[\s\x0B\x1C-\x1F\x85\p{Z}]+"
_TERMS = f"""
raw as (select doc_id, regexp_split_to_array(replace(replace(text, 'Tasks:', ''), 'Skills:', ''), '{_SPACES}') w from documents),
kept as (select doc_id, list_filter(w, lambda t: length(t) > 3 and lower(t) not in ({_STOP})
                                    and regexp_full_match(replace(t, ',', ''), '\\p{{L}}+')) w from raw),
tok as (select doc_id, list_filter(flatten(list_transform(w, lambda t: string_split(lower(t), ','))),
                                   lambda t: length(t) > 1 and t not in ({_STOP})) w from kept),
pos as (select doc_id, unnest(w) t, generate_subscripts(w, 1) i from tok),
terms as (select doc_id, t from pos
          union all select a.doc_id, a.t || ' ' || b.t from pos a join pos b on b.doc_id = a.doc_id and b.i = a.i + 1)
"""
_VOCAB = f"""{_TERMS}, vocab as (select t, count(*) n from terms group by 1 order by n desc, t limit 300)"""

SQL = {
    "nmf_given_topics": f"""with {_VOCAB},
        named as (select t, row_number() over (order by t) - 1 i from vocab),
        tf as (select doc_id, t, count(*) tf from terms where t in (select t from vocab) group by 1, 2),
        df as (select t, count(*) df from tf group by 1),
        w as (select doc_id, t, (1 + ln(tf)) * (ln((1 + (select count(*) from documents)) / (1 + df)::double) + 1) w from tf join df using (t)),
        u as (select doc_id, t, w / sqrt(sum(w * w) over (partition by doc_id)) w from w),
        h as (select i % 8 k, count(*) n from named group by 1),
        g as (select doc_id, i % 8 k, sum(w) / any_value(n) v from u join named using (t) join h on h.k = i % 8 group by doc_id, i % 8)
        select doc_id, k::int topic_id, coalesce(round(v / sum(v) over (partition by doc_id), 5), 0) weight
        from (select doc_id, k from documents, h) left join g using (doc_id, k)""",
    "vector_shares": """
        with x as (select vec_id, unnest(embedding::double[]) x, generate_subscripts(embedding, 1) - 1 i from embeddings)
        select vec_id, i::int place, round(x * x / sum(x * x) over (partition by vec_id), 6) share from x""",
    "term_counts": f"with {_TERMS} select t term, count(*) n from terms group by 1",
    "vocabulary": f"with {_VOCAB} select row_number() over (order by t) - 1 place, t term from vocab",
    "tfidf_smooth_l2": f"""with {_VOCAB},
        tf as (select doc_id, t, count(*) tf from terms where t in (select t from vocab) group by 1, 2),
        n as (select count(*) n from documents),
        df as (select t, count(*) df from tf group by 1),
        w as (select doc_id, t, (1 + ln(tf)) * (ln((1 + n) / (1 + df)::double) + 1) w from tf join df using (t), n)
        select doc_id, t term, round(w / sqrt(sum(w * w) over (partition by doc_id)), 6) weight from w""",
    "topic_profile": """
        with s as (select vec_id, unnest(embedding::double[]) x, generate_subscripts(embedding, 1) - 1 i from embeddings),
        r as (select *, row_number() over (partition by vec_id order by x * x desc, i desc) k from s),
        l as (select * from (values (0, 'Heavy Equipment Operation'), (1, 'Blueprint Reading & Planning'),
              (2, 'Structural Installation'), (3, 'Electrical & Mechanical Systems'),
              (4, 'Project Management & Coordination'), (5, 'Safety & Compliance'), (6, 'Civil & Site Work'),
              (7, 'Supervision & Leadership')) v(id, label))
        select vec_id, i::int topic_id, coalesce(label, 'Topic ' || i) label, round_even(x * x, 3) weight
        from r left join l on l.id = i where k <= 3""",
}

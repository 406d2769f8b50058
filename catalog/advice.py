"""Recommendation queries: every occupation is a source and a candidate."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalog.tables import VECTOR_WIDTH, described, described_with_pay, entities, table, with_groupings
from gradus.functions import numeric, text, vectors
from gradus.operators import features, latent, similarity
from gradus.plans import recommend as plans
from gradus.session import cut_lineage

METHOD_OF = {"progress": "kmeans", "pivot": "gmm", "field_change": "agglomerative", "skill_match": "hdbscan"}

GIVEN_TERMS = 40


def _occupations(df: DataFrame) -> DataFrame:
    """Entities under the names the recommendation plan uses; the squares of a unit vector
    stand in for membership probabilities."""
    named = with_groupings(df).select(
        F.col("id").alias("ordinal"), F.col("id").cast("string").alias("soc_code"),
        F.col("title").alias("occ_title"), F.col("wage").alias("median_wage_me"),
        numeric.tier(F.col("wage")).alias("wealth_tier"), F.col("vec").alias("embedding"),
        vectors.entropy(F.transform("vec", lambda x: x * x)).alias("boundary"),
        "cluster_kmeans", "cluster_gmm", "cluster_agglom", "cluster_hdbscan",
        *(["text"] if "text" in df.columns else []),
    )
    return named.withColumnRenamed("text", "skill_description")


def _ranked(spark, sf, mode: str) -> DataFrame:
    occ = _occupations(entities(spark, sf))
    requests = occ.select("soc_code", F.lit(mode).alias("mode"))
    modes = {m: METHOD_OF[m] for m in ("progress", "pivot", "field_change")}
    ranked = plans.rank_codes(requests, occ, modes, 3, VECTOR_WIDTH)
    return ranked.select(
        F.col("soc_code").cast("bigint").alias("src"), F.col("ordinal").alias("tgt"), "rank",
        F.round("score", 6).alias("score"), F.round("similarity", 6).alias("similarity"),
    )


def recommend_progress(spark, sf):
    return _ranked(spark, sf, "progress")


def recommend_pivot(spark, sf):
    return _ranked(spark, sf, "pivot")


def recommend_field_change(spark, sf):
    return _ranked(spark, sf, "field_change")


def membership_entropy(spark, sf):
    e = table(spark, sf, "embeddings")
    squares = F.transform(F.col("embedding").cast("array<double>"), lambda x: x * x)
    return e.select("vec_id", F.round(vectors.entropy(squares), 6).alias("boundary"))


def cosine_to_neighbour(spark, sf):
    """Similarity of every vector to the next one by id."""
    e = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    after = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("v").alias("w"))
    return e.join(after, "vec_id").select("vec_id", F.round(vectors.cosine(F.col("v"), F.col("w")), 6).alias("similarity"))


def knn_graph(spark, sf):
    graph = similarity.knn_graph(entities(spark, sf), "id", "vec", VECTOR_WIDTH, 6)
    return graph.select("id", "neighbour", "rank", F.round("similarity", 6).alias("similarity"))


def wage_blend_features(spark, sf):
    blended = features.blend_with_pay(entities(spark, sf), "vec", "wage", "feature", VECTOR_WIDTH)
    return blended.select(
        "id", F.round(vectors.norm(F.col("feature")), 6).alias("norm"),
        F.round(vectors.total(F.col("feature")), 6).alias("total"),
        F.array_join(F.transform("feature", lambda x: F.format_string("%.4f", x + 0.0)), " ").alias("feature"),
    )


def closest_topk(spark, sf):
    """Three closest occupations of every vector seen as a request."""
    occ = _occupations(entities(spark, sf))
    requests = table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("query_id"), F.reverse(F.col("embedding").cast("array<double>")).alias("vec"),
        F.lit(3).alias("top_k"),
    )
    found = plans.find_closest(requests, occ, VECTOR_WIDTH)
    return found.select(
        "query_id", "soc_code", "rank", "wealth_tier", F.round("median_wage_me", 4).alias("median_wage_me"),
        F.round("similarity_pct", 1).alias("similarity_pct"),
    )


def skill_gap_words(spark, sf):
    """Missing skill words from every document to the next one, over whole texts."""
    d = table(spark, sf, "documents")
    source = d.select("doc_id", text.words(F.col("text")).alias("s"))
    target = d.select((F.col("doc_id") - 1).alias("doc_id"), text.skill_words(F.col("text")).alias("t"))
    gap = text.skill_gap(F.col("s"), F.col("t"))
    return source.join(target, "doc_id").select("doc_id", F.array_join(gap, ",").alias("skills_to_acquire"))


def _requests(spark, sf) -> DataFrame:
    """One request per order by a worker of the occupation with that number, if there is one."""
    key = F.col("o_orderkey")
    mode = F.when(key % 4 == 0, "progress").when(key % 4 == 1, "pivot").when(key % 4 == 2, "field_change").otherwise("other")
    return table(spark, sf, "orders").select(
        key.alias("query_id"), F.col("o_custkey").cast("string").alias("soc_code"), mode.alias("mode"),
        (key % 7).cast("int").alias("top_n"),
        F.when(key % 3 > 0, F.col("o_totalprice")).alias("user_current_wage"),
    )


def request_validation(spark, sf):
    return plans.check_requests(_requests(spark, sf), "recommend").select("query_id", "error")


def request_defaults(spark, sf):
    """Requests with a missing mode or number of results get the usual ones before they are checked."""
    key = F.col("query_id")
    asked = _requests(spark, sf).withColumns(
        {"mode": F.when(key % 5 > 0, F.col("mode")), "top_n": F.when(key % 3 > 0, F.col("top_n"))}
    )
    return plans.check_requests(asked, "recommend").select("query_id", "mode", "top_n", "error")


def text_request_validation(spark, sf):
    turns = table(spark, sf, "conversations")
    place = F.col("conv_id") * 1000 + F.col("turn")
    requests = turns.select(
        place.alias("query_id"), F.col("text").alias("skills_text"), ((F.col("turn") % 4) + 2).cast("int").alias("top_n"),
        F.when(F.col("role") == "user", F.length("text") * 100.0).alias("user_current_wage"),
        F.when(F.col("turn") % 2 == 0, F.length("text") * 200.0).alias("target_min_wage"),
    )
    return plans.check_requests(requests, "from_text").select("query_id", "error")


def _support(spark, sf, of: DataFrame | None = None) -> DataFrame:
    """Line items as programs and orders as employers of the occupation they belong to; of the occupations ``of`` only."""
    mine = lambda df, key: df if of is None else df.join(of.select(F.col("ordinal").alias(key)), key, "left_semi")
    lines = mine(table(spark, sf, "lineitem").select("l_orderkey", "l_suppkey", "l_shipdate"), "l_orderkey").groupBy("l_orderkey", "l_suppkey").agg(F.min("l_shipdate").alias("d"))
    training = lines.select(
        F.col("l_orderkey").cast("string").alias("soc_code"), F.col("l_suppkey").alias("ordinal"),
        F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("program_name"),
    )
    orders = mine(table(spark, sf, "orders").select("o_custkey", "o_orderkey"), "o_custkey")
    employers = orders.select(
        F.col("o_custkey").cast("string").alias("soc_code"), F.col("o_orderkey").alias("ordinal"),
        F.concat(F.lit("O"), F.col("o_orderkey").cast("string")).alias("employer_name"),
        F.lit("job_board").alias("url_type"),
    )
    return plans.support_pages(training, employers)


def pathway_assembly(spark, sf):
    """Full answers to every valid request, with programs, employers, gaps and returns."""
    occ = _occupations(described(spark, sf))
    requests, _ = plans.split_requests(_requests(spark, sf), "recommend")
    modes = {m: METHOD_OF[m] for m in ("progress", "pivot", "field_change")}
    out = plans.recommend(requests, occ, modes, VECTOR_WIDTH, _support(spark, sf))
    names = lambda column, field: F.array_join(F.transform(column, lambda s: s[field]), ",")
    return out.select(
        "query_id", "soc_code", "mode", "status", "rank", "target_soc", "target_wealth_tier", "wage_source",
        "current_cluster_id", "cluster_method_used", "skill_gap_pct", "skill_similarity_pct",
        F.array_join("skills_to_acquire", ",").alias("skills"),
        F.col("roi.annual_salary_uplift").alias("annual_uplift"), F.col("roi.monthly_uplift").alias("monthly_uplift"),
        F.col("roi.breakeven_months").alias("breakeven_months"), F.col("roi.five_year_net_gain").alias("five_year_net_gain"),
        names("training_programs", "program_name").alias("programs"), names("employers", "employer_name").alias("employers"),
    )


def recommend_from_text(spark, sf):
    """Conversation turns as skill texts, encoded along the leading directions of all descriptions."""
    width = 64
    docs = cut_lineage(described_with_pay(spark, sf))
    encoder = latent.LatentText.fit(docs, "text", width)
    named = _occupations(docs).drop("embedding")
    occ = cut_lineage(encoder.encode(named, "skill_description", "embedding").drop("skill_description"))
    turns = table(spark, sf, "conversations")
    requests = turns.select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), F.col("text").alias("skills_text"),
        F.lit(3).alias("top_n"), F.when(F.col("turn") % 2 == 0, 50_000.0).alias("user_current_wage"),
        F.when(F.col("turn") % 3 == 0, 65_000.0).alias("target_min_wage"),
    )
    valid, _ = plans.split_requests(requests, "from_text")
    vectors_of = encoder.encode(valid, "skills_text", "vec")
    out = plans.recommend_from_text(vectors_of, occ, METHOD_OF, width, texts=named.select("ordinal", "skill_description"))
    return out.select(
        "query_id", "status", "rank", "target_soc", "target_wealth_tier", "skill_similarity_pct",
        F.col("closest_soc_match.soc_code").alias("closest"), "wage_source",
        F.array_join("skills_to_acquire", ",").alias("skills"), F.col("roi.breakeven_months").alias("breakeven_months"),
    )


def _given_projection(docs: DataFrame, column: str) -> latent.LatentText:
    """The words of most texts, turned to eight numbers by a rule in place of a fit."""
    terms, idf = latent.LatentText.weighing(docs, column, GIVEN_TERMS)
    place = np.arange(1, len(terms) + 1)[:, None] * np.arange(1, 9)[None, :]
    return latent.LatentText(terms, list(idf), np.cos(place))


def text_vectors(spark, sf):
    """Unit vectors of all texts along given directions of their most widespread words."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    encoded = _given_projection(docs, "text").encode(docs, "text", "vec")
    return encoded.select("doc_id", F.posexplode("vec").alias("place", "value")).withColumn("value", F.round("value", 6) + 0.0)


def closest_texts(spark, sf):
    """Three occupations closest to every page, over all described occupations with pay, by vectors of the texts."""
    docs = described_with_pay(spark, sf)
    encoder = _given_projection(docs, "text")
    occ = cut_lineage(encoder.encode(_occupations(docs).drop("embedding"), "skill_description", "embedding"))
    pages = table(spark, sf, "pages").select(F.col("page_id").alias("query_id"), F.col("html").alias("asked"), F.lit(3).alias("top_k"))
    found = plans.find_closest(encoder.encode(pages, "asked", "vec").drop("asked"), occ, 8)
    return found.select(
        "query_id", "soc_code", "rank", F.round("median_wage_me", 4).alias("median_wage_me"), F.round("similarity_pct", 1).alias("similarity_pct")
    )


def recommend_from_vectors(spark, sf):
    """The free-text plan on given vectors: every description asks, with reversed vectors."""
    docs = described(spark, sf)
    requests = docs.select(
        F.col("id").alias("query_id"), F.col("text").alias("skills_text"), F.lit(3).alias("top_n"),
        F.when(F.col("label") < 5, F.col("wage") + 20_000).alias("user_current_wage"),
        F.when(F.col("label") >= 7, 100_000.0).alias("target_min_wage"), F.reverse("vec").alias("vec"),
    )
    valid, _ = plans.split_requests(requests, "from_text")
    out = plans.recommend_from_text(valid, _occupations(docs), METHOD_OF, VECTOR_WIDTH)
    return out.select(
        "query_id", "status", "rank", "target_soc", "skill_gap_pct", "wage_source", "cluster_method_used",
        F.col("closest_soc_match.soc_code").alias("closest"), F.length("skills_text_preview").alias("preview_length"),
        F.array_join("skills_to_acquire", ",").alias("skills"), F.col("roi.breakeven_months").alias("breakeven_months"),
    )


def _detail(described_occupations: DataFrame) -> DataFrame:
    return _occupations(described_occupations).select(
        "soc_code", "occ_title", F.round("median_wage_me", 4).alias("median_wage_me"), "wealth_tier",
        "cluster_kmeans", "cluster_gmm", "cluster_agglom", "cluster_hdbscan",
        text.preview(F.col("skill_description"), 500, "...").alias("skill_description_preview"),
    )


def entity_detail(spark, sf):
    """Detail page of every described occupation that has a vector, with a preview of its text."""
    return _detail(described(spark, sf))


def entity_detail_with_pay(spark, sf):
    """Detail page of every described occupation that has a wage, with groupings from the key."""
    return _detail(described_with_pay(spark, sf))


QUERIES = {
    f.__name__: f
    for f in (
        recommend_progress, recommend_pivot, recommend_field_change, membership_entropy, cosine_to_neighbour,
        knn_graph, wage_blend_features, closest_topk, skill_gap_words, request_validation, request_defaults,
        text_request_validation, pathway_assembly, recommend_from_text, recommend_from_vectors, entity_detail,
        entity_detail_with_pay, text_vectors, closest_texts,
    )
}

_P = """
p0 as (select vec_id id, embedding::double[] e, label, o_totalprice / 3.0::double w
       from embeddings join orders on o_orderkey = vec_id),
p as (select *, list_sum(list_transform(e, lambda x: case when x * x > 0 then -(x * x) * ln(x * x) else 0 end)) / ln(64) b from p0)
"""
_COS = "list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e)))"
_RANKED = """
r as (select *, row_number() over (partition by src order by round(sc, 9) desc, tgt) rk from s)
select src, tgt, rk::int as rank, round(sc, 6) score, round(sim, 6) similarity from r where rk <= 3
"""
STOP = (
    "'and','or','the','to','of','a','in','is','with','for','on','by','as','be','are','at','from','an',"
    "'this','that','such','each','have','has','may','not','using','use','used','their','other','when','which'"
)
SPACES = r"[\s\x0B\x1C-\x1F\x85\p{Z}]+"


def _words(x: str) -> str:
    return f"list_distinct(regexp_split_to_array(lower({x}), '{SPACES}'))"


def _skill_words(x: str) -> str:
    return (
        f"list_filter({_words(x)}, lambda w: length(w) > 4 and regexp_full_match(w, '\\p{{L}}+') and w not in ({STOP}))"
    )


def _gap(source: str, target: str) -> str:
    """Sorted by length downwards, then alphabetically, via a fixed-width prefix."""
    missing = f"list_filter({target}, lambda w: not list_contains({source}, w))"
    keyed = f"list_sort(list_transform({missing}, lambda w: lpad((100000 - length(w))::varchar, 6, '0') || w))"
    return f"array_to_string(list_transform(({keyed})[1:6], lambda k: substring(k, 7)), ',')"


_VALID = """
req as (
  select o_orderkey query_id, o_custkey soc,
         case o_orderkey % 4 when 0 then 'progress' when 1 then 'pivot' when 2 then 'field_change' else 'other' end as mode,
         o_orderkey % 7 top_n, case when o_orderkey % 3 > 0 then o_totalprice end wage from orders),
checked as (
  select *, case when mode = 'other' then 'unknown mode' when top_n < 1 or top_n > 5 then 'top_n not in 1..5'
                 when wage < 20000 or wage > 500000 then 'user_current_wage not in 20000..500000' end error from req)
"""


def paths(cos: str) -> str:
    """SQL of the five best targets of every request, from occupations ``o`` and requests ``checked``: ``res``, ``prog``, ``emp``."""
    return f"""
        pairs as (
          select a.id src, b.id tgt, 'progress' as mode, {cos} sim, a.label = b.label same, b.w bw, b.b bb
          from o a join o b on a.id <> b.id and b.w > a.w
          union all
          select a.id, b.id, 'pivot', {cos}, false, b.w, b.b
          from o a join o b on a.id <> b.id and b.w > a.w and a.label % 4 <> b.label % 4
          union all
          select a.id, b.id, 'field_change', {cos}, a.label % 3 = b.label % 3, b.w, b.b
          from o a join o b on a.id <> b.id),
        scored as (
          select *, case mode when 'progress' then sim + case when same then 0.1::double else 0 end
                              when 'field_change' then sim + case when same then 0.05::double else 0 end
                              else 0.5::double * sim + 0.3::double * bw / max(bw) over (partition by src, mode)
                                   + 0.2::double * bb end sc from pairs),
        top as (select * from (select *, row_number() over (partition by src, mode order by round(sc, 9) desc, tgt) rk from scored) where rk <= 5),
        words as (select id, {_words("text")} s, {_skill_words("text")} t from o),
        full_top as (select top.*, round_even((1 - sim) * 100, 1) gap, {_gap("s.s", "t.t")} skills
                     from top join words s on s.id = src join words t on t.id = tgt),
        prog as (select l_orderkey k, string_agg('S' || l_suppkey, ',' order by l_suppkey) x
                 from (select distinct l_orderkey, l_suppkey from lineitem) group by 1),
        emp as (select o_custkey k, string_agg('O' || o_orderkey, ',' order by o_orderkey) x from orders group by 1),
        res as (
          select r.query_id, r.soc, r.mode, s.id known, s.label, t.*, r.wage uw, coalesce(r.wage, s.w) ew
          from checked r left join o s on s.id = r.soc
          left join full_top t on t.src = r.soc and t.mode = r.mode and t.rk <= r.top_n where error is null)"""


def _text_vectors(docs: str, name: str = "", given: str = "") -> str:
    """SQL of unit vectors ``id, j, v`` of a table ``id, text``; terms and weights are its own unless given."""
    own = f"""{name}voc as (select t, n, row_number() over (order by t) k from (select t, count(distinct id) n from {name}tok group by t order by n desc, t limit {GIVEN_TERMS})),
        {name}idf as (select t, k, ln((1 + (select count(*) from {docs})) / (1 + n)::double) + 1 w from {name}voc),"""
    return f"""{name}tok as (select id, unnest(list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')) t from {docs}),
        {"" if given else own}
        {name}raw as (select id, k, (1 + ln(count(*))) * w x from {name}tok join {"idf" if given else name + "idf"} using (t) group by id, k, w),
        {name}unit as (select id, k, x / sqrt(sum(x * x) over (partition by id)) x from {name}raw),
        {name}proj as (select id, j, sum(x * cos(k * j)) y from {name}unit, range(1, 9) g(j) group by id, j),
        {name}vecs as (select id, j, y / sqrt(sum(y * y) over (partition by id)) v from {name}proj)"""


SQL = {
    "recommend_progress": f"""with {_P},
        s as (select a.id src, b.id tgt, {_COS} sim, {_COS} + case when a.label = b.label then 0.1::double else 0 end sc
              from p a join p b on a.id <> b.id and b.w > a.w), {_RANKED}""",
    "recommend_pivot": f"""with {_P},
        c as (select a.id src, b.id tgt, {_COS} sim, b.w / max(b.w) over (partition by a.id) ws, b.b
              from p a join p b on a.id <> b.id and b.w > a.w and a.label % 4 <> b.label % 4),
        s as (select *, 0.5::double * sim + 0.3::double * ws + 0.2::double * b sc from c), {_RANKED}""",
    "recommend_field_change": f"""with {_P},
        s as (select a.id src, b.id tgt, {_COS} sim,
                     {_COS} + case when a.label % 3 = b.label % 3 then 0.05::double else 0 end sc
              from p a join p b on a.id <> b.id), {_RANKED}""",
    "membership_entropy": """
        select vec_id, round(list_sum(list_transform(embedding::double[],
          lambda x: case when x * x > 0 then -(x * x) * ln(x * x) else 0 end)) / ln(64), 6) boundary from embeddings""",
    "cosine_to_neighbour": f"""
        with e as (select vec_id, embedding::double[] e from embeddings)
        select a.vec_id, round({_COS}, 6) similarity from e a join e b on b.vec_id = a.vec_id + 1""",
    "knn_graph": f"""with {_P},
        s as (select a.id, b.id neighbour, {_COS} sim from p a cross join p b),
        r as (select *, row_number() over (partition by id order by round(sim, 9) desc, neighbour) rk from s)
        select id, neighbour, rk::int as rank, round(sim, 6) similarity from r where rk <= 6""",
    "wage_blend_features": f"""with {_P},
        m as (select id, w > min(w) over () paid, e from p),
        f as (select id, list_transform(e, lambda x: 0.65::double * x + case when paid then 0.35::double / 8 else 0 end) f from m),
        u as (select id, list_transform(f, lambda x: x / sqrt(list_dot_product(f, f))) f from f)
        select id, round(sqrt(list_dot_product(f, f)), 6) norm, round(list_sum(f), 6) total,
               array_to_string(list_transform(f, lambda x: printf('%.4f', x + 0.0)), ' ') feature from u""",
    "closest_topk": f"""with {_P},
        q as (select vec_id, list_reverse(embedding)::double[] e from embeddings),
        s as (select a.vec_id query_id, b.id, b.w, {_COS} sim from q a cross join p b),
        r as (select *, row_number() over (partition by query_id order by round(sim, 9) desc, id) rk from s where true)
        select query_id, id::varchar soc_code, rk::int as rank,
               case when w < 55000 then 'Tier 1 — Entry/Support' when w < 80000 then 'Tier 2 — Technical Core'
                    when w < 110000 then 'Tier 3 — Senior/Specialist' else 'Tier 4 — Leadership/Expert' end wealth_tier,
               round(w, 4) median_wage_me, round_even(sim * 100, 1) similarity_pct from r where rk <= 3""",
    "skill_gap_words": f"""
        with s as (select doc_id, {_words("text")} s from documents),
        t as (select doc_id - 1 doc_id, {_skill_words("text")} t from documents)
        select doc_id, {_gap("s", "t")} skills_to_acquire from s join t using (doc_id)""",
    "request_defaults": f"""with {_VALID},
        d as (select query_id, case when query_id % 5 > 0 then mode else 'progress' end as mode,
                     case when query_id % 3 > 0 then top_n else 3 end::int top_n, wage from req)
        select query_id, mode, top_n, case when mode = 'other' then 'unknown mode' when top_n < 1 or top_n > 5 then 'top_n not in 1..5'
                 when wage < 20000 or wage > 500000 then 'user_current_wage not in 20000..500000' end error from d""",
    "request_validation": f"with {_VALID} select query_id, error from checked",
    "text_request_validation": """
        with r as (select conv_id * 1000 + turn query_id, text, case when role = 'user' then length(text) * 100.0 end w,
                          case when turn % 2 = 0 then length(text) * 200.0 end m from conversations)
        select query_id, case when length(text) < 10 or trim(text) = '' then 'skills_text too short'
                              when query_id % 1000 % 4 + 2 > 5 then 'top_n not in 1..5'
                              when w < 20000 or w > 500000 then 'user_current_wage not in 20000..500000'
                              when m < 30000 then 'target_min_wage below 30000' end error from r""",
    "pathway_assembly": f"""with {_P}, {_VALID},
        o as (select p.*, text from p join documents on doc_id = id),
        {paths(_COS)}
        select query_id, soc::varchar soc_code, res.mode, case when known is null then 'unknown_code' when rk is null then 'no_candidates' else 'ok' end status,
               rk::int as rank, tgt::varchar target_soc,
               case when tgt is null then null when bw < 55000 then 'Tier 1 — Entry/Support' when bw < 80000 then 'Tier 2 — Technical Core'
                    when bw < 110000 then 'Tier 3 — Senior/Specialist' else 'Tier 4 — Leadership/Expert' end target_wealth_tier,
               case when uw is null then 'SOC median' else 'user-reported' end wage_source,
               (case res.mode when 'progress' then label when 'pivot' then label % 4 else label % 3 end)::bigint current_cluster_id,
               case res.mode when 'progress' then 'kmeans' when 'pivot' then 'gmm' else 'agglomerative' end cluster_method_used,
               gap skill_gap_pct, round_even(100 - gap, 1) skill_similarity_pct, skills,
               round_even(bw - ew, 0) annual_uplift, round_even((bw - ew) / 12, 0) monthly_uplift,
               case when bw > ew then round_even(5000 / ((bw - ew) / 12), 1) end breakeven_months,
               round_even((bw - ew) * 5 - 5000, 0) five_year_net_gain,
               case when tgt is not null then coalesce(prog.x, '') end programs, case when tgt is not null then coalesce(emp.x, '') end employers
        from res left join prog on prog.k = tgt left join emp on emp.k = tgt""",
    "text_vectors": f"""with d as (select doc_id id, text from documents), {_text_vectors("d")}
        select id doc_id, (j - 1)::int place, round(coalesce(v, 0), 6) + 0.0 as value from d cross join range(1, 9) g(j) left join vecs using (id, j)""",
    "closest_texts": f"""with d as (select doc_id id, text, o_totalprice / 3.0::double w from documents join orders on o_orderkey = doc_id), {_text_vectors("d")},
        pg as (select page_id id, html as text from pages), {_text_vectors("pg", "q", "voc")},
        a as (select id, list(coalesce(v, 0) order by j) e from pg cross join range(1, 9) g(j) left join qvecs using (id, j) group by id),
        b as (select id, list(coalesce(v, 0) order by j) e from d cross join range(1, 9) g(j) left join vecs using (id, j) group by id),
        s as (select a.id qid, b.id tgt, list_sum(list_transform(list_zip(a.e, b.e), lambda z: z[1] * z[2])) sim from a join b on true),
        t as (select *, row_number() over (partition by qid order by round(sim, 9) desc, tgt) rk from s)
        select qid query_id, tgt::varchar soc_code, rk::int as rank, round(w, 4) median_wage_me, round(round_even(sim * 100, 1), 1) similarity_pct
        from t join d on d.id = tgt where rk <= 3""",
    "recommend_from_vectors": f"""with {_P},
        o as (select p.*, text from p join documents on doc_id = id),
        q as (select id, list_reverse(e) e, text, case when label < 5 then w + 20000 end uw,
                     case when label >= 7 then 100000 end mw from o where length(text) >= 10 and trim(text) <> ''),
        s as (select a.id query_id, b.id tgt, {_COS} sim, b.w bw from q a join o b on a.mw is null or b.w >= a.mw),
        top as (select * from (select *, row_number() over (partition by query_id order by round(sim, 9) desc, tgt) rk from s) where rk <= 3),
        words as (select id, {_words("text")} s, {_skill_words("text")} t from o)
        select query_id, 'ok' status, rk::int as rank, tgt::varchar target_soc, round_even((1 - sim) * 100, 1) skill_gap_pct,
               case when uw is null then 'default ($45,000)' else 'user-reported' end wage_source, 'hdbscan' cluster_method_used,
               first_value(tgt) over (partition by query_id order by rk)::varchar closest,
               least(length(q.text), 200)::int preview_length, {_gap("s.s", "t.t")} skills,
               case when bw > coalesce(uw, 45000) then round_even(5000 / ((bw - coalesce(uw, 45000)) / 12), 1) end breakeven_months
        from top join q on q.id = query_id join words s on s.id = query_id join words t on t.id = tgt""",
    "entity_detail": f"""with {_P}
        select id::varchar soc_code, o_orderpriority occ_title, round(w, 4) median_wage_me,
               case when w < 55000 then 'Tier 1 — Entry/Support' when w < 80000 then 'Tier 2 — Technical Core'
                    when w < 110000 then 'Tier 3 — Senior/Specialist' else 'Tier 4 — Leadership/Expert' end wealth_tier,
               label::bigint cluster_kmeans, (label % 4)::bigint cluster_gmm, (label % 3)::bigint cluster_agglom,
               case when label = 9 then -1 else label end::bigint cluster_hdbscan,
               substring(text, 1, 500) || '...' skill_description_preview
        from p join documents on doc_id = id join orders on o_orderkey = id""",
    "entity_detail_with_pay": """
        with p as (select doc_id id, doc_id % 10 label, o_totalprice / 3.0::double w, o_orderpriority title, text
                   from documents join orders on o_orderkey = doc_id)
        select id::varchar soc_code, title occ_title, round(w, 4) median_wage_me,
               case when w < 55000 then 'Tier 1 — Entry/Support' when w < 80000 then 'Tier 2 — Technical Core'
                    when w < 110000 then 'Tier 3 — Senior/Specialist' else 'Tier 4 — Leadership/Expert' end wealth_tier,
               label::bigint cluster_kmeans, (label % 4)::bigint cluster_gmm, (label % 3)::bigint cluster_agglom,
               case when label = 9 then -1 else label end::bigint cluster_hdbscan,
               substring(text, 1, 500) || '...' skill_description_preview
        from p""",
}

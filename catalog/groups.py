"""Clustering queries over all vectors."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalog.tables import VECTOR_WIDTH, entities, table, with_groupings
from gradus import fixed
from gradus.functions import numeric
from gradus.operators import blocks, choose, density, features, hierarchy, kmeans, mixture, ranking, silhouette, ward
from gradus.plans import clustering, galaxy
from gradus.session import cut_lineage


def _grouped(spark, sf) -> DataFrame:
    return with_groupings(entities(spark, sf)).select(
        F.col("id").alias("ordinal"), F.col("id").cast("string").alias("soc_code"), F.col("title").alias("occ_title"),
        F.col("wage").alias("median_wage_me"), numeric.tier(F.col("wage")).alias("wealth_tier"), "vec",
        *fixed.METHOD_COLUMNS.values(),
    )


def silhouette_by_row(spark, sf):
    points = silhouette.silhouette_points(entities(spark, sf), "id", "vec", "label", VECTOR_WIDTH)
    return points.select("id", *[F.round(c, 6).alias(c) for c in ("a", "b", "silhouette")])


def _scores(spark, sf) -> DataFrame:
    found = silhouette.silhouette_scores(_grouped(spark, sf), "ordinal", "vec", list(fixed.METHOD_COLUMNS.values()), VECTOR_WIDTH)
    return choose.score_table(spark, {m: found[c] for m, c in fixed.METHOD_COLUMNS.items()})


def silhouette_scores(spark, sf):
    return choose.ranked_methods(_scores(spark, sf)).select("method", "silhouette", "place")


def best_method_select(spark, sf):
    """Hint and chosen method of every use; event types stand for modes nobody knows."""
    scores = _scores(spark, sf)
    # Shifted so that some scores are positive on these nearly uniform vectors.
    shifted = scores.withColumn("silhouette", F.round(F.col("silhouette") + 0.011, 4))
    hints = choose.hints(shifted)
    known = hints.select(F.col("use").alias("mode"))
    unknown = table(spark, sf, "events").select(F.col("event_type").alias("mode")).distinct()
    chosen = choose.methods_for(known.unionByName(unknown), "mode", shifted, hints)
    return chosen.join(hints.select(F.col("use").alias("mode"), F.col("method").alias("hint")), "mode", "left")


def group_medians(spark, sf):
    lines = table(spark, sf, "lineitem")
    found = ranking.group_medians(lines, ["l_returnflag", "l_linestatus"], "l_extendedprice", "median_price")
    return found.withColumn("median_price", F.round("median_price", 4))


def relabel_by_wage(spark, sf):
    df = _grouped(spark, sf).select("ordinal", "median_wage_me", "cluster_hdbscan")
    return ranking.relabel_by_median(df, "cluster_hdbscan", "median_wage_me", "cluster_id").select("ordinal", "cluster_id")


def cluster_overview(spark, sf):
    return clustering.cluster_overview(_grouped(spark, sf))


def cluster_members(spark, sf):
    pages = clustering.cluster_members(_grouped(spark, sf), F.col("soc_code"))
    return pages.select("method", "cluster_id", "page", F.array_join("occupations", ",").alias("members"))


def galaxy_layout(spark, sf):
    """Ring layout of all vectors; the well-rated documents count as recommended."""
    good = table(spark, sf, "labels").where("quality = 1").select(F.col("doc_id").cast("string").alias("soc_code"))
    laid = galaxy.ring_layout(_grouped(spark, sf), "cluster_kmeans", "7", good)
    return laid.select("soc_code", "x", "y", F.round("r", 6).alias("r"), "is_recommended", "is_current")


def _features(spark, sf) -> DataFrame:
    return features.blend_with_pay(entities(spark, sf), "vec", "wage", "feature", VECTOR_WIDTH)


def _labels(spark, sf, sweep, **args) -> DataFrame:
    df = cut_lineage(_features(spark, sf))
    labels, _ = sweep(df, "id", "feature", "wage", VECTOR_WIDTH, **args)
    return labels


def kmeans_sweep(spark, sf):
    return _labels(spark, sf, kmeans.kmeans_sweep)


def gmm_bic_sweep(spark, sf):
    out = _labels(spark, sf, mixture.mixture_sweep)
    return out.withColumn("total", F.round(F.aggregate("membership", F.lit(0.0), lambda s, x: s + x), 6)).drop("membership")


def ward_sweep(spark, sf):
    return _labels(spark, sf, ward.ward_sweep)


def ward_merges(spark, sf):
    merges = ward.ward_merges(_features(spark, sf), "id", "feature", VECTOR_WIDTH)
    return merges.withColumn("distance", F.round("distance", 6))


def density_cluster(spark, sf):
    return _labels(spark, sf, density.density_clusters)


def core_distance(spark, sf):
    points = entities(spark, sf).select(F.col("id").alias("key"), "vec")
    return density.core_distances(points, VECTOR_WIDTH, 2).select("key", F.round("core", 6).alias("core"))


def _given_centers(points: DataFrame) -> list:
    """Vectors of the three least ids, as fixed starts."""
    return blocks.matrix(points.orderBy("id").limit(3).select("vec").toArrow()["vec"])


def kmeans_fixed_starts(spark, sf):
    """Labels after three rounds of center moves from fixed starts."""
    points = entities(spark, sf)
    ((_, centers),) = kmeans.fit_centers(points, [_given_centers(points)], max_iter=2, tol=0.0)
    return kmeans.nearest_center(points, "vec", centers, "label_after").select("id", "label_after")


def mixture_step(spark, sf):
    """Weights and means of one expectation and maximisation from unit covariances at fixed means."""
    points = entities(spark, sf)
    means = _given_centers(points)
    start = mixture.Mixture(np.full(3, 1 / 3), means, np.stack([np.eye(VECTOR_WIDTH)] * 3))
    moved = mixture.next_mixture(points, start, points.count())
    rows = [(j, float(w), [float(x) for x in m]) for j, (w, m) in enumerate(zip(moved.weights, moved.means))]
    listed = spark.createDataFrame(rows, "component INT, weight DOUBLE, mean ARRAY<DOUBLE>")
    return listed.select("component", F.round("weight", 6).alias("weight"), F.posexplode("mean").alias("place", "mean")).withColumn(
        "mean", F.round("mean", 6)
    )


def ward_identity(spark, sf):
    """Number of merges and half the sum of their squared heights: the total squared deviation of all vectors."""
    merges = ward.ward_merges(entities(spark, sf), "id", "vec", VECTOR_WIDTH, few=256)  # rounds, not the last step in memory
    return merges.agg(F.count("*").alias("n_merges"), F.round(F.sum(F.col("distance") * F.col("distance")) / 2, 4).alias("deviation"))


def medians_with_infinities(spark, sf):
    """Median price per flag with some infinite prices, by the narrowing search alone."""
    key = F.col("l_orderkey") % 50
    price = F.when(key == 0, float("inf")).when(key == 1, float("-inf")).otherwise(F.col("l_extendedprice"))
    lines = table(spark, sf, "lineitem").select("l_returnflag", price.alias("price"))
    found = ranking.group_medians(lines, ["l_returnflag"], "price", "median_price", bound=100, fan=16)
    return found.select("l_returnflag", F.round("median_price", 4).alias("median_price"), "n_values")


def density_given_edges(spark, sf):
    """Density clusters of all customers from a given tree: neighbours by balance, apart by the cents between them."""
    cents = F.round(F.col("c_acctbal") * 100).cast("bigint")
    told = table(spark, sf, "customer").select(F.col("c_custkey").cast("bigint").alias("key"), cents.alias("cents"))
    placed = cut_lineage(ranking.global_index(told, [F.col("cents"), F.col("key")], "place"))
    after = placed.select(F.col("key").alias("_key"), F.col("cents").alias("_cents"), (F.col("place") - 1).alias("place"))
    tree = placed.join(after, "place").select(
        F.least("key", "_key").alias("lo"), F.greatest("key", "_key").alias("hi"), ((F.col("_cents") - F.col("cents") + 1) / 100.0).alias("w")
    )
    labels = cut_lineage(hierarchy.condensed_clusters(placed, cut_lineage(tree), min_size=5, stretch=20_000))
    least = labels.where("label <> -1").groupBy("label").agg(F.min("key").alias("first_key"))
    return labels.join(least, "label", "left").select(F.col("key").alias("c_custkey"), F.coalesce("first_key", F.lit(-1)).alias("first_key"))


def pca_galaxy(spark, sf):
    df = _grouped(spark, sf).withColumn("feature_vector", F.col("vec"))
    return galaxy.galaxy_points(df, "kmeans")


QUERIES = {
    f.__name__: f
    for f in (
        silhouette_by_row, silhouette_scores, best_method_select, group_medians, relabel_by_wage, cluster_overview,
        cluster_members, galaxy_layout, kmeans_sweep, gmm_bic_sweep, ward_sweep, ward_merges, density_cluster,
        core_distance, kmeans_fixed_starts, mixture_step, ward_identity, medians_with_infinities, pca_galaxy,
        density_given_edges,
    )
}

_P = """
p as (select vec_id id, embedding::double[] e, label::bigint label, o_totalprice / 3.0::double w
      from embeddings join orders on o_orderkey = vec_id)
"""
_LONG = """
lab as (select id, w, e, 'kmeans' as method, 0 mo, label c from p union all select id, w, e, 'gmm', 1, label % 4 from p
        union all select id, w, e, 'agglomerative', 2, label % 3 from p
        union all select id, w, e, 'hdbscan', 3, case when label = 9 then -1 else label end from p)
"""
_SIL = """
d as (select a.id i, b.id j, sqrt(list_sum(list_transform(list_zip(a.e, b.e), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) d
      from p a join p b on a.id <> b.id),
m as (select x.method, x.mo, x.id, x.c, y.c oc, avg(d) md from d join lab x on x.id = i join lab y on y.id = j and y.method = x.method
      where x.c <> -1 and y.c <> -1 group by all),
ab as (select method, mo, id, c, max(md) filter (oc = c) a, min(md) filter (oc <> c) b from m group by all),
s as (select *, case when a is null then 0 else (b - a) / greatest(a, b) end s from ab),
sc as (select method, mo, round(avg(s), 4) sil from s group by all)
"""

_APART = "list_sum(list_transform(list_zip({a}, {b}), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
_CENTERS = "c0 as (select row_number() over (order by id) - 1 c, e m from (select * from p order by id limit 3))"


def _moved(i: int) -> str:
    """SQL of one move of the centers to the means of their rows."""
    return f"""
        l{i} as (select id, arg_min(c, (round({_APART.format(a="e", b="m")}, 12), c)) c from p, c{i - 1} group by id),
        x{i} as (select c, k, avg(e[k]) v from l{i} join p using (id), range(1, {VECTOR_WIDTH + 1}) r(k) group by c, k),
        c{i} as (select c, list(v order by k) m from x{i} group by c)"""


SQL = {
    "kmeans_fixed_starts": f"""with {_P}, {_CENTERS}, {", ".join(_moved(i) for i in (1, 2, 3))}
        select id, arg_min(c, (round({_APART.format(a="e", b="m")}, 12), c))::int label_after from p, c3 group by id""",
    "mixture_step": f"""with {_P}, {_CENTERS},
        j as (select id, c, e, exp(-0.5 * {_APART.format(a="e", b="m")}) q from p, c0),
        r as (select id, c, e, q / sum(q) over (partition by id) r from j),
        n as (select c, sum(r) n from r group by c)
        select c::int component, round(n / (select count(*) from p), 6) weight, (k - 1)::int place, round(sum(r * e[k]) / n, 6) mean
        from r join n using (c), range(1, {VECTOR_WIDTH + 1}) g(k) group by c, n, k""",
    "ward_identity": f"""with {_P}, x as (select k, e[k] v from p, range(1, {VECTOR_WIDTH + 1}) g(k)),
        s as (select k, var_pop(v) * count(*) d from x group by k)
        select (select count(*) - 1 from p) n_merges, round(sum(d), 4) deviation from s""",
    "density_given_edges": """with recursive
        p as (select c_custkey::bigint k, round(c_acctbal * 100)::bigint v, row_number() over (order by round(c_acctbal * 100)::bigint, c_custkey) - 1 r
              from customer),
        g as (select r, (v2 - v + 1) / 100.0::double w, least(k, k2) lo, greatest(k, k2) hi
              from (select *, lead(v) over (order by r) v2, lead(k) over (order by r) k2 from p) where k2 is not null),
        e as (select r, w, row_number() over (order by w, lo, hi) pos from g),
        h as (select min(r) l, max(r) u, min(r) cl, max(r) cu, null::bigint pl, null::bigint pu, null::double born, false small, null::double lv, 0 depth from p
              union all
              select if(side = 0, s.l, cut + 1), if(side = 0, cut, s.u),
                     if(big > 1, if(side = 0, s.l, cut + 1), cl), if(big > 1, if(side = 0, cut, s.u), cu),
                     if(big > 1, cl, pl), if(big > 1, cu, pu), if(big > 1, 1 / w, born),
                     big < 2 and if(side = 0, cut - s.l + 1, s.u - cut) < 5, 1 / w, depth + if(big > 1, 1, 0)
              from (select h.*, x.cut, x.w, (if(x.cut - h.l + 1 >= 5, 1, 0) + if(h.u - x.cut >= 5, 1, 0)) big
                    from h join (select h.l, h.u, arg_max(e.r, e.pos) cut, arg_max(e.w, e.pos) w from h join e on e.r >= h.l and e.r < h.u
                                 where not h.small group by h.l, h.u) x on x.l = h.l and x.u = h.u
                    where not h.small) s, range(2) t(side)),
        c as (select distinct cl, cu, pl, pu, born, depth from h),
        fallen as (select cl, cu, sum((u - l + 1) * lv) f from h where small group by 1, 2),
        halved as (select pl cl, pu cu, sum(cu - cl + 1) * any_value(born) f from c where pl is not null group by 1, 2),
        s as (select c.*, coalesce(a.f, 0) + coalesce(b.f, 0) - (c.cu - c.cl + 1) * coalesce(born, 0) own
              from c left join fallen a on a.cl = c.cl and a.cu = c.cu left join halved b on b.cl = c.cl and b.cu = c.cu),
        best as (select cl, cu, pl, pu, depth, own b, pl is not null m from s where depth = (select max(depth) from s)
                 union all
                 select s.cl, s.cu, any_value(s.pl), any_value(s.pu), s.depth, greatest(any_value(s.own), coalesce(sum(o.b), 0)),
                        any_value(s.pl) is not null and any_value(s.own) >= coalesce(sum(o.b), 0)
                 from s left join best o on o.pl = s.cl and o.pu = s.cu where s.depth = (select max(depth) - 1 from best)
                 group by s.cl, s.cu, s.depth),
        top as (select * from best a where m and not exists (select 1 from best b where b.m and b.cl <= a.cl and b.cu >= a.cu and (b.cl <> a.cl or b.cu <> a.cu))),
        lab as (select p.k, top.cl from p left join top on p.r between top.cl and top.cu)
        select k c_custkey, if(cl is null, -1, min(k) over (partition by cl)) first_key from lab""",
    "medians_with_infinities": """
        select l_returnflag, round(median(case l_orderkey % 50 when 0 then 'inf'::double when 1 then '-inf'::double else l_extendedprice end), 4)
               median_price, count(*) n_values from lineitem group by 1""",
    "silhouette_by_row": f"""with {_P}, lab as (select id, label c, 'x' as method, 0 mo from p), {_SIL}
        select id, round(a, 6) a, round(b, 6) b, round(s, 6) silhouette from s""",
    "silhouette_scores": f"""with {_P}, {_LONG}, {_SIL}
        select method, sil silhouette, row_number() over (order by sil desc, mo)::int place from sc""",
    "best_method_select": f"""with {_P}, {_LONG}, {_SIL},
        sh as (select method, mo, round(sil + 0.011, 4) sil from sc),
        ov as (select coalesce((select method from sh where sil > 0 order by sil desc, mo limit 1), 'kmeans') o),
        u as (select * from (values ('overall', null), ('progress', 'kmeans'), ('pivot', 'gmm'),
                                    ('field_change', 'agglomerative'), ('skill_match', 'hdbscan')) v(use_, pref)),
        h as (select use_, case when use_ = 'overall' then o
                               when use_ = 'progress' or coalesce((select sil from sh where method = pref), -1) > 0 then pref
                               when use_ = 'skill_match' then o else 'kmeans' end hint from u, ov),
        modes as (select use_ as mode from u union select distinct event_type from events),
        j as (select mode, hint, coalesce(hint, (select hint from h where use_ = 'overall')) eff from modes left join h on use_ = mode)
        select mode, hint,
               case when (select sil from sh where method = eff) > 0 then eff
                    when (select sil from sh, ov where method = o) > 0 then (select o from ov) else 'kmeans' end as method from j""",
    "group_medians": """
        select l_returnflag, l_linestatus, round(median(l_extendedprice), 4) median_price, count(*) n_values
        from lineitem group by 1, 2""",
    "relabel_by_wage": f"""with {_P}, {_LONG},
        m as (select c, median(w) m from lab where method = 'hdbscan' and c <> -1 group by 1),
        r as (select c, row_number() over (order by m, c) - 1 n from m)
        select id ordinal, coalesce(n, -1)::int cluster_id from lab left join r using (c) where method = 'hdbscan'""",
    "cluster_overview": f"""with {_P}, {_LONG}
        select method, c::int cluster_id, c = -1 is_noise, count(*) n_occupations,
               case when c <> -1 then round_even(median(w), 0) end median_wage from lab group by method, c""",
    "cluster_members": f"""with {_P}, {_LONG},
        n as (select *, row_number() over (partition by method, c order by id) - 1 k from lab)
        select method, c::int cluster_id, (k // 1000)::int page, string_agg(id::varchar, ',' order by id) members
        from n group by method, c, k // 1000""",
    "galaxy_layout": f"""with {_P},
        i as (select *, row_number() over (order by label, id) - 1 k, count(*) over () n from p),
        g as (select *, k / n::double * (2 * pi()) t, 2 + w / 120000 * 3 r from i)
        select id::varchar soc_code, round(cos(t) * r, 2) + 0.0 x, round(sin(t) * r, 2) + 0.0 y, round(8 + w / 120000 * 8, 6) r,
               id in (select doc_id from labels where quality = 1) is_recommended, id = 7 is_current from g""",
    "core_distance": f"""with {_P},
        d as (select a.id i, sqrt(list_sum(list_transform(list_zip(a.e, b.e), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) d
              from p a join p b on a.id <> b.id)
        select i as key, round(d, 6) core from d qualify row_number() over (partition by i order by d) = 2""",
}

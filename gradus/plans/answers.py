"""What a reader of the tables asks for: lists, detail pages, children of codes, overviews and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradus import fixed
from gradus.functions import text
from gradus.operators import choose, ranking
from gradus.plans import clustering, recommend
from gradus.schemas import keep_existing

LIST_COLUMNS = [
    "soc_code", "occ_title", "role_description", "median_wage_me", "wage_source", "wealth_tier",
    *fixed.METHOD_COLUMNS.values(),
]
PREVIEW = 500


def occupation_list(occupations: DataFrame, page_size: int = 1_000) -> DataFrame:
    """``page, occupations, count``: all occupations by ``ordinal`` with their groups, in pages that all carry their number."""
    item = F.struct(*keep_existing(occupations, LIST_COLUMNS).columns)
    numbered = ranking.global_index(occupations.select("ordinal", item.alias("v")), [F.col("ordinal")], "_place")
    pages = numbered.groupBy(F.floor(F.col("_place") / page_size).alias("page")).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("_place", "v"))), lambda s: s["v"]).alias("occupations")
    )
    total = occupations.agg(F.count("*").alias("count"))
    return pages.join(F.broadcast(total))  # one row


def occupation_details(occupations: DataFrame, support: DataFrame) -> DataFrame:
    """Every occupation with the head of its text, its programs and its employers, a row per page of ``support``."""
    kept = keep_existing(occupations, LIST_COLUMNS)
    preview = text.preview(F.col("skill_description"), PREVIEW, "...").alias("skill_description_preview")
    return recommend.attach_support(occupations.select(*kept.columns, preview), support, target="soc_code")


def children_of_codes(asked: DataFrame, children: DataFrame, item, out: str, key: str = "soc_code", **page_args) -> DataFrame:
    """``key, page, out, count`` for every distinct asked code: its children by ``ordinal`` in pages, and their number on each.

    A code without children has one page with an empty list and count 0. Children of codes nobody asked for stay unread
    by the paging.
    """
    codes = asked.where(F.col(key).isNotNull()).select(key).distinct()
    mine = children.join(codes, key, "left_semi")
    counts = mine.groupBy(key).agg(F.count("*").alias("count"))
    pages = ranking.pages(mine, [key], "ordinal", item, out, **page_args)
    kind = dict(pages.dtypes)[out]
    return codes.join(counts, key, "left").join(pages, key, "left").withColumns(
        {
            "page": F.coalesce("page", F.lit(0)), out: F.coalesce(out, F.array().cast(kind)),
            "count": F.coalesce("count", F.lit(0)),
        }
    )


def tier_overview(occupations: DataFrame, scores: DataFrame, hint_table: DataFrame, **median_args) -> DataFrame:
    """One row per group of every method: size, median and range of wages, and of its method the silhouette, the number of
    groups without noise and the uses it is hinted for, in alphabetic order."""
    groups = clustering.cluster_overview(occupations, **median_args)
    keys = ["method", "cluster_id"]
    ranges = clustering.by_method(occupations.select("median_wage_me", *fixed.METHOD_COLUMNS.values())).groupBy(*keys).agg(
        F.min("median_wage_me").alias("least_wage"), F.max("median_wage_me").alias("greatest_wage")
    )
    uses = hint_table.groupBy("method").agg(F.sort_array(F.collect_list("use")).alias("uses"))
    # Four rows each at most.
    per_method = scores.select("method", "silhouette").join(uses, "method", "left").withColumn(
        "uses", F.coalesce("uses", F.array().cast("array<string>"))
    )
    numbers = groups.groupBy("method").agg(F.count_if(~F.col("is_noise")).alias("n_clusters"))
    return groups.join(ranges, keys).join(F.broadcast(per_method), "method").join(F.broadcast(numbers), "method")


def clustering_report(occupations: DataFrame, scores: DataFrame) -> DataFrame:
    """One row per occupation with its group in each method, the methods in order of silhouette and the hint of every use."""
    order = choose.ranked_methods(scores).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("place", "method"))), lambda s: s["method"]).alias("silhouette_ranking")
    )
    hint_map = choose.hints(scores).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("use", "method")))).alias("best_method_hints"))
    kept = keep_existing(occupations, ["soc_code", "occ_title", "wealth_tier", "median_wage_me", *fixed.METHOD_COLUMNS.values()])
    return kept.join(F.broadcast(order)).join(F.broadcast(hint_map))  # one row each


def status(occupations: DataFrame, scores: DataFrame) -> DataFrame:
    """One row per method: number of occupations in all, of groups without noise, silhouette, and the overall choice."""
    long = clustering.by_method(occupations.select(*fixed.METHOD_COLUMNS.values()))
    numbers = long.groupBy("method").agg(
        F.count("*").alias("occupations"), F.count_distinct(F.when(F.col("cluster_id") != -1, F.col("cluster_id"))).alias("n_clusters")
    )
    overall = choose.hints(scores).where("use = 'overall'").select(F.col("method").alias("best_overall"))
    return numbers.join(F.broadcast(scores.select("method", "silhouette")), "method").join(F.broadcast(overall))  # one row

"""Which clustering answers which kind of request."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gradus import fixed
from gradus.functions.numeric import lookup

METHODS = list(fixed.METHOD_COLUMNS)
USES = ["overall", *fixed.PREFERRED_METHOD]


def score_table(spark: SparkSession, scores: dict[str, float], clusters: dict[str, int] | None = None) -> DataFrame:
    """One row per method: ``method, silhouette, n_clusters``."""
    rows = [(m, float(s), (clusters or {}).get(m)) for m, s in scores.items()]
    return spark.createDataFrame(rows, "method STRING, silhouette DOUBLE, n_clusters INT")


def ranked_methods(scores: DataFrame) -> DataFrame:
    """Methods with their 1-based place by silhouette; equal scores in listed order."""
    place = lookup(F.col("method"), {m: i for i, m in enumerate(METHODS)}, len(METHODS))
    w = Window.orderBy(F.desc("silhouette"), place)
    return scores.withColumn("place", F.row_number().over(w))


def hints(scores: DataFrame) -> DataFrame:
    """Preferred method per use: ``use, method``.

    ``overall`` is the best positive silhouette. A use's own method stands when its
    silhouette is positive (moving up always uses k-means); otherwise k-means, and for
    skill matching the overall best.
    """
    order = lookup(F.col("method"), {m: -i for i, m in enumerate(METHODS)}, -len(METHODS))
    positive = F.col("silhouette") > 0
    best = F.max_by(F.when(positive, F.col("method")), F.when(positive, F.struct("silhouette", order)))
    one = scores.agg(
        F.coalesce(best, F.lit("kmeans")).alias("_overall"),
        F.map_from_entries(F.collect_list(F.struct("method", "silhouette"))).alias("_scores"),
    )
    use = F.explode(F.array(*map(F.lit, USES))).alias("use")
    own = lookup(F.col("use"), fixed.PREFERRED_METHOD)
    works = F.coalesce(F.try_element_at("_scores", own) > 0, F.lit(False))
    return one.select("*", use).select(
        "use",
        F.when(F.col("use") == "overall", F.col("_overall"))
        .when((F.col("use") == "progress") | works, own)
        .when(F.col("use") == "skill_match", F.col("_overall"))
        .otherwise("kmeans")
        .alias("method"),
    )


def methods_for(modes: DataFrame, mode: str, scores: DataFrame, hint_table: DataFrame, out: str = "method") -> DataFrame:
    """Method for each row's mode: its hint, or the overall best, or k-means, whichever first
    has a positive silhouette. Unknown modes use the overall hint."""
    known = hint_table.join(F.broadcast(scores.select("method", "silhouette")), "method", "left")  # five rows
    usable = known.select("use", F.when(F.col("silhouette") > 0, F.col("method")).alias("_m"))
    table = usable.agg(
        F.map_from_entries(F.collect_list(F.struct("use", "_m"))).alias("_by_use")
    ).first()["_by_use"]
    listed = lookup(F.col(mode), {u: u for u in table if u != "overall"}, "overall")
    chosen = lookup(listed, {u: m for u, m in table.items() if m is not None})
    fallback = table.get("overall") or "kmeans"
    return modes.withColumn(out, F.coalesce(chosen, F.lit(fallback)))


def method_map(scores: DataFrame) -> dict[str, str]:
    """Method per request mode as a small dictionary for the recommendation plan."""
    spark = scores.sparkSession
    modes = spark.createDataFrame([(m,) for m in fixed.PREFERRED_METHOD], "mode STRING")
    rows = methods_for(modes, "mode", scores, hints(scores)).collect()
    return {r["mode"]: r["method"] for r in rows}

"""Two-dimensional maps of the occupations."""

from __future__ import annotations

from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradus import fixed
from gradus.functions import numeric
from gradus.operators import ranking


def project(df: DataFrame, vec: str) -> DataFrame:
    """Add ``x, y``: the two leading components of the centred vectors, four places.

    The sign of a component is free; its largest loading is made positive.
    """
    points = df.withColumn("_features", array_to_vector(vec))
    centred = (
        StandardScaler(withMean=True, withStd=False, inputCol="_features", outputCol="_centred").fit(points).transform(points)
    )
    model = PCA(k=2, inputCol="_centred", outputCol="_pc").fit(centred)
    loadings = model.pc.toArray()
    signs = [1.0 if loadings[abs(loadings[:, j]).argmax(), j] > 0 else -1.0 for j in range(2)]
    at = vector_to_array("_pc")
    placed = model.transform(centred)
    return placed.withColumns(
        {axis: F.bround(at[j] * signs[j], 4) for j, axis in enumerate("xy")}
    ).drop("_features", "_centred", "_pc")


def galaxy_points(occupations: DataFrame, method: str, vec: str = "feature_vector") -> DataFrame:
    """Map points with position, group, tier colour and marker size."""
    column = fixed.METHOD_COLUMNS[method]
    if column not in occupations.columns:
        raise ValueError(f"no column {column}; available {occupations.columns}")
    tier = F.col("wealth_tier")
    return project(occupations, vec).select(
        *[c for c in ("ordinal", "soc_code", "occ_title", "role_description", "median_wage_me", "wealth_tier") if c in occupations.columns],
        F.col(column).cast("int").alias("cluster_id"),
        F.lit(method).alias("cluster_method"),
        "x", "y",
        numeric.lookup(tier, fixed.TIER_COLOURS, fixed.DEFAULT_COLOUR).alias("color"),
        numeric.bubble_size(F.col("median_wage_me")).alias("size"),
    )


def ring_layout(
    occupations: DataFrame, cluster: str, current: str | None = None, recommended: DataFrame | None = None
) -> DataFrame:
    """Points on a ring in group order, flagged when current or recommended."""
    n = occupations.count()
    placed = ranking.global_index(occupations, [F.col(cluster), F.col("ordinal")], "_index")
    out = placed.select("*", *numeric.polar_position(F.col("_index"), F.lit(n), F.col("median_wage_me"))).drop("_index")
    if recommended is not None:
        chosen = recommended.select(F.col("soc_code")).distinct().withColumn("_hit", F.lit(True))
        out = out.join(chosen, "soc_code", "left").withColumn("is_recommended", F.col("_hit").isNotNull()).drop("_hit")
    if current is not None:
        out = out.withColumn("is_current", F.col("soc_code") == current)
    return out

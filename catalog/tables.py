"""Driver tables in the roles the operators expect."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradus.session import spread

VECTOR_WIDTH = 64
# Tables whose rows cost far more work than their bytes suggest.
TEXT_TABLES = {"documents"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df) if name in TEXT_TABLES else df


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Occupations: a vector, a group label and a wage each."""
    e = table(spark, sf_dir, "embeddings")
    o = table(spark, sf_dir, "orders")
    return e.join(o, e.vec_id == o.o_orderkey).select(
        F.col("vec_id").alias("id"),
        F.col("embedding").cast("array<double>").alias("vec"),
        F.col("label").cast("bigint").alias("label"),
        (F.col("o_totalprice") / 3.0).alias("wage"),
        F.col("o_orderpriority").alias("title"),
    )


def with_groupings(df: DataFrame) -> DataFrame:
    """Four stand-in groupings, the last with noise."""
    label = F.col("label")
    return df.withColumns(
        {
            "cluster_kmeans": label,
            "cluster_gmm": label % 4,
            "cluster_agglom": label % 3,
            "cluster_hdbscan": F.when(label == 9, F.lit(-1)).otherwise(label).cast("bigint"),
        }
    )


def described(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Occupations that have a description."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    return entities(spark, sf_dir).join(d, "id")


def described_with_pay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every described occupation that has a wage; its text is still to be encoded."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    o = table(spark, sf_dir, "orders")
    return d.join(o, d.id == o.o_orderkey).select(
        "id", "text", (F.col("id") % 10).alias("label"), (F.col("o_totalprice") / 3.0).alias("wage"),
        F.col("o_orderpriority").alias("title"), F.array(F.lit(1.0)).alias("vec"),
    )


def wage_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pay by part, with the part's type as parent and the customer's nation as state."""
    l = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_extendedprice")
    p = table(spark, sf_dir, "part").select("p_partkey", "p_type")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    return (
        l.join(p, l.l_partkey == p.p_partkey)
        .join(o, l.l_orderkey == o.o_orderkey)
        .join(c, o.o_custkey == c.c_custkey)
        .select(
            F.col("l_partkey").alias("code"),
            F.col("p_type").alias("parent"),
            F.col("c_nationkey").alias("state"),
            F.col("l_extendedprice").alias("value"),
        )
    )

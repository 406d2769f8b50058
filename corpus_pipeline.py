"""Documents to training tokens: five stages, each written before the next reads it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradus.llm import bpe, common, mixing, quality, repeats, simhash

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _measured(docs: DataFrame) -> DataFrame:
    """The columns of documents with the length of the text as it is now; a null text stays null."""
    return docs.select("doc_id", "text", "lang", "source", F.length("text").cast("bigint").alias("n_chars"))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that fail the rules go; so do documents that the base rules reject or that lose over half of their words."""
    kept = quality.kept_rows(quality.judge(docs.select(COLUMNS)))
    return _measured(kept.select("_row.doc_id", F.col("cleaned").alias("text"), "_row.lang", "_row.source"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that chains of near fingerprints connect: three-word shingles, two bits at most."""
    return simhash.first_of_groups(docs.select(COLUMNS))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of fifty bytes or more that an earlier document has go, in whole characters; all documents stay."""
    out = repeats.remove_repeats(docs.select(COLUMNS), whole_characters=True)
    return _measured(out.select("_row.doc_id", F.col("kept").cast("string").alias("text"), "_row.lang", "_row.source"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated to their sources' target weights, shuffled."""
    return mixing.mix(docs.select(COLUMNS)).select("_row.*")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Number and digest of every document's ids, and digest of what they decode to."""
    return bpe.digests(bpe.encode(docs.select("doc_id", "text")))


STAGES = [
    ("quality rules", quality_rules),
    ("near duplicates", near_duplicates),
    ("repeated passages", repeated_passages),
    ("mixture", mixture),
    ("tokens", tokens),
]

# Fingerprints and byte-pair encoding have no SQL; tests compare the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Result of the last stage; every other one is written to the shared folder and read again."""
    docs = common.documents(spark, sf_dir)
    for _, stage in STAGES[:-1]:
        docs = common.written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)

"""Employers and job boards at occupation grain."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradus import fixed
from gradus.functions import text
from gradus.operators import matching, tables

COLUMNS = ["soc_code", "occ_title", "employer_name", "agc_type", "url", "url_type", "source_type"]
GENERAL_TYPE = "General Contractors"
MEMBER_TYPES = (GENERAL_TYPE, "Specialty Contractors")
# Board rows come after every member when the first of two equal rows is kept.
BOARD_OFFSET = 1 << 40


def clean_members(raw: DataFrame) -> DataFrame:
    """Named members of the two kinds, trimmed; ``raw`` has an ``ordinal``."""
    listed = raw.where(F.col("agc_type").isin(*MEMBER_TYPES) & (F.coalesce("employer_name", F.lit("")) != ""))
    return listed.select(
        text.strip(F.col("agc_type")).alias("agc_type"), text.strip(F.col("employer_name")).alias("employer_name"), "ordinal"
    )


def company_links(raw: DataFrame) -> DataFrame:
    """Link per company in list order: a repeated company keeps its place and its last link."""
    listed = raw.where("company IS NOT NULL AND url IS NOT NULL").withColumn("company", text.strip(F.lower("company")))
    return tables.last_value_first_place(listed, "company", "url", "ordinal")


def member_rows(
    members: DataFrame, codes: DataFrame, full_set: Column, links: DataFrame, titles: DataFrame,
    search_base: str, search_suffix: str = "", min_length: int = 6,
) -> DataFrame:
    """Members at code grain with their own site or a search address."""
    named = members.withColumn("_name", text.normalize_name(F.col("employer_name")))
    sites = links.withColumn("_link_name", text.normalize_name(F.col("company")))
    matched = matching.first_match(
        named, sites.drop("company"), "ordinal", "_name", "_link_name", "url", "ordinal", "_site", min_length
    )
    expanded = tables.expand_codes(
        matched, codes, "employer_name", "soc_codes", full_set, F.col("agc_type") == GENERAL_TYPE, fixed.GENERAL, "soc_code"
    )
    titled = expanded.join(titles.select("soc_code", "occ_title"), "soc_code", "left").withColumn(
        "occ_title", F.coalesce("occ_title", F.lit(""))
    )
    return titled.withColumns(
        {
            "url": F.coalesce("_site", text.search_url(F.col("occ_title"), search_base, search_suffix)),
            "url_type": F.when(F.col("_site").isNotNull(), "company_site").otherwise("indeed_fallback"),
            "source_type": F.lit("local_employer"),
        }
    ).drop("_name", "_site")


def board_rows(boards: DataFrame, titles: DataFrame, search_base: str, search_suffix: str = "") -> DataFrame:
    """Job boards at code grain; a board without an address gets one search address, that of
    its first code."""
    ordinal = F.col("ordinal") + BOARD_OFFSET
    rows = boards.select(
        F.col("board").alias("employer_name"), F.col("scope").alias("agc_type"), "url", ordinal.alias("ordinal"),
        F.get("soc_codes", F.lit(0)).alias("_first"), F.explode("soc_codes").alias("soc_code"),
    )
    names = titles.select("soc_code", "occ_title")
    firsts = names.select(F.col("soc_code").alias("_first"), F.col("occ_title").alias("_first_title"))
    blank = F.lit("")
    return (
        rows.join(names, "soc_code", "left")
        .join(firsts, "_first", "left")
        .withColumns(
            {
                "occ_title": F.coalesce("occ_title", blank),
                "url": F.coalesce("url", text.search_url(F.coalesce("_first_title", blank), search_base, search_suffix)),
                "url_type": F.lit("job_board"), "source_type": F.lit("job_board"),
            }
        )
        .drop("_first", "_first_title")
    )


def build_employers(member_table: DataFrame, board_table: DataFrame) -> DataFrame:
    """Both kinds together, the first row per code and employer, sorted."""
    both = tables.union_aligned([member_table, board_table])
    first = tables.keep_first(both, ["soc_code", "employer_name"], ["ordinal"])
    return first.select(*COLUMNS).orderBy("soc_code", "source_type", "employer_name")


def counts(employers: DataFrame) -> DataFrame:
    return tables.frequency(employers, "source_type")


def children_of(children: DataFrame, code: str) -> DataFrame:
    """Children of one code with their number on every row; no row when there are none."""
    mine = children.where(F.col("soc_code") == code)
    return mine.withColumn("count", F.lit(mine.count()))

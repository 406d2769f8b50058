"""Training programs: four sources under one schema, mapped to occupations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradus.functions import text
from gradus.operators import tables

COLUMNS = ["soc_code", "occ_title", "program_name", "college", "program_type", "credential", "url", "source"]


def community(programs: DataFrame, colleges: DataFrame | None = None) -> DataFrame:
    """Community-college programs; ``colleges`` (short, full) expands abbreviations."""
    out = programs.dropna(subset=["program_name"]).withColumns(
        {"program_type": text.credential_type(F.col("credential")), "source": F.lit("community_college")}
    )
    return tables.lookup_or_self(out, "college", colleges, "short", "full") if colleges is not None else out


def initiatives(programs: DataFrame) -> DataFrame:
    return programs.dropna(subset=["program_name"]).select(
        "program_name", "url", F.lit("Workforce Initiative").alias("college"), F.col("focus").alias("credential"),
        F.lit("bootcamp").alias("program_type"), F.lit("workforce_initiative").alias("source"),
    )


def university(programs: DataFrame, source: str = "university") -> DataFrame:
    return programs.dropna(subset=["program_name"]).select(
        "college", "program_name", "credential", F.lit("university").alias("program_type"),
        text.unwrap_url(F.col("url")).alias("url"), F.lit(source).alias("source"),
    )


def apprenticeships(programs: DataFrame, sponsor: str, url: str, excluded: Sequence[str] = ()) -> DataFrame:
    kept = programs.dropna(subset=["program_name"])
    if excluded:
        kept = kept.where(~F.col("program_name").isin(*excluded))
    return kept.select(
        "program_name", F.lit(sponsor).alias("college"), F.lit("Apprenticeship").alias("credential"),
        F.lit("apprenticeship").alias("program_type"), F.lit(url).alias("url"), F.lit("agc_apprenticeship").alias("source"),
    )


def build_programs(sources: list[DataFrame], mapping: DataFrame, occupations: DataFrame) -> DataFrame:
    """One row per program and mapped code, with the title of the code where it is known.

    ``mapping`` has ``program_name, soc_codes``; a program without codes disappears.
    """
    programs = tables.attach_codes(tables.union_aligned(sources), mapping, "program_name", "soc_codes", "soc_code")
    titled = programs.join(occupations.select("soc_code", "occ_title"), "soc_code", "left")
    return titled.select(*COLUMNS).orderBy("soc_code", "program_type", "program_name", "college")


def coverage(programs: DataFrame, occupations: DataFrame) -> dict[str, DataFrame]:
    return {
        "counts": tables.coverage(occupations, programs, "soc_code"),
        "distinct": programs.agg(
            F.countDistinct("soc_code").alias("n_codes"), F.countDistinct("program_name").alias("n_programs")
        ),
        "missing": tables.uncovered(occupations, programs, "soc_code").select("soc_code", "occ_title"),
    }

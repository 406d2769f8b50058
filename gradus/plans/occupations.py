"""Occupation master: clean codes, wages with their origin, skill and task text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradus.functions import numeric, text
from gradus.operators import tables
from gradus.schemas import require_columns

SOURCE_NAMES = ("home", "home_parent", "neighbour_avg", "national")


def clean_occupations(raw: DataFrame) -> DataFrame:
    """Rows that carry a code, the first of each code; ``raw`` has an ``ordinal``."""
    require_columns(raw, ["soc_code", "occ_title", "ordinal"])
    listed = raw.where(text.is_code(F.col("soc_code"))).withColumn("soc_code", text.clean_code(F.col("soc_code")))
    return tables.keep_first(listed, ["soc_code"], ["ordinal"])


def clean_wages(raw: DataFrame) -> DataFrame:
    """``code, parent, state, wage`` with both code suffixes removed and markers as NULL."""
    return raw.select(
        text.clean_code(F.col("OCC_CODE"), (".00", ".01")).alias("code"),
        F.col("PRIM_STATE").alias("state"),
        numeric.to_double(F.col("A_MEDIAN")).alias("wage"),
    ).withColumn("parent", text.parent_code(F.col("code")))


def wage_levels(home: str, neighbours: Sequence[str], names: Sequence[str] = SOURCE_NAMES) -> list[tables.Level]:
    """Home state, its parent code, neighbouring states, the nation (rows without a state)."""
    state = F.col("state")
    return [
        tables.Level(names[0], state == home, "code", "soc_code"),
        tables.Level(names[1], state == home, "parent", "soc_code"),
        tables.Level(names[2], state.isin(*neighbours), "code", "soc_code"),
        tables.Level(names[3], state.isNull(), "code", "soc_code"),
    ]


def average_outside(wages: DataFrame, codes: Sequence[str], excluded: Sequence[str], source: str) -> DataFrame:
    """Override rows: mean over all states but the excluded ones; rows without a state count."""
    kept = wages.where(F.col("code").isin(*codes) & ~F.coalesce(F.col("state").isin(*excluded), F.lit(False)))
    return kept.groupBy(F.col("code").alias("soc_code")).agg(F.avg("wage").alias("median_wage_me")).withColumn(
        "wage_source", F.lit(source)
    )


def described_text(rows: DataFrame, code: str, value: str, out: str) -> DataFrame:
    """Distinct values of every cleaned code as one text."""
    cleaned = rows.withColumn("soc_code", text.clean_code(F.col(code)))
    return tables.ordered_distinct_concat(cleaned, ["soc_code"], value, "ordinal", out)


def build_occupations(
    raw: DataFrame, wages: DataFrame, skills: DataFrame, tasks: DataFrame, home: str, neighbours: Sequence[str],
    wage_overrides: DataFrame | None = None, skill_overrides: DataFrame | None = None,
    averaged_codes: Sequence[str] = (), excluded_states: Sequence[str] = ("PR", "GU", "VI"),
    names: Sequence[str] = SOURCE_NAMES, averaged_name: str = "continental_avg",
) -> DataFrame:
    """The occupation master. ``raw``, ``skills`` and ``tasks`` carry an ``ordinal``.

    ``wage_overrides`` (soc_code, median_wage_me, wage_source) and ``skill_overrides``
    (soc_code, skill_description) patch single codes.
    """
    occupations = clean_occupations(raw)
    observed = clean_wages(wages)
    master = tables.fallback_with_provenance(
        occupations, observed, "wage", wage_levels(home, neighbours, names), "code", "median_wage_me", "wage_source"
    )
    patches = [wage_overrides] if wage_overrides is not None else []
    if averaged_codes:
        patches.append(average_outside(observed, averaged_codes, excluded_states, averaged_name))
    for overrides in patches:
        master = tables.patch(master, overrides, "soc_code")

    own = described_text(skills.where("`Scale ID` = 'IM'"), "O*NET-SOC Code", "Element Name", out="skill_description")
    # Texts of the codes under a parent, in code order, stand in for a parent without its own.
    place = own.withColumn("parent", text.parent_code(F.col("soc_code")))
    by_parent = tables.ordered_distinct_concat(place, ["parent"], "skill_description", "soc_code", "_parent_text")
    task_text = described_text(tasks.where("`Task Type` = 'Core'"), "O*NET-SOC Code", "Task", out="_tasks")
    master = (
        master.join(own, "soc_code", "left")
        .join(by_parent.withColumnRenamed("parent", "soc_code"), "soc_code", "left")
        .withColumn("skill_description", F.coalesce("skill_description", "_parent_text"))
        .drop("_parent_text")
    )
    if skill_overrides is not None:
        master = tables.patch(master, skill_overrides, "soc_code")
    return (
        master.join(task_text, "soc_code", "left")
        .withColumn("skill_description", text.join_sections(F.col("_tasks"), F.col("skill_description")))
        .drop("_tasks")
    )


def audit(master: DataFrame) -> dict[str, DataFrame]:
    """Wage origins by frequency, occupations still without a wage, text lengths."""
    return {
        "wage_sources": tables.frequency(master, "wage_source"),
        "still_missing": master.where("wage_source = 'Missing'").select("soc_code", "occ_title"),
        "missing_values": tables.missing_counts(master, ["median_wage_me", "skill_description"]),
        "text_lengths": master.select("occ_title", F.length("skill_description").alias("desc_len")),
    }

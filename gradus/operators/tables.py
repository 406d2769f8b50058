"""Cleaning, joining and rolling up tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradus.operators.ranking import pages
from gradus.session import cut_lineage


def keep_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key, the first in the given order.

    The rank filter is applied on the map side too, so a hot key sends one row per task.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def last_value_first_place(df: DataFrame, key: str, value: str, ordinal: str) -> DataFrame:
    """One row per key as a dictionary build leaves it: place of the first, value of the last."""
    return df.groupBy(key).agg(
        F.max_by(value, ordinal).alias(value), F.min(ordinal).alias(ordinal)
    )


def ordered_distinct_concat(
    df: DataFrame, keys: list[str], value: str, ordinal: str, out: str, sep: str = ", "
) -> DataFrame:
    """Distinct values of each key joined in order of first appearance.

    Repeats collapse before the values of a key meet, so the second step only ever sees
    what the result string holds. A key with nothing but NULLs gives an empty string.
    """
    firsts = df.dropna(subset=keys).groupBy(*keys, value).agg(F.min(ordinal).alias("_o"))
    item = F.when(F.col(value).isNotNull(), F.struct("_o", F.col(value).alias("v")))
    return firsts.groupBy(*keys).agg(
        F.concat_ws(sep, F.transform(F.sort_array(F.collect_list(item)), lambda s: s["v"])).alias(out)
    )


def ordered_distinct_pages(
    df: DataFrame, keys: list[str], value: str, ordinal: str, out: str, sep: str = ", ", page_size: int = 1_000
) -> DataFrame:
    """``keys, page, out``: the text of ``ordered_distinct_concat`` in pages of ``page_size`` values, for keys whose text has no bound.

    Pages in order, one after the other, are the whole text: from the second on a page begins with ``sep``. ``ordinal`` is an
    integer; values that first appear at the same one go by value. A key with nothing but NULLs has one empty page.
    """
    firsts = df.dropna(subset=keys).groupBy(*keys, value).agg(F.min(ordinal).alias("_o"))
    listed = pages(firsts.where(F.col(value).isNotNull()), keys, "_o", F.col(value), "_items", page_size, tie=value)
    text = F.concat(F.when(F.col("page") > 0, F.lit(sep)).otherwise(""), F.array_join("_items", sep))
    empty = firsts.select(*keys).distinct().join(listed.select(*keys), keys, "left_anti")
    return listed.select(*keys, "page", text.alias(out)).unionByName(empty.select(*keys, F.lit(0).alias("page"), F.lit("").alias(out)))


def parent_texts(
    entities: DataFrame, df: DataFrame, key: str, parent: str, value: str, ordinal: str, out: str, sep: str = ", "
) -> DataFrame:
    """``key, out`` for every entity without a row in ``df``: the texts of its parent's other children in key order.

    ``entities`` has ``key, parent``; ``df`` is what ``ordered_distinct_concat`` makes the children's own texts from. A
    parent's text is as long as all of its children's, so it is only put together where a child asks, and only that
    child's row carries it.
    """
    lacking = cut_lineage(entities.select(key, parent).join(df.select(key).distinct(), key, "left_anti"))
    siblings = entities.select(key, parent).join(lacking.select(parent).distinct(), parent, "left_semi")
    own = ordered_distinct_concat(df.join(siblings.select(key), key, "left_semi"), [key], value, ordinal, out, sep)
    texts = ordered_distinct_concat(own.join(siblings, key), [parent], out, key, out, sep)
    return lacking.join(texts, parent).select(key, out)


@dataclass(frozen=True)
class Level:
    """One step of a fallback: the mean over observations that satisfy ``where``,
    taken per observation column ``grain`` and looked up by entity column ``key``."""

    source: str
    where: Column
    grain: str
    key: str


def level_means(obs: DataFrame, value: str, levels: list[Level], fine: str) -> dict[str, DataFrame]:
    """Table per grain with the mean of level i in ``_level{i}``; the observations are shuffled once.

    Conditional sums and counts of every level are taken per fine grain in one pass with
    map-side combining; coarser grains add those up. ``fine`` must determine each grain.
    """
    grains = list(dict.fromkeys([fine, *(level.grain for level in levels)]))
    v = F.col(value)
    aggs = []
    for i, level in enumerate(levels):
        hit = F.when(F.coalesce(level.where, F.lit(False)), v)
        aggs += [F.sum(hit).alias(f"s{i}"), F.count(hit).alias(f"n{i}")]
    base = obs.where(v.isNotNull() & ~F.isnan(v)).groupBy(*grains).agg(*aggs)
    if len(grains) > 1:
        # Several roll-ups read this; column pruning would otherwise give each its own scan.
        base = cut_lineage(base)
    out = {}
    for grain in dict.fromkeys(level.grain for level in levels):
        mine = [(i, level) for i, level in enumerate(levels) if level.grain == grain]
        rolled = base.where(F.col(grain).isNotNull())
        sums = [F.sum(f"{c}{i}").alias(f"{c}{i}") for i, _ in mine for c in "sn"]
        rolled = rolled.groupBy(grain).agg(*sums)
        means = [
            F.when(F.col(f"n{i}") > 0, F.col(f"s{i}") / F.col(f"n{i}")).alias(f"_level{i}")
            for i, _ in mine
        ]
        out[grain] = rolled.select(grain, *means)
    return out


def fallback_with_provenance(
    entities: DataFrame,
    obs: DataFrame,
    value: str,
    levels: list[Level],
    fine: str,
    out: str,
    out_source: str,
    missing: str = "Missing",
) -> DataFrame:
    """Attach the first available level mean and the name of the level it came from."""
    means = level_means(obs, value, levels, fine)
    joined = entities
    for key, grain in dict.fromkeys((level.key, level.grain) for level in levels):
        mine = [f"_level{i}" for i, l in enumerate(levels) if (l.key, l.grain) == (key, grain)]
        right = means[grain].select(F.col(grain).alias("_k"), *mine)
        joined = joined.join(right, joined[key] == right["_k"], "left").drop("_k")
    columns = [f"_level{i}" for i in range(len(levels))]
    source = F
    for column, level in zip(columns, levels):
        source = source.when(F.col(column).isNotNull(), F.lit(level.source))
    return joined.withColumns(
        {out: F.coalesce(*columns), out_source: source.otherwise(F.lit(missing))}
    ).drop(*columns)


def patch(df: DataFrame, overrides: DataFrame, key: str) -> DataFrame:
    """Overwrite columns of the rows an override table names; its NULLs change nothing."""
    columns = [c for c in overrides.columns if c != key]
    renamed = overrides.withColumnsRenamed({c: f"_new_{c}" for c in columns})
    return (
        df.join(renamed, key, "left")
        .withColumns({c: F.coalesce(f"_new_{c}", c) for c in columns})
        .drop(*renamed.drop(key).columns)
        .select(*df.columns)
    )


def union_aligned(sources: list[DataFrame]) -> DataFrame:
    """UNION ALL by column name; absent columns become NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), sources)


def lookup_or_self(df: DataFrame, column: str, table: DataFrame, key: str, value: str) -> DataFrame:
    """Replace a column by its entry in a lookup table, or leave it."""
    renamed = table.select(F.col(key).alias("_k"), F.col(value).alias("_v"))
    return (
        df.join(renamed, F.col(column) == F.col("_k"), "left")
        .withColumn(column, F.coalesce("_v", column))
        .drop("_k", "_v")
    )


def attach_codes(programs: DataFrame, mapping: DataFrame, name: str, codes: str, code: str) -> DataFrame:
    """One row per program and mapped code; programs without a code disappear."""
    pairs = mapping.select(name, F.explode(codes).alias(code))
    return programs.join(pairs, name, "inner")


def uncovered(entities: DataFrame, children: DataFrame, key: str) -> DataFrame:
    return entities.join(children.select(key), key, "left_anti")


def coverage(entities: DataFrame, children: DataFrame, key: str) -> DataFrame:
    """One row: entities in all, with and without a child, and child rows."""
    has = children.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_n"))
    return (
        entities.select(key)
        .distinct()
        .join(has, key, "left")
        .agg(
            F.count("*").alias("n_entities"),
            F.count_if(F.col("_n").isNotNull()).alias("n_covered"),
            F.count_if(F.col("_n").isNull()).alias("n_missing"),
            F.coalesce(F.sum("_n"), F.lit(0)).cast("bigint").alias("n_children"),
        )
    )


def frequency(df: DataFrame, column: str, out: str = "n") -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias(out)).orderBy(F.desc(out), column)


def missing_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.agg(*[F.count_if(F.col(c).isNull()).alias(f"missing_{c}") for c in columns])


def extend_cache(
    wanted: DataFrame, cache: DataFrame, key: str, mapper: Callable[[DataFrame], DataFrame]
) -> DataFrame:
    """Cached mapping plus the mapper's answer for keys it does not hold yet.

    Write the result to a new place: the plan still reads the old cache.
    """
    fresh = wanted.select(key).where(F.col(key).isNotNull()).distinct().join(cache, key, "left_anti")
    return cache.unionByName(mapper(fresh).select(*cache.columns))


def expand_codes(
    members: DataFrame,
    mapping: DataFrame,
    name: str,
    codes: str,
    full_set: Column,
    takes_all: Column,
    general: str,
    code: str,
) -> DataFrame:
    """Members at code grain: those that take everything, and those mapped to the general
    marker or to nothing, get the full code set; the others their own codes."""
    joined = members.join(mapping, name, "left")
    own = F.coalesce(F.col(codes), F.array(F.lit(general)))
    picked = F.when(takes_all | (own == F.array(F.lit(general))), full_set).otherwise(own)
    return joined.withColumn(codes, picked).withColumn(code, F.explode(codes)).drop(codes)

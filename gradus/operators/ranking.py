"""Ranks, pages and medians that hold when one key has most of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradus.session import cut_lineage


def top_n(df: DataFrame, keys: list[str], order: list[Column], n: Column | int, out: str = "rank") -> DataFrame:
    """The first n rows per key with their 1-based rank.

    With an integer n the limit is also applied before the shuffle.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(out, F.row_number().over(w)).where(F.col(out) <= n)


def global_index(df: DataFrame, order: list[Column], out: str, small: int = 100_000) -> DataFrame:
    """0-based position of every row in a total order.

    A counted small table is ranked by one window. Otherwise rows are range-sorted over all
    tasks, numbered within their partition, and shifted by the rows of earlier partitions.
    """
    if df.limit(small + 1).count() <= small:
        return df.withColumn(out, F.row_number().over(Window.orderBy(*order)) - 1)
    numbered = cut_lineage(df.orderBy(*order).withColumn("_mid", F.monotonically_increasing_id()))
    part = F.shiftright("_mid", 33)
    # One row per partition of the sort: at most spark.sql.shuffle.partitions rows.
    sizes = numbered.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = sizes.select(
        "_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before")
    )
    return (
        numbered.withColumn("_part", part)
        .join(F.broadcast(before), "_part")
        .withColumn(out, F.col("_before") + F.col("_mid").bitwiseAND(F.lit((1 << 33) - 1)))
        .drop("_part", "_mid", "_before")
    )


def rank_in_key(df: DataFrame, keys: list[str], ordinal: str, out: str, width: int = 1 << 20, tie: str | None = None) -> DataFrame:
    """0-based rank by an integer ordinal within each key; it is unique, or with ``tie`` it is.

    The ordinal line is cut into stretches of ``width``; no window sees more than ``width``
    rows of a key, and counted stretches give the offsets.
    """
    stretched = df.withColumn("_s", F.floor(F.col(ordinal) / F.lit(width)))
    counts = stretched.groupBy(*keys, "_s").agg(F.count("*").alias("_n"))
    w = Window.partitionBy(*keys).orderBy("_s")
    before = counts.select(*keys, "_s", (F.sum("_n").over(w) - F.col("_n")).alias("_before"))
    local = F.row_number().over(Window.partitionBy(*keys, "_s").orderBy(ordinal, *([tie] if tie else []))) - 1
    return (
        stretched.withColumn("_local", local)
        .join(before, [*keys, "_s"])
        .withColumn(out, F.col("_before") + F.col("_local"))
        .drop("_s", "_local", "_before")
    )


def pages(
    df: DataFrame, keys: list[str], ordinal: str, item: Column, out: str, page_size: int = 1_000, tie: str | None = None
) -> DataFrame:
    """Children of each key as ordered lists of at most ``page_size`` items.

    Ordinary keys have the single page 0; a hot key gets as many pages as it needs, so no
    row or task has to hold all its children.
    """
    ranked = rank_in_key(df.where(" AND ".join(f"{k} IS NOT NULL" for k in keys)), keys, ordinal, "_r", tie=tie)
    entry = F.struct(F.col("_r"), item.alias("v"))
    return (
        ranked.groupBy(*keys, F.floor(F.col("_r") / page_size).cast("int").alias("page"))
        .agg(F.sort_array(F.collect_list(entry)).alias("_items"))
        .select(*keys, "page", F.transform("_items", lambda s: s["v"]).alias(out))
    )


SKETCH = 10_000  # a quantile sketch is right to one in this many ranks


def _bracketed(clean: DataFrame, keys: list[str], sizes: DataFrame, bound: int) -> DataFrame:
    """``keys, _v, _c, _below``: values around the middle with their counts, and how many rows lie below all of them.

    Groups of more than ``bound`` rows keep what lies between two quantiles of the sketch, next to the middle on both sides;
    others keep all. Where counting shows that a bracket misses the middle, the group keeps all too.
    """
    wide = F.col("n_values") <= bound
    inf = F.lit(float("inf"))
    ends = sizes.select(*keys, "n_values", F.when(wide, -inf).otherwise(F.col("_q")[0]).alias("_from"), F.when(wide, inf).otherwise(F.col("_q")[1]).alias("_to"))
    counted = cut_lineage(
        clean.join(ends, keys).where("_v <= _to").groupBy(*keys, "n_values", F.when(F.col("_v") >= F.col("_from"), F.col("_v")).alias("_v"))
        .agg(F.count("*").alias("_c"))
    )
    below = F.coalesce(F.sum(F.when(F.col("_v").isNull(), F.col("_c"))), F.lit(0))
    held = counted.groupBy(*keys, "n_values").agg(below.alias("_below"), F.sum("_c").alias("_upto"))
    lower, upper = F.floor((F.col("n_values") - 1) / 2), F.floor(F.col("n_values") / 2)
    held = cut_lineage(held.withColumn("_hit", (lower >= F.col("_below")) & (upper < F.col("_upto"))))
    kept = counted.where("_v IS NOT NULL").drop("n_values").join(held.where("_hit").drop("_upto", "_hit"), keys)
    missed = held.where("NOT _hit")
    if missed.isEmpty():
        return kept
    whole = clean.join(missed.select(*keys, "n_values"), keys).groupBy(*keys, "n_values", "_v").agg(F.count("*").alias("_c"))
    return cut_lineage(kept.unionByName(whole.withColumn("_below", F.lit(0).cast("bigint"))))


def group_medians(
    df: DataFrame, keys: list[str], value: str, out: str, bound: int = 1_000_000, fan: int = 1024, sketch: int = SKETCH
) -> DataFrame:
    """Exact interpolated median and row count per key, NULL and NaN values left out.

    One scan counts the groups and sketches their quantiles. If none has more than ``bound`` rows, the built-in exact median
    takes the second scan. Otherwise the second scan counts the values that the sketch puts around the middle (some
    4 in ``sketch`` of a group), which settles it; the rows are not read again. Should more than ``bound`` different values
    lie there, counts over ``fan`` equal ranges of the finite ones, infinities apart, narrow those down: least and
    greatest values never share a range, so every pass narrows.
    """
    v = F.col(value)
    clean = df.where(v.isNotNull() & ~F.isnan(v)).select(*keys, v.cast("double").alias("_v"))
    near = [0.5 - 2 / sketch, 0.5 + 2 / sketch]
    sizes = cut_lineage(clean.groupBy(*keys).agg(F.count("*").alias("n_values"), F.percentile_approx("_v", near, sketch).alias("_q")))
    largest = sizes.agg(F.max("n_values")).first()[0]
    if largest is None or largest <= bound:
        return clean.groupBy(*keys).agg(F.median("_v").alias(out), F.count("*").alias("n_values"))

    seen = _bracketed(clean, keys, sizes, bound)
    finite = F.when(F.abs("_v") < F.lit(float("inf")), F.col("_v"))
    extent = (
        F.count("*").alias("_cnt"), F.sum("_c").alias("_rows"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"),
        F.min(finite).alias("_flo"), F.max(finite).alias("_fhi"),
    )
    middles = F.array_distinct(F.array(F.floor((F.col("n_values") - 1) / 2), F.floor(F.col("n_values") / 2)))
    targets = cut_lineage(
        seen.groupBy(*keys, "n_values", "_below").agg(*extent)
        .withColumn("_id", F.explode(middles)).withColumn("_rank", F.col("_id") - F.col("_below")).drop("_below")
    )
    values = seen.select(*keys, "_v", "_c")
    unsettled = (F.col("_cnt") > bound) & (F.col("_hi") > F.col("_lo"))
    while not targets.where(unsettled).isEmpty():
        wide = targets.where(unsettled)
        # halves, so that the width of the range is finite too
        low, high = F.col("_flo") / 2, F.col("_fhi") / 2
        step = F.when(high > low, (F.col("_v") / 2 - low) / (high - low) * fan).otherwise(F.lit(0.0))
        at = F.when(F.col("_v") == float("-inf"), -1).when(F.col("_v") == float("inf"), fan).otherwise(
            F.when(F.col("_v") == F.col("_fhi"), fan - 1).otherwise(F.least(F.floor(step), F.lit(fan - 1)))
        )
        ranged = (
            values.join(wide, keys)
            .where("_v BETWEEN _lo AND _hi")
            .groupBy(*keys, "_id", "_rank", "n_values", at.alias("_bin"))
            .agg(*extent)
        )
        w = Window.partitionBy(*keys, "_id").orderBy("_bin")
        hit = (
            ranged.withColumn("_before", F.sum("_rows").over(w) - F.col("_rows"))
            .where("_rank >= _before AND _rank < _before + _rows")
            .withColumn("_rank", F.col("_rank") - F.col("_before"))
            .select(*targets.columns)
        )
        targets = cut_lineage(targets.where(~unsettled).unionByName(hit))

    w = Window.partitionBy(*keys, "_id").orderBy("_v")
    by_value = (
        values.join(targets.where("_hi > _lo"), keys)
        .where("_v BETWEEN _lo AND _hi")
        .withColumn("_before", F.sum("_c").over(w) - F.col("_c"))
        .where("_rank >= _before AND _rank < _before + _c")
    )
    same = targets.where("_hi = _lo").withColumn("_v", F.col("_lo"))
    found = by_value.select(*keys, "n_values", "_v").unionByName(same.select(*keys, "n_values", "_v"))
    return found.groupBy(*keys).agg(F.avg("_v").alias(out), F.first("n_values").alias("n_values"))


def relabel_by_median(df: DataFrame, label: str, value: str, out: str, noise: int = -1, **median_args) -> DataFrame:
    """Renumber groups 0, 1, ... by rising median of a value; the noise label stays."""
    medians = group_medians(df.where(F.col(label) != noise), [label], value, "_median", **median_args)
    # Groups without any value still need a number: they come last.
    groups = df.where(F.col(label) != noise).select(label).distinct().join(medians, label, "left")
    order = [F.col("_median").asc_nulls_last(), F.col(label)]
    order_table = global_index(groups, order, "_new").select(F.col(label).alias("_old"), "_new")
    return (
        df.join(order_table, F.col(label) == F.col("_old"), "left")
        .withColumn(out, F.coalesce("_new", F.lit(noise)).cast("int"))
        .drop("_old", "_new")
    )

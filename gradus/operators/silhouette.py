"""Exact Euclidean silhouette."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from gradus.operators import blocks, cells

# Groupings of at most that many groups are scored together, from sums to every group; one with more on its own.
FEW_GROUPS = 64
TILE_COLUMNS = 512  # of distances in double precision
_PARTIAL = "key BIGINT, own BIGINT, a DOUBLE, b DOUBLE, grp BIGINT, total DOUBLE"


def _distance_sums(points: pa.Table, others: pa.Table) -> pa.Table:
    """Mean distances to groups held whole, distance sums to pieces of larger groups."""
    x, y = blocks.matrix(points["vec"]), blocks.matrix(others["vec"])
    key, own = (blocks.numbers(points[c], np.int64) for c in ("key", "label"))
    label = blocks.numbers(others["label"], np.int64)
    order = np.argsort(label, kind="stable")
    y, label = y[order], label[order]
    other_key = blocks.numbers(others["key"], np.int64)[order]
    groups, starts = np.unique(label, return_index=True)
    size = blocks.numbers(others["size"])[order][starts]
    whole = np.asarray(others["whole"].to_pylist(), dtype=bool)[order][starts]
    parts = []
    for piece in blocks.row_chunks(len(key), len(label)):
        distance = np.sqrt(blocks.square_distances(x[piece], y))
        _, same_row, same_col = np.intersect1d(key[piece], other_key, return_indices=True)
        distance[same_row, same_col] = 0.0
        sums = np.add.reduceat(distance, starts, axis=1)
        mine = own[piece][:, None] == groups[None, :]
        in_own = np.where(mine & whole, sums / np.maximum(size - 1, 1), -np.inf).max(axis=1)
        nearest = np.where(~mine & whole, sums / size, np.inf).min(axis=1)
        parts.append(_partial(key[piece], own[piece], in_own, nearest, None, None))
        for g in np.flatnonzero(~whole):
            n = len(key[piece])
            parts.append(_partial(key[piece], own[piece], None, None, np.full(n, groups[g]), sums[:, g]))
    return pa.concat_tables(parts)


def _partial(key, own, a, b, grp, total) -> pa.Table:
    def column(values, kind):
        if values is None:
            return pa.nulls(len(key), kind)
        mask = ~np.isfinite(values) if kind == pa.float64() else None
        return pa.array(values, type=kind, mask=mask)

    return pa.table(
        {
            "key": column(key, pa.int64()), "own": column(own, pa.int64()),
            "a": column(a, pa.float64()), "b": column(b, pa.float64()),
            "grp": column(grp, pa.int64()), "total": column(total, pa.float64()),
        }
    )


def silhouette_points(
    df: DataFrame, key: str, vec: str, label: str, width: int, noise: int = -1,
    held_bytes: int = blocks.HELD_BYTES, block_rows: int | None = None, n: int | None = None,
) -> DataFrame:
    """Silhouette of every row that is not noise: ``key, label, a, b, silhouette``.

    A group of at most a block's rows stays in one block and leaves only its mean; a
    larger one is spread over blocks by row hash and its distance sums are added up.
    """
    points = df.where(F.col(label) != noise).select(
        F.col(key).alias("key"), F.col(label).cast("bigint").alias("label"), F.col(vec).alias("vec")
    )
    sizes = points.groupBy("label").agg(F.count("*").alias("size"))
    n = points.count() if n is None else n
    others = points.join(sizes, "label")
    if blocks.fits(n, width, held_bytes):
        sums = blocks.against_held(points, others.withColumn("whole", F.lit(True)), _distance_sums, _PARTIAL, cells=n * n)
        merged = sums.select("key", F.col("own").alias("label"), "a", "b")
    else:
        block_rows = blocks.rows_per_block(width, block_rows, n, blocks.cores(df))
        n_blocks = blocks.block_count(n, block_rows)
        pieces = F.ceil(F.col("size") / block_rows)
        others = others.withColumn("whole", pieces == 1)
        spread = F.pmod(F.xxhash64("label", F.pmod(F.xxhash64("key"), pieces)), F.lit(n_blocks))
        sums = blocks.block_grid(
            points, others, blocks.hash_block("key", n_blocks), spread, n_blocks, n_blocks,
            _distance_sums, _PARTIAL,
        )
        # Both branches read the block results; shuffling them by point is cheaper than redoing them.
        sums = sums.groupBy("key", "own", "grp").agg(
            F.max("a").alias("a"), F.min("b").alias("b"), F.sum("total").alias("total")
        )
        mean = F.col("total") / F.when(F.col("own") == F.col("grp"), F.greatest(F.col("size") - 1, F.lit(1))).otherwise(F.col("size"))
        merged = (
            sums.join(sizes.withColumnRenamed("label", "grp"), "grp", "left")
            .select(
                "key", F.col("own").alias("label"),
                F.coalesce("a", F.when(F.col("own") == F.col("grp"), mean)).alias("a"),
                F.coalesce("b", F.when(F.col("own") != F.col("grp"), mean)).alias("b"),
            )
            .groupBy("key", "label")
            .agg(F.max("a").alias("a"), F.min("b").alias("b"))
        )
    alone = F.col("size") == 1
    value = F.when(alone | (F.greatest("a", "b") == 0), 0.0).otherwise(
        (F.col("b") - F.col("a")) / F.greatest("a", "b")
    )
    return (
        merged.join(sizes, "label")
        .select(F.col("key").alias(key), F.col("label").alias(label), "a", "b", value.alias("silhouette"))
    )


def silhouette_score(df: DataFrame, key: str, vec: str, label: str, width: int, noise: int = -1, **limits) -> float:
    """Mean silhouette to four places; -1 below four rows or two groups."""
    shape = df.where(F.col(label) != noise).agg(F.count("*"), F.countDistinct(label)).first()
    if shape[0] < 4 or shape[1] < 2:
        return -1.0
    points = silhouette_points(df, key, vec, label, width, noise, n=shape[0], **limits)
    return round(points.agg(F.avg("silhouette")).first()[0], 4)


def _members(labels: np.ndarray, groups: list[np.ndarray]) -> np.ndarray:
    return np.hstack([labels[:, [j]] == g[None, :] for j, g in enumerate(groups)]).astype(np.float64)


def _group_sums(points: pa.Table, others: pa.Table, groups: list[np.ndarray], both: bool = False) -> list[np.ndarray]:
    """Distances from each point to the rows of every group of every grouping, added up; with ``both`` from each of the others
    to the points too, of the same distances. A tile of them stays in the cache."""
    x, y = blocks.matrix(points["vec"]), blocks.matrix(others["vec"])
    key, other = (blocks.numbers(t["key"], np.int64) for t in (points, others))
    member = [_members(blocks.matrix(t["labels"]).astype(np.int64), groups) for t in (points, others)]
    place = cells.places(other, key)
    out = [np.zeros((len(key), member[0].shape[1])), np.zeros((len(other) if both else 0, member[0].shape[1]))]
    for top in range(0, len(key), cells.TILE_ROWS):
        rows = slice(top, top + cells.TILE_ROWS)
        for left in range(0, len(other), TILE_COLUMNS):
            columns = slice(left, left + TILE_COLUMNS)
            distance = blocks.square_distances(x[rows], y[columns])
            np.sqrt(distance, out=distance)
            same = np.flatnonzero((place[rows] >= left) & (place[rows] < left + TILE_COLUMNS))
            distance[same, place[rows][same] - left] = 0.0
            out[0][rows] += distance @ member[1][columns]
            if both:
                out[1][columns] += distance.T @ member[0][rows]
    return out


def _values(total: np.ndarray, label: np.ndarray, groups: list[np.ndarray], sizes: list[np.ndarray]) -> list[pa.Array]:
    """One column of silhouettes a grouping, null where a row is in none of its groups."""
    out, at = [], 0
    for j, (names, size) in enumerate(zip(groups, sizes)):
        sums = total[:, at : at + len(names)]
        at += len(names)
        own = label[:, [j]] == names[None, :]
        a = np.where(own, sums / np.maximum(size - 1, 1), 0).sum(1)
        b = np.where(own, np.inf, sums / size).min(1)
        alone = (own * size).sum(1) == 1
        most = np.maximum(a, b)
        value = np.where(alone | (most == 0), 0.0, (b - a) / np.where(most == 0, 1, most))
        out.append(pa.array(value, mask=~own.any(1)))
    return out


def silhouette_scores(
    df: DataFrame, key: str, vec: str, labels: list[str], width: int, noise: int = -1,
    held_bytes: int = blocks.HELD_BYTES, block_rows: int | None = None, few: int = FEW_GROUPS,
) -> dict[str, float]:
    """``silhouette_score`` of several groupings of the same rows, from one pass over all distances.

    Where the rows do not fit a task, each pair of blocks is met once and serves the rows of both.
    """
    named = [F.when(F.col(c) != noise, F.col(c)).alias(c) for c in labels]
    shape = df.agg(*[f(c) for c in named for f in (F.count, F.countDistinct)], F.count("*")).first()
    counts = {c: (shape[2 * i], shape[2 * i + 1]) for i, c in enumerate(labels)}
    out = {c: -1.0 for c, (n, groups) in counts.items() if n < 4 or groups < 2}
    limits = {"held_bytes": held_bytes, "block_rows": block_rows}
    out |= {c: silhouette_score(df, key, vec, c, width, noise, **limits) for c in labels if c not in out and counts[c][1] > few}
    asked = [c for c in labels if c not in out]
    if not asked:
        return out
    listed = F.array(*[F.coalesce(F.col(c).cast("bigint"), F.lit(noise)) for c in asked])
    points = df.select(F.col(key).cast("bigint").alias("key"), F.col(vec).alias("vec"), listed.alias("labels"))
    # at most ``few`` rows a grouping
    sizes = points.select(F.posexplode("labels").alias("which", "name")).where(F.col("name") != noise).groupBy("which", "name").count()
    held = sorted(tuple(r) for r in sizes.collect())
    groups = [np.array([g for w, g, _ in held if w == i]) for i in range(len(asked))]
    size = [np.array([n for w, _, n in held if w == i], np.float64) for i in range(len(asked))]
    names = [f"s{i}" for i in range(len(asked))]
    schema = ", ".join(f"{c} DOUBLE" for c in names)
    n = shape[-1]
    if blocks.fits(n, width, held_bytes):

        def solve(batch: pa.Table, others: pa.Table) -> pa.Table:
            label = blocks.matrix(batch["labels"]).astype(np.int64)
            return pa.table(_values(_group_sums(batch, others, groups)[0], label, groups, size), names=names)

        scored = blocks.against_held(points, points, solve, schema, cells=n * n)
    else:
        per_block = blocks.rows_per_block(width, block_rows, n, blocks.cores(df))
        scored = _by_block_pairs(points, groups, size, names, blocks.block_count(n, per_block))
    found = scored.agg(*[F.avg(c) for c in names]).first()
    return out | {c: round(v, 4) for c, v in zip(asked, found)}


def _by_block_pairs(points: DataFrame, groups: list[np.ndarray], size: list[np.ndarray], names: list[str], n_blocks: int) -> DataFrame:
    columns = [f"t{i}" for i in range(sum(map(len, groups)))]

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        both = left["_lb"][0] != right["_rb"][0]
        sides = [left, right] if both else [left]
        named = [[t["key"], t["labels"], *[pa.array(c) for c in total.T]] for t, total in zip(sides, _group_sums(left, right, groups, both))]
        return pa.concat_tables([pa.table(columns_, names=["key", "labels", *columns]) for columns_ in named])

    dealt = points.withColumn("_block", blocks.hash_block("key", n_blocks).cast("int"))
    from_ = lambda a, b: F.explode(F.sequence(a, b))
    lefts = dealt.withColumnRenamed("_block", "_lb").withColumn("_rb", from_(F.col("_lb"), F.lit(n_blocks - 1)))
    rights = dealt.select(*[F.col(c).alias(c) for c in points.columns], F.col("_block").alias("_rb"))
    rights = rights.withColumn("_lb", from_(F.lit(0), F.col("_rb")))
    schema = "key BIGINT, labels ARRAY<BIGINT>, " + ", ".join(f"{c} DOUBLE" for c in columns)

    arrow_schema = to_arrow_schema(StructType.fromDDL(schema))

    def each(left: pa.Table, right: pa.Table) -> pa.Table:
        return meet(left, right).cast(arrow_schema) if left.num_rows and right.num_rows else arrow_schema.empty_table()

    met = lefts.groupBy("_lb", "_rb").cogroup(rights.groupBy("_lb", "_rb")).applyInArrow(each, schema)
    added = met.groupBy("key", "labels").agg(*[F.sum(c).alias(c) for c in columns]).select("labels", F.array(*columns).alias("total"))

    def score(batches):
        for batch in batches:
            if batch.num_rows:
                table = pa.Table.from_batches([batch])
                label = blocks.matrix(table["labels"]).astype(np.int64)
                yield pa.RecordBatch.from_arrays(_values(blocks.matrix(table["total"]), label, groups, size), names=names)

    return added.mapInArrow(score, ", ".join(f"{c} DOUBLE" for c in names))

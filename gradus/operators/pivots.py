"""Blocks around pivots: vectors of one direction lie together, and far blocks are never compared.

Similarity by cosine is distance between points of the unit sphere, where the triangle inequality tells how near the rows of a
cell can be to a query at best and at worst, from the distance to the cell's pivot and the cell's radius.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from gradus.operators import blocks
from gradus.session import cut_lineage

ROUNDING = 1e-7  # of distances, which are at most 2
TIES = 4e-9  # of their squares: cosines that far apart may round to the same score


def directions(m: np.ndarray, asking: bool) -> np.ndarray:
    """Points of the unit sphere whose products are the cosines; a zero row has a direction of its own, so 0 with all others."""
    unit = blocks.unit_rows(m)
    own = np.zeros((len(m), 2))
    own[~m.any(axis=1), int(asking)] = 1.0
    return np.hstack([unit, own])


def _cells(rows: DataFrame, name: str, pivots: np.ndarray) -> DataFrame:
    """Candidate rows with the nearest pivot and how far it is."""
    schema = f"{name} BIGINT, vec ARRAY<DOUBLE>, cell INT, far DOUBLE"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = directions(blocks.matrix(pa.table({"v": batch.column("vec")})["v"]), False) if batch.num_rows else np.zeros((0, pivots.shape[1]))
            parts = [blocks.square_distances(x[p], pivots) for p in blocks.row_chunks(len(x), len(pivots))]
            d = np.concatenate(parts) if parts else np.zeros((0, len(pivots)))
            cell = d.argmin(1) if len(d) else np.zeros(0, int)
            far = blocks.exact_distances(x, pivots[cell])
            columns = [batch.column(name), batch.column("vec"), pa.array(cell.astype(np.int32)), pa.array(far)]
            yield pa.RecordBatch.from_arrays(columns, names=[name, "vec", "cell", "far"])

    return rows.mapInArrow(run, schema)


def _wanted(rows: DataFrame, name: str, pivots: np.ndarray, size: np.ndarray, radius: np.ndarray, k: int) -> DataFrame:
    """Query rows with their own cell and every cell that may hold one of their k nearest.

    Cells are taken by their worst distance until they have k rows: the k-th nearest is no farther. A cell whose best
    distance is greater has none of them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = directions(blocks.matrix(pa.table({"v": batch.column("vec")})["v"]), True)
            own, listed, count = [], [], []
            for piece in blocks.row_chunks(len(x), len(pivots)):
                d = np.sqrt(blocks.square_distances(x[piece], pivots))
                worst = np.where(size > 0, d + radius, np.inf)
                order = np.argsort(worst, axis=1, kind="stable")
                enough = np.cumsum(size[order], axis=1) >= k
                place = np.where(enough.any(axis=1), enough.argmax(axis=1), len(pivots) - 1)
                reach = np.take_along_axis(worst, np.take_along_axis(order, place[:, None], 1), 1)
                reach = np.where(enough.any(axis=1)[:, None], reach, np.inf) + ROUNDING
                need = (np.maximum(d - radius - ROUNDING, 0) ** 2 <= reach**2 + TIES) & (size > 0)
                own.append(d.argmin(1))
                listed.append(np.nonzero(need)[1])
                count.append(need.sum(1))
            at = np.concatenate([[0], np.cumsum(np.concatenate(count))]).astype(np.int32)
            cells = pa.ListArray.from_arrays(at, np.concatenate(listed).astype(np.int32))
            columns = [batch.column(name), batch.column("vec"), pa.array(np.concatenate(own).astype(np.int32)), cells]
            yield pa.RecordBatch.from_arrays(columns, names=[name, "vec", "own", "cells"])

    return rows.mapInArrow(run, f"{name} BIGINT, vec ARRAY<DOUBLE>, own INT, cells ARRAY<INT>")


def near_blocks(
    queries: DataFrame, candidates: DataFrame, k: int, n_candidates: int, width: int,
    held_bytes: int = blocks.HELD_BYTES, block_rows: int | None = None,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Queries, candidates and the pairs of blocks that may hold one of a query's k nearest.

    Both sides, ``query_id, vec`` and ``ordinal, vec``, come with the columns of their block, ``own, turn`` and
    ``cell, piece``, and of the block they meet. Pivots are the candidates with the least key hashes, one for each block's rows,
    at most what ``held_bytes`` takes; cells of more rows than a block are cut by key hash.
    """
    vec = F.col("vec").cast("array<double>").alias("vec")
    queries = queries.select(F.col("query_id").cast("bigint").alias("query_id"), vec)
    candidates = candidates.select(F.col("ordinal").cast("bigint").alias("ordinal"), vec)
    per_block = blocks.rows_per_block(width, block_rows, n_candidates, blocks.cores(candidates))
    wanted = blocks.block_count(n_candidates, per_block)
    most = min(wanted, max(1, max(held_bytes, 1 << 20) // (8 * (width + 2))))
    picked = candidates.orderBy(F.xxhash64("ordinal"), "ordinal").limit(most).select("vec").toArrow()
    pivots = directions(blocks.matrix(picked["vec"]), False)
    dealt = cut_lineage(_cells(candidates, "ordinal", pivots))
    size, radius = np.zeros(len(pivots), np.int64), np.zeros(len(pivots))
    for r in dealt.groupBy("cell").agg(F.count("*").alias("n"), F.max("far").alias("far")).collect():  # a row a pivot
        size[r["cell"]], radius[r["cell"]] = r["n"], r["far"]
    asking = cut_lineage(_wanted(queries, "query_id", pivots, size, radius, k))

    def pieces(of: DataFrame, name: str) -> DataFrame:
        counted = of.groupBy(name).agg(F.ceil(F.count("*") / per_block).cast("int").alias("_pieces"))
        return F.broadcast(counted)  # a row a pivot

    right = dealt.join(pieces(dealt, "cell"), "cell").select(
        "ordinal", "vec", "cell", F.pmod(F.xxhash64("ordinal"), F.col("_pieces")).cast("int").alias("piece")
    )
    left = asking.join(pieces(asking, "own"), "own").select(
        "query_id", "vec", "own", F.pmod(F.xxhash64("query_id"), F.col("_pieces")).cast("int").alias("turn"), F.explode("cells").alias("cell")
    )
    left = left.join(pieces(dealt, "cell"), "cell").withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("_pieces") - 1))).drop("_pieces")
    pairs = cut_lineage(left.select("own", "turn", "cell", "piece").distinct())
    return left, right.join(pairs, ["cell", "piece"]), pairs


def against_near(left: DataFrame, right: DataFrame, kernel: blocks.Kernel, schema: str) -> DataFrame:
    """Kernel over every pair of blocks of ``near_blocks``."""
    arrow_schema = to_arrow_schema(StructType.fromDDL(schema))
    names = ["own", "turn", "cell", "piece"]

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        if a.num_rows == 0 or b.num_rows == 0:
            return arrow_schema.empty_table()
        return kernel(a, b).cast(arrow_schema)

    rights = right.select(*[F.col(c).alias(c) for c in right.columns])  # fresh column identities
    return left.groupBy(*names).cogroup(rights.groupBy(*names)).applyInArrow(run, schema)

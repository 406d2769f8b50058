"""Every-row-against-every-row work as blocks of matrices.

The caller's kernel gets two Arrow tables and returns a small result (the best few, sums);
pairs are never rows. A side within a byte limit is held by all tasks while the other side
streams past without a shuffle; otherwise both are cut into blocks of a set number of rows
and each pair of blocks is one group.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

Kernel = Callable[[pa.Table, pa.Table], pa.Table]

HELD_BYTES = 16 << 20
BLOCK_BYTES = 64 << 20
CHUNK_CELLS = 4_000_000
TASK_CELLS = 1 << 26  # pairs that one task of a stream meets
LEAST_ROWS = 4096  # of a block, however many cores there are
MOST_ROWS = 1 << 16  # of a block, however many rows there are: more rows make more tasks, not longer ones


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    """List column to a float64 matrix."""
    if len(column) == 0:
        return np.zeros((0, 0))
    flat = column.combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return np.asarray(flat, dtype=np.float64).reshape(len(column), -1)


def numbers(column: pa.ChunkedArray, dtype=np.float64) -> np.ndarray:
    """Numeric column to an array, NULL as NaN for floats."""
    values = column.combine_chunks()
    if np.issubdtype(dtype, np.floating):
        values = values.cast(pa.float64()).fill_null(float("nan"))
    return values.to_numpy(zero_copy_only=False).astype(dtype, copy=False)


def unit_rows(m: np.ndarray) -> np.ndarray:
    """Rows over their length; zero rows stay zero."""
    lengths = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(lengths == 0, 1.0, lengths)


def row_chunks(n_rows: int, n_columns: int) -> Iterator[slice]:
    """Slices of rows whose cells against all columns stay within a fixed number."""
    step = max(1, CHUNK_CELLS // max(1, n_columns))
    for start in range(0, n_rows, step):
        yield slice(start, min(start + step, n_rows))


def square_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2.0 * (a @ b.T)
    return np.maximum(d, 0.0, out=d)


def exact_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row-by-row distances that do not depend on which side is which."""
    diff = a - b
    return np.sqrt(np.einsum("ij,ij->i", diff, diff))


def smallest_columns(cost: np.ndarray, tie: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column numbers of the k smallest finite cells per row, ties by ``tie``."""
    n = cost.shape[1]
    if n == 0:
        return np.zeros(0, int), np.zeros(0, int)
    limit = np.partition(cost, min(k, n) - 1, axis=1)[:, min(k, n) - 1]
    rows, cols = np.nonzero((cost <= limit[:, None]) & np.isfinite(cost))
    order = np.lexsort((tie[cols], cost[rows, cols], rows))
    rows, cols = rows[order], cols[order]
    place = np.arange(len(rows)) - np.searchsorted(rows, rows)
    return rows[place < k], cols[place < k]


def fits(rows: int, width: int, limit: int = HELD_BYTES) -> bool:
    """Whether that many vectors stay within a byte limit."""
    return rows * width * 8 <= limit


def rows_per_block(width: int, block_rows: int | None = None, rows: int | None = None, cores: int = 1) -> int:
    """Rows whose vectors fill one block, unless a number is given; fewer where so few pairs of blocks of ``rows`` rows would
    leave cores idle."""
    full = max(1, min(MOST_ROWS, BLOCK_BYTES // (8 * width)))
    if block_rows or rows is None:
        return block_rows or full
    return min(full, max(LEAST_ROWS, math.ceil(rows / math.ceil(2 * math.sqrt(cores)))))


def block_count(rows: int, block_rows: int) -> int:
    return max(1, math.ceil(rows / block_rows))


def cores(df: DataFrame) -> int:
    return df.sparkSession.sparkContext.defaultParallelism


def dealt_tasks(cells: int, cores: int, most: int | None = None) -> int:
    """Tasks of a stream that has so many ``cells``, at most ``most`` unless there are more cores."""
    tasks = math.ceil(cells / TASK_CELLS)
    return max(cores, tasks if most is None else min(tasks, most))


def against_held(stream: DataFrame, held: DataFrame, kernel: Kernel, schema: str, cut=None, cells: int = 0, most: int | None = None) -> DataFrame:
    """Kernel over (batch of the stream, whole held side).

    ``cut`` merges the running result of a task with the next batch's, so that a task
    returns one small result however many batches it sees. Where the two sides have more ``cells``, pairs of rows, than a
    task should meet, the stream is dealt out anew, to ``most`` tasks or the cores: few bytes come in few partitions.
    """
    if cells > TASK_CELLS:
        stream = stream.repartition(dealt_tasks(cells, cores(stream), most))
    table = held.toArrow()
    shared = stream.sparkSession.sparkContext.broadcast(table)
    arrow_schema = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            result = kernel(pa.Table.from_batches([batch]), shared.value).cast(arrow_schema)
            if cut is None:
                yield from result.to_batches()
            else:
                kept = result if kept is None else cut(pa.concat_tables([kept, result]))
        if kept is not None:
            yield from kept.to_batches()

    return stream.mapInArrow(run, schema)


def block_grid(
    left: DataFrame, right: DataFrame, left_block: Column, right_block: Column, n_left: int, n_right: int,
    kernel: Kernel, schema: str,
) -> DataFrame:
    """Kernel over every pair of a left and a right block."""
    arrow_schema = to_arrow_schema(StructType.fromDDL(schema))
    lefts = left.withColumn("_lb", left_block.cast("int")).withColumn(
        "_rb", F.explode(F.sequence(F.lit(0), F.lit(n_right - 1)))
    )
    # Fresh column identities: both sides may stem from one table.
    rights = right.select(*[F.col(c).alias(c) for c in right.columns]).withColumn("_rb", right_block.cast("int")).withColumn(
        "_lb", F.explode(F.sequence(F.lit(0), F.lit(n_left - 1)))
    )

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        if a.num_rows == 0 or b.num_rows == 0:
            return arrow_schema.empty_table()
        return kernel(a, b).cast(arrow_schema)

    return (
        lefts.groupBy("_lb", "_rb").cogroup(rights.groupBy("_lb", "_rb")).applyInArrow(run, schema)
    )


def hash_block(key: str, n: int) -> Column:
    return F.pmod(F.xxhash64(F.lit("block"), F.col(key)), F.lit(n))


def all_against_all(
    left: DataFrame,
    right: DataFrame,
    left_key: str,
    right_key: str,
    width: int,
    kernel: Kernel,
    schema: str,
    held_bytes: int = HELD_BYTES,
    block_rows: int | None = None,
    cut=None,
    counts: tuple[int, int] | None = None,
    task_rows: int = 1,
) -> DataFrame:
    """Kernel results covering every pair of rows; ``width`` is the length of the vectors.

    Both keys must be unique, so hashed blocks come out even whatever the data look like.
    With the right side held each left row is seen once with all of it; otherwise a left
    row gets one partial result per block and the caller merges. Give ``task_rows`` where the kernel makes the held side ready
    at some cost: tasks of fewer streamed rows do not pay.
    """
    n_left, n_right = counts or (left.count(), right.count())
    if fits(n_right, width, held_bytes):
        return against_held(left, right, kernel, schema, None, n_left * n_right, math.ceil(n_left / task_rows))
    if cut is not None and fits(n_left, width, held_bytes):
        return against_held(right, left, lambda batch, held: kernel(held, batch), schema, cut, n_left * n_right, math.ceil(n_right / task_rows))
    per_block = rows_per_block(width, block_rows, max(n_left, n_right), cores(left))
    rows, cols = block_count(n_left, per_block), block_count(n_right, per_block)
    return block_grid(
        left, right, hash_block(left_key, rows), hash_block(right_key, cols), rows, cols, kernel, schema
    )

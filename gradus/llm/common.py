"""Helpers the text operators share: bytes of Arrow columns, words, bounded slices, written tables."""

from __future__ import annotations

import sys
import types
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from gradus.session import checkpoint_folder

WORD_PATTERN = r"[^\x20\x09-\x0D]+"
SPACES = np.zeros(256, bool)
SPACES[[32, 9, 10, 11, 12, 13]] = True
# Text held by one task at a time; arrays per byte take some ten times as much.
SLICE_BYTES = 2 << 20


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a column end to end, and the n + 1 places where its rows begin; null is empty."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    held = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return held[at[0] : at[-1]], at - at[0]


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Runs of rows whose texts take ``most`` bytes together, or one longer row."""
    for batch in batches:
        _, at = text_bytes(batch.column(column))
        start = 0
        while start < batch.num_rows:
            stop = max(start + 1, int(np.searchsorted(at, at[start] + most, "right")) - 1)
            yield batch.slice(start, stop - start)
            start = stop


def runs(inside: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin and end of every run of marked bytes within a row, and the n + 1 places in that list where each row's runs begin."""
    before = np.empty_like(inside)
    before[:1] = False
    before[1:] = inside[:-1]
    after = np.empty_like(inside)
    after[-1:] = False
    after[:-1] = inside[1:]
    edges = at[(at > 0) & (at < len(inside))]
    before[edges] = False
    after[edges - 1] = False
    starts = np.flatnonzero(inside & ~before)
    return starts, np.flatnonzero(inside & ~after) + 1, np.searchsorted(starts, at)


def word_places(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin and end of every word, and the n + 1 places in that list where each row's words begin."""
    return runs(~SPACES[data], at)


def pieces(data: np.ndarray, inside: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.DictionaryArray:
    """The runs of marked bytes as one dictionary-encoded column."""
    at = np.concatenate([[0], np.cumsum(ends - starts)])
    held = [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data[inside]))]
    return pa.Array.from_buffers(pa.large_binary(), len(starts), held).dictionary_encode()


def shared_folder(spark: SparkSession) -> str:
    """A new folder beside the checkpoints, which all executors see."""
    return f"{checkpoint_folder(spark)}/table-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """The same rows read back from Parquet in the shared folder: lineage is cut, columns can be pruned."""
    folder = shared_folder(df.sparkSession)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def row_and(taken: DataFrame, more: str) -> StructType:
    """The type of ``_row`` of a table, whatever its columns are called, and further columns."""
    return StructType([taken.schema["_row"], *StructType.fromDDL(more).fields])


def worker_store() -> dict:
    """What stays in a worker process from task to task; the package itself comes anew with every task."""
    return sys.modules.setdefault("_gradus_worker", types.ModuleType("_gradus_worker")).__dict__


def as_text(column) -> F.Column:
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))

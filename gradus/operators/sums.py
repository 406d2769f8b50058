"""Sums of long number arrays over all tasks, met in a tree so that the driver takes one row."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FAN = 16


def as_row(values: np.ndarray) -> pa.RecordBatch:
    """One row for ``added``: the numbers as binary."""
    return pa.RecordBatch.from_arrays([pa.array([np.ascontiguousarray(values, np.float64).tobytes()], pa.binary())], names=["sums"])


def _add(table: pa.Table) -> pa.Table:
    total = None
    for value in table["sums"]:
        part = np.frombuffer(value.as_py(), np.float64)
        total = part.copy() if total is None else total + part
    return pa.Table.from_batches([as_row(total)])


def added(rows: DataFrame, fan: int = FAN, tasks: int | None = None) -> np.ndarray | None:
    """Sum of the arrays in column ``sums`` (equally long, as binary), NULL-free; None without any row.

    Where arrays are short and loops ask for many sums, give the number of ``tasks`` that make a row each: the driver adds up to
    ``fan`` rows itself, without a shuffle.
    """
    if tasks is not None and tasks <= fan:
        found = rows.toArrow()
        return np.frombuffer(_add(found)["sums"][0].as_py(), np.float64).copy() if found.num_rows else None
    rows = rows.groupBy(F.pmod(F.spark_partition_id(), F.lit(fan)).alias("_g")).applyInArrow(_add, "sums BINARY")
    found = rows.groupBy().applyInArrow(_add, "sums BINARY").toArrow()
    return np.frombuffer(found["sums"][0].as_py(), np.float64).copy() if found.num_rows else None

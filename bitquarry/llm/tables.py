"""Tables shared by the operators: reading inputs, cutting lineage, slices of batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from bitquarry.sources.stored import checked, shared_dir
from bitquarry.sources.stored import stored as cut

__all__ = ["checked", "cut", "read", "shared_dir", "slices"]


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """One input table, by Spark's reader alone (the store may be remote)."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def slices(batch: pa.RecordBatch, most_rows: int = 1024, most_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """A batch in parts of bounded rows and bytes of its last column (text or binary); a row that is larger is a part of its own."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(batch.num_columns - 1)), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < batch.num_rows:
        before = int(ends[at - 1]) if at else 0
        end = min(at + most_rows, max(at + 1, int(np.searchsorted(ends, before + most_bytes, "right"))))
        yield batch.slice(at, end - at)
        at = end

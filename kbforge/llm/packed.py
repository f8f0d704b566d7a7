"""Rows that carry many values at once, dealt to buckets: the exchange of the index-building operators.

A segment of the input (some documents) sends each bucket one row with parallel
arrays instead of a row per value.  A key is counted inside its segment first, so
however often it occurs a bucket receives it once from each segment.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

BUCKET_KEYS = 1_000_000     # keys a bucket is meant to receive


def schema_of(ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


def bucket_count(df: DataFrame, keys: int, of: int = BUCKET_KEYS) -> int:
    """Buckets for ``keys`` keys in all: enough for the cores, more as the input grows."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return max(cores, -(-int(keys) // of))


def mixed(a: np.ndarray, b: np.ndarray | int = 0) -> np.ndarray:
    """A well mixed unsigned 64-bit hash of integer pairs."""
    with np.errstate(over="ignore"):
        h = a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(32)
        h += np.asarray(b).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        return h ^ (h >> np.uint64(32))


def offsets(counts: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)


def lists(values: np.ndarray, ends: np.ndarray, kind: pa.DataType) -> pa.Array:
    """List column whose row ``i`` is ``values[ends[i]:ends[i + 1]]``."""
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, kind.value_type))


def flat(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(all values, offsets) of a list column."""
    arr = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(arr, pa.ChunkedArray):        # no chunk, or more than one
        arr = pa.concat_arrays(arr.chunks) if arr.num_chunks else pa.array([], arr.type)
    size = np.asarray(arr.value_lengths().fill_null(0)) if len(arr) else np.zeros(0, np.int32)
    return np.asarray(arr.flatten()), offsets(size)


def deal(bucket: np.ndarray, columns: dict[str, np.ndarray], fixed: dict, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """One row per bucket that occurs: ``bucket``, the ``fixed`` values and the columns' values as arrays."""
    if not len(bucket):
        return
    order = np.argsort(bucket, kind="stable")
    named, first = np.unique(bucket[order], return_index=True)
    ends = np.append(first, len(order)).astype(np.int32)
    out = []
    for f in schema:
        if f.name in columns:
            out.append(lists(columns[f.name][order], ends, f.type))
        elif f.name == "bucket":
            out.append(pa.array(named, f.type))
        else:
            out.append(pa.array([fixed[f.name]] * len(named), f.type))
    yield pa.RecordBatch.from_arrays(out, schema=schema)


def runs(*sorted_keys: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal keys in columns sorted together."""
    n = len(sorted_keys[0])
    if not n:
        return np.zeros(0, np.int64)
    new = np.ones(n, bool)
    new[1:] = False
    for k in sorted_keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)

"""Shared folders and small column helpers of the training-data operators."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder name in ``spark.checkpoint.dir``; under the warehouse where that is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: computed once, and not lost with an executor."""
    folder = shared_folder(df.sparkSession, name)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def held_out(key: Column | str, parts: int, rest: int) -> Column:
    """Whether the CRC-32 of the key as text leaves ``rest``; false for a null key."""
    key = F.col(key) if isinstance(key, str) else key
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % parts == rest, F.lit(False))


def bounded_sample(df: DataFrame, key: str, rows: int) -> DataFrame:
    """About ``rows`` rows chosen by the hash of ``key``: the same ones in every run, without a sort."""
    share = min(1.0, rows / max(1, df.count()))
    return df.filter(F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(1 << 30)) < int(share * (1 << 30)))


def pieces(array: pa.Array, limit: int = 1 << 18) -> Iterator[tuple[int, int]]:
    """Row ranges of a string array with at most ``limit`` bytes each, longer single rows alone. After the last one
    Arrow gives memory that it no longer needs back to the system, as workers live from stage to stage."""
    sizes = pc.fill_null(pc.binary_length(array), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes)
    at = 0
    while at < len(sizes):
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + limit, "right")))
        yield at, to
        at = to
    pa.default_memory_pool().release_unused()


def utf8(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all rows and each row's offsets; nulls are empty."""
    array = pc.fill_null(array, "")
    if pa.types.is_large_string(array.type):
        array = array.cast(pa.string())
    if not len(array):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(array.buffers()[1], np.int32)[array.offset : array.offset + len(array) + 1].astype(np.int64)
    data = np.frombuffer(array.buffers()[2], np.uint8) if array.buffers()[2] else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]

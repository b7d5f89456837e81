"""Shared pieces of the corpus operators: intermediate tables, Arrow batches, a worker's memory."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import fresh_path, materialize, scratch, wrote

__all__ = [
    "LOWER", "documents", "fresh_path", "materialize", "memo", "release", "remainder", "scratch", "slices", "text_bytes", "unused", "wrote",
]

#: Lower-cases A-Z of UTF-8 bytes and leaves every other byte alone.
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return df.select(*columns) if columns else df


def text_bytes(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """UTF-8 bytes of a string column; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def slices(batches: Iterator[pa.RecordBatch], rows: int = 1000, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Batches of at most so many rows and bytes of text (or one row), so that a worker decodes few at a time."""
    for batch in batches:
        if "text" in batch.schema.names:
            lengths = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False)
        else:
            lengths = np.zeros(batch.num_rows, dtype=np.int64)
        upto = np.cumsum(lengths, dtype=np.int64)
        at = 0
        while at < batch.num_rows:
            before = upto[at - 1] if at else 0
            most = int(np.searchsorted(upto, before + size, side="right")) - at
            yield batch.slice(at, max(1, min(rows, most)))
            at += max(1, min(rows, most))
    release()


def release() -> None:
    """Give freed memory back to the system: workers are reused by later stages."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not all C libraries have it
        ctypes.CDLL(None).malloc_trim(0)


_memos: dict[str, dict] = {}


def memo(name: str) -> dict:
    """A worker's cache for one operator; those of others go, so a reused worker holds one operator's."""
    if name not in _memos:
        _memos.clear()
        _memos[name] = {}
    return _memos[name]


def remainder(doc_id: str, modulus: int):
    """crc32 of the id as text, modulo ``modulus``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % modulus


def unused(df: DataFrame, *names: str) -> list[str]:
    """Column names like ``names`` that ``df`` does not have."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out

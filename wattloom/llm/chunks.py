"""Documents packed into chunks, and rows of one key brought together: for operators that exchange arrays, not rows.

A chunk is one row: the ids and lengths of some documents and their texts (bytes, compressed
together). Once written, what a chunk holds is fixed, so a later exchange can answer a chunk by
the order of what it asked, without naming documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NO_ID, write_table

CHUNK = "chunk long, ids binary, null binary, lengths binary, texts binary"


@cache
def _zstd() -> tuple:
    """A worker's compressor and decompressor: to make one costs more than to use it on a small array."""
    import zstandard

    return zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def zip_bytes(data: bytes) -> bytes:
    return _zstd()[0].compress(data)


def unzip_bytes(data: bytes) -> bytes:
    return _zstd()[1].decompress(data)


def pack_chunks(docs: DataFrame, size: int) -> DataFrame:
    """Chunks of about `size` bytes of text (at least one document), written to the shared folder. A null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, no, rows, held = TaskContext.get().partitionId(), 0, [], 0

        def out() -> pa.RecordBatch:
            ids = np.array([NO_ID if d is None else d for d, _ in rows], np.int64)
            null = np.array([d is None for d, _ in rows], np.uint8)
            lengths = np.array([len(t) for _, t in rows], np.int64)
            cells = [(part << 32) + no, ids.tobytes(), null.tobytes(), lengths.tobytes(), zip_bytes(b"".join(t for _, t in rows))]
            return pa.RecordBatch.from_arrays([pa.array([c], pa.int64() if k == 0 else pa.binary()) for k, c in enumerate(cells)], [f.split()[0] for f in CHUNK.split(", ")])

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows.append((doc, text or b""))
                held += len(rows[-1][1])
                if held >= size:
                    yield out()
                    no, rows, held = no + 1, [], 0
        if rows:
            yield out()

    packed = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")).mapInArrow(run, CHUNK)
    return write_table(packed, "chunks")


def unpack(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, bytes]:
    """ids, null (whether an id is), lengths, all texts joined."""
    return np.frombuffer(row["ids"], np.int64), np.frombuffer(row["null"], np.uint8) > 0, np.frombuffer(row["lengths"], np.int64), unzip_bytes(row["texts"])


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for k in range(batch.num_rows):
            yield batch.slice(k, 1).to_pylist()[0]


def by_key(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[object, list[dict]]]:
    """The rows of each key, from batches that are sorted by it."""
    now, rows = None, []
    for row in rows_of(batches):
        if rows and row[key] != now:
            yield now, rows
            rows = []
        now = row[key]
        rows.append(row)
    if rows:
        yield now, rows


def mix64(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))

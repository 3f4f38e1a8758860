"""Best-fit packing of tokenized documents by the linear grouping scheme.

A document's ids end with `end_id`; only documents longer than the sequence are cut. Pieces are
dealt by hash to shards of about `shard_pieces`, and each shard is packed on its own, so no task
holds more than a shard and at most a sequence per shard is lost to the border:

1. Large pieces (over `small` of the sequence) are sorted and put into groups of equal number; each
   counts as long as the longest of its group, so only a few sizes are left.
2. Configurations of those sizes: for the largest size left, the fullest configuration that holds
   it (subset sums over what is left), used as often as the counts allow, until none is left.
3. The actual pieces take the places of their group, which leaves some space in every sequence.
4. The small pieces go, longest first, where they fit best; a new sequence only where none fits.

Nulls: a null text is an empty one (just the end id); a null doc_id stays null. Repeated rows are
packed as often as they come. An empty table gives an empty result. Only doc_id and text are read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import TEXTS, write_table
from .tokenizing import encoder

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def token_pieces(docs: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = 4096, keeps_space: bool = False) -> DataFrame:
    """The pieces of all documents: doc_id, piece, start, length, ids_crc32."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer, keeps_space)
        for batch in batches:
            rows: list[list] = [[], [], [], [], []]
            for doc, ids in zip(batch.column(0).to_pylist(), encode(x or "" for x in batch.column(1).to_pylist()), strict=True):
                ids = np.append(ids, end_id).astype("<u4")
                for k, at in enumerate(range(0, len(ids), capacity)):
                    cut = ids[at : at + capacity]
                    for row, x in zip(rows, (doc, k, at, len(cut), zlib.crc32(cut.tobytes())), strict=True):
                        row.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(rows, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, PIECES)


def _fullest(sizes: list[int], counts: list[int], first: int, capacity: int) -> list[int]:
    """The configuration (how many of each size) that fills most and holds sizes[first] at least once."""
    room, steps, sums = capacity - sizes[first], [], 1
    mask = (1 << (room + 1)) - 1
    for i in range(first, len(sizes)):
        most, k = min(counts[i] - (i == first), room // sizes[i]), 1
        while most > 0:  # 1, 2, 4, ... of a size, and the rest
            take = min(k, most)
            steps.append((i, take, sums))
            sums |= (sums << (take * sizes[i])) & mask
            most, k = most - take, 2 * k
    at, out = sums.bit_length() - 1, [0] * len(sizes)
    for i, take, before in reversed(steps):
        if not before >> at & 1:
            at -= take * sizes[i]
            out[i] += take
    out[first] += 1
    return out


def pack(lengths: np.ndarray, capacity: int, groups: int = 96, small: float = 1 / 8) -> tuple[np.ndarray, np.ndarray]:
    """The sequence of each length (numbers from 0) and its offset there."""
    order = np.argsort(-lengths, kind="stable")
    large = order[lengths[order] > capacity * small]
    rest = order[len(large) :]
    per = max(1, -(-len(large) // groups))
    members = [large[k : k + per].tolist() for k in range(0, len(large), per)]
    sizes, counts = [int(lengths[m[0]]) for m in members], [len(m) for m in members]
    where, offset, used = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), []
    for first in range(len(sizes)):
        while counts[first]:
            chosen = [(i, n) for i, n in enumerate(_fullest(sizes, counts, first, capacity)) if n]
            for _ in range(min(counts[i] // n for i, n in chosen)):
                at = 0
                for i, n in chosen:
                    for _ in range(n):
                        piece = members[i].pop()
                        where[piece], offset[piece] = len(used), at
                        at += int(lengths[piece])
                    counts[i] -= n
                used.append(at)
    free: dict[int, list[int]] = {}
    there = 0  # bit r is set if a sequence has r tokens of room
    for s, at in enumerate(used):
        free.setdefault(capacity - at, []).append(s)
        there |= 1 << (capacity - at)
    for piece in rest.tolist():
        n = int(lengths[piece])
        fits = there >> n
        if fits:
            room = n + (fits & -fits).bit_length() - 1
            s = free[room].pop()
            if not free[room]:
                there &= ~(1 << room)
        else:
            room, s = capacity, len(used)
            used.append(0)
        where[piece], offset[piece] = s, capacity - room
        free.setdefault(room - n, []).append(s)
        there |= 1 << (room - n)
    return where, offset


def pack_pieces(pieces: DataFrame, capacity: int = 4096, shard_pieces: int = 3000) -> DataFrame:
    """pieces with sequence_id and offset."""
    pieces = write_table(pieces, "pieces", TEXTS)
    shards = max(1, round(pieces.count() / shard_pieces))

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([(c, "ascending") for c in ("length", "doc_id", "piece", "ids_crc32")])
        where, offset = pack(table["length"].to_numpy(), capacity)
        shard = table["shard"][0].as_py()
        return table.drop_columns("shard").append_column("sequence_id", pa.array(where + (shard << 32))).append_column("offset", pa.array(offset))

    dealt = pieces.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", "start"), F.lit(shards)))
    return dealt.groupBy("shard").applyInArrow(run, f"{PIECES}, sequence_id long, offset long")

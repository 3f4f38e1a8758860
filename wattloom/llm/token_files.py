"""Token ids as compact files: every document its own zstandard frame, with a dictionary they share.

A file ("shard") is a row of a Parquet table, so Spark's committer, retries and any store it can
write to are behind it. Its bytes: magic, hash of the dictionary (sha256), width of an id in bytes, the
number of documents and of ids, then the index (doc_id, whether it is null, end of its frame, its
number of ids), then the frames. read_documents() reads single documents: Parquet's statistics of the first and
last doc_id find the shard, the index finds the frame, and only that is decompressed. Shards are cut by their
bytes (and number of documents), and their ranges are as many as the ids need. The
dictionary stands beside the shards, is trained on the id arrays of about `samples` documents (a
seeded sample; it only affects size, never the ids) and is checked by its hash on reading.

Documents are in ascending order of doc_id (ties by hash of the text, null last). A null text has
just the end id. An empty table gives no shard. Only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import NO_ID, partitions, sampled, scratch, write_table
from .tokenizing import encoder

MAGIC = b"WLTOK1\n\0"
HEAD = np.dtype([("magic", "S8"), ("dictionary", "V32"), ("width", "<u4"), ("docs", "<u8"), ("ids", "<u8")])
ENTRY = np.dtype([("doc_id", "<i8"), ("null", "u1"), ("end", "<u8"), ("ids", "<u4")])
SHARDS = "part int, no int, docs long, ids long, first long, last long, image binary"
#: Bytes of ids that a range of documents has, and bytes of frames that a shard has, about.
RANGE, SHARD = 16 << 20, 8 << 20


def _serialized(ids: np.ndarray, width: int) -> bytes:
    return ids.astype(f"<u{width}").tobytes()


def train_dictionary(docs: DataFrame, tokenizer: str, keeps_space: bool, end_id: int, width: int, samples: int, size: int) -> bytes:
    """A zstandard dictionary of at most `size` bytes; empty if there is too little to train on."""
    import zstandard

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer, keeps_space)
        for batch in batches:
            found = encode(x or "" for x in batch.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array([_serialized(np.append(x, end_id), width) for x in found], pa.binary())], ["ids"])

    few = sampled(docs.select("doc_id", "text"), samples, F.xxhash64(F.lit(5), "doc_id", "text"))
    found = [bytes(r.ids) for r in few.select("text").repartition(8).mapInArrow(run, "ids binary").collect()]
    try:
        return zstandard.train_dictionary(size, sorted(found)).as_bytes()
    except zstandard.ZstdError:
        return b""


def _codec(dictionary: bytes) -> dict:
    import zstandard

    return {"dict_data": zstandard.ZstdCompressionDict(dictionary)} if dictionary else {}


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, keeps_space: bool = True, vocabulary: int = 50257, samples: int = 1000, dictionary_size: int = 65536, shard_docs: int = 20_000, shard_bytes: int = SHARD) -> None:
    width = 2 if max(vocabulary, end_id + 1) <= 65536 else 4
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    dictionary = train_dictionary(docs, tokenizer, keeps_space, end_id, width, samples, dictionary_size)
    mark = hashlib.sha256(dictionary).digest()

    def compress(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        encode, codec = encoder(tokenizer, keeps_space), zstandard.ZstdCompressor(level=3, write_checksum=False, **_codec(dictionary))
        no = TaskContext.get().partitionId() << 40
        for batch in batches:
            doc_ids, ties = batch.column(0), batch.column(2)
            sizes, frames, held, done = [], [], 0, 0
            for x in encode(x or "" for x in batch.column(1).to_pylist()):
                sizes.append(len(x) + 1)
                frames.append(codec.compress(_serialized(np.append(x, end_id), width)))
                held += len(frames[-1])
                if held >= SHARD or done + len(frames) == batch.num_rows:
                    n = len(frames)
                    yield pa.RecordBatch.from_arrays([doc_ids.slice(done, n), ties.slice(done, n), pa.array(np.arange(no, no + n)), pa.array(sizes, pa.int64()), pa.array(frames, pa.binary())], ["doc_id", "tie", "no", "ids", "frame"])
                    sizes, frames, held, done, no = [], [], 0, done + n, no + n

    def image(rows: list[tuple]) -> bytes:
        index, head = np.zeros(len(rows), ENTRY), np.zeros(1, HEAD)
        index["doc_id"], index["null"] = [r[0] or 0 for r in rows], [r[0] is None for r in rows]
        index["end"], index["ids"] = np.cumsum([len(r[2]) for r in rows]), [r[1] for r in rows]
        head["magic"], head["width"], head["docs"], head["ids"] = MAGIC, width, len(rows), index["ids"].sum(dtype=np.int64)
        head["dictionary"] = np.void(mark)
        return head.tobytes() + index.tobytes() + b"".join(r[2] for r in rows)

    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, no, rows, held = TaskContext.get().partitionId(), 0, [], 0

        def out() -> pa.RecordBatch:
            places = [NO_ID if r[0] is None else r[0] for r in (rows[0], rows[-1])]
            cells = [pa.array([x], t) for x, t in zip((part, no, len(rows), sum(r[1] for r in rows), *places, image(rows)), (pa.int32(), pa.int32(), *[pa.int64()] * 4, pa.binary()), strict=True)]
            return pa.RecordBatch.from_arrays(cells, [f.split()[0] for f in SHARDS.split(", ")])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows.append(row)
                held += len(row[2])
                if held >= shard_bytes or len(rows) >= shard_docs:
                    yield out()
                    no, rows, held = no + 1, [], 0
        if rows:
            yield out()

    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("tie")).mapInArrow(compress, "doc_id long, tie long, no long, ids long, frame binary")
    rows = write_table(rows.withColumn("_place", F.coalesce("doc_id", F.lit(NO_ID))), "frames")
    ranges = max(partitions(docs.sparkSession), (rows.select(F.sum("ids")).head()[0] or 0) * width // RANGE)
    ranged = rows.repartitionByRange(ranges, "_place", "tie", "no").sortWithinPartitions("_place", "tie", "no").select("doc_id", "ids", "frame")
    ranged.mapInArrow(file, SHARDS).write.option("compression", "none").option("parquet.block.size", shard_bytes).parquet(f"{path}/shards")
    spark = docs.sparkSession
    spark.createDataFrame([(mark, dictionary)], "hash binary, dictionary binary").coalesce(1).write.parquet(f"{path}/dictionary")


def _reader(spark: SparkSession, path: str):
    """A function from a shard's bytes to its index, the places of its frames, and a function that gives the ids of one."""
    kept = spark.read.schema("hash binary, dictionary binary").parquet(f"{path}/dictionary").head()
    dictionary, mark = bytes(kept.dictionary), bytes(kept.hash)

    def opened(data: bytes):
        import zstandard

        if hashlib.sha256(dictionary).digest() != mark:
            raise ValueError("the dictionary is not the one that these files were written with")
        head = np.frombuffer(data, HEAD, 1)[0]
        if head["magic"] != MAGIC.rstrip(b"\0") or head["dictionary"].tobytes() != mark:
            raise ValueError("not a shard of these files")
        codec, width = zstandard.ZstdDecompressor(**_codec(dictionary)), int(head["width"])
        index = np.frombuffer(data, ENTRY, int(head["docs"]), HEAD.itemsize)
        base = HEAD.itemsize + index.nbytes
        ends = index["end"].astype(np.int64) + base
        begins = np.append(base, ends[:-1])
        return index, lambda k: np.frombuffer(codec.decompress(data[begins[k] : ends[k]]), f"<u{width}").astype("<u4").tobytes()

    return opened


#: Ranges of ids that the scan of the shards is asked for.
RANGES = 64


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """Per document, from the files: doc_id, start (ids before it), n_tokens, ids (little-endian unsigned 32-bit)."""
    shards = spark.read.schema(SHARDS).parquet(f"{path}/shards")
    opened = _reader(spark, path)
    before = Window.orderBy("part", "no").rowsBetween(Window.unboundedPreceding, -1)  # one small row per shard
    starts = write_table(shards.select("part", "no", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("start")), "starts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                index, ids = opened(data.as_py())
                at = start + np.cumsum(index["ids"], dtype=np.int64) - index["ids"]
                for k in range(0, len(index), 200):
                    some = slice(k, k + 200)
                    found = [ids(i) for i in range(k, min(k + 200, len(index)))]
                    yield pa.RecordBatch.from_arrays([pa.array(index["doc_id"][some], mask=index["null"][some] > 0), pa.array(at[some]), pa.array(index["ids"][some].astype(np.int64)), pa.array(found, pa.binary())], ["doc_id", "start", "n_tokens", "ids"])

    return shards.join(starts, ["part", "no"]).select("start", "image").mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def read_documents(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """(doc_id, ids) of the documents named: only shards that may hold one are read, and of these only its frames decompressed."""
    opened, wanted = _reader(spark, path), np.unique(np.array(doc_ids, np.int64))
    shards = spark.read.schema(SHARDS).parquet(f"{path}/shards")
    cuts = np.sort(np.argsort(np.diff(wanted))[-(RANGES - 1) :]) + 1  # the widest gaps: so many ranges at most, however many ids
    may = F.lit(False)
    for some in np.split(wanted, cuts):
        if len(some):
            may = may | ((F.col("first") <= int(some[-1])) & (F.col("last") >= int(some[0])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                index, ids = opened(data.as_py())
                known = np.where(index["null"] > 0, NO_ID, index["doc_id"])  # ascending
                places = [k for a, b in zip(np.searchsorted(known, wanted), np.searchsorted(known, wanted, side="right"), strict=True) for k in range(a, b) if not index["null"][k]]
                yield pa.RecordBatch.from_arrays([pa.array(known[places].astype(np.int64)), pa.array([ids(k) for k in places], pa.binary())], ["doc_id", "ids"])

    return shards.where(may).select("image").mapInArrow(run, "doc_id long, ids binary")


def round_trip(docs: DataFrame, tokenizer: str, **how) -> DataFrame:
    """Write docs into the shared folder and read them from there."""
    path = scratch(docs.sparkSession, "tokens")
    write_token_files(docs, path, tokenizer, **how)
    return read_token_files(docs.sparkSession, path)



"""Language-model scores from a probabilistic suffix tree over words.

States are contexts of up to `depth` words. A context is retained if it occurs at least `least` times in
the training part (a fixed number, so the tree grows with the corpus) and the distribution of the
symbols behind it diverges from what its parent (the longest retained shorter suffix) predicts for
them by at least `divergence` nats per occurrence. The root is smoothed by adding one;
P(w|s) = max(c(s,w) - d, 0) / C(s) + d T(s) / C(s) P(w|parent), T(s) being the number of different
successors. A token is scored in the longest retained state that is a suffix of what stands before
it in its text. The end of a text is a symbol of its own.

Counts are of all training texts, and no task holds the tree. Documents are packed into chunks of
tokens once. Level by level, a chunk sends its distinct contexts, each with its different successors,
to buckets by the context's hash; a bucket adds up what all chunks sent, decides which contexts stay,
and answers each chunk in the order it asked. What is known of the level before says how often a
context occurs, so contexts under `least` are never sent. Contexts with at least a thousandth of
all tokens (so there are at most 1000 of a length) are dealt to several buckets by their successors; the
sums of those parts, a bounded number of rows, are put together on the driver.

A context goes by the upper 48 bits of its hash (its bucket follows from these), a successor by 32.

Chunks lie in a table bucketed by their number, so a level exchanges what chunks ask and what they are
told and never the chunks themselves.

A chunk sends a row to each bucket: with chunks of 6 MB and half as many buckets, a row holds over a
kilobyte up to some TB of text; beyond, give larger chunks.

Nulls: a null text is an empty one (just the end), a null doc_id belongs to the training part.
Repeated rows count as often as they come. An empty table gives an empty result. Very long texts
are processed whole. Only doc_id and text are read.
"""

from __future__ import annotations

import re
import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.files import bucketed
from .chunks import by_key, mix64, rows_of, unzip_bytes, zip_bytes
from .common import LOWER, NO_ID, UPPER, partitions, write_table

_WORDS = re.compile(rb"[^\x20\x09-\x0D]+")
_FOLD = bytes.maketrans(UPPER.encode(), LOWER.encode())
END = b"\n"  # no word holds white space
#: Logarithms are added up as whole numbers of these parts, so sums do not depend on their order.
PARTS = 4096
#: A context with this share of all tokens is dealt to several buckets.
HOT = 1e-3

CHUNK = "chunk long, ids binary, null binary, sizes binary, words binary, hashes binary"
REPLY = "chunk long, level int, bucket long, kinds binary, counts binary, hot long, total long, gain double, logs long, different long"
ASK = "bucket long, chunk long, contexts binary, hot binary, sizes binary, logs binary, next binary, counts binary"


def held_out(ids: np.ndarray, null: np.ndarray) -> np.ndarray:
    return np.array([not n and zlib.crc32(str(i).encode()) % 7 == 2 for i, n in zip(ids.tolist(), null.tolist(), strict=True)], bool)


def _zip(x: np.ndarray) -> bytes:
    """Whole numbers from 0 on, compressed byte by byte: all lowest bytes, then the next, as many as the largest needs."""
    x = np.ascontiguousarray(x, "<u8")
    width = max(1, (int(x.max()).bit_length() + 7) // 8) if len(x) else 1
    return bytes([width]) + zip_bytes(x.view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes())


def _unzip(data: bytes) -> np.ndarray:
    width = data[0]
    found = np.frombuffer(unzip_bytes(data[1:]), np.uint8).reshape(width, -1)
    out = np.zeros((found.shape[1], 8), np.uint8)
    out[:, :width] = found.T
    return out.view("<u8")[:, 0].astype(np.int64)


def pack_tokens(docs: DataFrame, size: int, parts: int) -> DataFrame:
    """Chunks of about `size` bytes of text (at least one document), written to a table of so many buckets: ids, tokens per document, token numbers and the hashes of the words that they number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        part, no, held = TaskContext.get().partitionId(), 0, 0
        ids, sizes, words, numbers = [], [], [], defaultdict(count().__next__)

        def out() -> pa.RecordBatch:
            hashes, all_words = np.fromiter((xxhash.xxh64_intdigest(w) for w in numbers), np.uint64, len(numbers)), np.concatenate(words)
            order = np.argsort(-np.bincount(all_words), kind="stable")  # frequent words get small numbers
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            known = np.array([NO_ID if d is None else d for d in ids], np.int64)
            cells = [(part << 32) + no, known.tobytes(), np.array([d is None for d in ids], np.uint8).tobytes(), np.array(sizes, np.int64).tobytes(), _zip(place[all_words]), hashes[order].tobytes()]
            return _batch(CHUNK, [[c] for c in cells])

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = _WORDS.findall((text or b"").translate(_FOLD))
                found.append(END)
                ids.append(doc)
                sizes.append(len(found))
                words.append(np.fromiter(map(numbers.__getitem__, found), np.int32, len(found)))
                held += len(text or b"") + 1
                if held >= size:
                    yield out()
                    no, held = no + 1, 0
                    ids, sizes, words, numbers = [], [], [], defaultdict(count().__next__)
        if ids:
            yield out()

    packed = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")).mapInArrow(run, CHUNK)
    return bucketed(packed, "token-chunks", "chunk", [], parts, dealt=False)


def _batch(schema: str, cells: list) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "binary": pa.binary()}
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(cells, fields, strict=True)], [n for n, _ in fields])


class Tokens:
    """The tokens of a chunk: word (place of its hash in `hashes`; by_hash: their order), doc, train, and the level that its probabilities have reached."""

    def __init__(self, row: dict):
        self.ids, self.null = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["null"], np.uint8) > 0
        self.sizes, self.hashes = np.frombuffer(row["sizes"], np.int64), np.frombuffer(row["hashes"], np.uint64)
        self.word = _unzip(row["words"])
        self.by_hash = np.argsort(self.hashes)
        self.doc = np.repeat(np.arange(len(self.sizes)), self.sizes)
        self.out = held_out(self.ids, self.null)
        self.train = ~self.out[self.doc]
        self.key = np.zeros(len(self.word), np.uint64)  # of the context of the level before each token

    def asked(self, level: int, seen: np.ndarray, least: int) -> np.ndarray:
        """The tokens with a context of `level` words that occurs `least` times; seen: how often each token comes in its context of the level before."""
        self.key[1:] = mix64(self.key[:-1] * np.uint64(3) + self.hashes[self.word[:-1]])
        self.key[:1] = 0
        ok = np.zeros(len(self.word), bool)
        ok[level:] = (self.doc[level:] == self.doc[:-level]) & (seen[level - 1 : -1] >= least)
        return np.flatnonzero(ok)


class Level:
    """The contexts of a level in a chunk, in the order of their hashes, and their different successors."""

    def __init__(self, t: Tokens, at: np.ndarray, total: np.ndarray, many: float):
        """at: the tokens that have one; total: how often each one's context occurs; many: from where it is dealt to several buckets."""
        key, parts = t.key[at], np.maximum(1, np.ceil(total / many)).astype(np.uint64)
        hot = np.flatnonzero(parts > 1)
        key = key.copy()
        key[hot] = mix64(key[hot] + np.uint64(1) + mix64(t.hashes[t.word[at[hot]]]) % parts[hot])
        order = np.lexsort((t.word[at], key))
        key, word = key[order], t.word[at[order]]
        new = np.append(True, key[1:] != key[:-1]) if len(key) else np.zeros(0, bool)
        first = new | np.append(True, word[1:] != word[:-1]) if len(key) else new
        self.pair, self.context = np.empty(len(at), np.int64), np.empty(len(at), np.int64)  # of each token
        self.pair[order], self.context[order] = np.cumsum(first) - 1, np.cumsum(new) - 1
        self.names, self.origin = key[new], np.where(parts[order[new]] > 1, t.key[at[order[new]]], np.uint64(0))
        self.next = t.hashes[word[first]]
        self.sizes = np.bincount((np.cumsum(new) - 1)[first], minlength=len(self.names))
        self.n = np.bincount(self.pair, weights=t.train[at], minlength=len(self.next)).astype(np.int64)

    def rows(self, buckets: int, chunk: int, logs: np.ndarray) -> pa.RecordBatch:
        of = ((self.names >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
        ends = np.append(0, np.cumsum(self.sizes))
        out: list[list] = [[] for _ in range(8)]
        for k, a, b in _runs(of):
            p, q = int(ends[a]), int(ends[b])
            hot = self.origin[a:b]
            cells = (k, chunk, _zip(self.names[a:b] >> np.uint64(16)), _zip(hot) if hot.any() else b"", _zip(self.sizes[a:b]), _zip(-logs[a:b]), (self.next[p:q] >> np.uint64(32)).astype(np.uint32).tobytes(), _zip(self.n[p:q]))
            for cell, x in zip(out, cells, strict=True):
                cell.append(x)
        return _batch(ASK, out)


def _words_asked(t: Tokens, buckets: int, chunk: int) -> pa.RecordBatch:
    """The words of a chunk as successors of the empty context."""
    n, hashes = np.bincount(t.word[t.train], minlength=len(t.hashes))[t.by_hash], t.hashes[t.by_hash]
    out: list[list] = [[] for _ in range(8)]
    for k, a, b in _runs(((hashes >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)):
        for cell, x in zip(out, (k, chunk, hashes[a:b].tobytes(), b"", b"", b"", b"", _zip(n[a:b])), strict=True):
            cell.append(x)
    return _batch(ASK, out)


def _reply(**cells) -> pa.RecordBatch:
    n = len(next(iter(cells.values())))
    return _batch(REPLY, [cells.get(f.split()[0], [None] * n) for f in REPLY.split(", ")])


def _add_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for bucket, rows in by_key(batches, "bucket"):
        names, back = np.unique(np.concatenate([np.frombuffer(r["contexts"], np.uint64) for r in rows]), return_inverse=True)
        counts = [_unzip(r["counts"]) for r in rows]
        sums = np.zeros(len(names), np.int64)
        np.add.at(sums, back, np.concatenate(counts))
        yield _reply(level=[0], total=[int(sums.sum())], different=[int((sums > 0).sum())])
        told = np.split(sums[back], np.cumsum([len(c) for c in counts])[:-1])
        yield _reply(chunk=[r["chunk"] for r in rows], level=[0] * len(rows), bucket=[bucket] * len(rows), counts=[_zip(x) for x in told])


def _adder(level: int, divergence: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, rows in by_key(batches, "bucket"):
            own = [_unzip(r["contexts"]) for r in rows]
            sizes = [_unzip(r["sizes"]) for r in rows]
            names, back = np.unique(np.concatenate(own), return_inverse=True)
            logs, hot = np.zeros(len(names), np.int64), np.zeros(len(names), np.uint64)
            np.subtract.at(logs, back, np.concatenate([_unzip(r["logs"]) for r in rows]))
            hot[back] = np.concatenate([_unzip(r["hot"]).view(np.uint64) if r["hot"] else np.zeros(len(o), np.uint64) for r, o in zip(rows, own, strict=True)])
            of = np.repeat(back, np.concatenate(sizes))
            pairs, pair = np.unique(of.astype(np.uint64) << np.uint64(32) | np.concatenate([np.frombuffer(r["next"], np.uint32) for r in rows]), return_inverse=True)
            counts = [_unzip(r["counts"]) for r in rows]
            sums = np.zeros(len(pairs), np.int64)
            np.add.at(sums, pair, np.concatenate(counts))
            context, some = (pairs >> np.uint64(32)).astype(np.int64), sums > 0
            total = np.zeros(len(names), np.int64)
            np.add.at(total, context, sums)
            gain = np.bincount(context[some], weights=sums[some] * np.log(sums[some]), minlength=len(names))
            kinds = np.bincount(context[some], minlength=len(names))
            stays = _diverges(total, gain, logs, divergence)
            for i in np.flatnonzero(hot).tolist():
                yield _reply(level=[level], hot=[int(hot[i].view(np.int64))], total=[int(total[i])], gain=[float(gain[i])], logs=[int(logs[i])], different=[int(kinds[i])])
            told = np.where(stays & (hot == 0), kinds, 0)[back]
            ends, pair_ends = np.cumsum([len(o) for o in own])[:-1], np.cumsum([len(c) for c in counts])[:-1]
            yield _reply(
                chunk=[r["chunk"] for r in rows], level=[level] * len(rows), bucket=[bucket] * len(rows), kinds=[_zip(x) for x in np.split(told, ends)], counts=[_zip(x) for x in np.split(sums[pair], pair_ends)]
            )

    return run


def _diverges(total, gain, logs, divergence: float):
    """Whether contexts stay; gain: the sum of n log n of their successors, logs: that of the logarithms that the parent gives them."""
    n = np.maximum(total, 1)
    return (total > 0) & ((gain - logs / PARTS) / n - np.log(n) >= divergence)


def _runs(x: np.ndarray) -> list[tuple[int, int, int]]:
    """(value, from, to) of each run of equal values."""
    if not len(x):
        return []
    edges = np.flatnonzero(np.append(True, x[1:] != x[:-1]))
    return list(zip(x[edges].tolist(), edges.tolist(), np.append(edges[1:], len(x)).tolist(), strict=True))


def _sums(x: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros(n, np.int64)
    np.add.at(out, at, x)
    return out


def score(docs: DataFrame, depth: int = 2, least: int = 2, divergence: float = 0.05, discount: float = 0.75, chunk: int = 6 << 20) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length(F.col("text").cast("binary")))).head()[0] or 0
    tasks = size // chunk + partitions(spark)
    chunks = pack_tokens(docs, chunk, tasks)
    n_chunks = chunks.count()
    buckets = max(16, partitions(spark), n_chunks // 2)
    exchange = lambda asked: asked.repartitionById(buckets, F.col("bucket").cast("int")).sortWithinPartitions("bucket", "chunk")

    def ask_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            yield _words_asked(Tokens(row), buckets, row["chunk"])

    replies = write_table(exchange(chunks.mapInArrow(ask_words, ASK)).mapInArrow(_add_words, REPLY), "replies-0")
    totals = replies.where("chunk is null").agg(F.sum("total"), F.sum("different")).head()
    total, vocabulary = int(totals[0] or 0), int(totals[1] or 0)
    hot: list[dict[int, int]] = [{}]  # of each level: how many successors the hot contexts that stay have

    def reached(row: dict, got: list[dict], told: list[dict]) -> tuple[Tokens, np.ndarray, np.ndarray, np.ndarray]:
        """The tokens of a chunk after the levels that have been answered: with the counts at the root, in the last level, and probabilities."""
        t = Tokens(row)
        got = sorted(got, key=lambda r: (r["level"], r["bucket"]))
        answer = lambda level, c: np.concatenate([_unzip(r[c]) for r in got if r["level"] == level] or [np.zeros(0, np.int64)])
        of_words = np.zeros(len(t.hashes), np.int64)
        of_words[t.by_hash] = answer(0, "counts")
        root = of_words[t.word]
        p, seen = (root + 1.0) / (total + vocabulary + 1.0), root
        for level in range(1, len(told)):
            at = t.asked(level, seen, least)
            c = seen[at - 1]
            here = Level(t, at, c, many)
            kinds = answer(level, "kinds")
            for i in np.flatnonzero(here.origin).tolist():
                kinds[i] = told[level].get(int(here.origin[i]), 0)
            n, kinds = answer(level, "counts")[here.pair], kinds[here.context]
            stay = kinds > 0
            q = p.copy()
            some, held = at[stay], c[stay].astype(np.float64)
            q[some] = np.maximum(n[stay] - discount, 0) / held + discount * kinds[stay] / held * p[some]
            p, seen = q, np.zeros(len(t.word), np.int64)
            seen[at] = n
        return t, root, seen, p

    many = max(HOT * total, 1.0)
    if total < 1 / HOT:
        many = float("inf")
    for level in range(1, depth + 1):

        def ask(row: dict, got: list[dict], level: int = level, told: list = list(hot)) -> pa.RecordBatch:
            t, _, seen, p = reached(row, got, told)
            at = t.asked(level, seen, least)
            here = Level(t, at, seen[at - 1], many)
            logs = np.rint(np.log(p[at]) * PARTS).astype(np.int64) * t.train[at]
            return here.rows(buckets, row["chunk"], _sums(logs, here.context, len(here.names)))

        asked = _with_replies(chunks, replies, tasks, ask, ASK)
        new = write_table(exchange(asked).mapInArrow(_adder(level, divergence), REPLY), f"replies-{level}")
        sums = new.where("hot is not null").groupBy("hot").agg(*[F.sum(c) for c in ("total", "gain", "logs", "different")]).collect()  # at most 1000 rows
        hot.append({r[0] & (2**64 - 1): r[4] for r in sums if _diverges(np.array(r[1]), r[2], r[3], divergence)})
        replies = replies.unionByName(new)

    def finish(row: dict, got: list[dict]) -> pa.RecordBatch:
        t, root, _, p = reached(row, got, hot)
        starts = np.cumsum(t.sizes) - t.sizes
        add = lambda x: np.add.reduceat(x, starts)  # noqa: E731  every text has a token, its end
        base = np.log10((root + 1.0) / (total + vocabulary + 1.0))
        cells = [pa.array(t.ids, mask=t.null), pa.array(t.out), pa.array(t.sizes), pa.array(add((root > 0).astype(np.int64))), pa.array(np.full(len(t.ids), total)), pa.array(add(base)), pa.array(add(np.log10(p)))]
        return pa.RecordBatch.from_arrays(cells, ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return _with_replies(chunks, replies, tasks, finish, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def _with_replies(chunks: DataFrame, replies: DataFrame, tasks: int, run: Callable[[dict, list[dict]], pa.RecordBatch], schema: str) -> DataFrame:
    """What run makes of each chunk and what it has been told; only the replies are exchanged."""

    def each(chunk: pa.Table, told: pa.Table) -> pa.Table:
        return pa.Table.from_batches([run(row, told.to_pylist()) for row in chunk.to_pylist()])

    told = replies.where("chunk is not null").select("chunk", "level", "bucket", "kinds", "counts").repartition(tasks, "chunk")
    return chunks.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInArrow(each, schema)

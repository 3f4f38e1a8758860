"""Exact substring dedup by a distributed, prefix-aware merge sort of suffixes.

A byte goes if a string of `width` bytes over it also starts in a document with a smaller doc_id.
Only suffixes that matter are sorted:

1. Anchors. Of the k-byte strings (k = width div 2) in every string of `width` bytes, the one with
   the smallest hash (the first, if several) is an anchor. Equal strings have equal anchors, so every
   repeat shows at an anchor. Hashes of anchors are exchanged as arrays by bucket; only anchors
   that occur in more than one document go on. This is a filter: it may let some through in vain.
2. Suffixes. Each such anchor gives its suffix (`width` bytes from the anchor on) and, behind it, the
   bytes before the anchor backwards. A chunk of documents sorts its own, and sends them as front-coded
   runs (length of the prefix shared with the one before, and the rest) to ranges of the order.
3. Merge. A range combines its runs with a loser tree that carries common-prefix lengths: of two
   heads the one sharing more with the last output is first, and only if they share as much are
   bytes compared, from there on. The merged order comes with the prefix length of all neighbours.
4. Decision. Suffixes that agree in k bytes stand together. For each of the strings of `width` bytes
   over an anchor, starting o bytes before it, those with the same width - o bytes from the anchor on
   follow from the prefix lengths of the merged order, those with the same o bytes before it from
   the order of the reversed parts; the smallest doc_id of those that share both decides.

Within a chunk, copies of a suffix are merged, so a passage in very many documents sends a range
no more than one suffix per chunk. Where the limits of ranges fall inside the suffixes of one very
frequent anchor, its strings are decided by a Spark aggregate over all ranges instead.

Nulls: a null text is an empty one. Documents without an id come after all others and, like
documents that share an id, remove nothing from each other. An empty table gives an empty result.
Only doc_id and text are read; texts are processed whole, as UTF-8 bytes.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import by_key, mix64, pack_chunks, rows_of, unpack, unzip_bytes, zip_bytes
from .common import join_unique, partitions, write_table

SEGMENT = 1 << 16
PAD = 0xFF  # no byte of UTF-8
_MUL = np.uint64(0x9E3779B97F4A7C15)


def _rolled(a: np.ndarray, k: int) -> np.ndarray:
    """A hash of every k bytes in a row, from hashes of 1, 2, 4, ... bytes."""
    piece, size, power = a.astype(np.uint64) + np.uint64(1), 1, _MUL
    out, done, n = None, 0, len(a) - k + 1
    while True:
        if k & size:
            here = piece[done : done + n]
            out, done = (here.copy() if out is None else out * power + here), done + size
        if done == k:
            return mix64(out)
        with np.errstate(over="ignore"):
            piece, size, power = piece[:-size] * power + piece[size:], 2 * size, power * power


def _sliding_min(x: np.ndarray, n: int) -> np.ndarray:
    have = 1
    while have < n:
        step = min(have, n - have)
        x = np.minimum(x[: len(x) - step], x[step:])
        have += step
    return x


def find_anchors(a: np.ndarray, lengths: np.ndarray, width: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, hashes) of the anchors of the documents that stand one after another in a."""
    n = len(a) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    ends = np.cumsum(lengths)
    whole = np.zeros(len(a) + 1, bool)  # strings of `width` bytes that lie in one document
    for lo, hi in zip((ends - lengths).tolist(), (ends - width + 1).tolist(), strict=True):
        if hi > lo:
            whole[lo:hi] = True
    place_bits = np.uint64((1 << 24) - 1)
    places, hashes = [], []
    for at in range(0, n, SEGMENT):
        part = a[at : at + SEGMENT + width - 1]
        h = _rolled(part, k)
        least = _sliding_min((h & ~place_bits) | np.arange(len(h), dtype=np.uint64), width - k + 1)
        chosen = np.zeros(len(h), bool)
        chosen[(least[whole[at : at + len(least)]] & place_bits).astype(np.int64)] = True
        here = np.flatnonzero(chosen)
        places.append(here + at)
        hashes.append(h[here])
    places, hashes = np.concatenate(places), np.concatenate(hashes)
    places, first = np.unique(places, return_index=True)
    return places, hashes[first]


class Chunk:
    def __init__(self, row: dict, width: int, k: int):
        self.ids, self.null, self.lengths, texts = unpack(row)
        self.bytes = np.frombuffer(texts, np.uint8)
        self.places, self.hashes = find_anchors(self.bytes, self.lengths, width, k)
        self.ends = np.cumsum(self.lengths)
        self.doc = np.searchsorted(self.ends, self.places, side="right")
        order = np.argsort(self.hashes, kind="stable")
        self.names, first = np.unique(self.hashes[order], return_index=True)
        self.name_of = np.searchsorted(self.names, self.hashes)
        ids = self.ids[self.doc[order]]
        low, high = (np.minimum.reduceat(ids, first), np.maximum.reduceat(ids, first)) if len(first) else (ids, ids)
        self.several = low < high  # in more than one document of this chunk


def _contexts(a: np.ndarray, places: np.ndarray, start: np.ndarray, end: np.ndarray, width: int, k: int) -> np.ndarray:
    """Per place: `width` bytes from there on and the width - k bytes before it backwards, PAD outside the document."""
    step = np.concatenate([np.arange(width), -1 - np.arange(width - k)])
    out = np.empty((len(places), len(step)), np.uint8)
    for lo in range(0, len(places), SEGMENT):
        some = slice(lo, lo + SEGMENT)
        at = places[some, None] + step[None, :]
        inside = (at >= start[some, None]) & (at < end[some, None])
        out[some] = np.where(inside, a[np.clip(at, 0, max(len(a) - 1, 0))], PAD)
    return out


def _sorted_rows(x: np.ndarray) -> np.ndarray:
    """The order of byte strings (rows)."""
    more = -x.shape[1] % 8
    words = np.ascontiguousarray(np.pad(x, ((0, 0), (0, more)))).view(">u8").astype(np.uint64)
    return np.lexsort(words.T[::-1])


def _shared(x: np.ndarray) -> np.ndarray:
    """Length of the prefix that each row shares with the one before (the first: 0)."""
    if len(x) < 2:
        return np.zeros(len(x), np.int64)
    apart = x[1:] != x[:-1]
    return np.append(0, np.where(apart.any(1), apart.argmax(1), x.shape[1]))


def front_code(x: np.ndarray, shared: np.ndarray) -> tuple[bytes, bytes]:
    return shared.astype(np.uint8).tobytes(), zip_bytes(x[np.arange(x.shape[1])[None, :] >= shared[:, None]].tobytes())


def front_decode(shared: np.ndarray, rest: bytes, size: int) -> np.ndarray:
    own = np.arange(size)[None, :] >= shared[:, None]
    x = np.zeros(own.shape, np.uint8)
    x[own] = np.frombuffer(unzip_bytes(rest), np.uint8)
    last = np.maximum.accumulate(np.where(own, np.arange(len(x))[:, None], 0), axis=0)
    return np.take_along_axis(x, last, axis=0)


def merge_runs(runs: list[list[bytes]], shared: list[list[int]], size: int) -> tuple[list[int], list[int]]:
    """Merge sorted runs; (run of each output, prefix length that it shares with the output before).

    heads[r] is the place in run r. Each loser stands in its node with the prefix that it shares with
    the string it was last compared with: the last output, for those on the path that is played again.
    A run that has ended shares -1, and so loses.
    """
    k = 1
    while k < len(runs):
        k *= 2
    heads = [0] * len(runs)
    now = [run[0] if run else b"" for run in runs] + [b""] * (k - len(runs))
    losers, known = [0] * k, [0] * k  # by node

    def after(a: int, b: int, p: int) -> tuple[bool, int]:
        """Whether the head of a comes after that of b, and what they share, which is p at least."""
        x, y = now[a], now[b]
        if p < size and x[p] == y[p]:
            p = size - ((int.from_bytes(x[p:]) ^ int.from_bytes(y[p:])).bit_length() + 7 >> 3)
        return (a > b if p == size else x[p] > y[p]), p

    winners = [(0, -1)] * k + [(i, 0 if i < len(runs) and runs[i] else -1) for i in range(k)]
    for node in range(k - 1, 0, -1):
        (a, p), (b, q) = winners[2 * node], winners[2 * node + 1]
        if p < 0 or q < 0:
            winners[node], (losers[node], known[node]) = ((a, p), (b, q)) if q < 0 else ((b, q), (a, p))
        else:
            swap, known[node] = after(a, b, 0)
            winners[node], losers[node] = ((b, 0), a) if swap else ((a, 0), b)
    best, p = winners[1]
    out, lengths = [], []
    while p >= 0:
        out.append(best)
        lengths.append(p)
        at = heads[best] = heads[best] + 1
        if at < len(runs[best]):
            now[best], p = runs[best][at], shared[best][at]
        else:
            p = -1
        node = (best + k) >> 1
        while node:
            q = known[node]
            if q > p:
                known[node], p = p, q
                losers[node], best = best, losers[node]
            elif q == p >= 0:
                swap, known[node] = after(best, losers[node], p)
                if swap:
                    losers[node], best = best, losers[node]
            node >>= 1
    return out, lengths


def _classes(shared: np.ndarray, at_least: int) -> np.ndarray:
    return np.cumsum(shared < at_least)


def decide(x: np.ndarray, shared: np.ndarray, docs: np.ndarray, width: int, k: int, undecided: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(masks, again) of suffixes in merged order: bit o of a mask is set if the string that starts o bytes before the anchor goes.

    again: whether a suffix is one that other ranges may have strings in common with (its anchor is `undecided`).
    """
    size = x.shape[1]
    same = _classes(shared, size) - 1
    starts = np.flatnonzero(shared < size)
    least = np.minimum.reduceat(docs, starts)[same]
    masks = np.where(docs > least, (1 << (width - k + 1)) - 1, 0)
    anchor = _classes(shared[starts], k) - 1  # of each different suffix
    several = np.bincount(anchor)[anchor] > 1
    first = starts[several]
    if len(first):
        rows, low = x[first], np.minimum.reduceat(docs, starts)[several]
        apart, at = shared[starts], np.flatnonzero(several)
        right = np.append(0, np.minimum.reduceat(apart[: at[-1] + 1], at[:-1] + 1)) if len(at) > 1 else np.zeros(1, np.int64)
        back = rows[:, width:]
        order = _sorted_rows(back)
        left = _shared(back[order])
        found = np.zeros(len(rows), np.int64)
        for o in range(width - k + 1):
            side = np.empty(len(rows), np.int64)
            side[order] = _classes(left, o)
            key = _classes(right, width - o) * (len(rows) + 1) + side
            _, where = np.unique(key, return_inverse=True)
            smallest = np.full(where.max() + 1, np.iinfo(np.int64).max)
            np.minimum.at(smallest, where, low)
            found |= (smallest[where] < low).astype(np.int64) << o
        full = np.zeros(len(starts), np.int64)
        full[several] = found
        masks |= full[same]
    fits = np.zeros(len(x), np.int64)
    for o in range(width - k + 1):
        ok = (x[:, width - o - 1] != PAD) & ((x[:, width + o - 1] != PAD) if o else True)
        fits |= ok.astype(np.int64) << o
    return masks & fits, undecided & (docs == least)


def remove_repeats(docs: DataFrame, width: int = 50, chunk: int = 4 << 20) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (the bytes that stay) of every document."""
    spark = docs.sparkSession
    k = width // 2
    size = 2 * width - k
    chunks = pack_chunks(docs, chunk)
    n_chunks = chunks.count()
    buckets = ranges = max(64, partitions(spark), n_chunks)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            c = Chunk(row, width, k)
            of = ((c.names >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
            edges = np.searchsorted(of, np.arange(buckets + 1))
            some = np.flatnonzero(edges[1:] > edges[:-1]).tolist()
            cells = [[(c.names[edges[b] : edges[b + 1]] & np.uint64(0xFFFFFFFF)).astype(np.uint32).tobytes() for b in some], [zip_bytes(np.packbits(c.several[edges[b] : edges[b + 1]]).tobytes()) for b in some]]
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array([row["chunk"]] * len(some), pa.int64()), pa.array(cells[0], pa.binary()), pa.array(cells[1], pa.binary())], ["bucket", "chunk", "tags", "several"])

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, rows in by_key(batches, "bucket"):
            tags = [np.frombuffer(r["tags"], np.uint32) for r in rows]
            several = [np.unpackbits(np.frombuffer(unzip_bytes(r["several"]), np.uint8), count=len(t)) for r, t in zip(rows, tags, strict=True)]
            names, where, n = np.unique(np.concatenate(tags), return_inverse=True, return_counts=True)
            n[np.unique(where[np.concatenate(several) > 0])] += 1
            bits = np.split(n[where] > 1, np.cumsum([len(t) for t in tags])[:-1])
            yield pa.RecordBatch.from_arrays([pa.array([r["chunk"] for r in rows], pa.int64()), pa.array([bucket] * len(rows), pa.int64()), pa.array([len(t) for t in tags], pa.int64()), pa.array([zip_bytes(np.packbits(b).tobytes()) for b in bits], pa.binary())], ["chunk", "bucket", "n", "again"])

    asked = chunks.mapInArrow(ask, "bucket long, chunk long, tags binary, several binary").repartition(buckets, "bucket").sortWithinPartitions("bucket", "chunk")
    replies = write_table(asked.mapInArrow(answer, "chunk long, bucket long, n long, again binary"), "answers")
    limits = _limits(chunks, n_chunks, ranges, width, k)
    open_cores = {s[:k] for s in limits if s[k:] != bytes(size - k)}

    def suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in by_key(batches, "chunk"):
            row = next(r for r in rows if r["ids"] is not None)
            got = sorted((r for r in rows if r["ids"] is None), key=lambda r: r["bucket"])
            c = Chunk(row, width, k)
            again = np.concatenate([np.unpackbits(np.frombuffer(unzip_bytes(r["again"]), np.uint8), count=r["n"]) for r in got] or [np.zeros(0, np.uint8)]) > 0
            at = np.flatnonzero(again[c.name_of]) if len(again) else np.zeros(0, np.int64)
            if not len(at):
                continue
            doc, places = c.doc[at], c.places[at]
            x = _contexts(c.bytes, places, (c.ends - c.lengths)[doc], c.ends[doc], width, k)
            order = _sorted_rows(x)
            x, ids, places = x[order], c.ids[doc[order]], places[order]
            shared = _shared(x)
            first = np.flatnonzero(shared < size)
            stays = ids == np.minimum.reduceat(ids, first)[_classes(shared, size) - 1]
            gone = places[~stays]
            x, ids, places = x[stays], ids[stays], places[stays]
            strings = [b.tobytes() for b in x]
            cut = [0, *[bisect_left(strings, s) for s in limits], len(strings)]
            shared = _shared(x)
            shared[[a for a, b in zip(cut, cut[1:], strict=False) if b > a]] = 0
            out: list[dict] = []
            if len(gone):  # copies of a suffix of an earlier document of this chunk: all strings over it go
                out.append({"range": row["chunk"] % ranges, "chunk": row["chunk"], "places": zip_bytes(gone.astype(np.uint32).tobytes())})
            for r, (a, b) in enumerate(zip(cut, cut[1:], strict=False)):
                if b > a:
                    prefixes, rest = front_code(x[a:b], shared[a:b])
                    out.append({"range": r, "chunk": row["chunk"], "prefixes": prefixes, "rest": rest, "docs": zip_bytes(ids[a:b].tobytes()), "places": zip_bytes(places[a:b].astype(np.uint32).tobytes())})
            yield pa.RecordBatch.from_pylist(out, schema=_RUN)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in by_key(batches, "range"):
            out: list[dict] = []
            full = (1 << (width - k + 1)) - 1
            for r in (r for r in rows if r["rest"] is None):
                n = len(unzip_bytes(r["places"])) // 4
                out.append({"chunk": r["chunk"], "places": r["places"], "masks": zip_bytes(np.full(n, full, np.uint32).tobytes())})
            rows = [r for r in rows if r["rest"] is not None]
            if rows:
                prefixes = [np.frombuffer(r["prefixes"], np.uint8).astype(np.int64) for r in rows]
                x = [front_decode(p, r["rest"], size) for p, r in zip(prefixes, rows, strict=True)]
                run, shared = merge_runs([[b.tobytes() for b in part] for part in x], [p.tolist() for p in prefixes], size)
                run, shared = np.array(run), np.array(shared)
                order = np.empty(len(run), np.int64)
                order[np.argsort(run, kind="stable")] = np.arange(len(run))  # each run keeps its order
                x = np.concatenate(x)[order]
                docs_ = np.concatenate([np.frombuffer(unzip_bytes(r["docs"]), np.int64) for r in rows])[order]
                places = np.concatenate([np.frombuffer(unzip_bytes(r["places"]), np.uint32) for r in rows])[order]
                undecided = np.array([b[:k].tobytes() in open_cores for b in x], bool) if open_cores else np.zeros(len(x), bool)
                masks, again = decide(x, shared, docs_, width, k, undecided)
                some = masks > 0
                by_run = np.argsort(run[some], kind="stable")
                for i, a, b in _runs(run[some][by_run]):
                    pick = np.flatnonzero(some)[by_run[a:b]]
                    out.append({"chunk": rows[i]["chunk"], "places": zip_bytes(places[pick].tobytes()), "masks": zip_bytes(masks[pick].astype(np.uint32).tobytes())})
                for i in np.flatnonzero(again).tolist():
                    b = x[i]
                    for o in range(width - k + 1):
                        s = np.concatenate([b[width : width + o][::-1], b[: width - o]])
                        if not (s == PAD).any():
                            out.append({"chunk": rows[run[i]]["chunk"], "string": s.tobytes(), "doc": int(docs_[i]), "place": int(places[i]), "o": o})
            for i in range(0, len(out), 5000):
                yield pa.RecordBatch.from_pylist(out[i : i + 5000], schema=_GONE)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in by_key(batches, "chunk"):
            row = next(r for r in rows if r["ids"] is not None)
            ids, null, lengths, texts = unpack(row)
            a = np.frombuffer(texts, np.uint8)
            ends = np.cumsum(lengths)
            begins = ends - lengths
            marks = np.zeros(len(a) + 1, bool)  # strings that go, by their first byte
            got = [r for r in rows if r["ids"] is None]
            places, masks = (np.frombuffer(b"".join(unzip_bytes(r[c]) for r in got), np.uint32) for c in ("places", "masks"))
            places = places.astype(np.int64)
            doc = np.searchsorted(ends, places, side="right")
            low, high = begins[doc], ends[doc] - width
            for o in range(width - k + 1):
                start = places - o
                ok = (masks >> np.uint32(o) & np.uint32(1) > 0) & (start >= low) & (start <= high)
                marks[start[ok]] = True
            seen = np.cumsum(marks)
            gone = (seen[:-1] - np.concatenate([np.zeros(min(width, len(a)), seen.dtype), seen[: max(len(a) - width, 0)]])) > 0
            edge = gone.copy()
            edge[1:] &= ~gone[:-1]
            inner = begins[(begins > 0) & (begins < len(a))]
            edge[inner] = gone[inner]
            removed, spans = np.append(0, np.cumsum(gone)), np.append(0, np.cumsum(edge))
            for i in range(0, len(ids), 200):
                lo, hi = begins[i : i + 200], ends[i : i + 200]
                kept = [a[p:q][~gone[p:q]].tobytes() for p, q in zip(lo.tolist(), hi.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(ids[i : i + 200], mask=null[i : i + 200]), pa.array(hi - lo), pa.array((removed[hi] - removed[lo]).astype(np.int64)), pa.array((spans[hi] - spans[lo]).astype(np.int64)), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    both = chunks.unionByName(replies, allowMissingColumns=True).repartition(max(n_chunks, partitions(spark)), "chunk").sortWithinPartitions("chunk")
    runs = both.mapInArrow(suffixes, "range long, chunk long, prefixes binary, rest binary, docs binary, places binary")
    merged = runs.repartition(ranges, "range").sortWithinPartitions("range", "chunk")
    gone = write_table(merged.mapInArrow(merge, "chunk long, places binary, masks binary, string binary, doc long, place long, o long"), "gone")
    decided = gone.where("masks is not null").select("chunk", "places", "masks")
    if open_cores:
        shared = gone.where("string is not null").select("chunk", "string", "doc", "place", "o")
        least = shared.groupBy("string").agg(F.min("doc").alias("least"))
        more = join_unique(shared, least, "string").where("doc > least").groupBy("chunk", "place").agg(F.bit_or(F.expr("shiftleft(1L, int(o))")).alias("mask"))
        decided = decided.unionByName(more.mapInArrow(_as_rows, "chunk long, places binary, masks binary"))
    both = chunks.unionByName(decided, allowMissingColumns=True).repartition(max(n_chunks, partitions(spark)), "chunk").sortWithinPartitions("chunk")
    return both.mapInArrow(finish, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


_RUN = pa.schema([("range", pa.int64()), ("chunk", pa.int64()), ("prefixes", pa.binary()), ("rest", pa.binary()), ("docs", pa.binary()), ("places", pa.binary())])
_GONE = pa.schema([("chunk", pa.int64()), ("places", pa.binary()), ("masks", pa.binary()), ("string", pa.binary()), ("doc", pa.int64()), ("place", pa.int64()), ("o", pa.int64())])


def _as_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        cells = [[zip_bytes(np.array([x], np.uint32).tobytes()) for x in batch.column(c).to_pylist()] for c in (1, 2)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cells[0], pa.binary()), pa.array(cells[1], pa.binary())], ["chunk", "places", "masks"])


def _runs(x: np.ndarray) -> list[tuple[int, int, int]]:
    if not len(x):
        return []
    edges = np.flatnonzero(np.append(True, x[1:] != x[:-1]))
    return list(zip(x[edges].tolist(), edges.tolist(), np.append(edges[1:], len(x)).tolist(), strict=True))


def _limits(chunks: DataFrame, n_chunks: int, ranges: int, width: int, k: int, most: int = 100_000) -> list[bytes]:
    """Limits of the ranges, from suffixes at evenly spaced places: a bounded sample, which only sets the size of the ranges.

    A limit is cut to the anchor's k bytes (and so never parts an anchor's suffixes), but where
    several limits have the same anchor, a very frequent one.
    """
    per = max(1, min(64, most // max(n_chunks, 1)))
    step = max(1, n_chunks // most)

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            _, _, lengths, texts = unpack(row)
            a, ends = np.frombuffer(texts, np.uint8), np.cumsum(lengths)
            if row["chunk"] % step == 0 and len(a):
                places = np.unique(np.linspace(0, len(a) - 1, per).astype(np.int64))
                doc = np.searchsorted(ends, places, side="right")
                x = _contexts(a, places, (ends - lengths)[doc], ends[doc], width, k)
                yield pa.RecordBatch.from_arrays([pa.array([b.tobytes() for b in x], pa.binary())], ["suffix"])

    found = sorted(bytes(r.suffix) for r in chunks.mapInArrow(some, "suffix binary").collect())
    picked = {found[i * len(found) // ranges] for i in range(1, ranges)} if found else set()  # fewer than ranges from fewer suffixes
    cores = Counter(s[:k] for s in picked)
    size = 2 * width - k
    return sorted({s if cores[s[:k]] > 1 else s[:k] + bytes(size - k) for s in picked})

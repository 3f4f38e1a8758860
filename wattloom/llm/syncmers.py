"""Document fingerprints from closed syncmers.

A k-mer (of `k` code points) is an anchor if the smallest of its inner substrings of `s` code points
stands at its first or last place. Whether it is one depends on the k-mer alone, so an edit
elsewhere never moves an anchor. anchors() gives them with their positions; a fingerprint is the hashes
of all of them (32 bits each) in the order of their positions, as hexadecimal digits, whatever the length of the text. likeness() compares
two fingerprints: the n-th anchor of a hash in one meets the n-th in the other, the most of these that stand in the same order in both
are what the texts have in common, and that is given as a share of all anchors of both. A text without
anchors (shorter than k, say) has one hash, of the whole text; an empty one has none, is like
another empty one (1) and unlike any other (0).

successors() pairs each document with the next in the order of doc_id (after the last: the first)
without a sort in one task: documents are dealt by doc_id into ranges whose limits come from
quantiles, and the first of a range goes to the one before too.

Nulls: a null text is an empty one, a null doc_id comes last. Documents with the same doc_id are in
the order of their texts' hashes. Texts are processed whole. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NO_ID, partitions

_MUL, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
#: Code points that are worked on at once; the parts overlap by k - 1.
STEP = 32768


def _hashes(codes: np.ndarray, n: int) -> np.ndarray:
    """A hash of every n codes in a row."""
    out = np.zeros(len(codes) - n + 1, np.uint64)
    for j in range(n):
        out *= _MUL
        out += codes[j : j + len(out)]
    out ^= out >> np.uint64(31)
    out *= _MIX
    out ^= out >> np.uint64(29)
    return out


def _least(x: np.ndarray, n: int) -> np.ndarray:
    """The least of every n values in a row."""
    have = 1
    out = x
    while have < n:
        step = min(have, n - have)
        out = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out


def anchors(text: str, k: int = 15, s: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(positions, hashes) of the closed syncmers."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
    places, found = [], []
    for at in range(0, len(codes) - k + 1, STEP):
        part = codes[at : at + STEP + k - 1]
        inner = _hashes(part, s)
        span = k - s + 1
        least = _least(inner, span)
        here = np.flatnonzero((inner[: len(least)] == least) | (inner[span - 1 :] == least))
        places.append(here + at)
        found.append(_hashes(part, k)[here])
    if places:
        return np.concatenate(places), np.concatenate(found)
    return np.zeros(0, np.int64), np.zeros(0, np.uint64)


def marks(text: str, k: int = 15, s: int = 5) -> np.ndarray:
    """The hashes of all anchors in the order of their positions, as 32-bit numbers."""
    if not text:
        return np.zeros(0, np.uint32)
    found = anchors(text, k, s)[1]
    if not len(found):
        return np.array([int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=4).digest(), "big")], np.uint32)
    return (found >> np.uint64(32)).astype(np.uint32)


def fingerprint(found: np.ndarray) -> str:
    return found.astype(">u4").tobytes().hex()


def marks_of(fingerprint: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(fingerprint), ">u4").astype(np.uint32)


def _numbered(found: np.ndarray) -> np.ndarray:
    """The hashes made distinct: each with the number of times that it came before."""
    found = found.astype(np.uint64)
    order = np.argsort(found, kind="stable")
    ranked = found[order]
    first = np.flatnonzero(np.append(True, ranked[1:] != ranked[:-1]))
    out = np.empty_like(found)
    out[order] = ranked + (np.arange(len(ranked)) - np.repeat(first, np.diff(np.append(first, len(ranked))))).astype(np.uint64) * _MUL
    return out


def in_order(a: np.ndarray, b: np.ndarray) -> int:
    """How many anchors of a and b, given in order, can be matched without crossing."""
    _, left, right = np.intersect1d(_numbered(a), _numbered(b), return_indices=True)
    right = right[np.argsort(left)]
    if (right[1:] > right[:-1]).all():
        return len(right)
    tails: list[int] = []
    for x in right.tolist():
        at = bisect_left(tails, x)
        tails[at : at + 1] = [x]
    return len(tails)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = in_order(a, b)
    return both / (len(a) + len(b) - both)


def _range_of(limits: np.ndarray, parts: np.ndarray, place: np.ndarray, tie: np.ndarray) -> np.ndarray:
    """The number of a document's range; a range of one doc_id that has very many documents is parted by their texts' hashes."""
    at = np.searchsorted(limits, place, side="left")
    first = np.append(0, np.cumsum(parts))
    n = np.append(parts, 1)[at]
    share = ((tie >> 32) + (1 << 31)) * n >> 32
    return first[at] + np.where(n > 1, np.minimum(share, n - 1), 0)


def successors(docs: DataFrame, then: Callable, schema: str, per: int = 4000) -> DataFrame:
    """then(doc, next) for every document; each is (doc_id, text), the next one that of the following document. Ranges have about `per` documents."""
    spark = docs.sparkSession
    place = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("_place")
    slim = docs.select(place)
    n = max(2 * partitions(spark), docs.count() // per)
    cuts = np.array(slim.agg(F.percentile_approx("_place", [k / n for k in range(1, n)], 100 * n)).head()[0] or [], np.int64)
    limits, again = np.unique(np.append(cuts, [NO_ID]), return_counts=True)
    # A doc_id at several quantiles has as many ranges, after one for what comes before it.
    hot = limits[again > 2]
    limits = np.unique(np.concatenate([limits, hot - 1]))
    parts = np.ones(len(limits), np.int64)
    parts[np.searchsorted(limits, hot)] = again[again > 2]

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(_range_of(limits, parts, *at))], ["place", "tie", "range"])

    keys = docs.select(place, F.xxhash64("text").alias("tie"))
    found = keys.mapInArrow(ranges, "place long, tie long, range long").groupBy("range").agg(F.min(F.struct("place", "tie")).alias("first")).orderBy("range").collect()  # a row per range
    number = {r["range"]: i for i, r in enumerate(found)}
    before = {tuple(r["first"]): i - 1 if i else len(found) - 1 for i, r in enumerate(found)}  # of the first of all: the last range

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place, tie = (batch.column(c).to_numpy(zero_copy_only=False) for c in range(2))
            rows = [(i, number[r], 0) for i, r in enumerate(_range_of(limits, parts, place, tie).tolist())]
            rows += [(i, before[p], 1) for i, p in enumerate(zip(place.tolist(), tie.tolist(), strict=True)) if p in before]
            take = pa.array([r[0] for r in rows], pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.int64())] + [c.take(take) for c in batch.columns], ["range", "after", "place", "tie", "doc_id", "text"])

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, done, size = None, [], 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist(done, schema=_arrow(schema))

        for batch in batches:
            for r, after, doc_id, text in zip(*(batch.column(c).to_pylist() for c in ("range", "after", "doc_id", "text")), strict=True):
                doc = (doc_id, text or "")
                if last is not None and last[0] == r:
                    done.append(then(last[1], doc))
                    size += 1
                last = None if after else (r, doc)
                if size >= 500:
                    yield out()
                    done, size = [], 0
        if done:
            yield out()

    rows = docs.select(place, F.xxhash64("text").alias("tie"), F.col("doc_id").cast("long"), F.col("text").cast("string"))
    rows = rows.mapInArrow(deal, "range int, after long, place long, tie long, doc_id long, text string")
    rows = rows.repartitionById(max(len(found), 1), "range").sortWithinPartitions("range", "after", "place", "tie")
    return rows.mapInArrow(follow, schema)


def _arrow(schema: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "string": pa.string(), "double": pa.float64()}
    return pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in schema.split(", ")])


COMPARED = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def compare_edited(docs: DataFrame, k: int = 15, s: int = 5) -> DataFrame:
    """Fingerprint of each text and of its edited form: its last quarter replaced by the beginning of the next text."""
    memory: list = [None, None]

    def marked(text: str) -> np.ndarray:
        if memory[0] != text:  # the next document's is needed again for that document
            memory[:] = text, marks(text, k, s)
        return memory[1]

    def then(doc: tuple, after: tuple) -> dict:
        text, cut = doc[1], len(doc[1]) // 4
        edited = text[: len(text) - cut] + after[1][:cut]
        own = marked(text)
        new = own if edited == text else marks(edited, k, s)
        following = marked(after[1])
        return {
            "doc_id": doc[0], "n_chars": len(text), "edited_sha256": hashlib.sha256(edited.encode()).hexdigest(), "fingerprint": fingerprint(own),
            "edited_fingerprint": fingerprint(new), "near_edited": likeness(own, new), "near_next": likeness(own, following),
        }

    return successors(docs, then, COMPARED)


def fingerprints(docs: DataFrame, k: int = 15, s: int = 5) -> DataFrame:
    """(doc_id, n_anchors, fingerprint) of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [x or "" for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(anchors(x, k, s)[0]) for x in texts], pa.int64()), pa.array([fingerprint(marks(x, k, s)) for x in texts])], ["doc_id", "n_anchors", "fingerprint"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_anchors long, fingerprint string")



"""SimHash near-duplicates: fingerprints, and links by the general pigeonhole principle.

Fingerprints have 64 bits, set where over half the 64-bit hashes of a text's word shingles have
them. Two fingerprints link if they differ in at most `bits` bits.

Equal fingerprints are merged first. The 64 bits are put into `parts` groups (as many as bits may
differ, whatever the number of fingerprints, so that a fingerprint gives as many rows in a large table as in
a small one) so that correlated bits meet (what correlates between groups makes candidates for nothing). By the general pigeonhole
principle, thresholds t of the groups that sum to bits - parts + 1 (-1: skip the group) miss no
link: some group differs by at most its t. Each fingerprint gets its own thresholds, by dynamic
programming over the estimated candidates: a group in which its value is a frequent one is
skipped or kept exact, and its share goes to the others. Fingerprints are filed once per group
under their value; each probes the values within its threshold. Filed and probing rows meet in
one task per value, where XOR and popcount verify them in blocks. Only a spanning forest of the
links found there goes on, so a group of very many near copies gives no more rows than it has
fingerprints. Frequent values (known from counts of all fingerprints; there can be only few) are
dealt to several tasks, probing rows by salt. These are at
most SALTS for each value, so the copies of filed rows grow with the fingerprints, not with the square of a value's.

Nulls: a null text counts as empty (fingerprint 0); a null doc_id stays null and never is a
component's id unless all of the component lack one. Repeated rows stay rows. Long texts are
processed whole. An empty table gives an empty result. Only doc_id and text are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, NO_ID, UPPER, join_unique, partitions, write_table
from .components import connected_components

_WORDS = re.compile(rb"[^\x20\x09-\x0D]+")
_LOWER = bytes.maketrans(UPPER.encode(), LOWER.encode())
#: Filed rows of a value that one task compares with one salt of probing rows, at least.
BLOCK = 4096
#: Salts of a value, at most.
SALTS = 64


def fingerprint(text: bytes, shingle: int) -> int:
    import xxhash

    words = _WORDS.findall(text.translate(_LOWER))
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    k = min(shingle, len(words))
    starts = np.concatenate([[0], ends[:-1] + 1])[: len(words) - k + 1].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], 42) for a, b in zip(starts, ends[k - 1 :].tolist(), strict=True)), np.uint64, len(starts))
    return bits_of_hashes(hashes)


def bits_of_hashes(hashes: np.ndarray) -> int:
    """The bits that over half of the hashes have."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65536):
        part = hashes[at : at + 65536]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """(doc_id, tie, fp): tie is the hash of the text, fp the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(x or b"", shingle) for x in batch.column(2).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found.view(np.int64))], ["doc_id", "tie", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("tie"), F.col("text").cast("binary")).mapInArrow(run, "doc_id long, tie long, fp long")


def _bit_matrix(fps: DataFrame) -> np.ndarray:
    """How often each two bits are set together, over all fingerprints; 64 x 64 and the number of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((64, 64)), 0
        for batch in batches:
            bits = np.unpackbits(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            total, n = total + bits.T @ bits, n + len(bits)
        i = np.arange(64)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(np.repeat(i, 64), 64)), pa.array(np.append(np.tile(i, 64), 64)), pa.array(np.append(total.ravel(), n))], ["i", "j", "n"])

    rows = fps.select("fp").mapInArrow(run, "i long, j long, n double").groupBy("i", "j").agg(F.sum("n").alias("n")).collect()  # 64 x 64 + 1 rows
    out = np.zeros((65, 65))
    for r in rows:
        out[r.i, r.j] = r.n
    return out


def bit_groups(together: np.ndarray, parts: int) -> list[list[int]]:
    """The bits of each group: it takes, one by one, the free bit that correlates most with those it has."""
    n = max(together[64, 64], 1)
    share = np.diag(together)[:64] / n
    both = together[:64, :64] / n - np.outer(share, share)
    spread = np.sqrt(np.maximum(share * (1 - share), 1e-12))
    alike = np.abs(both / np.outer(spread, spread))
    free, groups = list(range(64)), []
    for p in range(parts):
        size = (64 - sum(map(len, groups))) // (parts - p)
        group = [max(free, key=lambda b: alike[b, free].sum())]
        free.remove(group[0])
        while len(group) < size:
            best = max(free, key=lambda b: alike[b, group].sum())
            group.append(best)
            free.remove(best)
        groups.append(sorted(group))
    return groups


def _project(fp: np.ndarray, group: list[int]) -> np.ndarray:
    out = np.zeros(len(fp), np.int64)
    for k, b in enumerate(group):
        out |= ((fp >> np.uint64(b)) & np.uint64(1)).astype(np.int64) << k
    return out


def allot(cost: np.ndarray, total: int) -> np.ndarray:
    """Thresholds from -1 on, of each row and group, that sum to total at the least cost[row, group, threshold + 1]."""
    rows, parts, kinds = cost.shape
    width = total + parts + 1  # sums of thresholds + 1
    best = np.full((rows, width), np.inf)
    best[:, 0] = 0
    took = np.zeros((parts, rows, width), np.int64)
    for p in range(parts):
        new = np.full((rows, width), np.inf)
        for t in range(min(kinds, width)):
            through = best[:, : width - t] + cost[:, p, t, None]
            better = through < new[:, t:]
            new[:, t:] = np.where(better, through, new[:, t:])
            took[p][:, t:] = np.where(better, t, took[p][:, t:])
        best = new
    at, out = np.full(rows, total + parts), np.zeros((rows, parts), np.int64)
    for p in reversed(range(parts)):
        out[:, p] = took[p][np.arange(rows), at]
        at = at - out[:, p]
    return out - 1


def _spanning(filed: np.ndarray, probing: np.ndarray, bits: int) -> list[tuple[int, int]]:
    """A spanning forest (as positions in a list of distinct fingerprints) of the links between the two, with that list."""
    values, at = np.unique(np.concatenate([filed, probing]), return_inverse=True)
    left, right = at[: len(filed)], at[len(filed) :]
    root = np.arange(len(values))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    links = []
    for k in range(0, len(right), 512):
        some = right[k : k + 512]
        a, b = np.nonzero(np.bitwise_count(values[some][:, None] ^ values[left][None, :]) <= bits)
        for x, y in zip(some[a].tolist(), left[b].tolist(), strict=True):
            p, q = find(x), find(y)
            if p != q:
                root[p] = q
                links.append((x, y))
    return [(int(values[x]), int(values[y])) for x, y in links]


def cheapest_parts(n: int, bits: int) -> int:
    """How many groups make the fewest probes and candidates per fingerprint, were all values as frequent."""

    def cost(parts: int) -> float:
        low, more = divmod(bits - parts + 1, parts)  # thresholds as even as can be
        size = 64 // parts
        probes = lambda t: sum(comb(size, r) for r in range(t + 1)) if t >= 0 else 0
        return (more * probes(low + 1) + (parts - more) * probes(low)) * (4 + n / 2.0**size)

    return min(range(min(2, bits + 1), bits + 2), key=cost)


def filed_and_probing(fps: DataFrame, bits: int = 4, parts: int | None = None) -> DataFrame:
    """(key, salt, probes, fp): the rows that the distinct fingerprints fps (fp long) are filed under and those that probe."""
    spark = fps.sparkSession
    together = _bit_matrix(fps)
    n = int(together[64, 64])
    parts = parts or max(min(2, bits + 1), bits)  # not cheapest_parts(n, bits): the rows of a fingerprint would grow with n
    block = max(BLOCK, -(-n // SALTS))
    groups = bit_groups(together, parts)
    project = [f"({' | '.join(f'(shiftrightunsigned(fp, {b}) & 1L) << {k}' for k, b in enumerate(g))})" for g in groups]
    values = fps.selectExpr(f"posexplode(array({', '.join(project)})) as (part, value)")
    # A value is frequent with 1/1000 of all fingerprints or more, so there are at most 1000 of each group.
    often = values.groupBy("part", "value").count().where(F.col("count") >= max(BLOCK // 4, n // 1000)).collect()
    frequent = spark.sparkContext.broadcast({(r["part"], r["value"]): r["count"] for r in often})
    flips = [[sum(1 << x for x in c) for r in range(t + 1) for c in combinations(range(len(g)), r)] for g in groups for t in range(bits + 1)]
    flips = {(p, t): np.array(flips[p * (bits + 1) + t], np.int64) for p in range(parts) for t in range(bits + 1)}

    def file_and_probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = frequent.value
        for batch in batches:
            signed = batch.column(0).to_numpy(zero_copy_only=False)
            fp = signed.view(np.uint64)
            for lo in range(0, len(fp), 2000):
                part_fp = fp[lo : lo + 2000]
                own = [_project(part_fp, g) for g in groups]
                held = [np.array([often.get((p, v), 0) for v in own[p].tolist()], float) for p in range(parts)]
                cost = np.zeros((len(part_fp), parts, bits + 2))
                for p in range(parts):
                    for t in range(bits + 1):
                        cost[:, p, t + 1] = held[p] + len(flips[p, t]) * (4 + n / 2.0 ** len(groups[p]))
                chosen = allot(cost, bits - parts + 1)
                for p in range(parts):
                    salts = np.maximum(1, -(-held[p].astype(np.int64) // block))
                    who = np.repeat(np.arange(len(part_fp)), salts)
                    salt = np.arange(len(who)) - np.repeat(np.cumsum(salts) - salts, salts)
                    out = [(own[p][who], salt, who, np.zeros(len(who), bool))]
                    for t in np.unique(chosen[:, p]):
                        if t >= 0:
                            rows = np.flatnonzero(chosen[:, p] == t)
                            near = (own[p][rows][:, None] ^ flips[p, t][None, :]).ravel()
                            who = np.repeat(rows, len(flips[p, t]))
                            share = np.array([often.get((p, v), 0) for v in near.tolist()]) if often else np.zeros(len(near), np.int64)
                            share = np.maximum(1, -(-share // block))
                            out.append((near, (part_fp[who] % share.astype(np.uint64)).astype(np.int64), who, np.ones(len(who), bool)))
                    value, salt, who, probes = (np.concatenate(x) for x in zip(*out, strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(value), pa.array(salt * parts + p), pa.array(probes), pa.array(part_fp[who].view(np.int64))], ["key", "salt", "probes", "fp"])

    return fps.select("fp").mapInArrow(file_and_probe, "key long, salt long, probes boolean, fp long")


def link_fingerprints(fps: DataFrame, bits: int = 4, parts: int | None = None) -> DataFrame:
    """Links (a, b) between the distinct fingerprints fps (fp long), enough to connect what is connected."""

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Batches sorted by key; a key may go on in the next batch."""
        rest = None
        for batch in _with_end(batches):
            rows = [] if batch is None else [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            if rest is not None and rows:
                rows = [np.concatenate(x) for x in zip(rest, rows, strict=True)]
            elif rest is not None:
                rows = rest
            if not rows:
                continue
            key, salt, probes, fp = rows
            edge = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (salt[1:] != salt[:-1])))
            ends = np.append(edge[1:], len(key))
            if batch is not None:
                rest = [x[edge[-1] :] for x in rows]
                edge, ends = edge[:-1], ends[:-1]
            links = []
            more = ends - edge > 1
            for a, b in zip(edge[more].tolist(), ends[more].tolist(), strict=True):
                asks = probes[a:b]
                filed = fp[a:b][~asks].view(np.uint64)
                if len(filed) and asks.any() and b - a > 2 or len(filed) == 1 and asks.sum() == 1 and fp[a] != fp[b - 1]:
                    links += _spanning(filed, fp[a:b][asks].view(np.uint64), bits)
            if links:
                found = np.array(links, np.uint64)
                yield pa.RecordBatch.from_arrays([pa.array(found[:, 0].copy().view(np.int64)), pa.array(found[:, 1].copy().view(np.int64))], ["a", "b"])

    rows = filed_and_probing(fps, bits, parts).repartition(partitions(fps.sparkSession), "key", "salt").sortWithinPartitions("key", "salt")
    return rows.mapInArrow(meet, "a long, b long")


def _with_end(batches: Iterator) -> Iterator:
    yield from batches
    yield None


def near_duplicates(docs: DataFrame, shingle: int = 4, bits: int = 4, parts: int | None = None) -> DataFrame:
    """(doc_id, tie, fp, group, component_id) of every row; component_id: the smallest doc_id that links reach; tie: the hash of the text; group: the component's own number."""
    found = write_table(fingerprints(docs, shingle), "fingerprints")
    classes = write_table(found.select("fp").distinct(), "classes")
    links = write_table(link_fingerprints(classes, bits, parts).distinct(), "fp-links")
    return named_groups(found.select("doc_id", "tie", F.col("fp").alias("kind")), connected_components(links)).withColumnRenamed("kind", "fp")


def named_groups(found: DataFrame, names: DataFrame) -> DataFrame:
    """(doc_id, tie, kind, group, component_id) from rows (doc_id, tie, kind) of a written table and the components (node, component) of the kinds that have links."""
    kinds = found.groupBy("kind").agg(F.min("doc_id").alias("_first"))
    kinds = kinds.join(names.withColumnRenamed("node", "kind"), "kind", "left").withColumn("group", F.coalesce("component", "kind"))
    kinds = write_table(kinds.select("kind", "group", "_first"), "kinds")
    smallest = kinds.groupBy("group").agg(F.min("_first").alias("component_id"))
    kinds = write_table(join_unique(kinds.select("kind", "group"), smallest, "group").select("kind", "group", "component_id"), "components")
    return join_unique(found, kinds, "kind").select("doc_id", "tie", "kind", "group", "component_id")


def one_of_each(docs: DataFrame, **how) -> DataFrame:
    """docs without near copies by fingerprints."""
    return first_of_each(docs, near_duplicates(docs.select("doc_id", "text"), **how))


def first_of_each(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The rows of docs that lead their groups in found (doc_id, tie, group): the smallest doc_id (null last), of texts that share it the smallest hash; of equal rows one.

    A document is known by its id and its text's hash, so texts that share an id, or have none, are kept apart.
    What is dropped is what is joined, so where few rows are no text is shuffled.
    """
    place = F.coalesce("doc_id", F.lit(NO_ID))
    known = write_table(found.groupBy("group", "doc_id", "tie").agg(F.count(F.lit(1)).alias("rows")), "known")
    leads = known.groupBy("group").agg(F.min(F.struct(place.alias("_place"), "tie")).alias("_lead"), F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")
    gone = join_unique(known, leads, "group").where(F.struct(place.alias("_place"), "tie") != F.col("_lead"))
    gone = write_table(gone.select(F.col("doc_id").alias("_sh_id"), F.col("tie").alias("_sh_tie")), "gone")
    same = docs["doc_id"].cast("long").eqNullSafe(F.col("_sh_id")) & (F.xxhash64(docs["text"]) == F.col("_sh_tie"))
    out = docs.join(gone, same, "left_anti")
    again = known.where("rows > 1").select(F.col("doc_id").alias("_sh_id"), F.col("tie").alias("_sh_tie"))
    if again.isEmpty():
        return out
    whole = F.struct(*[out[c] for c in out.columns])
    one = out.join(again, same, "left_semi").groupBy(F.col("doc_id").alias("_sh_id"), F.xxhash64("text").alias("_sh_tie")).agg(F.min_by(whole, F.xxhash64(*[out[c] for c in out.columns])).alias("_sh_row"))
    return out.join(again, same, "left_anti").unionByName(one.select("_sh_row.*"))

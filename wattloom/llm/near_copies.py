"""Near copies by the exact Jaccard similarity of word shingles: SimHash first, a prefix filter for the rest.

Two texts link if the sets of their word shingles (five words, lower case; a shorter text is one
shingle) have a Jaccard similarity of `least` or more. Equal sets are merged first.

1. SimHash. The fingerprints of the sets are linked at a few bits by the general pigeonhole of simhash.py
   and checked exactly. That joins copies with very few changes, whatever their number, in linear time. It
   cannot do all: at a similarity of 0.8 fingerprints of 64 bits differ in 10 bits on average and in up
   to about 20, for which every fingerprint would have to probe most of a part's values.
2. Prefix filter, which misses no pair: in one order of all shingles, two sets that are so alike share
   one of their first n - ceil(least n) + 1. Sets of different components that share such a shingle are
   compared by their sizes and by parities of as many bits as they have shingles (of 512 to 1024 bits, then of
   all), which differ in at most as many bits as the sets in shingles; what passes is compared exactly.
   Of each group only what connects it (a star around one of them, as far as that goes) is compared at first. If some of that fails, so
   are stars around other sets of the groups concerned, and then all pairs that are still in different components.

Groups over BLOCK are dealt to several tasks; the components found there are joined by one set of each,
and what then is still apart is compared between all blocks.

Any order is right. Shingles that are frequent in a sample of documents come last, so they are
among the first of few texts.

Nulls and repeated rows are as in simhash: a null text counts as empty, empty texts are alike, a
null doc_id is a component's id only where all lack one. Only doc_id and text are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import mix64
from .common import LOWER, TEXTS, UPPER, frequent, join_unique, partitions, write_table
from .components import connected_components
from .simhash import bits_of_hashes, link_fingerprints, named_groups

_WORDS = re.compile(rb"[^\x20\x09-\x0D]+")
_LOWER = bytes.maketrans(UPPER.encode(), LOWER.encode())
#: Sets that share a shingle up to this number are compared in one step; of more, one distance after another.
SMALL = 64
#: Sets that share a shingle and are compared in one task.
BLOCK = 4096
#: Documents whose shingles tell which are frequent, and in how many of them a frequent one is.
SAMPLE, OFTEN = 5000, 2
#: Bits of the parity that goes with every shared shingle, at least and at most (powers of two).
FEWEST, MOST = 512, 1024
KEYED = ["key", "salt", "turn", "n", "sid", "part", "odd"]
#: Further stars around other sets before all pairs that are left are compared.
ROUNDS = 2


def shingles(text: bytes, k: int) -> np.ndarray:
    """The distinct hashes of the word shingles, in ascending order."""
    import xxhash

    words = _WORDS.findall(text.translate(_LOWER))
    if not words:
        return np.zeros(0, np.uint64)
    each = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    k = min(k, len(each))
    out = np.zeros(len(each) - k + 1, np.uint64)
    for j in range(k):
        out = mix64(out * np.uint64(3) + each[j : j + len(out)])
    return np.unique(out)


def parity(found: np.ndarray, most: int) -> bytes:
    """Bit i is the parity of the number of hashes that end in i; as many bits as hashes, within limits."""
    size = FEWEST
    while size < min(len(found), most):
        size *= 2
    odd = np.bincount((found & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def _folded(odd: list[bytes], size: int) -> np.ndarray:
    """Parities of `size` bits from longer ones, as rows of numbers."""
    out = np.zeros((len(odd), size // 64), np.uint64)
    of = np.fromiter(map(len, odd), np.int64, len(odd))
    for n in np.unique(of).tolist():
        at = np.flatnonzero(of == n)
        words = np.frombuffer(b"".join([odd[i] for i in at.tolist()]), np.uint64).reshape(len(at), -1, size // 64)
        out[at] = np.bitwise_xor.reduce(words, axis=1)
    return out


def _frequent(docs: DataFrame, k: int) -> np.ndarray:
    """Hashes that are in OFTEN or more of about SAMPLE documents: at most SAMPLE / OFTEN times the shingles of a text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingles(x or b"", k) for x in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([*found, np.zeros(0, np.uint64)]).view(np.int64))], ["key"])

    every = max(1, docs.count() // SAMPLE)
    some = docs.where(F.pmod(F.xxhash64(F.lit(5), "doc_id", F.length("text")), F.lit(every)) == 0)
    often = some.select(F.col("text").cast("binary")).mapInArrow(run, "key long").groupBy("key").count().where(F.col("count") >= OFTEN).select("key").toArrow()
    return np.sort(often["key"].to_numpy().view(np.uint64))


def _among(sorted_keys: np.ndarray, x: np.ndarray) -> np.ndarray:
    if not len(sorted_keys):
        return np.zeros(len(x), bool)
    return sorted_keys[np.minimum(np.searchsorted(sorted_keys, x), len(sorted_keys) - 1)] == x


def shingle_sets(docs: DataFrame, k: int, least: float) -> DataFrame:
    """(doc_id, tie, sid, fp, n, odd, wide, first): the text's hash, the hash of the set, its fingerprint, size, parity, the parity of all bits (only of large sets), and the shingles that two sets alike share one of."""
    frequent = docs.sparkSession.sparkContext.broadcast(_frequent(docs, k))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        last = frequent.value
        for batch in batches:
            sid, fp, n, odd, wide, first = [], [], [], [], [], []
            for text in batch.column(2).to_pylist():
                found = shingles(text or b"", k)
                sid.append(xxhash.xxh64_intdigest(found.tobytes()))
                fp.append(bits_of_hashes(found))
                n.append(len(found))
                odd.append(parity(found, MOST))
                wide.append(parity(found, len(found)) if len(found) > MOST else None)
                late = _among(last, found)
                m = len(found) - ceil(least * len(found) - 1e-9) + 1 if len(found) else 0
                first.append(np.concatenate([found[~late], found[late]])[:m].view(np.int64))
            cells = [batch.column(0), batch.column(1), *[pa.array(np.array(x, np.uint64).view(np.int64)) for x in (sid, fp)], pa.array(n, pa.int64()), pa.array(odd, pa.binary()), pa.array(wide, pa.binary()), pa.array(first, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(cells, ["doc_id", "tie", "sid", "fp", "n", "odd", "wide", "first"])

    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("tie"), F.col("text").cast("binary"))
    return rows.mapInArrow(run, "doc_id long, tie long, sid long, fp long, n long, odd binary, wide binary, first array<long>")


def _candidates(rows: DataFrame, least: float, forest: bool) -> DataFrame:
    """Pairs (a, b) of sets that share a key and may be alike, from rows KEYED; not those with equal part.

    forest: of each group enough pairs to connect what pairs connect.
    """
    apart = (1 - least) / (1 + least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in _with_end(batches):
            table = None if batch is None else pa.Table.from_batches([batch])
            if rest is not None:
                table = pa.concat_tables([rest, table]) if table is not None else rest
            if table is None or not table.num_rows:
                continue
            key, salt = (table[c].to_numpy() for c in ("key", "salt"))
            edge = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (salt[1:] != salt[:-1])))
            if batch is not None:
                rest = table.slice(edge[-1])
                table, edge = table.slice(0, edge[-1]), edge[:-1]
            if not table.num_rows:
                continue
            found = [x for x in met(edge, table) if len(x)]
            if found:
                pairs = np.unique(np.sort(np.concatenate(found), axis=1), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(pairs[:, 0])), pa.array(np.ascontiguousarray(pairs[:, 1]))], ["a", "b"])

    def met(edge: np.ndarray, table: pa.Table) -> Iterator[np.ndarray]:
        n, sid, part = (table[c].to_numpy() for c in ("n", "sid", "part"))
        odd = table["odd"].to_pylist()
        has, levels, bits = np.fromiter(map(len, odd), np.int64, len(odd)) * 8, [], FEWEST
        while bits <= MOST and (has >= bits).any():  # rows with at least so many bits, and where they stand
            rows = np.flatnonzero(has >= bits)
            where = np.zeros(len(odd), np.int64)
            where[rows] = np.arange(len(rows))
            levels.append((bits, where, _folded([odd[r] for r in rows.tolist()], bits)))
            bits *= 2
        size = np.diff(np.append(edge, len(n)))
        group = np.repeat(np.arange(len(edge)), size)

        def alike(i: np.ndarray, j: np.ndarray) -> np.ndarray:
            """Which of the pairs (i, j) may be."""
            ok = (part[i] != part[j]) & (np.minimum(n[i], n[j]) >= least * np.maximum(n[i], n[j]) - 1e-9)
            for bits, where, folded in levels:
                at = np.flatnonzero(ok & (has[i] >= bits) & (has[j] >= bits))
                ok[at] = np.bitwise_count(folded[where[i[at]]] ^ folded[where[j[at]]]).sum(axis=1) <= apart * (n[i[at]] + n[j[at]]) + 1e-9
            return ok

        label = np.arange(len(n))
        if forest:  # a star around the first of each group, as far as that goes
            first = edge[group]
            rest = np.flatnonzero(label != first)
            rest = rest[alike(first[rest], rest)]
            label[rest] = first[rest]
            same = np.flatnonzero(part == part[first])  # in the component of the first already
            label[same] = first[same]
            yield sid[np.stack([first[rest], rest], axis=1)]
        open_ = np.maximum.reduceat(label, edge) > edge  # groups of several parts
        few = np.flatnonzero((size <= SMALL)[group] & open_[group])
        for d in range(1, SMALL):
            few = few[few + d < len(n)]
            few = few[group[few] == group[few + d]]
            if not len(few):
                break
            at = few[label[few] != label[few + d]]
            at = at[alike(at, at + d)]
            yield sid[np.stack([at, at + d], axis=1)]
        for g in np.flatnonzero((size > SMALL) & open_).tolist():
            lo, m = int(edge[g]), int(size[g])
            own = label[lo : lo + m].copy()
            for d in range(1, m):
                at = np.arange(m - d)
                at = at[own[at] != own[at + d]]
                at = at[alike(lo + at, lo + at + d)]
                if forest:
                    tree = []
                    for i in at.tolist():
                        if own[i] != own[i + d]:
                            tree.append(i)
                            own[own == own[i]] = own[i + d]
                    at = np.array(tree, np.int64)
                yield sid[lo + np.stack([at, at + d], axis=1)]
                if forest and (own == own[0]).all():
                    break

    rows = rows if "turn" in rows.columns else rows.withColumn("turn", F.col("sid"))
    rows = rows.select(KEYED).repartition(partitions(rows.sparkSession), "key", "salt").sortWithinPartitions("key", "salt", "turn", "sid")
    return rows.mapInArrow(run, "a long, b long").distinct()


def _of_all_bits(pairs: DataFrame, classes: DataFrame, least: float) -> DataFrame:
    """The pairs without those of large sets whose parities of all bits differ too much, written."""
    apart = (1 - least) / (1 + least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for n, m, x, y in zip(*(batch.column(c).to_pylist() for c in range(2, 6)), strict=True):
                both = _folded([x, y], 8 * min(len(x), len(y))) if x and y else None
                ok.append(both is None or int(np.bitwise_count(both[0] ^ both[1]).sum()) <= apart * (n + m) + 1e-9)
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    pairs = write_table(pairs, "candidates")
    large = classes.where("wide is not null").select("sid", "n", "wide")
    if large.isEmpty():
        return pairs
    one, other = (large.select(F.col("sid").alias(c), F.col("n").alias(f"n_{c}"), F.col("wide").alias(f"wide_{c}")) for c in "ab")
    both = pairs.join(one, "a", "left").join(other, "b", "left")
    return write_table(both.select("a", "b", "n_a", "n_b", "wide_a", "wide_b").mapInArrow(run, "a long, b long"), "candidates")


def _with_end(batches: Iterator) -> Iterator:
    yield from batches
    yield None


def _verified(pairs: DataFrame, docs: DataFrame, classes: DataFrame, k: int, least: float) -> DataFrame:
    """Those of the pairs (a written table) whose sets have a similarity of `least` or more, written."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            found = [shingles(x or b"", k).tobytes() for x in batch.column(0).to_pylist()]
            sid = np.array([xxhash.xxh64_intdigest(x) for x in found], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(sid), pa.array(found, pa.binary())], ["sid", "found"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = np.sort(np.concatenate([x, y]), kind="stable")
                both = int((both[1:] == both[:-1]).sum())
                ok.append(both >= least * (len(x) + len(y) - both) - 1e-9)
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    named = write_table(classes.join(pairs.select(F.explode(F.array("a", "b")).alias("sid")).distinct(), "sid", "left_semi").select(F.col("doc").alias("_doc"), F.col("tie").alias("_tie")).distinct(), "compared")
    texts = docs.join(named, docs["doc_id"].cast("long").eqNullSafe(F.col("_doc")) & (F.xxhash64(docs["text"]) == F.col("_tie")), "left_semi").select(F.col("text").cast("binary"))
    held = write_table(texts.mapInArrow(sets, "sid long, found binary"), "compared-sets", TEXTS)
    if held.count() > named.count():  # rows that repeat
        held = write_table(held.dropDuplicates(["sid"]), "compared-sets")
    often = {c: frequent(pairs, c) for c in "ab"}
    both = join_unique(pairs, held.select(F.col("sid").alias("a"), F.col("found").alias("x")), "a", often=often["a"])
    both = join_unique(both, held.select(F.col("sid").alias("b"), F.col("found").alias("y")), "b", often=often["b"])
    return write_table(both.select("a", "b", "x", "y").mapInArrow(compare, "a long, b long"), "set-links", TEXTS)


def _neighbours(classes: DataFrame) -> DataFrame:
    """Pairs (a, b) of sets with the same fingerprint: of each task's part of the order of fingerprints, the first of each with its others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            fp, sid = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            if last is not None:
                fp, sid = np.append(last[0], fp), np.append(last[1], sid)
            if len(fp):
                edge = np.flatnonzero(np.append(True, fp[1:] != fp[:-1]))
                first = np.repeat(edge, np.diff(np.append(edge, len(fp))))
                rest, last = np.flatnonzero(first != np.arange(len(fp))), (fp[edge[-1]], sid[edge[-1]])
                a, b = sid[first[rest]], sid[rest]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    n = partitions(classes.sparkSession)
    return classes.select("fp", "sid").repartitionByRange(n, "fp", "sid").sortWithinPartitions("fp", "sid").mapInArrow(run, "a long, b long")


def _named(rows: DataFrame, names: DataFrame) -> DataFrame:
    """rows with part: the component of their set."""
    return rows.join(names.select(F.col("node").alias("sid"), F.col("component").alias("part")), "sid", "left").withColumn("part", F.coalesce("part", "sid"))


def near_duplicates(docs: DataFrame, shingle: int = 5, least: float = 0.8, bits: int = 4) -> DataFrame:
    """(doc_id, tie, group, component_id) of every row; component_id: the smallest doc_id that links reach; tie: the hash of the text; group: the component's own number."""
    found = write_table(shingle_sets(docs, shingle, least), "shingle-sets", TEXTS)
    firsts = found.groupBy("sid").agg(F.min(F.struct(F.coalesce("doc_id", F.lit(2**63 - 1)).alias("place"), "doc_id", "tie")).alias("at"), *[F.first(c).alias(c) for c in ("fp", "n", "odd", "wide", "first")])
    classes = write_table(firsts.select("sid", F.col("at.doc_id").alias("doc"), F.col("at.tie").alias("tie"), "fp", "n", "odd", "wide", "first"), "set-classes")

    lead = write_table(classes.groupBy("fp").agg(F.min("sid").alias("sid")), "fp-leads")
    near = link_fingerprints(lead.select("fp"), bits).distinct().withColumnsRenamed({"a": "fp", "b": "_other"})
    near = near.join(lead, "fp").select(F.col("sid").alias("_a"), F.col("_other").alias("fp")).join(lead, "fp")
    pairs = _neighbours(classes).unionByName(near.select(F.least("_a", "sid").alias("a"), F.greatest("_a", "sid").alias("b")))
    links = _verified(_of_all_bits(pairs, classes, least), docs, classes, shingle, least)
    names = connected_components(links)

    keys = classes.select("sid", F.explode("first").alias("key"))
    shared = keys.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    keys = write_table(keys.join(shared, "key"), "shared-keys")
    about = classes.select("sid", "n", "odd")
    salted = F.expr(f"if(size <= {BLOCK}, 0, pmod(xxhash64(sid, 7), (size + {BLOCK - 1}) div {BLOCK}))")
    pairs = _of_all_bits(_candidates(_named(keys.withColumn("salt", salted).join(about, "sid"), names), least, True), classes, least)
    good = _verified(pairs, docs, classes, shingle, least)
    links = links.unionByName(good)
    names = connected_components(links)
    hot = keys.where(F.col("size") > BLOCK)
    if not hot.isEmpty():
        one = _named(hot, names).groupBy("key", "part").agg(F.min("sid").alias("sid")).withColumn("salt", F.expr(f"pmod(xxhash64(part), 1 + count(1) over (partition by key) div {BLOCK})"))
        more = _of_all_bits(_candidates(one.join(about, "sid"), least, True), classes, least)
        if not more.isEmpty():
            pairs, links = pairs.unionByName(more), links.unionByName(_verified(more, docs, classes, shingle, least))
            names = connected_components(links)

    def still_open(seed: int) -> DataFrame:
        """Rows of the shared keys that a failed pair concerns, or that are large, and whose sets are in several components."""
        failed = pairs.join(links, ["a", "b"], "left_anti").select(F.explode(F.array("a", "b")).alias("sid")).distinct()
        open_keys = keys.join(failed, "sid", "left_semi").select("key").unionByName(hot.select("key")).distinct()
        rest = write_table(_named(keys.join(open_keys, "key", "left_semi"), names), "open-keys")
        apart = rest.groupBy("key").agg(F.min("part").alias("_a"), F.max("part").alias("_b")).where("_a <> _b").select("key")
        return rest.join(apart, "key", "left_semi").withColumn("salt", salted).join(about, "sid").withColumn("turn", F.xxhash64("sid", F.lit(seed)))

    for seed in range(1, ROUNDS + 1):  # other stars, so that few pairs are left for the last step
        more = _of_all_bits(_candidates(still_open(seed), least, True).join(pairs, ["a", "b"], "left_anti"), classes, least)
        if more.isEmpty():
            break
        good = _verified(more, docs, classes, shingle, least)
        pairs, links = pairs.unionByName(more), links.unionByName(good)
        if good.isEmpty():
            break
        names = connected_components(links)
    rest = still_open(0)
    blocks = F.expr(f"(size + {BLOCK - 1}) div {BLOCK}")
    own = F.pmod(F.xxhash64("sid", F.lit(7)), blocks)
    salts = F.transform(F.sequence(F.lit(0).cast("long"), blocks - 1), lambda j: F.least(own, j) * blocks + F.greatest(own, j))
    rest = rest.withColumn("salt", F.explode(salts))
    more = _of_all_bits(_candidates(rest, least, False).join(pairs, ["a", "b"], "left_anti"), classes, least)
    if not more.isEmpty():
        names = connected_components(links.unionByName(_verified(more, docs, classes, shingle, least)))
    return named_groups(found.select("doc_id", "tie", F.col("sid").alias("kind")), names)

"""Nearest neighbours by an inverted multi-index.

The two halves of the vectors are quantised separately with as many centroids as the number of vectors
calls for (`cells`: a seventh of its root, 16 to 1024; k-means on about `sample` vectors, a seeded sample, at
least 16 per centroid); every vector is filed under its pair of centroids. A query goes through the pairs by the sum of its squared distances to
the two centroids, lowest first, with a heap that holds only the frontier, until the pairs it has
taken hold enough vectors, which are reranked by the exact distance.

How many are enough is measured: `trial` queries (a bounded number) are compared with brute force
over all vectors, and the share of vectors at which they reach `recall` is taken.

The pairs are dealt to a fixed number of shards of about equal size; one with more than `block` vectors
(many copies of one vector, say) is dealt to several. A query is sent once to each shard that holds a pair
it takes, with the largest sum of distances that it goes to. A shard compares it with the vectors of its pairs
up to that sum and passes on its best `k`, so the rows that are sent and passed on grow with the queries,
not with the pairs that they take. A shard's vectors stream by; its queries and their best are held.

Vectors that are null, zero, or hold a null or a non-finite component take no part, nor does a null
vec_id. Vectors of another length than most are compared exactly with all of their own length, without the
index. Rows that repeat are candidates each, but ask once; different vectors under one vec_id ask one by
one, and a query is never compared with a row of its own vec_id. An empty table gives an empty result.
Only vec_id and embedding are read.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import sampled, write_table

#: Parts that the index is dealt to. Fixed, so that a query's candidates do not grow with the index; more machines may take more.
SHARDS = 32


def valid_vectors(rows: DataFrame) -> DataFrame:
    """(vec_id, v, dim): the vectors that take part, as doubles."""
    v = F.col("embedding").cast("array<double>")
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where("vec_id is not null and v is not null and size(v) > 0")
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(F.coalesce(x, F.lit(0.0))) & (F.abs(F.coalesce(x, F.lit(0.0))) < float("inf")))
    return rows.where(fine & F.exists("v", lambda x: x != 0)).withColumn("dim", F.size("v"))


def _odd_lengths(rows: DataFrame, every: int, k: int) -> DataFrame:
    """(query_id, ask, vec_id, score): exact, for vectors (vec_id, v, dim) of lengths that few have; in blocks of rows, the best k of each block."""
    asks = rows.where(F.col("vec_id") % every == 0).select("dim", F.col("vec_id").alias("query_id"), F.col("v").alias("_q")).dropDuplicates(["query_id", "_q"])
    blocks = rows.select("dim", F.pmod(F.xxhash64("vec_id", "v"), F.lit(64)).alias("block"), "vec_id", "v")
    apart = F.sqrt(F.aggregate(F.zip_with("_q", "v", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda t, x: t + x))
    met = blocks.join(asks, "dim").where("vec_id <> query_id").select("query_id", F.xxhash64("_q").alias("ask"), "block", "vec_id", apart.alias("score"))
    best = F.row_number().over(Window.partitionBy("query_id", "ask", "block").orderBy("score", "vec_id"))
    return met.withColumn("_rank", best).where(F.col("_rank") <= k).select("query_id", "ask", "vec_id", "score")


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a**2).sum(1)[:, None] + (b**2).sum(1)[None] - 2 * a @ b.T, 0)


def k_means(x: np.ndarray, k: int, rounds: int = 12, seed: int = 3) -> np.ndarray:
    x = np.unique(x, axis=0)
    k = min(k, len(x))
    centres = x[np.sort(np.random.default_rng(seed).choice(len(x), k, replace=False))].copy()
    for _ in range(rounds):
        near = np.concatenate([_apart(x[i : i + 4096], centres).argmin(1) for i in range(0, len(x), 4096)])
        n = np.bincount(near, minlength=k)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    return centres


def nearest_pairs(first: np.ndarray, second: np.ndarray, held: np.ndarray, enough: int) -> list[int]:
    """Pairs (i * len(second) + j) by first[i] + second[j], lowest first, until they hold `enough` vectors."""
    a, b = np.argsort(first, kind="stable"), np.argsort(second, kind="stable")
    fa, sb, la, lb = first[a].tolist(), second[b].tolist(), a.tolist(), b.tolist()
    width, heap, out, got = len(second), [(fa[0] + sb[0], 0, 0)], [], 0
    while heap and got < enough:
        _, i, j = heapq.heappop(heap)
        pair = la[i] * width + lb[j]
        if n := held[pair]:
            out.append(pair)
            got += n
        if j + 1 < width:
            heapq.heappush(heap, (fa[i] + sb[j + 1], i, j + 1))
        if j == 0 and i + 1 < len(la):
            heapq.heappush(heap, (fa[i + 1] + sb[0], i + 1, 0))
    return out


def _best(queries: np.ndarray, names: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place of the query, vec_id, distance) of the k nearest of each query, exact, ties to the smaller vec_id."""
    out: list[tuple] = []
    order = np.argsort(ids, kind="stable")
    ids, x = ids[order], x[order]
    rough = _apart(queries, x)
    own = names[:, None] == ids[None, :]
    rough[own] = np.inf
    for q in range(len(queries)):
        row = rough[q]
        n = len(ids) - int(own[q].sum())
        if n > k:
            limit = np.partition(row, k - 1)[k - 1]
            some = np.flatnonzero(row <= limit + 1e-9 * max(1.0, limit, float((queries[q] ** 2).sum())))  # rounding of the fast form
        else:
            some = np.flatnonzero(~own[q])
        d = np.sqrt(((x[some] - queries[q]) ** 2).sum(1))
        best = np.lexsort((ids[some], d))[:k]
        out.append((np.full(len(best), q), ids[some][best], d[best]))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))


def _marks(x: np.ndarray) -> np.ndarray:
    """A number of each vector, to tell vectors under one vec_id apart."""
    return np.array([zlib.crc32(np.ascontiguousarray(v).tobytes()) for v in x], np.int64)


class Shard:
    """The queries of a shard and the best k of each so far."""

    def __init__(self, no: int, k: int, halves):
        self.no, self.k, self.halves, self.asked, self.ready = no, k, halves, [], False

    def ask(self, ids: np.ndarray, q: np.ndarray, reach: np.ndarray) -> None:
        self.asked.append((ids, q, reach))

    def see(self, pair: np.ndarray, ids: np.ndarray, x: np.ndarray) -> None:
        """Vectors in the order of their pairs, after all queries."""
        if not self.asked:
            return
        if not self.ready:
            self.names, self.q, self.reach = (np.concatenate(c) for c in zip(*self.asked, strict=True))
            self.first, self.second = self.halves(self.q)
            self.norm = (self.q**2).sum(1)
            self.limit = self.reach + 1e-9 * np.maximum(np.maximum(self.reach, self.norm), 1)  # rounding
            self.worst = np.full(len(self.names), np.inf)
            self.best = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)) for _ in range(0, len(self.names), 1024)]
            self.ready = True
        for i in range(0, len(x), 2048):
            for j in range(len(self.best)):
                self._compare(j, pair[i : i + 2048], ids[i : i + 2048], x[i : i + 2048])

    def _compare(self, j: int, pair: np.ndarray, ids: np.ndarray, x: np.ndarray) -> None:
        own = slice(1024 * j, 1024 * (j + 1))
        q, width, k = self.q[own], self.second.shape[1], self.k
        rough, edges = np.full((len(q), len(x)), np.inf), np.flatnonzero(np.append(True, pair[1:] != pair[:-1]))
        for a, b in zip(edges.tolist(), [*edges[1:].tolist(), len(x)], strict=True):
            who = np.flatnonzero(self.first[own, pair[a] // width] + self.second[own, pair[a] % width] <= self.limit[own])
            if len(who):
                rough[who, a:b] = np.nan_to_num(_apart(q[who], x[a:b]), nan=np.finfo(float).max)
        rough[self.names[own][:, None] == ids[None]] = np.inf
        most = self.worst[own] if len(x) <= k else np.minimum(self.worst[own], np.partition(rough, k - 1, axis=1)[:, k - 1])
        most = most + 1e-9 * np.maximum(np.maximum(most, self.norm[own]), 1)  # rounding of the fast form
        r, c = np.nonzero((rough <= most[:, None]) & (rough < np.inf))
        if not len(r):
            return
        d = np.sqrt(np.concatenate([((x[c[t : t + 65536]] - q[r[t : t + 65536]]) ** 2).sum(1) for t in range(0, len(r), 65536)]))
        who, ids, d = (np.concatenate(z) for z in zip(self.best[j], (r, ids[c], d), strict=True))
        order = np.lexsort((ids, d, who))
        who, ids, d = who[order], ids[order], d[order]
        rank = np.arange(len(who)) - np.searchsorted(who, who)
        self.worst[own][who[rank == k - 1]] = d[rank == k - 1] ** 2
        self.best[j] = tuple(z[rank < k] for z in (who, ids, d))

    def found(self) -> pa.RecordBatch:
        best = self.best if self.ready else []
        who = np.concatenate([np.zeros(0, np.int64), *[w + 1024 * j for j, (w, _, _) in enumerate(best)]])
        names, marks = (self.names, _marks(self.q)) if self.ready else (who, who)
        cells = [names[who], marks[who], np.concatenate([np.zeros(0, np.int64), *[i for _, i, _ in best]]), np.concatenate([np.zeros(0), *[d for _, _, d in best]])]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in cells], ["query_id", "ask", "vec_id", "score"])


def search(rows: DataFrame, every: int = 100, k: int = 10, **how) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each row whose vec_id is divisible by `every`."""
    rank = F.row_number().over(Window.partitionBy("query_id", "ask").orderBy("score", "vec_id"))
    return candidates(rows, every, k, **how).withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def candidates(rows: DataFrame, every: int = 100, k: int = 10, cells: int | None = None, sample: int = 8192, trial: int = 96, recall: float = 0.97, block: int = 2048, shards: int = SHARDS) -> DataFrame:
    """query_id, ask, vec_id, score: the k nearest that each shard has found of each query."""
    spark = rows.sparkSession
    all_ = write_table(valid_vectors(rows), "vectors")
    dims = all_.groupBy("dim").count().orderBy(F.desc("count"), "dim").limit(1).collect()
    if not dims:
        return spark.createDataFrame([], "query_id long, ask long, vec_id long, score double")
    x = all_.where(F.col("dim") == dims[0]["dim"]).select("vec_id", "v")
    cells = cells or int(min(1024, max(16, dims[0]["count"] ** 0.5 / 7)))
    some = sampled(x, max(sample, 16 * cells), F.xxhash64(F.lit(11), "vec_id")).collect()
    learn = np.array([r.v for r in some])
    half = max(1, learn.shape[1] // 2)
    codes = [k_means(learn[:, :half], cells), k_means(learn[:, half:], cells) if half < learn.shape[1] else np.zeros((1, 0))]
    width = len(codes[1])

    def halves(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return _apart(v[:, :half], codes[0]), _apart(v[:, half:], codes[1])

    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = halves(_matrix(batch.column(1)))
            yield pa.RecordBatch.from_arrays([pa.array(a.argmin(1) * width + b.argmin(1)), *batch.columns], ["pair", "vec_id", "v"])

    filed = write_table(x.mapInArrow(file, "pair long, vec_id long, v array<double>"), "filed")
    held = np.zeros(len(codes[0]) * width, np.int64)
    for r in filed.groupBy("pair").count().collect():  # at most cells x cells rows
        held[r["pair"]] = r["count"]
    blocks = np.maximum(1, -(-held // block))
    at = np.cumsum(blocks) - blocks  # of each pair's first block
    place_of, turn = np.empty(int(blocks.sum()), np.int64), np.arange(int(blocks.sum()))
    turn = np.where(turn // shards % 2, shards - 1 - turn % shards, turn % shards)  # there and back, the largest first
    place_of[np.argsort(-np.repeat(held / blocks, blocks), kind="stable")] = turn

    asked = write_table(filed.where(F.col("vec_id") % every == 0).dropDuplicates(["vec_id", "v"]), "asked")
    tried = sorted(sampled(asked.select("vec_id", "v"), trial, F.xxhash64(F.lit(13), "vec_id")).collect(), key=lambda r: (r.vec_id, r.v))
    enough = _enough(filed, tried, halves, held, width, k, recall)

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row per query and shard that holds a pair it takes."""
        for batch in batches:
            a, b = halves(_matrix(batch.column(1)))
            for q in range(batch.num_rows):
                pairs = np.array(nearest_pairs(a[q], b[q], held, enough), np.int64)
                reach = float((a[q][pairs // width] + b[q][pairs % width]).max())
                n = blocks[pairs]
                to = np.unique(place_of[np.repeat(at[pairs], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)])
                one = pa.array(np.full(len(to), q))
                yield pa.RecordBatch.from_arrays([pa.array(to.astype(np.int32)), pa.array(np.full(len(to), -1)), batch.column(0).take(one), pa.array(np.full(len(to), reach)), batch.column(1).take(one)], names)

    names, kinds = ["shard", "pair", "vec_id", "reach", "v"], "shard int, pair long, vec_id long, reach double, v array<double>"
    where = spark.sparkContext.broadcast((place_of, at, blocks))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place_of, at, blocks = where.value
        for batch in batches:
            pair, ids = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            no = ((ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(20)) % blocks[pair].astype(np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(place_of[at[pair] + no.astype(np.int64)].astype(np.int32)), batch.column(0), batch.column(1), pa.array(np.zeros(len(ids))), batch.column(2)], names)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Batches sorted by shard and pair; queries (pair -1) come first."""
        now = None
        for batch in batches:
            shard, pair, ids, reach = (c.to_numpy(zero_copy_only=False) for c in batch.columns[:4])
            v = _matrix(batch.column(4))
            for no in np.unique(shard).tolist():
                if now is None or now.no != no:
                    if now is not None:
                        yield now.found()
                    now = Shard(no, k, halves)
                asks, seen = np.flatnonzero((shard == no) & (pair < 0)), np.flatnonzero((shard == no) & (pair >= 0))
                if len(asks):
                    now.ask(ids[asks], v[asks], reach[asks])
                if len(seen):
                    now.see(pair[seen], ids[seen], v[seen])
        if now is not None:
            yield now.found()

    both = asked.select("vec_id", "v").mapInArrow(probe, kinds).unionByName(filed.mapInArrow(place, kinds))
    both = both.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "pair", "vec_id")
    met = both.mapInArrow(meet, "query_id long, ask long, vec_id long, score double")
    odd = all_.where(F.col("dim") != dims[0]["dim"])
    if not odd.isEmpty():
        met = met.unionByName(_odd_lengths(odd, every, k))
    return met


def _enough(filed: DataFrame, tried: list, halves, held: np.ndarray, width: int, k: int, recall: float) -> int:
    """How many vectors the pairs taken must hold so that the tried queries find `recall` of their k nearest."""
    if not tried:
        return 1
    names, q = np.array([r.vec_id for r in tried]), np.array([r.v for r in tried])

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, i, d = _best(q, names, batch.column(1).to_numpy(), _matrix(batch.column(2)), k)
            pair = dict(zip(batch.column(1).to_pylist(), batch.column(0).to_pylist(), strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(n), pa.array(i), pa.array(d), pa.array([pair[x] for x in i.tolist()], pa.int64())], ["query", "vec_id", "score", "pair"])

    near = filed.mapInArrow(exact, "query long, vec_id long, score double, pair long")
    near = near.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy("score", "vec_id"))).where(F.col("rank") <= k).collect()
    total, needs = int(held.sum()), []
    a, b = halves(q)
    for i in range(len(names)):
        order = nearest_pairs(a[i], b[i], held, total + 1)
        upto = dict(zip(order, np.cumsum(held[order]).tolist(), strict=True))
        needs += [upto[r["pair"]] for r in near if r["query"] == i]
    return int(np.quantile(needs, recall, method="higher")) if needs else 1

"""Mixing sources to target weights by Sainte-Lague apportionment, with built-in functions only.

Sources get word targets from their weights; what exceeds a cap (twice the source) is shared
again among the others. Targets become whole numbers of equal-token blocks by highest quotients,
first per source, then per shard of a source. A shard is a seeded random part of its source; its
documents stand in seeded order and are cut into n blocks of equal length. With q blocks to take,
the whole shard is taken q div n times and a run of q mod n blocks, from a seeded start, once more.
So a document is taken whole, but for the two at the ends of that run.

Nulls: a null text has no words, a null source is a source of its own, after all others, a null
doc_id is an id like any other. Repeated rows are separate documents. An empty table gives an
empty result. Only doc_id, text and source are read; other columns of docs may have any names. Tables of
sources and of shards are small, so their windows are over one partition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD_AND_GAP, word_count, write_table

WEIGHTS = (3, 1, 2)


def sized(docs: DataFrame, seed: int = 17) -> DataFrame:
    """docs and, of each, _size (words) and _order (its place in the seeded order)."""
    return docs.withColumns({"_size": word_count(F.col("text")), "_order": F.xxhash64(F.lit(seed), "doc_id", "text")})


def source_targets(rows: DataFrame, weights: tuple = WEIGHTS, share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """(source, _no, _words, _target, _capped) from rows (source, _size); one row per source.

    With sources in the order of (cap x words) / weight, the level that uncapped sources reach per
    unit of weight is the highest of (budget - caps before) / (weights from here on).
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_fill = Window.orderBy("_fill", "_no")
    before = by_fill.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_fill.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    kinds = F.array(*[F.lit(float(w)) for w in weights])
    out = rows.groupBy("source").agg(F.sum("_size").alias("_words")).withColumn("_no", F.row_number().over(by_name))
    out = out.withColumns({"_weight": F.element_at(kinds, (F.col("_no") - 1) % len(weights) + 1), "_most": F.col("_words") * cap})
    out = out.withColumns({"_fill": F.col("_most") / F.col("_weight"), "_budget": F.sum("_words").over(everything) * share})
    out = out.withColumn("_reached", (F.col("_budget") - F.coalesce(F.sum("_most").over(before), F.lit(0.0))) / F.sum("_weight").over(onward))
    out = out.withColumn("_level", F.max("_reached").over(everything) * F.col("_weight"))
    return out.select("source", "_no", "_words", F.least("_most", "_level").alias("_target"), (F.col("_most") <= F.col("_level")).alias("_capped"))


def apportion(parties: DataFrame, group: list[str], key: str, votes: str, seats: str, out: str) -> DataFrame:
    """Sainte-Lague: adds `out`, the seats that each party of a group gets out of the group's `seats`.

    Of v votes the k-th seat has the quotient v / (2k - 1), and the highest quotients win. All seats
    that a party gets with half a seat less per party in play are won for certain; none beyond
    those with half a seat more per party can be. Only the few seats between are ranked.
    """
    w = Window.partitionBy(*group)
    p = parties.withColumns({"_all": F.sum(votes).over(w), "_n": F.count(F.lit(1)).over(w)})
    part = F.coalesce(F.col(votes) / F.expr("nullif(_all, 0)"), F.lit(0.0))
    p = p.withColumns({
        "_low": F.greatest(F.lit(0), F.floor(part * (F.col(seats) - F.col("_n") / 2) + 0.5) - 1),
        "_high": F.floor(part * (F.col(seats) + F.col("_n") / 2) + 0.5) + 1,
    })
    p = p.withColumn("_open", F.col(seats) - F.sum("_low").over(w))
    p = p.withColumn("_seat", F.explode(F.expr("sequence(_low, _high)")))  # the first stands for the certain ones
    quotient = F.when(F.col("_seat") == F.col("_low"), F.lit(float("inf"))).otherwise(F.col(votes) / (2 * F.col("_seat") - 1))
    ranked = p.withColumn("_rank", F.row_number().over(w.orderBy(quotient.desc(), key)) - F.col("_n"))
    won = F.max(F.when(F.col("_rank") <= F.col("_open"), F.col("_seat"))).alias(out)
    return ranked.groupBy(*parties.columns).agg(won)


def plan_mix(slim: DataFrame, weights: tuple = WEIGHTS, share: float = 1.5, cap: int = 2, block_words: int = 512, shard_words: int = 65536, seed: int = 17) -> tuple[DataFrame, DataFrame]:
    """Two small tables from rows (source, _size, _order): sources with targets, shards with quotas.

    A block has block_words, fewer where sources are so small that a block would show in their
    totals. Shards have about shard_words, more where there would be over 65536 of them.
    """
    src = source_targets(slim, weights, share, cap)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    total, n = F.sum("_words").over(everything), F.count(F.lit(1)).over(everything)
    src = src.withColumns({
        "_block": F.greatest(F.lit(1), F.least(F.lit(block_words), F.floor(total / (n * 1000)))).cast("long"),
        "_shards": F.greatest(F.lit(1), F.ceil(F.col("_words") / F.greatest(F.lit(shard_words), F.ceil(total / 65536)))).cast("long"),
    })
    src = write_table(src, "mix-sources")
    free = src.where(~F.col("_capped")).withColumns({"_of": F.lit(0), "_seats": F.round(F.sum("_target").over(everything) / F.col("_block")).cast("long")})
    free = apportion(free.select("_no", "_target", "_of", "_seats"), ["_of"], "_no", "_target", "_seats", "_quota").select("_no", "_quota")
    src = write_table(src.join(free, "_no", "left"), "mix-quotas")

    rows = slim.join(src, slim["source"].eqNullSafe(src["source"])).select("_no", F.expr("pmod(_order, _shards)").alias("_shard"), "_size", "_block", "_capped", "_quota")
    shards = rows.groupBy("_no", "_shard").agg(F.sum("_size").alias("_length"), *[F.first(c).alias(c) for c in ("_block", "_capped", "_quota")])
    shards = shards.where("_length > 0").withColumn("_blocks", F.greatest(F.lit(1), F.round(F.col("_length") / F.col("_block"))).cast("long"))
    full = shards.where("_capped").withColumn("_take", F.col("_blocks") * cap)
    part = apportion(shards.where("not _capped").drop("_capped"), ["_no"], "_shard", "_length", "_quota", "_take")
    part = part.withColumn("_take", F.least(F.col("_take"), F.col("_blocks") * cap))
    cols = ["_no", "_shard", "_length", "_blocks", "_take"]
    shards = full.select(cols).unionByName(part.select(cols))
    shards = shards.selectExpr("_no", "_shard", "_length", "_take div _blocks as _times", "_take % _blocks as _rest", f"pmod(xxhash64({seed}, _no, _shard), _blocks) as _first", "_blocks")
    at = lambda block: f"(({block}) * _length + _blocks - 1) div _blocks"  # noqa: E731  the first word of a block
    shards = shards.selectExpr(
        "_no", "_shard", "_times", f"{at('_first')} as _a1", f"if(_first + _rest > _blocks, _length, {at('_first + _rest')}) as _b1", f"if(_first + _rest > _blocks, {at('_first + _rest - _blocks')}, 0L) as _b2",
    )
    return src, write_table(shards, "mix-shards")


def apply_mix(rows: DataFrame, sources: DataFrame, shards: DataFrame) -> DataFrame:
    """rows (with source, _size, _order) and _words and _target of the source, _times (whole takes) and _spans: words taken once more, as places in the document."""
    src = sources.select(F.col("source").alias("_source"), "_no", "_words", "_target", "_shards")
    out = rows.join(src, rows["source"].eqNullSafe(src["_source"])).withColumn("_shard", F.expr("pmod(_order, _shards)"))
    w = Window.partitionBy("_no", "_shard").orderBy("_order", "doc_id", "_size").rowsBetween(Window.unboundedPreceding, 0)
    out = out.withColumn("_at", F.sum("_size").over(w) - F.col("_size"))
    out = out.join(shards, ["_no", "_shard"], "left")
    cut = lambda a, b: f"named_struct('a', greatest({a} - _at, 0L), 'b', least({b} - _at, _size))"
    out = out.withColumn("_spans", F.expr(f"filter(array({cut('0L', '_b2')}, {cut('_a1', '_b1')}), s -> s.a < s.b)"))
    out = out.withColumns({"_times": F.coalesce("_times", F.lit(0)), "_spans": F.coalesce("_spans", F.expr("filter(array(named_struct('a', 0L, 'b', 0L)), s -> false)"))})
    return out.drop("_source", "_no", "_shards", "_shard", "_at", "_a1", "_b1", "_b2")


def mix(docs: DataFrame, **how) -> DataFrame:
    """Per document: doc_id, source, size, source_size, target (its source's), taken, times, spans."""
    slim = write_table(sized(docs.select("doc_id", "text", "source"), how.get("seed", 17)).select("doc_id", "source", "_size", "_order"), "mix-slim")
    out = apply_mix(slim, *plan_mix(slim, **how))
    taken = F.expr("_times * _size + aggregate(_spans, 0L, (t, s) -> t + s.b - s.a)")
    return out.select("doc_id", "source", F.col("_size").alias("size"), F.col("_words").alias("source_size"), F.col("_target").alias("target"), taken.alias("taken"), F.col("_times").alias("times"), F.col("_spans").alias("spans"))


def mixed_documents(docs: DataFrame, **how) -> DataFrame:
    """The mix itself, as rows like docs: a document as often as it is taken whole, and once more with the words of its spans.

    Documents that no block touches go. A text taken in part keeps its layout between the words it
    keeps; n_chars, if there, is set anew.
    """
    rows = docs.select("doc_id", "text", "source", F.struct(*docs.columns).alias("_row"))  # so no name of docs meets one of these
    rows = sized(rows, how.get("seed", 17))
    slim = write_table(rows.select("source", "_size", "_order"), "mix-slim")
    out = apply_mix(rows, *plan_mix(slim, **how))
    part = F.expr("aggregate(_spans, 0L, (t, s) -> t + s.b - s.a)")
    words = F.regexp_extract_all("text", F.lit(WORD_AND_GAP), F.lit(0))
    cut = F.aggregate("_spans", F.lit(""), lambda t, s: F.concat(t, F.array_join(F.slice(words, s["a"].cast("int") + 1, (s["b"] - s["a"]).cast("int")), "")))
    some = F.when((part > 0) & (part < F.col("_size")), F.array(cut)).when(part > 0, F.array("text")).otherwise(F.array().cast("array<string>"))
    out = out.withColumn("_text", F.explode(F.concat(F.array_repeat("text", F.col("_times").cast("int")), some)))
    kept = {"text": F.col("_text")} | ({"n_chars": F.length("_text").cast("long")} if "n_chars" in docs.columns else {})
    return out.select(*[kept.get(c, F.col("_row")[c]).alias(c) for c in docs.columns])

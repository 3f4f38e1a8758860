"""How far the sources of a language are from each other in what they say: bitmaps per count level.

A document's terms are its runs of ASCII letters and characters beyond ASCII, A-Z in lower case. A language
keeps the terms that at least `least` of its documents have (V of them). In a group (a source of a
language, or the whole language) a kept term that occurs n times weighs p = 1 + 10^9 (n + 2) / (N + 2 V),
rounded down, N being the sum of n; two weights are (p - q)^2 / (p + q) apart, rounded down.

1. Tasks count terms by group and pass on sums, so frequent terms and sources are no burden.
2. Kept terms are numbered in the order of their frequency, 64 to a word, so that terms of a word have
   similar counts. A bitmap is a row: group, word, count level, and the bits of the terms of that word that
   occur so often in the group (bit_or over partial sums).
3. Words are dealt into blocks, and the sources of a language into chunks of about `chunk`; a task gets
   the bitmaps of a block and of two chunks, whatever the number of sources and terms. For two sources, AND and
   popcount of the bitmaps of a word give the number of terms with each pair of counts, times how far
   their weights are apart. Terms that only one has are what its bitmaps hold besides; terms that neither
   has are the rest of the block.
4. Sums per block are added up by pair of sources.

The result has a row per ordered pair of sources of a language, so it grows with the square of their number; no other
step does.

Nulls: null text, lang and source count as ''. Repeated rows count each. A source without terms has
pairs and no terms; with no kept terms all pairs are 0 apart. An empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions, slices, write_table

#: What is no part of a term becomes a space, A-Z become a-z; bytes beyond ASCII stay.
FOLD = bytes(c if c >= 0x80 or 0x61 <= c <= 0x7A else c + 32 if 0x41 <= c <= 0x5A else 0x20 for c in range(256))
#: Counts that a task holds before it passes them on.
HELD = 400_000
COUNTED = "lang string, source string, term string, n long, n_docs long"
UNIT = 1_000_000_000


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, n_docs), and a row with a null term for every group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, tuple[Counter, Counter]] = {}
        size = 0

        def out() -> Iterator[pa.RecordBatch]:
            for (lang, source), (counts, docs) in held.items():
                terms = list(counts)
                columns = [pa.array([None, *terms], pa.binary()).cast(pa.string()), pa.array([0, *counts.values()], pa.int64()), pa.array([0, *(docs[t] for t in terms)], pa.int64())]
                yield pa.RecordBatch.from_arrays([pa.array([x] * (len(terms) + 1), pa.string()) for x in (lang, source)] + columns, [c.split()[0] for c in COUNTED.split(", ")])

        for batch in batches:
            for lang, source, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                counts, docs = held.setdefault((lang, source), (Counter(), Counter()))
                before, seen = len(docs), set()
                for part in slices((text or b"").translate(FOLD)):
                    words = part.split()
                    counts.update(words)
                    seen.update(words)
                docs.update(seen)
                size += len(docs) - before
                if size >= HELD:
                    yield from out()
                    held.clear()
                    size = 0
        yield from out()

    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    rows = docs.select(name("lang"), name("source"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(run, COUNTED).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("n_docs").alias("n_docs"))


def numbered(counts: DataFrame, least: int) -> DataFrame:
    """(lang, term, lang_n, word, bit) of the kept terms; frequent ones first."""
    kept = counts.where("term is not null").groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("n_docs").alias("_docs")).where(F.col("_docs") >= least).drop("_docs")
    order = ["lang", F.desc("lang_n"), "term"]
    ranged = write_table(kept, "kept-terms").repartitionByRange(partitions(counts.sparkSession), *order).sortWithinPartitions(*order)
    return write_table(ranged.withColumn("_no", F.monotonically_increasing_id()).selectExpr("lang", "term", "lang_n", "_no div 64 as word", "int(_no % 64) as bit"), "numbered-terms")


def weight(n: Column, total: Column, size: Column) -> Column:
    return 1 + F.call_function("div", F.lit(UNIT).cast("decimal(38,0)") * (n + 2), total + 2 * size)


def apart(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def _apart(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // (p + q)


def _joint(a: tuple, b: tuple, size: int) -> int:
    """Sum over the terms of a block; a, b: weight of what does not occur, then words (sorted), weights and bits of the levels."""
    (none_a, word_a, p_a, bits_a), (none_b, word_b, p_b, bits_b) = a, b
    first = np.searchsorted(word_b, word_a, "left")
    many = np.searchsorted(word_b, word_a, "right") - first
    i = np.repeat(np.arange(len(word_a)), many)
    j = np.arange(len(i)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(first, many)
    both = np.bitwise_count(bits_a[i] & bits_b[j]).astype(np.int64)
    i, j, both = i[both > 0], j[both > 0], both[both > 0]
    only_a = np.bitwise_count(bits_a).astype(np.int64) - np.bincount(i, both, len(bits_a)).astype(np.int64)
    only_b = np.bitwise_count(bits_b).astype(np.int64) - np.bincount(j, both, len(bits_b)).astype(np.int64)
    neither = size - int(both.sum() + only_a.sum() + only_b.sum())
    found = (_apart(p_a[i], p_b[j]) * both).sum() + (_apart(p_a, none_b) * only_a).sum() + (_apart(none_a, p_b) * only_b).sum()
    return int(found) + int(_apart(none_a, none_b)) * neither


PAIRS = "lang string, a string, b string, value long"


def _block_pairs(pdf: pd.DataFrame) -> pd.DataFrame:
    """Each pair of sources with what the terms of a block add; of two chunks, pairs between them only."""
    pdf = pdf.sort_values(["source", "word"], kind="stable")
    found, lang, size = [], pdf["lang"].iloc[0], int(pdf["size"].max())
    for (source, chunk), x in pdf.groupby(["source", "chunk"], sort=False):
        none, some = x["bits"] == 0, x["bits"] != 0
        found.append((source, chunk, (np.int64(x["p"][none].iloc[0]), x["word"][some].to_numpy(np.int64), x["p"][some].to_numpy(np.int64), x["bits"][some].to_numpy(np.int64).view(np.uint64))))
    across = pdf["c1"].iloc[0] != pdf["c2"].iloc[0]
    rows = [(lang, s, t, _joint(a, b, size)) for k, (s, c, a) in enumerate(found) for t, e, b in found[k + 1 :] if not across or c != e]
    return pd.DataFrame(rows, columns=["lang", "a", "b", "value"])


def divergences(docs: DataFrame, least: int = 10, top: int = 10, words: int = 32, chunk: int = 64) -> DataFrame:
    """(lang, source, part, item, value, rank): all other sources by how far they are (part pair), and the `top` terms that a source has more of than its language (part term)."""
    counts = write_table(term_counts(docs), "term-counts")
    terms = numbered(counts, least)
    found = write_table(counts.where("n > 0").join(terms, ["lang", "term"]).select("lang", "source", "term", "word", "bit", "n", "lang_n"), "group-terms")
    sums = found.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    sizes = terms.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"))
    groups = counts.select("lang", "source").distinct().join(sums, ["lang", "source"], "left").withColumn("total", F.coalesce("total", F.lit(0)))
    langs = groups.groupBy("lang").agg(F.sum("total").alias("lang_total"), F.expr(f"ceil(count(1) / {chunk})").cast("int").alias("chunks")).join(sizes, "lang", "left").withColumn("terms", F.coalesce("terms", F.lit(0)))
    groups = write_table(groups.join(langs, "lang").withColumn("chunk", F.expr("int(pmod(xxhash64(source), chunks))")), "groups")

    level = found.groupBy("lang", "source", "word", "n").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits")).join(groups, ["lang", "source"])
    level = level.select("lang", "source", "chunk", "chunks", F.expr(f"word div {words}").alias("block"), "word", weight(F.col("n"), F.col("total"), F.col("terms")).alias("p"), "bits", F.lit(0).cast("long").alias("size"))
    blocks = terms.groupBy("lang", F.expr(f"word div {words}").alias("block")).agg(F.count(F.lit(1)).alias("size"))
    none = groups.join(blocks, "lang").select("lang", "source", "chunk", "chunks", "block", F.lit(-1).cast("long").alias("word"), weight(F.lit(0), F.col("total"), F.col("terms")).alias("p"), F.lit(0).cast("long").alias("bits"), "size")
    dealt = level.unionByName(none).withColumn("_with", F.explode(F.expr("sequence(0, chunks - 1)"))).select("lang", "source", "chunk", "block", "word", "p", "bits", "size", F.least("chunk", "_with").alias("c1"), F.greatest("chunk", "_with").alias("c2"))
    pairs = dealt.groupBy("lang", "block", "c1", "c2").applyInPandas(_block_pairs, PAIRS).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))

    one, other = groups.select("lang", "source"), groups.select("lang", F.col("source").alias("item"))
    asked = one.join(other, "lang").where("source <> item").withColumns({"a": F.least("source", "item"), "b": F.greatest("source", "item")})
    asked = asked.join(pairs, ["lang", "a", "b"], "left").select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).alias("value"))
    p, q = weight(F.col("n"), F.col("total"), F.col("terms")), weight(F.col("lang_n"), F.col("lang_total"), F.col("terms"))
    more = found.join(groups, ["lang", "source"]).select("lang", "source", "term", p.alias("p"), q.alias("q")).where("p > q")
    more = more.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), apart(F.col("p"), F.col("q")).alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    return asked.withColumn("rank", rank).unionByName(more.withColumn("rank", rank).where(F.col("rank") <= top))

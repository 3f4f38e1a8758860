"""Quality rules whose thresholds are chosen under a limit on false rejections.

measured() counts words, symbols, repeated lines and repeated words of every whole text. Texts that
fail the base rule (too few words, or more than a fifth of them in repeats) go. For the rest there
are four rules, each of which rejects a text whose value reaches a cutoff: symbols per 1000
characters of words, ten times the mean length of a word, repeated lines per 1000, and words in
repeats per 1000 (whole numbers up to 1000).

cutoffs() sets them per stratum (lang) from labelled documents:

1. A part of the labelled documents (a quarter, by a hash of doc_id) proposes a ladder of cutoffs per
   rule: quantiles of the low-quality documents' values, the largest first.
2. The others, the holdout, test them in that order. A cutoff is certified if the exact binomial upper
   bound of the share of good documents that it rejects is at most the rule's part of `limit`, in other
   words if so few rejections among so many good documents had a probability of at most delta were the
   share that large. The first that fails ends the ladder (fixed sequence: no correction is needed
   within it), and delta is divided by the number of rules and strata (Bonferroni). So with the
   given confidence no stratum loses more than `limit` of its good documents to these rules.
3. A certified cutoff counts only if it is of use: the exact lower bound of the share of low-quality
   documents it rejects lies above the same limit. Of those that count, the largest that rejects nearly
   as many low-quality documents (`enough`) of the proposing part as the smallest does is taken. A rule without one
   rejects nothing there.

All labelled documents count: the histograms of values (at most 1001 per rule, stratum, part and
quality) are added up where the rows are, and only those meet in a task.

Nulls: a null text has no words and fails the base rule, a null lang is the stratum ''. Labels without
doc_id or quality take no part; of several labels of a document the lowest quality counts. Rows with
the same doc_id are measured each for itself. An empty table gives an empty result; without labels
only the base rule rejects.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_unique, slices, write_table

#: White space, symbols, words in a window, the least number of words and the most in repeats (per cent).
SPACE, SYMBOLS, WIDTH, LEAST_WORDS, MOST_REPEATS = b" \t\n\x0b\x0c\r", b"#*$%&|<>", 5, 10, 20
RULES = {
    "symbols": "if(word_chars > 0, least(1000, 1000 * n_symbols div word_chars), 0)",
    "word_length": "if(n_words > 0, least(1000, 10 * word_chars div n_words), 0)",
    "dup_lines": "if(n_lines > 0, 1000 * n_dup_lines div n_lines, 0)",
    "repeats": "if(n_words > 0, 1000 * n_repeat_words div n_words, 0)",
}
COUNTS = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]


def repeated_words(text: bytes, width: int = WIDTH) -> tuple[int, int]:
    """(words, words in windows of `width` words that come twice or more).

    Words get numbers, so that a long text needs some bytes per word; windows with different hashes differ,
    and only a text in which hashes repeat has its windows compared by the numbers themselves.
    """
    known: dict[bytes, int] = {}
    parts = [np.fromiter((known.setdefault(w, len(known)) for w in part.split()), np.int64) for part in slices(text)]
    codes = parts[0] if len(parts) == 1 else np.concatenate(parts)
    n = len(codes) - width + 1
    if n < 2:
        return len(codes), 0
    mixed = codes.astype(np.uint64)
    hashes = np.zeros(n, np.uint64)
    for j in range(width):
        hashes = (hashes ^ (hashes >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + mixed[j : j + n]
    if len(np.unique(hashes)) == n:
        return len(codes), 0
    window = codes[:n]
    for j in range(1, width):
        window = np.unique(window * len(known) + codes[j : j + n], return_inverse=True)[1]
    often = np.bincount(window)[window] > 1
    return len(codes), int((np.convolve(often, np.ones(width, np.int64)) > 0).sum())


def _counts(text: bytes) -> tuple[int, ...]:
    n, repeats = repeated_words(text)
    chars = len(text.decode("utf-8", "replace")) - sum(map(text.count, SPACE))
    lines = [x for x in text.split(b"\n") if x.strip()]
    return n, chars, sum(map(text.count, SYMBOLS)), len(lines), len(lines) - len(set(lines)), repeats


def measured(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, the counts) of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([_counts(t or b"") for t in batch.column(2).to_pylist()], np.int64).reshape(-1, len(COUNTS))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array(found[:, k]) for k in range(len(COUNTS))]], ["doc_id", "lang", *COUNTS])

    rows = docs.select("doc_id", F.coalesce("lang", F.lit("")).cast("string").alias("lang"), F.col("text").cast("binary").alias("text"))
    kind = dict(docs.dtypes)["doc_id"]
    return rows.mapInArrow(run, f"doc_id {kind}, lang string, " + ", ".join(f"{c} long" for c in COUNTS))


def with_values(counts: DataFrame) -> DataFrame:
    """base_failed, and the value that each rule looks at."""
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATS * F.col("n_words"))
    return counts.withColumns({"base_failed": failed} | {k: F.expr(x) for k, x in RULES.items()})


def at_most(k: int, n: int, p: float) -> float:
    """Probability of k or fewer out of n at the rate p, from the sum of its terms."""
    if k >= n:
        return 1.0
    i = np.arange(k)
    terms = n * np.log1p(-p) + np.concatenate([[0.0], np.cumsum(np.log((n - i) / (i + 1)) + np.log(p) - np.log1p(-p))])
    top = terms.max()
    return float(min(1.0, np.exp(top) * np.exp(terms - top).sum()))


def upper_bound(k: int, n: int, delta: float) -> float:
    """The rate above which k or fewer out of n has a probability under delta."""
    low, high = k / n if n else 0.0, 1.0
    while high - low > 1e-9:
        p = (low + high) / 2
        low, high = (p, high) if at_most(k, n, p) > delta else (low, p)
    return high


def certified(k: int, n: int, limit: float, delta: float) -> bool:
    """Whether the upper bound for k out of n is at most limit."""
    return n > 0 and k <= n * limit and at_most(k, n, limit) <= delta


def of_use(k: int, n: int, limit: float, delta: float) -> bool:
    """Whether the lower bound for k out of n is above limit."""
    return n > 0 and k > n * limit and at_most(n - k, n, 1 - limit) <= delta


CUTOFFS = "lang string, rule string, cutoff long, good long, good_rejected long, bound double, low long, low_rejected long"


def choose(part: pd.DataFrame, limit: float, delta: float, steps: int, enough: float) -> tuple | None:
    """The cutoff of one rule from its histogram (value, fit, good, n), with what the holdout says of it; None if there is none."""
    of = {(f, g): part[(part["fit"] == f) & (part["good"] == g)] for f in (True, False) for g in (True, False)}
    reach = lambda x, c: int(x["n"][x["value"] >= c].sum())
    low = of[True, False].sort_values("value")
    if not len(low):
        return None
    at = np.ceil(np.arange(1, steps + 1) / steps * low["n"].sum()).astype(np.int64)
    ladder = np.unique(low["value"].to_numpy()[np.searchsorted(low["n"].cumsum().to_numpy(), at)])
    fine, good, bad = [], of[False, True], of[False, False]
    for c in ladder[ladder > 0][::-1]:
        if not certified(reach(good, c), int(good["n"].sum()), limit, delta):
            break
        if of_use(reach(bad, c), int(bad["n"].sum()), limit, delta):
            fine.append(int(c))
    if not fine:
        return None
    c = next(c for c in fine if reach(low, c) >= enough * reach(low, fine[-1]))
    n, k = int(good["n"].sum()), reach(good, c)
    return c, n, k, upper_bound(k, n, delta), int(bad["n"].sum()), reach(bad, c)


def cutoffs(values: DataFrame, labels: DataFrame, limit: float = 0.02, confidence: float = 0.95, steps: int = 16, enough: float = 0.95) -> DataFrame:
    """CUTOFFS per stratum and rule, where there is one; values: what with_values() gives, written."""
    marks = labels.groupBy("doc_id").agg(F.min("quality").alias("_quality")).where("doc_id is not null and _quality is not null")
    fit = (F.crc32(F.col("doc_id").cast("string")) % 4 == 0).alias("fit")
    known = values.where("not base_failed").join(marks, "doc_id").select("lang", fit, (F.col("_quality") > 0).alias("good"), F.expr(f"stack({len(RULES)}, {', '.join(f'{k!r}, {k}' for k in RULES)}) as (rule, value)"))
    counts = write_table(known.groupBy("lang", "rule", "value", "fit", "good").agg(F.count(F.lit(1)).alias("n")), "rule-values")
    strata = counts.select("lang").distinct().count()
    delta, each = (1 - confidence) / max(1, strata * len(RULES)), limit / len(RULES)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        found = choose(pdf, each, delta, steps, enough)
        rows = [(pdf["lang"].iloc[0], pdf["rule"].iloc[0], *found)] if found else []
        return pd.DataFrame(rows, columns=[c.split()[0] for c in CUTOFFS.split(", ")])

    return counts.groupBy("lang", "rule").applyInPandas(run, CUTOFFS)


def judge(docs: DataFrame, labels: DataFrame, **chosen) -> DataFrame:
    """(doc_id, lang, the counts, base_failed, the values, kept, rejected_by) of every document."""
    values = write_table(with_values(measured(docs)), "measured")
    found = write_table(cutoffs(values, labels, **chosen), "cutoffs")
    each = found.groupBy("lang").agg(*[F.max(F.when(F.col("rule") == r, F.col("cutoff"))).alias(f"_{r}") for r in RULES])
    rows = join_unique(values, each, "lang", "left")
    against = F.filter(F.array(F.when(F.col("base_failed"), F.lit("base")), *[F.when(F.col(r) >= F.col(f"_{r}"), F.lit(r)) for r in RULES]), lambda x: x.isNotNull())
    return rows.withColumn("rejected_by", against).withColumn("kept", F.size("rejected_by") == 0).drop(*[f"_{r}" for r in RULES])

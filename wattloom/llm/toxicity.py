"""Toxicity by cumulative-link ordinal regression on sparse text features.

Features are the different words of a text (lower case) and, of each, its beginnings of 4, 5 and 6
characters, hashed. P(grade > j) = sigmoid(w x - t_j): one weight per feature for all ordered
thresholds t_0 < t_1 < ..., fitted by gradient steps. severity() is the expected grade,
the sum of these probabilities.

Labels say whether a document is toxic and whether it is good. Its grade is 0 if it is not toxic, 1 if it is
toxic and otherwise good (or nothing is said of that), 2 if it is toxic and bad: grades come from the labels
alone. A table that has grades can be fitted as it is (`grade`). The model is fitted on at most `fit_rows`
labels of documents that are there (a documented bound: those with the smallest seeded hashes). It uses the features of `least_toxic` toxic ones or
more whose log-odds between toxic and
clean documents, by counts over those, are `least_odds` or more, or `least_odds` below 0 or less, and as
surely (`least_sure` standard errors) not 0: words that toxic documents have 20 times as often, or as rarely. All such features are used.
Where quality says nothing about toxicity, the second grade is told from the first by chance alone, and severity orders documents as the probability of grade 1 does.

Nulls: a null text has no words; labels that are null, or whose document is missing, take no part. Of
several labels of a document each counts. Without toxic labels the severity is 0. Texts are
processed whole; repeated rows are scored alike. An empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import write_table

#: Expected severity from which a document is rejected: some three times that of a text without any feature. On held-out
#: labels (each half of them, models of the other half) 0.1 finds 81 % of the toxic and rejects 0.9 % of the clean, 0.25 finds 69 % and rejects 0.1 %.
REJECT = 0.1
_WORDS = re.compile(r"\w+")


def word_features(word: str) -> list[int]:
    """Hashed: the word, and its beginnings (shorter ones only if they are shorter)."""
    found = [zlib.crc32(b"w" + word.encode("utf-8", "surrogatepass"))]
    found += [zlib.crc32(b"%d" % n + word[:n].encode("utf-8", "surrogatepass")) for n in (4, 5, 6) if len(word) >= n]
    return found


def different_words(text: str | None) -> set[str]:
    return set(_WORDS.findall((text or "").lower()))


class Model:
    """Weights by feature, and the thresholds between the grades."""

    def __init__(self, weights: dict[int, float], thresholds: list[float]):
        self.weights, self.thresholds, self._known = weights, thresholds, {}

    def __getstate__(self):
        return self.weights, self.thresholds

    def __setstate__(self, state):
        self.__init__(*state)

    def of_word(self, word: str) -> float:
        if (got := self._known.get(word)) is None:
            if len(self._known) > 150_000:
                self._known.clear()
            got = self._known[word] = sum(self.weights.get(f, 0.0) for f in word_features(word))
        return got

    def severity(self, text: str | None) -> float:
        x = math.fsum(map(self.of_word, different_words(text)))
        return math.fsum(1 / (1 + math.exp(min(700.0, t - x))) for t in self.thresholds)


def _counts(rows: DataFrame, only: set[int] | None = None) -> DataFrame:
    """(feature, n): documents that have it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                found = {f for w in different_words(text) for f in word_features(w)}
                n.update(found if only is None else found & only)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.int64()), pa.array(list(n.values()), pa.int64())], ["feature", "n"])

    return rows.select("text").mapInArrow(run, "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n"))


def _fit(x: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, n: int, rounds: int = 1000, rate: float = 0.1, ridge: float = 2e-5) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds by Adam steps on the mean log-likelihood of the grades."""
    row = np.repeat(np.arange(len(x)), [len(f) for f, _ in x])
    col, val = (np.concatenate([a[k] for a in x]) for k in (0, 1))
    levels = int(y.max())
    p = np.zeros(n + levels)  # weights, first threshold, logs of the steps to the next ones
    p[n] = 2.0
    m, v = np.zeros_like(p), np.zeros_like(p)
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -40, 40)))
    for step in range(1, rounds + 1):
        t = p[n] + np.append(0, np.cumsum(np.exp(p[n + 1 :])))
        score = np.bincount(row, weights=val * p[col], minlength=len(x))
        above = np.column_stack([np.ones(len(x)), sigmoid(score[:, None] - t[None, :]), np.zeros(len(x))])
        chance = np.maximum(above[np.arange(len(x)), y] - above[np.arange(len(x)), y + 1], 1e-12)
        slope = above * (1 - above)
        lower, upper = slope[np.arange(len(x)), y], slope[np.arange(len(x)), y + 1]
        by_score = (lower - upper) / chance / len(x)
        by_t = np.zeros(levels + 2)
        np.add.at(by_t, y, -lower / chance / len(x))
        np.add.at(by_t, y + 1, upper / chance / len(x))
        by_t = by_t[1:-1]
        g = np.concatenate([np.bincount(col, weights=val * by_score[row], minlength=n) - ridge * p[:n], [by_t.sum()], [by_t[k:].sum() * np.exp(p[n + k]) for k in range(1, levels)]])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        p = p + rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
    return p[:n], p[n] + np.append(0, np.cumsum(np.exp(p[n + 1 :])))


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = 20_000, least_sure: float = 3.5, least_odds: float = 3.0, least_toxic: int = 5, grade: str | None = None) -> Model:
    """A model from docs (doc_id, text) and labels (doc_id, toxic, quality if there, and `grade` if given)."""
    bad = F.col("quality").cast("int") <= 0 if "quality" in labels.columns else F.lit(False)
    by_label = F.when(F.col("toxic") > 0, F.when(F.coalesce(bad, F.lit(False)), 2).otherwise(1)).otherwise(0)
    known = labels.where("doc_id is not null and toxic is not null").select("doc_id", F.col("toxic").cast("int").alias("toxic"), F.coalesce(F.col(grade).cast("int") if grade else F.lit(None), by_label).cast("int").alias("grade"))
    known = known.join(docs.select("doc_id"), "doc_id", "left_semi").orderBy(F.xxhash64(F.lit(9), "doc_id"), "doc_id", "toxic", "grade").limit(fit_rows)
    rows = write_table(docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").select("text", "toxic", "grade").repartition(16), "labelled")
    totals = rows.agg(F.count_if(F.col("toxic") > 0), F.count_if(F.col("toxic") <= 0)).head()
    n_toxic, n_clean = totals[0], max(totals[1], 1)
    often = {r["feature"]: r["n"] for r in _counts(rows.where("toxic > 0")).where(F.col("n") >= least_toxic).collect()} if n_toxic else {}
    clean = {r["feature"]: r["n"] for r in _counts(rows.where("toxic <= 0"), set(often)).collect()} if often else {}
    found = []
    for f, n in often.items():
        m = clean.get(f, 0)
        odds = math.log(((n + 0.5) / (n_toxic + 1)) / ((m + 0.5) / (n_clean + 1)))
        found.append((-abs(odds) / math.sqrt(1 / (n + 0.5) + 1 / (m + 0.5)), f, odds))
    picked = [f for sure, f, odds in sorted(found) if -sure >= least_sure and abs(odds) >= least_odds]
    place = {f: k for k, f in enumerate(picked)}

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], []]
            for text, given in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                n: dict[int, float] = {}
                for w in different_words(text):
                    for f in word_features(w):
                        if f in place:
                            n[place[f]] = n.get(place[f], 0.0) + 1.0
                for cell, x in zip(out, (list(n), list(n.values()), given), strict=True):
                    cell.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.list_(pa.int32())), pa.array(out[1], pa.list_(pa.float64())), pa.array(out[2], pa.int32())], ["features", "values", "grade"])

    if not picked:
        return Model({}, [])
    got = rows.mapInArrow(encode, "features array<int>, values array<double>, grade int").collect()  # at most fit_rows rows, a few features each
    got.sort(key=lambda r: (r["grade"], r["features"], r["values"]))
    y = np.array([r["grade"] for r in got])
    used = np.unique(y[y > 0])  # grades without rows would have no threshold
    if not len(used):
        return Model({}, [])
    y = np.searchsorted(used, y, side="right")
    w, t = _fit([(np.array(r["features"], np.int64), np.array(r["values"])) for r in got], y, len(picked))
    steps = np.diff(np.append(0, used))
    return Model({f: float(x) for f, x in zip(picked, w, strict=True) if x}, np.repeat(t, steps).tolist())


def severity(model: Model, text: Column) -> Column:
    """The expected grade of a text."""

    @F.pandas_udf("double")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([model.severity(x) for x in texts], dtype=float)

    return run(text)


def scored(docs: DataFrame, labels: DataFrame, reject: float = REJECT, **how) -> DataFrame:
    """docs with severity, and toxic: whether that is `reject` or more (in place of columns of these names)."""
    model = fit(docs, labels, **how)
    return docs.withColumn("severity", severity(model, F.col("text"))).withColumn("toxic", F.col("severity") >= reject)

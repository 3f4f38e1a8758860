"""Rolling backtests with any Spark ML estimator: one model for all series of a target, refitted origin by origin on the days before.

Features do not depend on the origin, so they are computed and written once; an origin reads its training days from that table by a filter, without
copies or shuffles of rows. Fits of several origins run at once. What they forecast is written origin by origin, so a lost executor costs one fit at most.
"""

from __future__ import annotations

from collections.abc import Callable
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import Estimator, Model
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.files import scratch

#: From the names of the features' and the label's column to an estimator whose models have a prediction column "pred".
Factory = Callable[[str, str], Estimator]
#: Training rows of a partition: trees exchange a few kilobytes per partition and level.
ROWS = 50_000


def boosted(rounds: int = 120, depth: int = 5, least: int = 8, rows: float = 0.85, columns: float = 0.85, rate: float = 0.05, bins: int = 64, seed: int = 2026) -> Factory:
    """Boosted trees; a leaf has `least` rows or more, a tree sees a share of the rows, a node of the features."""
    return lambda features, label: GBTRegressor(
        featuresCol=features, labelCol=label, predictionCol="pred", maxIter=rounds, maxDepth=depth, minInstancesPerNode=least, subsamplingRate=rows,
        featureSubsetStrategy=str(columns), stepSize=rate, maxBins=bins, seed=seed,
    )


def forest(trees: int = 120, depth: int = 8, least: int = 8, rows: float = 0.85, columns: float = 0.85, bins: int = 64, seed: int = 2026) -> Factory:
    """A random forest: all its trees grow at once."""
    return lambda features, label: RandomForestRegressor(
        featuresCol=features, labelCol=label, predictionCol="pred", numTrees=trees, maxDepth=depth, minInstancesPerNode=least, subsamplingRate=rows, featureSubsetStrategy=str(columns), maxBins=bins, seed=seed,
    )


class Origins:
    """The written feature table of a backtest, its origins, and the training rows of each.

    Rows with a null feature take no part; known_before: a label is known so many days after its row's day.
    """

    def __init__(self, rows: DataFrame, given: list[str], columns: list[str], label: str, first_day: int, every: int = 1, known_before: int = 0, split: str = "target"):
        self.spark, self.given, self.label, self.split, self.every, self.known_before = rows.sparkSession, given, label, split, every, known_before
        table = VectorAssembler(inputCols=columns, outputCol="features").transform(rows.dropna(subset=columns)).select(*given, label, "features")
        path = scratch(self.spark, "features")
        table.sortWithinPartitions("day_no").write.partitionBy(split).parquet(path)
        self.table = self.spark.read.schema(table.select(*[c for c in table.columns if c != split], split).schema).parquet(path)
        days = self.table.groupBy(split, "day_no").agg(F.count(F.lit(1)).alias("n"), F.count(label).alias("known")).collect()  # a row per target and day
        self.known = {(r[split], r["day_no"]): r["known"] for r in days}
        last = {r[split]: max(x["day_no"] for x in days if x[split] == r[split]) for r in days}
        self.all = [(t, o) for t in sorted(last) for o in range(first_day, last[t] + 1, every) if self._rows(t, o)]

    def _rows(self, target: str, origin: int) -> int:
        return sum(n for (t, d), n in self.known.items() if t == target and d < origin - self.known_before)

    def training(self, target: str, origin: int) -> DataFrame:
        """(features, label) of all days whose labels are known at the origin: a filter of the written table."""
        rows = self.table.where((F.col(self.split) == target) & (F.col("day_no") < origin - self.known_before) & F.col(self.label).isNotNull())
        return rows.select("features", self.label).coalesce(1 + self._rows(target, origin) // ROWS)

    def asked(self, target: str, origin: int) -> DataFrame:
        return self.table.where((F.col(self.split) == target) & F.col("day_no").between(origin, origin + self.every - 1))

    def fitted(self, factory: Factory, use: Callable[[str, int, Model], None], at_once: int) -> None:
        """use() gets every origin's model."""

        def fit(which: tuple[str, int]) -> None:
            use(*which, factory("features", self.label).fit(self.training(*which)))

        with ThreadPool(at_once) as pool:
            pool.map(inheritable_thread_target(self.spark)(fit), self.all, chunksize=1)


def backtest(origins: Origins, factory: Factory, at_once: int = 8) -> DataFrame:
    """(the given columns, pred): every day from the first origin on, forecast by the model of the newest origin, not below 0."""
    out = scratch(origins.spark, "forecasts")

    def use(target: str, origin: int, model: Model) -> None:
        found = model.transform(origins.asked(target, origin)).select(*origins.given, F.greatest(F.col("pred"), F.lit(0.0)).alias("pred"))
        found.write.parquet(f"{out}/{target}-{origin}")

    origins.fitted(factory, use, at_once)
    schema = origins.table.select(*origins.given, F.lit(0.0).alias("pred")).schema
    return origins.spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(out)


def importances(origins: Origins, columns: list[str], factory: Factory, at_once: int = 8) -> DataFrame:
    """(feature, weight): a model's weights are the mean gains of the splits on each feature as parts of 1 (0 without a split), averaged over all models."""
    out = scratch(origins.spark, "models")
    origins.fitted(factory, lambda target, origin, model: model.save(f"{out}/{target}-{origin}"), at_once)
    parts = [origins.spark.read.parquet(f"{out}/{t}-{o}/data").select(F.lit(f"{t}-{o}").alias("model"), "nodeData.*") for t, o in origins.all]
    nodes = parts[0]
    for p in parts[1:]:
        nodes = nodes.unionByName(p)
    gains = nodes.where("leftChild >= 0").groupBy("model", F.col("split.featureIndex").alias("at")).agg(F.avg("gain").alias("gain"))
    whole = gains.groupBy("model").agg(F.sum("gain").alias("all"))
    shares = gains.join(whole, "model").groupBy("at").agg(F.sum(F.col("gain") / F.col("all")).alias("sum"))
    names = origins.spark.createDataFrame(list(enumerate(columns)), "at int, feature string")
    return names.join(shares, "at", "left").select("feature", (F.coalesce("sum", F.lit(0.0)) / len(parts)).alias("weight"))

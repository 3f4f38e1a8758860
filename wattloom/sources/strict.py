"""CSV files read strictly: a header must be the expected one, a row must fit, and what does not is reported instead of loaded.

Files are read as text columns with the place of every row: its file, the start of its split, and its number within the task,
which together give the order of rows in a file however it is split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Files without the expected header are looked up by broadcast up to so many.
MOST_FILES = 10_000
PLACE = ["_file", "_block", "_line"]


def _text(spark: SparkSession, paths: str | list[str], names: list[str]) -> DataFrame:
    schema = T.StructType([T.StructField(c, T.StringType()) for c in [*names, "_bad"]])
    rows = spark.read.schema(schema).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").option("recursiveFileLookup", "true").csv(paths, header=False)
    return rows.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_line"))


def _is_header(names: list[str]) -> Column:
    """A byte order mark before the first name is left out."""
    cells = F.array(F.regexp_replace(names[0], "^\ufeff", ""), *[F.col(f"`{c}`") for c in names[1:]])
    return F.coalesce(F.transform(cells, lambda x: F.trim(x)) == F.array(*map(F.lit, names)), F.lit(False))


def _typed(kind: str, names: list[str], required: bool, not_negative: bool) -> tuple[Column, Column]:
    """Of columns under the same rules: their values as an array, and the first fault."""
    cells = F.transform(F.array(*[F.col(f"`{c}`") for c in names]), lambda x: F.nullif(F.trim(x), F.lit("")))
    value = (lambda x: x) if kind == "string" else lambda x: x.try_cast(kind)

    def fault(x: Column, i: Column) -> Column:
        v = value(x)
        odd = v.isNull() if kind != "double" else v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
        what = F.when(x.isNotNull() & odd, f": no {kind}")
        what = what.when(x.isNull(), ": empty") if required else what
        what = what.when(v < 0, ": below 0") if not_negative else what
        return F.concat(F.get(F.array(*map(F.lit, names)), i), what)

    return F.transform(cells, value), F.get(F.filter(F.transform(cells, fault), lambda x: x.isNotNull()), F.lit(0))


def read_strict(spark: SparkSession, paths: str | list[str], columns: dict[str, str], required: list[str] | None = None, not_negative: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows, rejected) of CSV files: rows with the columns as given (name: type) and PLACE; rejected (_file, reason, row).

    A file whose header is not exactly these columns in this order is rejected as a whole (reason "header", row null). A row is rejected if it has more or
    fewer cells ("cells"), a cell that is no value of its type ("name: no type"; doubles must be finite), nothing in a required column (by default all;
    "name: empty") or a value under 0 in one of not_negative ("name: below 0"). The header is looked for in a first pass over the files.
    """
    names, required = list(columns), list(columns) if required is None else required
    raw = _text(spark, paths, names)
    head = _is_header(names)
    without = raw.groupBy("_file").agg(F.count_if(head).alias("_heads")).where("_heads <> 1").select("_file")
    few = without.count() <= MOST_FILES
    rows = raw.where(~head).join(F.broadcast(without) if few else without, "_file", "left_anti")
    rules: dict[tuple, list[str]] = {}
    for name, kind in columns.items():
        rules.setdefault((kind, name in required, name in (not_negative or ())), []).append(name)
    found = {i: (*_typed(rule[0], some, *rule[1:]), some) for i, (rule, some) in enumerate(rules.items())}
    rows = rows.withColumns({f"_values{i}": x for i, (x, _, _) in found.items()} | {"_reason": F.coalesce(F.when(F.col("_bad").isNotNull(), "cells"), *[f for _, f, _ in found.values()])})
    typed = {c: F.get(f"_values{i}", F.lit(k)).alias(c) for i, (_, _, some) in found.items() for k, c in enumerate(some)}
    whole = F.coalesce("_bad", F.array_join(F.array(*[F.col(f"`{c}`") for c in names]), ",", ""))
    rejected = rows.where("_reason is not null").select("_file", F.col("_reason").alias("reason"), whole.alias("row"))
    rejected = rejected.unionByName(without.select("_file", F.lit("header").alias("reason"), F.lit(None).cast("string").alias("row")))
    return rows.where("_reason is null").select(*[typed[c] for c in names], *PLACE), rejected


def filled_down(rows: DataFrame, column: str) -> DataFrame:
    """rows (with PLACE) in which an empty cell of the column has what stands above it in the file.

    Each split is filled for itself, in parallel; what the splits before it ended with is carried over by a table of a row per split.
    """
    split = ["_file", "_block"]
    above = F.last(column, ignorenulls=True).over(_in_order(split, "_line", 0))
    ends = rows.groupBy(*split).agg(F.max(F.when(F.col(column).isNotNull(), F.struct("_line", column))).alias("_end"))
    carried = ends.select(*split, F.last(F.col(f"_end.{column}"), ignorenulls=True).over(_in_order(["_file"], "_block", -1)).alias("_carried"))
    return rows.withColumn("_above", above).join(carried, split).withColumn(column, F.coalesce("_above", "_carried")).drop("_above", "_carried")


def _in_order(keys: list[str], by: str, last: int) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(by).rowsBetween(Window.unboundedPreceding, last)

"""What the operators share: tables, the shared folder, words."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.files import scratch

#: Words are runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
WORD_AND_GAP = r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rows without an id count as after all others.
NO_ID = 2**63 - 1
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Rows of a batch of whole texts, or of their shingles.
TEXTS = 500


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def write_table(df: DataFrame, name: str, batch: int | None = None) -> DataFrame:
    """Cut the lineage: write df as Parquet into the shared folder and read it from there.

    batch: rows that Python gets at once while df is written, for rows that hold whole texts (Spark's default is 10,000, and both sides hold them).
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    before = spark.conf.get(BATCH)
    try:
        if batch is not None:
            spark.conf.set(BATCH, min(batch, int(before)) if int(before) > 0 else batch)
        df.write.option("compression", "zstd").parquet(path)
    finally:
        if batch is not None:
            spark.conf.set(BATCH, before)
    return spark.read.schema(df.schema).parquet(path)


def slices(data: bytes, size: int = 1 << 22) -> Iterator[bytes]:
    """data in parts of about `size` bytes that end before white space, so that no word is cut."""
    at = 0
    while len(data) - at > size:
        end = at + size
        while end < len(data) and data[end] not in b" \t\n\x0b\x0c\r":
            end += 1
        yield data[at:end]
        at = end
    yield data[at:]


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def word_count(text: Column) -> Column:
    """Number of words; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(text, UPPER, LOWER)


def frequent(rows: DataFrame, key: str, hot: int = 1000) -> list:
    """The keys that at least `hot` and at least a thousandth of all rows of a written table have: 1000 at most."""
    n = rows.count()
    if n < hot:
        return []
    counts = rows.where(F.col(key).isNotNull()).groupBy(key).count()
    return [r[0] for r in counts.where(F.col("count") >= max(hot, n / 1000)).select(key).collect()]


def join_unique(big: DataFrame, small: DataFrame, key: str, how: str = "inner", hot: int = 1000, often: list | None = None) -> DataFrame:
    """big (a written table, unless `often` is given) joined to small, which has one row per key, so that no task gets all rows of a frequent key.

    The rows of small with a frequent key (1000 at most) are broadcast, and such rows of big stay where they are.
    """
    often = frequent(big, key, hot) if often is None else often
    if not often:
        return big.join(small, key, how)
    some = F.coalesce(F.col(key).isin(often), F.lit(False))
    return big.where(~some).join(small.where(~some), key, how).unionByName(big.where(some).join(F.broadcast(small.where(some)), key, how))


def sampled(rows: DataFrame, size: int, seen: Column) -> DataFrame:
    """About `size` different rows, those whose hash `seen` (a long) is low enough; of rows with the same hash one. No row leaves its task but the chosen ones."""
    n = rows.count()
    if n <= size:
        return rows
    limit = -(2**63) + 2**64 * size // n
    return rows.withColumn("_seen", seen).where(F.col("_seen") < limit).dropDuplicates(["_seen"]).drop("_seen")

"""From raw documents to packed training sequences, in five stages that are each written as Parquet and read again."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wattloom.llm import line_dedup, mixing, near_copies, packing, simhash, toxicity
from wattloom.llm.common import table, write_table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with an expected severity of toxicity.REJECT or more go."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return docs.where(toxicity.severity(model, F.col("text")) < toxicity.REJECT)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that came earlier, but for an edit, go; and with them the documents of which nothing but white space is left."""
    out = line_dedup.dedup_lines(docs).where("n_removed = 0 or text rlike '[^\\\\x20\\\\x09-\\\\x0D]'")
    return out.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents whose five-word shingles have a Jaccard similarity of 0.8 or more, linked in chains, the one with the smallest doc_id stays."""
    return simhash.first_of_each(docs, near_copies.near_duplicates(docs.select("doc_id", "text"), shingle=5, least=0.8))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources in proportion to their weights; a document comes as often as it is taken, the last time perhaps in part."""
    return mixing.mixed_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the tokenized documents with their sequences and places."""
    return packing.pack_pieces(packing.token_pieces(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=1, capacity=4096), capacity=4096)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("simhash_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Trained weights, XXH64 fingerprints and the tokenizer are beyond SQL; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = write_table(stage(spark, docs, sf_dir), name)
    return docs

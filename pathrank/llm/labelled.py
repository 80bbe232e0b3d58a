"""A bounded sample of labelled documents, and the folds that a query may learn from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def remainder(modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus


def sample(docs: DataFrame, labels: DataFrame, column: str, most: int) -> DataFrame:
    """(doc_id, text, y) of at most ``most`` labelled documents, those of the smallest hashed ids.

    The ids of the sample are bounded by ``most`` rows, so they are broadcast to the documents.
    """
    chosen = labels.where(F.col(column).isNotNull()).groupBy("doc_id").agg(F.max(column).cast("int").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")

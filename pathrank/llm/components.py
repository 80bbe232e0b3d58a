"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathrank.llm.common import cut

#: Edges that a partition holds on average, at least.
ROWS_A_PART = 100_000


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("high", "low").cast("decimal(20,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every end of ``edges`` (columns a, b): root is the smallest id that can be reached.

    Roots themselves are not listed. Each round hangs a node's larger neighbours on its smallest one and then
    its smaller ones, so that the number of rounds grows with the logarithm of a chain's length.
    """
    pairs = edges.select(F.greatest("a", "b").alias("high"), F.least("a", "b").alias("low")).where("high <> low").distinct()
    stars = cut(pairs)
    state = _state(stars)
    parts = state[0] // ROWS_A_PART + 1  # few edges are kept in few files
    while True:
        both = stars.select(F.col("high").alias("u"), F.col("low").alias("v")).union(stars.select("low", "high"))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("high"), F.col("m").alias("low")).where("high <> low").distinct()
        least = large.groupBy("high").agg(F.min("low").alias("m"))
        rest = large.join(least, "high").where("low <> m").select(F.col("low").alias("high"), F.col("m").alias("low"))
        new = cut(rest.union(least.select("high", F.col("m").alias("low"))).distinct().coalesce(parts))
        last, state = state, _state(new)
        stars = new
        if state == last:
            return stars.select(F.col("high").alias("node"), F.col("low").alias("root"))

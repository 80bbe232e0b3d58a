"""Joins on keys of which a few, hubs, have a large share of all edges."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is a hub if it has more than this share of a task's even part of all edges.
HUB_SHARE = 0.5


def hubs(edges: DataFrame, on: Sequence[str], parts: int, share: float = HUB_SHARE) -> DataFrame:
    """(on, salts): the keys that have more than ``share / parts`` of all edges, and over how many tasks to spread each.

    Keys are counted exactly, with partial counts before the shuffle. There are fewer than ``parts / share`` hubs whatever the
    size of the table, so they can be broadcast.
    """
    counts = edges.groupBy(*on).agg(F.count("*").alias("_n"))
    total = counts.agg(F.sum("_n").alias("_all"))  # one row
    least = F.col("_all") * F.lit(share / parts)
    return counts.crossJoin(F.broadcast(total)).where(F.col("_n") > least).select(*on, F.ceil(F.col("_n") / least).cast("int").alias("_salts"))


def hub_join(left: DataFrame, edges: DataFrame, on: Sequence[str], how: str = "inner", parts: int | None = None, share: float = HUB_SHARE) -> DataFrame:
    """``left.join(edges, on, how)``, inner or left, with the edges of hubs spread by salt over several tasks.

    Rows of ``left`` are copied for hubs only, once for each salt. A copy that meets no edge is no row without
    continuation, as its hub has edges: such copies go.
    """
    if how not in ("inner", "left"):
        raise ValueError(f"hubs are spread in inner and left joins, not in {how}")
    on = list(on)
    parts = parts or int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    heavy = F.broadcast(hubs(edges, on, parts, share))
    others = [c for c in edges.columns if c not in on]
    spread = edges.join(heavy, on, "left").withColumn("_salt", F.when(F.col("_salts").isNull(), 0).otherwise(F.pmod(F.xxhash64(*(others or on)), F.col("_salts")).cast("int"))).drop("_salts")
    copied = left.join(heavy, on, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1)))
    if how == "left":
        spread = spread.withColumn("_met", F.lit(True))
    found = copied.join(spread, [*on, "_salt"], how)
    if how == "left":
        found = found.where(F.col("_met").isNotNull() | F.col("_salts").isNull()).drop("_met")
    return found.select(*left.columns, *[c for c in others if c not in left.columns])

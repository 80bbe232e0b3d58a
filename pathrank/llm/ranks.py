"""Gapless numbers and neighbours in a global order, without a window over all rows in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pathrank.sources.shared import cut

#: Rows that one window of a numbering holds on average.
ROWS_A_WINDOW = 20_000


def numbered(df: DataFrame, group: str, cells: list[str], order: list[str], name: str) -> DataFrame:
    """``df`` with a number from 0 on for each row of a group, in the order of ``cells`` and then ``order``.

    ``cells`` (not null) cut a group into parts small enough for a window each; their sizes are added up first.
    """
    sizes = df.groupBy(group, *cells).agg(F.count("*").alias("_n"))
    before = Window.partitionBy(group).orderBy(*cells).rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(group, *cells, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy(group, *cells).orderBy(*order)
    return df.withColumn("_row", F.row_number().over(inside) - 1).join(starts, [group, *cells]).withColumn(name, (F.col("_start") + F.col("_row")).cast("long")).drop("_start", "_row")


def followers(ids: DataFrame) -> DataFrame:
    """(doc_id, next_id) for distinct ids: the next smaller one; for the smallest, the largest of all."""
    dealt = cut(ids.where("doc_id is not null").select("doc_id").distinct().repartitionByRange("doc_id").withColumn("_part", F.spark_partition_id()))
    inside = Window.partitionBy("_part").orderBy(F.desc("doc_id"))
    tops = dealt.groupBy("_part").agg(F.max("doc_id").alias("_top"))
    parts = Window.orderBy("_part")  # a row for each partition
    tops = tops.select("_part", F.coalesce(F.lag("_top").over(parts), F.max("_top").over(Window.partitionBy())).alias("_below"))
    return dealt.withColumn("next_id", F.lead("doc_id").over(inside)).join(tops, "_part").select("doc_id", F.coalesce("next_id", "_below").alias("next_id"))

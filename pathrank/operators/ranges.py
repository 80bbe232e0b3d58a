"""Running sums over a whole table in one order, without a window over all rows in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pathrank.sources.shared import cut


def cumulated(df: DataFrame, order: Sequence[Column], sums: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """``df`` with ``before_<c>``, the sum of c over all rows that come earlier, and ``all_<c>``, over all rows; of each group ``by``.

    Rows are range-partitioned; sums inside a partition are shifted by those of the partitions before it. The
    partitions are written before their numbers are used, so that a task that runs again sees the same ones.
    """
    by = list(by)
    dealt = cut(df.repartitionByRange(*by, *order).withColumn("_part", F.spark_partition_id()))
    inside = Window.partitionBy("_part", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    groups = Window.partitionBy(*by)
    parts = groups.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each group and partition that has it
    starts = dealt.groupBy("_part", *by).agg(*[F.sum(c).alias(c) for c in sums])
    starts = starts.select("_part", *by, *[F.coalesce(F.sum(c).over(parts), F.lit(0)).alias(f"_start_{c}") for c in sums], *[F.sum(c).over(groups).alias(f"all_{c}") for c in sums])
    starts = starts if by else F.broadcast(starts)  # a row for each partition
    summed = dealt.select("*", *[F.coalesce(F.sum(c).over(inside), F.lit(0)).alias(f"_inside_{c}") for c in sums]).join(starts, ["_part", *by])
    return summed.select(*df.columns, *[(F.col(f"_start_{c}") + F.col(f"_inside_{c}")).alias(f"before_{c}") for c in sums], *[f"all_{c}" for c in sums])


def numbered(df: DataFrame, order: Sequence[Column], name: str, by: Sequence[str] = ()) -> DataFrame:
    """``df`` with a gapless number from 0 on in one order, and ``n_all``, the number of rows; of each group ``by``."""
    return cumulated(df.withColumn("_one", F.lit(1).cast("long")), order, ["_one"], by).withColumnsRenamed({"before__one": name, "all__one": "n_all"}).drop("_one")

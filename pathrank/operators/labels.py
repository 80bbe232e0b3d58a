"""Labelled target nodes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pathrank.functions.dates import month
from pathrank.operators.sampling import negatives_capped, time_split
from pathrank.sources.scan import valid_ids


def mapped(column: str, values: dict) -> Column:
    """The label of each listed value; null for others."""
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])[F.col(column)]


def best_per_month(df: DataFrame, keys: Sequence[str], label: str, time: str, month_column: str = "feature_month") -> DataFrame:
    """One row for each node and month: the highest label, then the latest time."""
    best = Window.partitionBy(*keys, month_column).orderBy(F.desc(label), F.desc(time))
    return df.withColumn("_n", F.row_number().over(best)).where("_n = 1").drop("_n")


def labelled_targets(
    df: DataFrame,
    keys: Sequence[str],
    time: str,
    label: str,
    values: dict | None = None,
    limit: str | None = None,
    ranges: dict[str, tuple[str, str]] | None = None,
    limits: dict[str, str] | None = None,
    most: int | None = None,
) -> DataFrame:
    """keys, label, source_time, feature_month and split: valid ids, mapped labels, one row per node and month.

    most: cap on the training split's rows, reached by dropping negatives; other splits are kept whole.
    """
    out = valid_ids(df, keys)
    if limit:
        out = out.where(F.expr(limit))
    if ranges:
        out = time_split(out, time, ranges, limits)
    else:
        out = out.withColumn("split", F.lit("all"))
    out = out.select(*keys, (mapped(label, values) if values else F.col(label)).alias("label"), F.col(time).alias("source_time"), "split").where("label is not null")
    out = best_per_month(out.withColumn("feature_month", month("source_time")), keys, "label", "source_time")
    if most is not None:
        train = out.where("split = 'train'")
        out = negatives_capped(train, "label", most, [*keys, "feature_month"]).unionByName(out.where("split <> 'train'"))
    return out

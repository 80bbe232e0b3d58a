"""Months and ranges of months."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def month(ts: str | Column) -> Column:
    """The first day of a timestamp's month."""
    return F.trunc(F.col(ts) if isinstance(ts, str) else ts, "MM")


def expanded_months(df: DataFrame, column: str, back: int, name: str = "feature_month") -> DataFrame:
    """A row for a month and each of the ``back`` months before it; no row twice."""
    months = F.sequence(F.add_months(F.col(column), -back), F.col(column), F.expr("interval 1 month"))
    return df.withColumn(name, F.explode(months)).distinct()


def split_at_months(df: DataFrame, start: str, end: str) -> DataFrame:
    """Half-open ranges cut at the first days of months: columns ``part_start`` and ``part_end``."""
    first = F.to_date(F.col(start))
    inner = F.filter(F.sequence(F.trunc(first, "MM"), F.to_date(F.col(end)), F.expr("interval 1 month")), lambda m: (m > first) & (m < F.to_date(F.col(end))))
    edges = F.concat(F.array(first), inner)
    return df.withColumn("part_start", F.explode(edges)).withColumn("part_end", F.least(F.add_months(F.trunc("part_start", "MM"), 1), F.to_date(F.col(end)))).where("part_start < part_end")

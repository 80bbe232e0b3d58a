"""Column summaries and data checks."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathrank.operators.ranges import cumulated


def column_summary(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """(by, column, n, min, max, mean, stddev): one aggregation, turned into a row per column."""
    parts = [F.struct(F.lit(c).alias("column_name"), F.count(c).alias("n"), F.min(c).cast("double").alias("min_value"), F.max(c).cast("double").alias("max_value"), F.avg(c).alias("mean_value"), F.stddev_samp(c).alias("std_value")) for c in columns]
    grouped = df.groupBy(*by).agg(F.array(*parts).alias("_s")) if by else df.agg(F.array(*parts).alias("_s"))
    return grouped.select(*by, F.inline("_s"))


def constant_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column_name, value) of the columns that hold one value only."""
    parts = [F.struct(F.lit(c).alias("column_name"), F.min(c).cast("string").alias("low"), F.max(c).cast("string").alias("high")) for c in columns]
    return df.agg(F.array(*parts).alias("_s")).select(F.inline("_s")).where("low = high").select("column_name", F.col("low").alias("value"))


def duplicate_ids(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Rows against distinct ids: two aggregations, none of which gathers the ids in one place."""
    counts = df.groupBy(*by, *columns).agg(F.count("*").alias("_n"))
    aggs = [F.sum("_n").alias("n_rows"), F.count("*").alias("n_distinct"), (F.sum("_n") - F.count("*")).alias("n_extra")]
    return counts.groupBy(*by).agg(*aggs) if by else counts.agg(*aggs)


def value_frequencies(df: DataFrame, column: str, n: int) -> DataFrame:
    """The n most frequent values, with the number of distinct ones."""
    counts = df.groupBy(column).agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), column).limit(n).crossJoin(F.broadcast(counts.agg(F.count("*").alias("n_distinct"))))  # one row


def pivot_counts(df: DataFrame, key: str, column: str, values: Sequence[str], extra: str = "Extra") -> DataFrame:
    """Rows of each key by value; values that are not listed count as ``Extra``."""
    listed = [*values, extra]
    bucket = F.when(F.col(column).cast("string").isin(list(values)), F.col(column).cast("string")).otherwise(extra)
    return df.withColumn("_bucket", bucket).groupBy(key).pivot("_bucket", listed).agg(F.count(F.lit(1))).fillna(0, subset=listed)


def prefixed_counts(df: DataFrame, key: str, values: dict[str, Sequence[str]], extra: str = "Extra") -> DataFrame:
    """The same for several columns in one aggregation, under names ``column_value``."""
    counts = []
    for column, listed in values.items():
        c = F.col(column).cast("string")
        counts += [F.count_if(c == v).alias(f"{column}_{v}") for v in listed]
        counts.append(F.count_if(~F.coalesce(c.isin(list(listed)), F.lit(False))).alias(f"{column}_{extra}"))
    return df.groupBy(key).agg(*counts)


def quantiles(df: DataFrame, column: str, shares: Sequence[float]) -> DataFrame:
    """One row with ``e``, the exact quantiles of a column, interpolated between neighbouring values; null if it has none.

    Values are counted and range-partitioned, so no task holds all distinct ones.
    """
    counted = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("v")).agg(F.count("*").alias("n"))
    ranked = cumulated(counted, [F.asc("v")], ["n"])
    edges = []
    for share in shares:
        place = F.lit(float(share)) * (F.col("all_n") - 1)
        low, high = (F.max(F.when((F.col("before_n") <= at) & (at < F.col("before_n") + F.col("n")), F.col("v").cast("double"))) for at in (F.floor(place), F.ceil(place)))
        edges.append(low + (high - low) * F.max(place - F.floor(place)))
    return ranked.agg(F.array(*edges).alias("e"))


def quantile_histogram(df: DataFrame, column: str, bins: int) -> DataFrame:
    """(bin, low, high, n): bins between exact quantiles, the last one closed; repeated edges leave empty bins.

    The edges are one small array; all bins are counted in one pass.
    """
    edges = quantiles(df, column, [i / bins for i in range(bins + 1)])
    rows = edges.select(F.posexplode(F.arrays_zip(F.slice("e", 1, bins).alias("low"), F.slice("e", 2, bins).alias("high"))).alias("bin", "x")).select("bin", F.col("x.low").alias("low"), F.col("x.high").alias("high"))
    value = F.col(column)
    place = F.when(value == F.element_at("e", bins + 1), bins - 1).otherwise(F.size(F.filter("e", lambda e: e <= value)) - 1)
    counts = df.select(column).crossJoin(F.broadcast(edges)).where(value.isNotNull()).groupBy(place.alias("bin")).agg(F.count("*").alias("n"))  # one row
    return rows.join(counts, "bin", "left").select("bin", "low", "high", F.coalesce("n", F.lit(0)).alias("n"))


def size_report(paths: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """(path, n_rows, n_starts) of path tables, each with its start column."""
    parts = []
    for name, (df, start) in paths.items():
        parts.append(df.groupBy(start).agg(F.count("*").alias("_n")).agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("n_rows"), F.count(start).alias("n_starts")).select(F.lit(name).alias("path"), "n_rows", "n_starts"))
    return reduce(DataFrame.unionByName, parts)

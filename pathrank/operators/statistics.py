"""Statistics of columns by partition that can be merged: moments and quantile sketches.

A table has a row for each partition and column: number of values, least, greatest, mean, sum of squared deviations, and a
KLL sketch. Any range of partitions is summarised from these rows; a new partition costs one pass over itself. Kept
under a manifest (``kept_statistics``), only partitions whose source is new or changed are read.

Counts, extremes and moments are those of the values themselves, up to the rounding of floating point. Sketched quantiles have a
rank error that depends on the sketch's size only: for k = 200, about 1.33 % of the values for a single quantile with 99 %
confidence; merging keeps that bound.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathrank.sources.manifest import content_versions, resumed

#: Size of the sketches.
SKETCH = 200


def partition_statistics(df: DataFrame, columns: Sequence[str], key: str) -> DataFrame:
    """(key, column_name, n, low, high, mean, m2, sketch) in one pass over ``df``; columns without a value have n = 0."""
    parts = []
    for c in columns:
        x = F.col(c).cast("double")
        m2 = F.coalesce(F.var_pop(x) * F.count(x), F.lit(0.0))
        parts.append(F.struct(F.lit(c).alias("column_name"), F.count(x).alias("n"), F.min(x).alias("low"), F.max(x).alias("high"), F.avg(x).alias("mean"), m2.alias("m2"), F.kll_sketch_agg_double(x, F.lit(SKETCH)).alias("sketch")))
    return df.groupBy(key).agg(F.array(*parts).alias("_s")).select(key, F.inline("_s"))


def kept_statistics(spark: SparkSession, folder: str, df: DataFrame, columns: Sequence[str], key: str, partitions: Sequence, versions: Mapping[str, str] | None = None) -> DataFrame:
    """The statistics of the wanted partitions, of which only new and changed ones are computed.

    versions: partition: version of the source; by content if None.
    """
    versions = content_versions([(df, [key, *columns])], key, partitions) if versions is None else versions
    return resumed(spark, folder, key, partitions, lambda wanted: partition_statistics(df.where(F.col(key).isin(wanted)), columns, key), ",".join(columns), versions)


def merged(statistics: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, column_name, n, low, high, mean, m2, sketch) over all partitions of a group.

    Deviations are taken from the merged mean, so that means far from 0 cost no digits.
    """
    keys = [*by, "column_name"]
    whole = statistics.where("n > 0").groupBy(*keys).agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"), (F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("mean"), F.kll_merge_agg_double("sketch").alias("sketch"))
    off = statistics.where("n > 0").select(*keys, F.col("n").alias("_n"), F.col("mean").alias("_mean"), F.col("m2").alias("_m2")).join(whole.select(*keys, "mean"), keys)
    spread = off.groupBy(*keys).agg(F.sum(F.col("_m2") + F.col("_n") * F.pow(F.col("_mean") - F.col("mean"), 2)).alias("m2"))
    return whole.join(spread, keys).select(*keys, "n", "low", "high", "mean", "m2", "sketch")


def summary(statistics: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, column_name, n, min_value, max_value, mean_value, std_value), as ``column_summary`` has them."""
    deviation = F.when(F.col("n") > 1, F.sqrt(F.col("m2") / (F.col("n") - 1)))
    return merged(statistics, by).select(*by, "column_name", "n", F.col("low").alias("min_value"), F.col("high").alias("max_value"), F.col("mean").alias("mean_value"), deviation.alias("std_value"))


def sketched_quantiles(statistics: DataFrame, shares: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """(by, column_name, e): quantiles from the merged sketches."""
    ranks = F.array(*[F.lit(float(s)) for s in shares])
    return merged(statistics, by).select(*by, "column_name", F.kll_sketch_get_quantile_double("sketch", ranks).alias("e"))


def scale_by_statistics(rows: DataFrame, statistics: DataFrame, key: str, partition: str, features: Sequence[str], how: str = "norm", eps: float = 1e-5) -> DataFrame:
    """``rows`` scaled by the statistics of their partition, which come from the table of statistics instead of a scan."""
    wide = statistics.where(F.col("column_name").isin(list(features))).groupBy(partition).pivot("column_name", list(features)).agg(F.first(F.struct("n", "low", "high", "mean", "m2")))
    met = rows.select(key, partition, *features).join(wide.withColumnsRenamed({f: f"_{f}" for f in features}), partition)

    def scaled(f: str):
        s = F.col(f"_{f}")
        if how == "norm":
            return (F.col(f) - s["low"]) / (s["high"] - s["low"] + eps)
        return (F.col(f) - s["mean"]) / F.sqrt(F.when(s["n"] > 1, s["m2"] / (s["n"] - 1)) + eps)

    return met.select(key, partition, *[scaled(f).alias(f) for f in features])

"""Caps per group, class-balanced batches and splits. Random orders are md5 keys, the same on every run."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pathrank.plans.spec import Sample

SEED = 42
#: Rows that are ranked in one window of a hash's cell, on average.
ROWS_A_CELL = 100_000


def order_key(keys: Sequence[str], seed: int = SEED) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]))


def _first(df: DataFrame, groups: Sequence[str], order: list, n: int) -> DataFrame:
    window = Window.partitionBy(*groups).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(window)).where(F.col("_rank") <= n).drop("_rank")


def _leading(df: DataFrame, groups: Sequence[str], order: list, n: int) -> DataFrame:
    """The rows that a short order, which a longer one begins with, does not rule out: the first n of each group and their ties.

    They are few, so hashes of the longer order are made of them alone, after the shuffle, and none goes through it.
    """
    window = Window.partitionBy(*groups).orderBy(*order)
    return df.withColumn("_rank", F.rank().over(window)).where(F.col("_rank") <= n).drop("_rank")


def random_n(df: DataFrame, groups: Sequence[str], keys: Sequence[str], n: int, seed: int = SEED) -> DataFrame:
    """At most n rows of each group, chosen by a hash of group and keys."""
    key = order_key([*groups, *keys], seed)
    cells = df.withColumn("_cell", F.conv(F.substring(key, 1, 5), 16, 10).cast("int"))
    return _first(_leading(cells, groups, ["_cell"], n).drop("_cell"), groups, [key, *keys], n)


def top_n(df: DataFrame, groups: Sequence[str], features: Sequence[str], keys: Sequence[str], n: int, seed: int = SEED) -> DataFrame:
    """The n rows of each group with the largest features; ties by hash."""
    order = [F.desc(f) for f in features]
    return _first(_leading(df, groups, order, n), groups, [*order, order_key([*groups, *keys], seed), *keys], n)


def threshold_n(df: DataFrame, groups: Sequence[str], keys: Sequence[str], n: int) -> DataFrame:
    """At most n rows of each group, in the order of the keys."""
    return _first(df, groups, list(keys), n)


def capped(df: DataFrame, groups: Sequence[str], keys: Sequence[str], sample: Sample, names: dict[str, str] | None = None) -> DataFrame:
    """A specification's cap."""
    if sample.kind == "random":
        return random_n(df, groups, keys, sample.n)
    if sample.kind == "top":
        if not sample.features:
            raise ValueError("a top sample needs features")
        return top_n(df, groups, [(names or {}).get(f, f) for f in sample.features], keys, sample.n)
    if sample.kind == "threshold":
        return threshold_n(df, groups, keys, sample.n)
    raise ValueError(f"unknown sample: {sample.kind}")


def negatives_capped(df: DataFrame, label: str, most: int, keys: Sequence[str], seed: int = SEED) -> DataFrame:
    """All positives; of the negatives as many as fit under ``most`` rows.

    Only hash keys below the wanted rank's are needed, so negatives are ranked within cells of the hash, of which there are
    as many as keep a cell at some ROWS_A_CELL rows, 16 at least.
    """
    total = df.agg(F.count("*").alias("_all"), F.count_if(F.col(label) > 0).alias("_positive"))
    free = F.when(F.col("_all") > most, F.greatest(F.lit(most) - F.col("_positive"), F.lit(0))).otherwise(F.col("_all"))
    digits = F.greatest(F.lit(1), F.ceil(F.log(16.0, F.col("_all") / ROWS_A_CELL))).cast("int")
    limits = F.broadcast(total.select(free.alias("_free"), digits.alias("_digits")))  # one row
    negatives = df.where(F.col(label) <= 0).crossJoin(limits).withColumn("_key", order_key(keys, seed)).withColumn("_cell", F.substring("_key", F.lit(1), F.col("_digits")))
    sizes = negatives.groupBy("_cell").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)  # a row for each cell
    starts = sizes.select("_cell", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("_cell").orderBy("_key", *keys)
    ranked = negatives.withColumn("_rank", F.row_number().over(inside)).join(starts, "_cell")
    kept = ranked.where(F.col("_start") + F.col("_rank") <= F.col("_free"))
    return df.where(F.col(label) > 0).unionByName(kept.select(*df.columns))


def class_batch(df: DataFrame, label: str, n: int, portion: float, keys: Sequence[str], seed: int = SEED) -> DataFrame:
    """ceil(n * portion) positives and the rest of n negatives; with portion 0, n rows of any class."""
    positives = -int(-n * portion // 1)
    order = [order_key(keys, seed), *keys]
    if portion == 0:
        return df.orderBy(*order).limit(n)
    return df.where(F.col(label) > 0).orderBy(*order).limit(positives).unionByName(df.where(F.col(label) <= 0).orderBy(*order).limit(n - positives))


def time_split(df: DataFrame, column: str, ranges: dict[str, tuple[str, str]], limits: dict[str, str] | None = None) -> DataFrame:
    """A ``split`` column by half-open time ranges; rows of no split, or against their split's predicate, go."""
    split = F.lit(None).cast("string")
    for name, (low, high) in ranges.items():
        inside = (F.col(column) >= F.lit(low).cast("timestamp")) & (F.col(column) < F.lit(high).cast("timestamp"))
        if name in (limits or {}):
            inside = inside & F.expr(limits[name])
        split = F.when(inside, F.lit(name)).otherwise(split)
    return df.withColumn("split", split).where("split is not null")


def row_slice(df: DataFrame, order: Sequence[str], start: int, stop: int) -> DataFrame:
    """Rows ``start`` to before ``stop`` of an order."""
    return df.orderBy(*order).limit(stop).offset(start) if start else df.orderBy(*order).limit(stop)

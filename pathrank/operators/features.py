"""Feature assembly, vectors, scaling and the feature matrix."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.ml.feature import MinMaxScaler, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathrank.functions.vectors import zero_filled


def assemble(targets: DataFrame, key: str, tables: Sequence[tuple[str, DataFrame, str, Sequence[str]]], broadcast_rows: int | None = None) -> DataFrame:
    """Every target with the features of all tables (name, data, id, features), ``name_feature``, 0 where missing.

    broadcast_rows: tables of at most so many rows (counted) are broadcast.
    """
    out = targets.select(key).distinct()
    for name, data, id_column, features in tables:
        side = data.select(F.col(id_column).alias(key), *[F.col(f).alias(f"{name}_{f}") for f in features]).dropDuplicates([key])
        if broadcast_rows is not None and side.limit(broadcast_rows + 1).count() <= broadcast_rows:
            side = F.broadcast(side)
        out = out.join(side, key, "left").fillna(0, subset=[f"{name}_{f}" for f in features])
    return out


def combine_tables(tables: Sequence[tuple[str, DataFrame, str, Sequence[str]]], key: str) -> DataFrame:
    """All ids of all tables with all features: a union in long rows and one aggregation, not a chain of outer joins."""
    columns = [(name, f) for name, _, _, features in tables for f in features]
    parts = []
    for name, data, id_column, features in tables:
        own = {(name, f) for f in features}
        parts.append(data.select(F.col(id_column).alias(key), *[(F.col(f).cast("double") if (n, f) in own else F.lit(None).cast("double")).alias(f"{n}_{f}") for n, f in columns]))
    return reduce(DataFrame.unionByName, parts).groupBy(key).agg(*[F.max(f"{n}_{f}").alias(f"{n}_{f}") for n, f in columns]).fillna(0.0)


def point_in_time(samples: DataFrame, features: DataFrame, keys: Sequence[str], sample_time: str, feature_time: str, columns: Sequence[str]) -> DataFrame:
    """Each sample with the features of its own time, 0 where there are none."""
    side = features.select(*keys, F.col(feature_time).alias(sample_time), *columns).dropDuplicates([*keys, sample_time])
    return samples.join(side, [*keys, sample_time], "left").fillna(0, subset=list(columns))


def left_join_vectors(left: DataFrame, right: DataFrame, key: str, vector: str, size: int) -> DataFrame:
    """A left join of vectors (arrays of doubles); absent ones are zero vectors of the given size."""
    return left.join(right.select(key, vector), key, "left").withColumn(vector, zero_filled(vector, size))


def vectorize(df: DataFrame, keys: Sequence[str], features: Sequence[str], kinds: Sequence[str] = ("raw", "norm", "std"), with_mean: bool = False) -> DataFrame:
    """``features_raw``, ``features_norm`` (min-max) and ``features_std`` (over the standard deviation) as arrays of doubles."""
    df = VectorAssembler(inputCols=list(features), outputCol="_raw").transform(df.fillna(0, subset=list(features)))
    out = [*keys]
    if "raw" in kinds:
        out.append(vector_to_array("_raw").alias("features_raw"))
    if "norm" in kinds:
        df = MinMaxScaler(inputCol="_raw", outputCol="_norm").fit(df).transform(df)
        out.append(vector_to_array("_norm").alias("features_norm"))
    if "std" in kinds:
        df = StandardScaler(inputCol="_raw", outputCol="_std", withMean=with_mean, withStd=True).fit(df).transform(df)
        out.append(vector_to_array("_std").alias("features_std"))
    return df.select(*out)


def scale_by_partition(targets: DataFrame, table: DataFrame, key: str, partition: str, features: Sequence[str], how: str = "norm", eps: float = 1e-5) -> DataFrame:
    """Target rows scaled by the statistics of the whole table of their partition."""
    stats = table.groupBy(partition).agg(*[x for f in features for x in ((F.min(f).alias(f"_min_{f}"), F.max(f).alias(f"_max_{f}")) if how == "norm" else (F.avg(f).alias(f"_avg_{f}"), F.var_samp(f).alias(f"_var_{f}")))])
    rows = table.join(targets.select(key, partition).distinct(), [key, partition], "left_semi").join(stats, partition)

    def scaled(f: str):
        if how == "norm":
            return (F.col(f) - F.col(f"_min_{f}")) / (F.col(f"_max_{f}") - F.col(f"_min_{f}") + eps)
        return (F.col(f) - F.col(f"_avg_{f}")) / F.sqrt(F.col(f"_var_{f}") + eps)

    return rows.select(key, partition, *[scaled(f).alias(f) for f in features])


def feature_matrix(samples: DataFrame, keys: Sequence[str], blocks: dict[tuple[str, str], DataFrame], drop: Sequence[tuple[str, str]] = ()) -> DataFrame:
    """Samples with every block's columns, named ``feature__path__position``, 0 where a sample has none.

    blocks: (path, position): a table with the keys and features.
    """
    out = samples
    for (path, position), block in blocks.items():
        if (path, position) in drop or (path, "*") in drop:
            continue
        names = {c: f"{c}__{path}__{position}" for c in block.columns if c not in keys}
        out = out.join(block.withColumnsRenamed(names), list(keys), "left").fillna(0, subset=list(names.values()))
    return out

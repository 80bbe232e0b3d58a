"""Scans of node and edge tables: partitions, nulls, targets, predicates, duplicates, projection, caps."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pathrank.operators.sampling import capped
from pathrank.plans.spec import Edge, NodeAttributes
from pathrank.sources.catalog import GraphCatalog


def read_partitions(spark: SparkSession, path: str, key: str, values: Iterable | None = None) -> DataFrame:
    """A partitioned Parquet table; only the wanted partitions are read."""
    df = spark.read.parquet(path)
    return df if values is None else df.where(F.col(key).isin(list(values)))


def read_table(spark: SparkSession, name: str, key: str, values: Iterable | None = None) -> DataFrame:
    """A catalogue table with the same restriction."""
    df = spark.table(name)
    return df if values is None else df.where(F.col(key).isin(list(values)))


def valid_ids(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows whose ids are neither null nor empty."""
    for c in columns:
        df = df.where(F.col(c).isNotNull() & (F.col(c).cast("string") != ""))
    return df


def restricted(df: DataFrame, targets: DataFrame | None, columns: Sequence[str]) -> DataFrame:
    """Rows whose ids are among the targets (a semi-join)."""
    return df if targets is None else df.join(targets.select(*columns).distinct(), list(columns), "left_semi")


def deduplicated(df: DataFrame, keys: Sequence[str], features: Sequence[str], how: str = "first") -> DataFrame:
    """One row for each key: the smallest by its features, or their sums."""
    if how == "sum":
        return df.groupBy(*keys).agg(*[F.sum(f).alias(f) for f in features]) if features else df.select(*keys).distinct()
    if how != "first":
        raise ValueError(f"unknown way to deduplicate: {how}")
    if not features:
        return df.select(*keys).distinct()
    order = Window.partitionBy(*keys).orderBy(*features)
    return df.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def edge_scan(graph: GraphCatalog, edge: Edge, targets: DataFrame | None = None, partitions: Sequence | None = None, dedup: str = "first") -> DataFrame:
    """An edge table under path names: a column for each position, ``Edge_<index>_<feature>``, the partition key.

    ``targets`` has columns named like head positions.
    """
    table = graph.edges[edge.table]
    key = [graph.partition_key] if graph.partition_key in table.data.columns else []
    features = list(edge.features)
    ends = [*edge.heads, *edge.tails]
    df = table.data
    if partitions is not None and key:
        df = df.where(F.col(key[0]).isin(list(partitions)))
    if edge.limit:
        df = df.where(F.expr(edge.limit))
    df = df.select(*[F.col(c).alias(p.column) for p, c in ends], *key, *[F.col(f).alias(f"Edge_{edge.index}_{f}") for f in features]).dropna()
    heads = [p.column for p, _ in edge.heads]
    if targets is not None:
        shared = [c for c in [*heads, *key] if c in targets.columns]
        if shared:
            df = restricted(df, targets, shared)
    names = [f"Edge_{edge.index}_{f}" for f in features]
    df = deduplicated(df, [p.column for p, _ in ends] + key, names, dedup)
    if edge.sample:
        df = capped(df, [*heads, *key], [p.column for p, _ in edge.tails], edge.sample, {f: f"Edge_{edge.index}_{f}" for f in features})
    return df


def node_scan(graph: GraphCatalog, node: NodeAttributes, partitions: Sequence | None = None) -> DataFrame:
    """A node table's id under the position's name, its features as ``Type_index_feature``."""
    table = graph.node(node.position.type, node.table)
    key = [graph.partition_key] if graph.partition_key in table.data.columns else []
    df = table.data
    if partitions is not None and key:
        df = df.where(F.col(key[0]).isin(list(partitions)))
    if node.limit:
        df = df.where(F.expr(node.limit))
    features = list(node.features)
    df = df.select(F.col(node.column).alias(node.position.column), *key, *[F.col(f).alias(f"{node.position.column}_{f}") for f in features]).dropna()
    return deduplicated(df, [node.position.column, *key], [f"{node.position.column}_{f}" for f in features])


def limited_by_features(edges: DataFrame, column: str, nodes: DataFrame, id_column: str, features: Sequence[str], predicate: str) -> DataFrame:
    """Edges that satisfy a predicate over features of the node at one end; the features do not stay."""
    side = nodes.select(F.col(id_column).alias(column), *features).dropDuplicates([column])
    return edges.join(side, column, "left").where(F.expr(predicate)).select(*edges.columns)

"""A heterogeneous graph as named DataFrames. The catalogue holds no data."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class NodeTable:
    data: DataFrame
    id_column: str
    features: tuple[str, ...]


@dataclass(frozen=True)
class EdgeTable:
    data: DataFrame
    ends: dict[str, str]  # column: node type; any number of columns
    features: tuple[str, ...] = ()


@dataclass(frozen=True)
class GraphCatalog:
    nodes: dict[str, dict[str, NodeTable]]
    edges: dict[str, EdgeTable]
    partition_key: str | None = None

    def node(self, type_: str, name: str) -> NodeTable:
        return self.nodes[type_][name]

    def types(self) -> list[str]:
        """All node types, those that only edges know included."""
        return sorted(set(self.nodes) | {t for e in self.edges.values() for t in e.ends.values()})

    def summary(self, spark: SparkSession) -> DataFrame:
        """kind, type, table, ids, number of features and rows of every table; types without one have a row too."""
        counts = []
        for type_, tables in self.nodes.items():
            for name, t in tables.items():
                counts.append(t.data.agg(F.count("*").alias("n_rows")).select(F.lit("Node").alias("kind"), F.lit(type_).alias("type"), F.lit(name).alias("table_name"), F.lit(t.id_column).alias("ids"), F.lit(len(t.features)).alias("n_features"), "n_rows"))
        for name, e in self.edges.items():
            counts.append(e.data.agg(F.count("*").alias("n_rows")).select(F.lit("Edge").alias("kind"), F.lit(name).alias("type"), F.lit(name).alias("table_name"), F.lit(",".join(sorted(e.ends))).alias("ids"), F.lit(len(e.features)).alias("n_features"), "n_rows"))
        bare = [("Node", t, None, None, 0, 0) for t in self.types() if t not in self.nodes]
        if bare:
            counts.append(spark.createDataFrame(bare, "kind string, type string, table_name string, ids string, n_features int, n_rows long"))
        return reduce(DataFrame.unionByName, counts)

    def subgraph(self, keep_nodes: Iterable[str] | None = None, keep_edges: Iterable[str] | None = None, rename_nodes: dict[str, str] | None = None, rename_edges: dict[str, str] | None = None, edge_columns: dict[str, list[str]] | None = None) -> GraphCatalog:
        """A view with some node and edge types, under other names, and with fewer edge columns."""
        new_node, new_edge = rename_nodes or {}, rename_edges or {}
        nodes = {new_node.get(t, t): tables for t, tables in self.nodes.items() if keep_nodes is None or t in set(keep_nodes)}
        edges = {}
        for name, e in self.edges.items():
            if keep_edges is not None and name not in set(keep_edges):
                continue
            wanted = (edge_columns or {}).get(name)
            if wanted is not None:
                key = [self.partition_key] if self.partition_key in e.data.columns else []
                e = EdgeTable(e.data.select(*wanted, *key), {c: t for c, t in e.ends.items() if c in wanted}, tuple(f for f in e.features if f in wanted))
            edges[new_edge.get(name, name)] = replace(e, ends={c: new_node.get(t, t) for c, t in e.ends.items()})
        return GraphCatalog(nodes, edges, self.partition_key)


def common_partitions(tables: Iterable[DataFrame], key: str) -> DataFrame:
    """The values of the partition key that all tables have."""
    return reduce(DataFrame.intersect, [t.select(key).distinct() for t in tables])

"""Meta-paths: chains of relations with summed weights, and what follows from their instances."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathrank.operators.sampling import capped
from pathrank.plans.spec import Sample


@dataclass(frozen=True)
class Link:
    """One relation of a chain: an edge table, its ends, and an optional weight, predicate and cap per head."""

    data: DataFrame
    head: str
    tail: str
    weight: str | None = None
    limit: str | None = None
    sample: Sample | None = None


def consolidated(link: Link) -> DataFrame:
    """(head, tail, weight): parallel edges summed; without a weight each edge counts one."""
    df = link.data.where(F.expr(link.limit)) if link.limit else link.data
    weight = F.col(link.weight) if link.weight else F.lit(1.0)
    return df.select(F.col(link.head).alias("head"), F.col(link.tail).alias("tail"), weight.cast("double").alias("weight")).dropna(subset=["head", "tail"]).groupBy("head", "tail").agg(F.sum("weight").alias("weight"))


def metapath(links: Sequence[Link], names: Sequence[str], how: str = "inner", limits: dict[int, str] | None = None, cap: Sample | None = None) -> DataFrame:
    """Instances of a chain: a column for each node (``names``) and ``Weight_k`` for each relation.

    limits: predicates after the k-th relation. cap: rows per start node.
    """
    path: DataFrame | None = None
    for k, link in enumerate(links, 1):
        edges = consolidated(link)
        if link.sample:
            edges = capped(edges, ["head"], ["tail"], link.sample)
        edges = edges.select(F.col("head").alias(names[k - 1]), F.col("tail").alias(names[k]), F.col("weight").alias(f"Weight_{k}"))
        path = edges if path is None else path.join(edges, names[k - 1], how)
        if limits and k in limits:
            path = path.where(F.expr(limits[k]))
    path = path.select(*names[: len(links) + 1], *[f"Weight_{k}" for k in range(1, len(links) + 1)])
    return capped(path, [names[0]], list(path.columns[1:]), cap) if cap else path


def node_query(paths: DataFrame, start: str) -> DataFrame:
    """The start nodes that have an instance."""
    return paths.select(start).where(F.col(start).isNotNull()).distinct()


def universe(parts: Iterable[tuple[DataFrame, dict[str, str]]]) -> DataFrame:
    """(node_type, node): all nodes that paths or edges touch; each part comes with its columns' types."""
    columns = [df.select(F.lit(t).alias("node_type"), F.col(c).cast("string").alias("node")) for df, types in parts for c, t in types.items()]
    return reduce(DataFrame.unionByName, columns).where("node is not null").distinct()

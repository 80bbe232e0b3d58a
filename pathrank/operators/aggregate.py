"""Aggregation of features along paths back to the start nodes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pathrank.operators import path
from pathrank.plans.spec import PathSpec, Position
from pathrank.sources.catalog import GraphCatalog
from pathrank.sources.manifest import content_versions, resumed
from pathrank.sources.shared import cut

_FUNCTIONS = {"AVG": F.avg, "SUM": F.sum, "MAX": F.max, "MIN": F.min}


def _value(column: str, missing: str) -> Column:
    if missing not in ("zero", "ignore"):
        raise ValueError(f"missing is zero or ignore, not {missing}")
    c = F.col(column).cast("double")
    return F.coalesce(c, F.lit(0.0)) if missing == "zero" else c


def expressions(features: Sequence[str], functions: Sequence[str], missing: str = "zero") -> list[Column]:
    """``FUNC_feature`` for each feature and function; COUNT is ``COUNT_All``, of rows."""
    out = [_FUNCTIONS[f](_value(c, missing)).alias(f"{f}_{c}") for f in functions if f != "COUNT" for c in features]
    return out + [F.count("*").alias("COUNT_All")] * ("COUNT" in functions)


def aggregate_features(df: DataFrame, ids: Sequence[str], features: Sequence[str], functions: Sequence[str], missing: str = "zero") -> DataFrame:
    """Features of ``df`` grouped by ``ids``; a missing value counts as 0, or not at all (``missing='ignore'``)."""
    return df.groupBy(*ids).agg(*expressions(features, functions, missing))


def wide_aggregate(df: DataFrame, ids: Sequence[str], features: Sequence[str], functions: Sequence[str], columns: int = 300, missing: str = "zero") -> DataFrame:
    """The same for more aggregates than one stage's code can hold (``columns``), in one pass over the data.

    Features become rows (id, feature's number, value), which one aggregation of constant width reduces before
    they are shuffled; a second one puts a start's features, a row each by then, back into columns.
    """
    if len(features) * len(functions) <= columns:
        return aggregate_features(df, ids, features, functions, missing)
    value = F.array(*[F.struct(F.lit(k).alias("_f"), _value(c, missing).alias("_v")) for k, c in enumerate(features)])
    made = [f for f in functions if f != "COUNT"]
    parts = [_FUNCTIONS[f]("_v").alias(f) for f in made] + [F.count("*").alias("COUNT")]
    tall = df.select(*ids, F.inline(value)).groupBy(*ids, "_f").agg(*parts)
    whole = tall.groupBy(*ids).agg(F.map_from_entries(F.collect_list(F.struct("_f", F.struct(*made, "COUNT")))).alias("_m"))  # a row for each feature
    cells = [F.col("_m")[k][f].alias(f"{f}_{c}") for f in made for k, c in enumerate(features)]
    return whole.select(*ids, *cells, *([F.col("_m")[0]["COUNT"].alias("COUNT_All")] if "COUNT" in functions else []))


def node_aggregate(paths: DataFrame, start: Sequence[str], position: Position, table: DataFrame, id_column: str, features: Sequence[str], functions: Sequence[str], missing: str = "zero") -> DataFrame:
    """Features of the nodes at a position, once per instance, aggregated to the start nodes."""
    side = table.select(F.col(id_column).alias(position.column), *features).dropDuplicates([position.column])
    return aggregate_features(paths.select(*start, position.column).join(side, position.column, "left"), start, features, functions, missing)


def _brought(position: Position, table: DataFrame, id_column: str, features: Sequence[str]) -> dict[str, DataFrame]:
    """A node table as ``find_paths`` takes it along; its features are named after the position."""
    side = table.select(F.col(id_column).alias(position.column), *[F.col(f).alias(f"_{position.column}_{f}") for f in features])
    return {position.column: side.dropDuplicates([position.column])}


def searched_node_aggregate(graph: GraphCatalog, spec: PathSpec, position: Position, table: DataFrame, id_column: str, features: Sequence[str], functions: Sequence[str], missing: str = "zero") -> DataFrame:
    """``node_aggregate`` to the start nodes of a path that is yet to be searched.

    Features are looked up for the edges that bring the nodes, not for the instances, of which there are more; these are only
    shuffled when they are aggregated.
    """
    start = [p.column for p in spec.start]
    if position in spec.start:
        return node_aggregate(path.find_paths(graph, spec), start, position, table, id_column, features, functions, missing)
    found = path.find_paths(graph, spec, brought=_brought(position, table, id_column, features))
    return aggregate_features(found.select(*start, *[F.col(f"_{position.column}_{f}").alias(f) for f in features]), start, features, functions, missing)


def aggregate_search(graph: GraphCatalog, spec: PathSpec, tables: dict[str, tuple[DataFrame, str, Sequence[str]]], functions: Sequence[str], missing: str = "zero", partitions: Sequence | None = None) -> dict[str, DataFrame]:
    """``aggregate_path`` of a path that is yet to be searched, for all positions behind the start and all edges.

    All are parts of one aggregation, which is materialised: instances are neither stored nor searched for each. Rows are
    grouped by the partition key too, if the path has it.
    """
    nodes = [p for p in spec.positions() if p.type in tables and p not in spec.start]
    found = path.find_paths(graph, spec, partitions=partitions, brought={p.column: _brought(p, *tables[p.type])[p.column] for p in nodes})
    ids = [p.column for p in spec.start] + [graph.partition_key] * (graph.partition_key in found.columns)
    owners = {f"Node___{p.type}___{p.index}": {f: f"_{p.column}_{f}" for f in tables[p.type][2]} for p in nodes}
    owners |= {f"Edge___{e.table}___{e.index}": {c: c for f in e.features for c in [f"Edge_{e.index}_{f}"]} for e in spec.edges() if e.features}
    whole = cut(aggregate_features(found, ids, list(dict.fromkeys(c for own in owners.values() for c in own.values())), functions, missing))
    made = [f for f in functions if f != "COUNT"]
    count = ["COUNT_All"] * ("COUNT" in functions)
    return {name: whole.select(*ids, *[F.col(f"{f}_{column}").alias(f"{f}_{c}") for f in made for c, column in own.items()], *count) for name, own in owners.items()}


def edge_aggregate(paths: DataFrame, start: Sequence[str], edge_index: int, functions: Sequence[str], missing: str = "zero") -> DataFrame:
    """An edge's features along the path, aggregated to the start nodes."""
    features = [c for c in paths.columns if c.startswith(f"Edge_{edge_index}_")]
    return aggregate_features(paths, start, features, functions, missing)


def start_features(paths: DataFrame, position: Position, tables: Sequence[tuple[DataFrame, str, Sequence[str]]]) -> DataFrame:
    """The start nodes' own features, from every table, 0 where there are none."""
    out = paths.select(position.column).distinct()
    for table, id_column, features in tables:
        side = table.select(F.col(id_column).alias(position.column), *features).dropDuplicates([position.column])
        out = out.join(side, position.column, "left").fillna(0, subset=list(features))
    return out


def aggregate_path(paths: DataFrame, spec: PathSpec, tables: dict[str, tuple[DataFrame, str, Sequence[str]]], functions: Sequence[str], missing: str = "zero", partition: str | None = None) -> dict[str, DataFrame]:
    """A DataFrame per position with features and per edge with features; tables: type: (data, id, features).

    ``partition``: a partition key of the paths that groups beside the start nodes. Cut or store the path table
    first if several of the results will be computed.
    """
    start = [p.column for p in spec.start] + [partition] * (partition is not None)
    out: dict[str, DataFrame] = {}
    for p in spec.positions():
        if p.type in tables and p.column in paths.columns:
            data, id_column, features = tables[p.type]
            out[f"Node___{p.type}___{p.index}"] = start_features(paths, p, [tables[p.type]]) if p in spec.start else node_aggregate(paths, start, p, data, id_column, features, functions, missing)
    for e in spec.edges():
        if e.features:
            out[f"Edge___{e.table}___{e.index}"] = edge_aggregate(paths, start, e.index, functions, missing)
    return out


def stored_elements(graph: GraphCatalog, spec: PathSpec, folder: str, partitions: Sequence, spark: SparkSession, tables: dict[str, tuple[DataFrame, str, Sequence[str]]], functions: Sequence[str], missing: str = "zero", targets: DataFrame | None = None) -> dict[str, DataFrame]:
    """The aggregates of ``aggregate_path`` by start node and partition, of which only unfinished partitions are computed.

    Instances come from ``stored_paths`` in the same folder, so that they are searched once for all positions.
    """
    key = graph.partition_key
    sources = [*path.source_tables(graph, spec), *[(data, [id_column, *features]) for data, id_column, features in tables.values()]]
    versions = content_versions(sources, key, partitions)
    state = "|".join([repr(sorted(functions)), missing, path.targets_state(targets)])
    place = f"{folder.rstrip('/')}/{spec.name}-{spec.fingerprint(str(key))}-elements"
    names = [f"Node___{p.type}___{p.index}" for p in spec.positions() if p.type in tables and p not in spec.start] + [f"Edge___{e.table}___{e.index}" for e in spec.edges() if e.features]

    def computed(name: str):
        return lambda wanted: aggregate_path(path.stored_paths(graph, spec, folder, wanted, spark, targets), spec, tables, functions, missing, key)[name]

    return {name: resumed(spark, f"{place}/{name}", key, partitions, computed(name), state, versions) for name in names}


def weight_aggregate(paths: DataFrame, start: str, node: str, weight: str, functions: Sequence[str] = ("AVG", "SUM", "MAX", "MIN", "COUNT")) -> DataFrame:
    """Weights summed per (start, node), then aggregated per start."""
    return aggregate_features(paths.groupBy(start, node).agg(F.sum(weight).alias(weight)), [start], [weight], functions)


def tail_features(targets: DataFrame, key: str, paths: DataFrame, tail: str, table: DataFrame, id_column: str, features: Sequence[str], prefix: str, functions: Sequence[str] = ("AVG", "MIN", "MAX", "SUM", "COUNT")) -> DataFrame:
    """Aggregated tail features for every target, 0 where it has no path, names prefixed."""
    side = table.select(F.col(id_column).alias(tail), *features).dropDuplicates([tail])
    found = aggregate_features(paths.select(key, tail).join(side, tail, "left"), [key], features, functions)
    values = [c for c in found.columns if c != key]
    return targets.select(key).distinct().join(found, key, "left").fillna(0, subset=values).select(key, *[F.col(c).alias(f"{prefix}{c}") for c in values])


def hopwise_sum(first: DataFrame, second: DataFrame, start: str, middle: str, tail: str, table: DataFrame, id_column: str, feature: str) -> DataFrame:
    """SUM, COUNT and AVG of a tail feature over all two-hop instances, without building them.

    Sums and counts are pushed back hop by hop: a middle node's sum counts once for each way to reach it.
    """
    side = table.select(F.col(id_column).alias(tail), F.coalesce(F.col(feature).cast("double"), F.lit(0.0)).alias("_v")).dropDuplicates([tail])
    per_middle = second.select(middle, tail).join(side, tail, "left").groupBy(middle).agg(F.sum(F.coalesce("_v", F.lit(0.0))).alias("_s"), F.count("*").alias("_n"))
    out = first.select(start, middle).join(per_middle, middle).groupBy(start).agg(F.sum("_s").alias(f"SUM_{feature}"), F.sum("_n").alias("COUNT_All"))
    return out.withColumn(f"AVG_{feature}", F.col(f"SUM_{feature}") / F.col("COUNT_All"))


def label_vote(paths: DataFrame, start: str, position: Position, table: DataFrame, id_column: str, classes: Sequence[str], targets: DataFrame | None = None) -> DataFrame:
    """The class whose one-hot label is largest on average over a start node's instances; 0 for a target without any."""
    means = node_aggregate(paths, [start], position, table, id_column, classes, ["AVG"])
    if targets is not None:
        means = targets.select(start).distinct().join(means, start, "left").fillna(0.0)
    votes = F.array(*[F.round(F.col(f"AVG_{c}"), 9) for c in classes])
    return means.select(start, (F.array_position(votes, F.array_max(votes)) - 1).cast("int").alias("predicted"))

"""Dense node numbers, indexed adjacency, reverse and merged edges."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pathrank.sources.manifest import Manifest, resumed
from pathrank.sources.shared import cut


def dense_index(nodes: DataFrame, type_column: str = "node_type", id_column: str = "node") -> DataFrame:
    """A gapless ``idx`` from 0 on per type, in the order of ids.

    Rows are range-partitioned by (type, id); numbers inside a partition are shifted by the sizes of those
    before it, so that no window holds more than a partition of a type.
    """
    dealt = nodes.select(type_column, id_column).distinct().repartitionByRange(type_column, id_column).withColumn("_part", F.spark_partition_id())
    dealt = cut(dealt)  # a partition's number is used twice
    inside = Window.partitionBy(type_column, "_part").orderBy(id_column)
    ranked = dealt.withColumn("_row", F.row_number().over(inside))
    sizes = ranked.groupBy(type_column, "_part").agg(F.max("_row").alias("_n"))
    before = Window.partitionBy(type_column).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(type_column, "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    return ranked.join(starts, [type_column, "_part"]).select(type_column, id_column, (F.col("_start") + F.col("_row") - 1).cast("long").alias("idx"))


def grown_index(old: DataFrame | None, nodes: DataFrame, type_column: str = "node_type", id_column: str = "node", version: int | None = None) -> DataFrame:
    """(type, id, idx, version): a dictionary that grows. Old numbers stay; new nodes follow their type's largest one, gapless, in the order of ids.

    ``old``: the dictionary so far, or None. The new rows carry the new version's number, the one after ``old``'s largest if
    it is not given, so that they can be appended alone.
    """
    if old is None:
        return dense_index(nodes, type_column, id_column).withColumn("version", F.lit(version or 1))
    new = nodes.select(type_column, id_column).distinct().join(old.select(type_column, id_column), [type_column, id_column], "left_anti")
    ends = old.groupBy(type_column).agg((F.max("idx") + 1).alias("_next"))  # a row for each type
    numbered = dense_index(new, type_column, id_column).join(ends, type_column, "left").withColumn("idx", F.col("idx") + F.coalesce("_next", F.lit(0)))
    if version is None:
        last = old.agg((F.coalesce(F.max("version"), F.lit(0)) + 1).cast("int").alias("version"))
        numbered = numbered.crossJoin(F.broadcast(last))  # one row
    else:
        numbered = numbered.withColumn("version", F.lit(version))
    return old.select(type_column, id_column, "idx", "version").unionByName(numbered.select(type_column, id_column, "idx", "version"))


def kept_index(spark: SparkSession, folder: str, nodes: DataFrame, version: int, type_column: str = "node_type", id_column: str = "node") -> DataFrame:
    """The dictionary of a folder grown by ``nodes`` as ``version``, which is written if it is not there yet; earlier ones must be."""
    def grown(wanted: list) -> DataFrame:
        old = Manifest(spark, folder, "version").read([c for p, c in Manifest(spark, folder, "version").newest().items() if int(p) < version])
        return grown_index(old, nodes, type_column, id_column, version).where(F.col("version") == version)

    if missing := {str(v) for v in range(1, version)} - set(Manifest(spark, folder, "version").newest()):
        raise ValueError(f"versions {sorted(missing)} come first")
    return resumed(spark, folder, "version", list(range(1, version + 1)), grown)


def indexed(paths: DataFrame, types: dict[str, str], index: DataFrame) -> DataFrame:
    """Every node column of ``types`` (column: type) replaced by its number, null where a node is missing."""
    for column, type_ in types.items():
        side = index.where(F.col("node_type") == type_).select(F.col("node").alias(column), F.col("idx").alias(f"{column}_idx"))
        paths = paths.withColumn(column, F.col(column).cast("string")).join(side, column, "left")
    return paths.select(*[f"{c}_idx" for c in types])


def missing_nodes(paths: DataFrame, types: dict[str, str], index: DataFrame) -> DataFrame:
    """(rows, missing) of an indexed table: how many ends have no number."""
    found = indexed(paths, types, index)
    return found.agg(F.count("*").alias("n_rows"), *[F.count_if(F.col(f"{c}_idx").isNull()).alias(f"{c}_missing") for c in types])


def with_reverse(edges: DataFrame, relation: str = "relation") -> DataFrame:
    """Edges (relation, head, tail) and, as ``<relation>_by``, the same with ends swapped."""
    there = F.struct(relation, "head", "tail")
    back = F.struct(F.concat(F.col(relation), F.lit("_by")).alias(relation), F.col("tail").alias("head"), F.col("head").alias("tail"))
    return edges.select(F.inline(F.array(there, back)))  # one pass


def merged_hops(parts: Sequence[DataFrame]) -> DataFrame:
    """Distinct (relation, head, tail) over all hops."""
    return reduce(DataFrame.unionByName, [p.select("relation", "head", "tail") for p in parts]).distinct()


def merged_parallel(tables: Sequence[DataFrame], ends: Sequence[str], parts: int | None = None) -> DataFrame:
    """Edge tables with the same ends as one: features summed, missing ones 0.

    parts: edges are dealt into so many before they are summed, which bounds the memory of a task.
    """
    union = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)
    union = union if parts is None else union.repartition(parts, *ends)
    features = [c for c in union.columns if c not in ends]
    return union.groupBy(*ends).agg(*[F.coalesce(F.sum(f), F.lit(0.0)).alias(f) for f in features])

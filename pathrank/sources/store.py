"""Stored results: resumable partitioned writes, aggregates read back, catalogue tables, feature dictionaries."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathrank.sources.manifest import resumed


def stored(spark: SparkSession, path: str) -> DataFrame | None:
    """A Parquet result, or None if there is none."""
    try:
        return spark.read.parquet(path)
    except AnalysisException:
        return None


def write_missing(spark: SparkSession, path: str, key: str, wanted: Sequence, compute: Callable[[list], DataFrame]) -> DataFrame:
    """The wanted partitions of a stored result, of which those that its manifest does not have are computed and written first."""
    return resumed(spark, path, key, wanted, compute)


def write_elements(elements: dict[str, DataFrame], path: str) -> None:
    """Each position's aggregate under its name."""
    for name, df in elements.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def read_elements(spark: SparkSession, path: str, names: Sequence[str]) -> dict[str, DataFrame] | None:
    """All named aggregates of a path, or None if any is missing."""
    found = {n: stored(spark, f"{path}/{n}") for n in names}
    return None if any(df is None for df in found.values()) else found


def upload(df: DataFrame, table: str, key: str, comments: dict[str, str] | None = None, path: str | None = None) -> None:
    """Writes partitions of a catalogue table (ORC, snappy), made with column comments if it is new."""
    spark = df.sparkSession
    for name, comment in (comments or {}).items():
        df = df.withMetadata(name, {"comment": comment})
    columns = [c for c in df.columns if c != key] + [key]
    df = df.select(*columns)
    if not spark.catalog.tableExists(table):
        writer = df.write.format("orc").option("compression", "snappy").partitionBy(key)
        (writer.option("path", path) if path else writer).saveAsTable(table)
        return
    setting = "spark.sql.sources.partitionOverwriteMode"
    before = spark.conf.get(setting)
    spark.conf.set(setting, "dynamic")
    try:
        df.write.format("orc").mode("overwrite").insertInto(table, overwrite=True)
    finally:
        spark.conf.set(setting, before)


def feature_dictionary(df: DataFrame, position: str) -> DataFrame:
    """(position, feature, type, comment, n_values) of a table's columns: its schema, and how many values each has."""
    rows = [F.struct(F.lit(position).alias("position"), F.lit(f.name).alias("feature"), F.lit(f.dataType.simpleString()).alias("type"), F.lit(f.metadata.get("comment", "")).alias("comment"), F.count(f.name).alias("n_values")) for f in df.schema]
    return df.agg(F.array(*rows).alias("rows")).select(F.inline("rows"))

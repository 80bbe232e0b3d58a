"""Resume by a manifest: which partitions of a stored result are finished, for which state of what they depend on.

A stored result is a folder with ``manifest``, a table to which each run appends a row for every partition that it
computed, and ``data/<run>``, that run's rows, partitioned by the key. The data is written before the manifest's rows, so
a run that is lost leaves files that no row names, and a partition is finished when, and only when, a row says so,
also if it has no rows at all. A row carries the state that the partition was computed for (specification,
targets, version of the source); a partition whose state is another one now is computed again, and its newest row counts.

Partition values are kept as strings, so ``01`` stays ``01``, and data is read with the schema that the manifest holds.
The manifest has a row for each partition and run; it is what the driver reads, never the data.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

_ROWS = "partition string, state string, run string, n_rows long, schema string, at long"


@dataclass(frozen=True)
class Commit:
    """A finished partition: the state it holds for, the run that wrote it and the number of its rows."""

    partition: str
    state: str
    run: str
    n_rows: int
    schema: str
    at: int


class Manifest:
    """The commits of a stored result in a folder of any store that Spark writes to."""

    def __init__(self, spark: SparkSession, folder: str, key: str) -> None:
        self.spark, self.folder, self.key = spark, folder.rstrip("/"), key

    def table(self) -> DataFrame:
        """All commits, also those that later ones replace."""
        try:
            return self.spark.read.schema(_ROWS).parquet(f"{self.folder}/manifest")
        except AnalysisException:
            return self.spark.createDataFrame([], _ROWS)

    def newest(self) -> dict[str, Commit]:
        """The last commit of each partition."""
        order = F.struct("at", "run")
        rows = self.table().groupBy("partition").agg(F.max_by(F.struct("partition", "state", "run", "n_rows", "schema", "at"), order).alias("c")).select("c.*")
        return {r["partition"]: Commit(**r.asDict()) for r in rows.collect()}  # a row for each partition

    def finished(self, states: Mapping[str, str]) -> dict[str, Commit]:
        """Of the wanted partitions (partition: state) those that are there in that state."""
        return {p: c for p, c in self.newest().items() if states.get(p) == c.state}

    def _run(self, run: str) -> str:
        return f"{self.folder}/data/{run}"

    def write(self, rows: DataFrame, states: Mapping[str, str]) -> None:
        """Stores ``rows`` as the partitions of ``states``, then commits all of these, also the empty ones.

        Rows of other partitions are left out.
        """
        run = uuid.uuid4().hex
        wanted = rows.withColumn(self.key, F.col(self.key).cast("string")).where(F.col(self.key).isin(list(states)))
        wanted.write.partitionBy(self.key).parquet(self._run(run))
        try:
            counts = {r[0]: r[1] for r in self._read(run, rows.schema).groupBy(self.key).count().collect()}  # of this run's partitions
        except AnalysisException:  # nothing was written
            counts = {}
        schema, at = json.dumps(rows.schema.jsonValue()), time.time_ns()
        commits = [(p, s, run, counts.get(p, 0), schema, at) for p, s in states.items()]
        self.spark.createDataFrame(commits, _ROWS).coalesce(1).write.mode("append").parquet(f"{self.folder}/manifest")

    def _read(self, run: str, schema: StructType) -> DataFrame:
        plain = StructType([f for f in schema if f.name != self.key] + [StructField(self.key, StringType())])
        return self.spark.read.schema(plain).parquet(self._run(run))

    def read(self, commits: Iterable[Commit]) -> DataFrame | None:
        """The rows of these commits, in the columns and types that they were written with; None if there is no commit."""
        commits = list(commits)
        if not commits:
            return None
        schema = StructType.fromJson(json.loads(max(commits, key=lambda c: c.at).schema))
        runs: dict[str, list[str]] = {}
        for c in commits:
            if c.n_rows:
                runs.setdefault(c.run, []).append(c.partition)
        parts = [self._read(run, schema).where(F.col(self.key).isin(values)) for run, values in runs.items()]
        found = reduce(DataFrame.unionByName, parts) if parts else self.spark.createDataFrame([], schema)
        return found.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema])

    def sweep(self) -> list[str]:
        """Deletes the data of runs that no newest commit names: lost runs and replaced partitions. No run may be at work."""
        store = self.spark._jvm.org.apache.hadoop.fs
        data = store.Path(f"{self.folder}/data")
        files = data.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not files.exists(data):
            return []
        named = {c.run for c in self.newest().values()}
        gone = [s.getPath() for s in files.listStatus(data) if s.getPath().getName() not in named]
        for path in gone:
            files.delete(path, True)
        return sorted(p.getName() for p in gone)


def resumed(spark: SparkSession, folder: str, key: str, wanted: Sequence, compute: Callable[[list], DataFrame], state: str = "", versions: Mapping[str, str] | None = None) -> DataFrame:
    """The wanted partitions of a stored result; ``compute`` is asked for those that are not finished in this state.

    ``state``: what the whole result depends on; ``versions``: what each partition depends on besides (partition: version).
    """
    manifest = Manifest(spark, folder, key)
    asked = {str(v): v for v in wanted}
    states = {p: f"{state}|{(versions or {}).get(p, '')}" for p in asked}
    done = manifest.finished(states)
    if missing := {p: s for p, s in states.items() if p not in done}:
        manifest.write(compute([asked[p] for p in missing]), missing)
        done = manifest.finished(states)
    if not asked:
        raise ValueError("no partition is wanted")
    return manifest.read(done.values())


def content_versions(tables: Iterable[tuple[DataFrame, Sequence[str]]], key: str, partitions: Sequence) -> dict[str, str]:
    """A version of each partition by content: rows and a sum of hashes of the given columns of each table.

    One pass over each table, of those columns and partitions only, with a row for each partition as its outcome. A table
    without the key counts for every partition. Use ``file_versions``, or a store's own snapshot numbers, where a pass is too much.
    """
    found: dict[str, list[str]] = {str(p): [] for p in partitions}
    for table, columns in tables:
        sums = [F.count("*").alias("n"), F.sum(F.xxhash64(*columns).cast("decimal(20,0)")).alias("h")]
        if key in table.columns:
            rows = {str(r[0]): f"{r['n']}:{r['h']}" for r in table.where(F.col(key).isin(list(partitions))).groupBy(key).agg(*sums).collect()}
        else:
            one = table.agg(*sums).first()
            rows = dict.fromkeys(found, f"{one['n']}:{one['h']}")
        for p, versions in found.items():
            versions.append(rows.get(p, "0"))
    return {p: ",".join(v) for p, v in found.items()}


def file_versions(spark: SparkSession, path: str, key: str, partitions: Sequence) -> dict[str, str]:
    """A version of each partition of a Parquet table by its files: how many, how large and when last changed; no row is read."""
    files = spark.read.parquet(path).where(F.col(key).isin(list(partitions))).select(F.col(key).cast("string").alias("p"), "_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").distinct()
    rows = files.groupBy("p").agg(F.count("*").alias("n"), F.sum("file_size").alias("size"), F.max("file_modification_time").cast("string").alias("at"))
    found = {r["p"]: f"{r['n']}:{r['size']}:{r['at']}" for r in rows.collect()}
    return {str(p): found.get(str(p), "0") for p in partitions}

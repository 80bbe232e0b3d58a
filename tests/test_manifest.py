"""Resume by a manifest: padded, empty and changed partitions, other targets, lost runs."""

import pytest
from pyspark.sql import functions as F

from pathrank.operators import aggregate, path
from pathrank.plans.spec import Edge, Hop, PathSpec, Position, Relation
from pathrank.sources import manifest, store
from pathrank.sources.catalog import EdgeTable, GraphCatalog

pytestmark = pytest.mark.usefixtures("plain_plans")

A, B = Position("A", 1), Position("B", 2)
SPEC = PathSpec("p", (Hop((A,), (B,), (Relation(Edge("ab", 1, ((A, "a"),), ((B, "b"),), features=("w",))),)),))
ROWS = [(1, 10, 1.0, "01"), (2, 20, 2.0, "01"), (3, 30, 3.0, "02")]


@pytest.fixture
def searched(monkeypatch):
    asked, plain = [], path.find_paths
    monkeypatch.setattr(path, "find_paths", lambda *x, **more: asked.append(list(more["partitions"])) or plain(*x, **more))
    return asked


def graph(spark, rows=ROWS, key="string"):
    return GraphCatalog({}, {"ab": EdgeTable(spark.createDataFrame(rows, f"a long, b long, w double, month {key}"), {"a": "A", "b": "B"}, ("w",))}, "month")


def found(df):
    return sorted(tuple(r) for r in df.select("month", "A_1", "B_2", "Edge_1_w").collect())


def test_padded_partitions_come_back(spark, tmp_path, searched):
    for _ in range(2):
        rows = path.stored_paths(graph(spark), SPEC, str(tmp_path), ["01", "02"], spark)
        assert found(rows) == [("01", 1, 10, 1.0), ("01", 2, 20, 2.0), ("02", 3, 30, 3.0)]
    assert searched == [["01", "02"]]


def test_empty_partitions_are_finished(spark, tmp_path, searched):
    assert found(path.stored_paths(graph(spark), SPEC, str(tmp_path), ["03"], spark)) == []
    assert found(path.stored_paths(graph(spark), SPEC, str(tmp_path), ["03", "04"], spark)) == []
    assert len(found(path.stored_paths(graph(spark), SPEC, str(tmp_path), ["01", "03"], spark))) == 2
    assert searched == [["03"], ["04"], ["01"]]


def test_other_targets_and_changed_sources_are_searched_again(spark, tmp_path, searched):
    one = spark.createDataFrame([(1,)], "A_1 long")
    assert len(found(path.stored_paths(graph(spark), SPEC, str(tmp_path), ["01", "02"], spark))) == 3
    assert found(path.stored_paths(graph(spark), SPEC, str(tmp_path), ["01"], spark, one)) == [("01", 1, 10, 1.0)]
    assert found(path.stored_paths(graph(spark), SPEC, str(tmp_path), ["01"], spark, one.union(one))) == [("01", 1, 10, 1.0)]  # the same targets
    changed = graph(spark, [*ROWS[:2], (3, 30, 4.0, "02")])
    assert found(path.stored_paths(changed, SPEC, str(tmp_path), ["02"], spark)) == [("02", 3, 30, 4.0)]
    assert searched == [["01", "02"], ["01"], ["02"]]
    # a version that the user names is taken instead of the content
    path.stored_paths(changed, SPEC, str(tmp_path), ["02"], spark, versions={"02": "snapshot 7"})
    path.stored_paths(graph(spark), SPEC, str(tmp_path), ["02"], spark, versions={"02": "snapshot 7"})
    assert searched[3:] == [["02"]]


def test_keys_keep_their_type(spark, tmp_path):
    rows = path.stored_paths(graph(spark, [(1, 10, 1.0, 1), (2, 20, 1.0, 12)], "int"), SPEC, str(tmp_path), [1, 12], spark)
    assert rows.schema["month"].dataType.simpleString() == "int" and [r[0] for r in found(rows)] == [1, 12]


def test_lost_runs_do_not_count_and_are_swept(spark, tmp_path, monkeypatch):
    df, folder = spark.createDataFrame([(1, "a"), (2, "b")], "x long, p string"), str(tmp_path / "t")
    compute = lambda wanted: df.where(F.col("p").isin(wanted))
    kept = manifest.Manifest(spark, folder, "p")
    with monkeypatch.context() as m:  # the data is there, but the driver is lost before the commit
        m.setattr(manifest.Manifest, "_read", lambda *x: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            kept.write(compute(["a"]), {"a": "|"})
    assert kept.newest() == {} and kept.read([]) is None
    assert [tuple(r) for r in store.write_missing(spark, folder, "p", ["a"], compute).collect()] == [(1, "a")]
    assert len(kept.sweep()) == 1 and kept.sweep() == []
    assert store.write_missing(spark, folder, "p", ["a", "b"], compute).count() == 2
    with pytest.raises(ValueError):
        store.write_missing(spark, folder, "p", [], compute)


def test_file_versions_follow_the_files(spark, tmp_path):
    folder = str(tmp_path / "source")
    df = spark.createDataFrame([(1, "a"), (2, "b")], "x long, p string")
    df.write.partitionBy("p").parquet(folder)
    before = manifest.file_versions(spark, folder, "p", ["a", "b", "c"])
    assert before["c"] == "0" and before == manifest.file_versions(spark, folder, "p", ["a", "b", "c"])
    df.where("p = 'b'").write.partitionBy("p").mode("append").parquet(folder)
    spark.catalog.refreshByPath(folder)
    after = manifest.file_versions(spark, folder, "p", ["a", "b"])
    assert after["a"] == before["a"] and after["b"] != before["b"]


def test_aggregates_are_stored_by_partition(spark, tmp_path, searched):
    weights = spark.createDataFrame([(10, 5.0), (20, 7.0), (30, 9.0)], "b long, x double")
    for months, n in ((["01"], 2), (["01", "02", "03"], 3)):
        kept = aggregate.stored_elements(graph(spark), SPEC, str(tmp_path), months, spark, {"B": (weights, "b", ["x"])}, ["AVG", "COUNT"])
        assert sorted(kept) == ["Edge___ab___1", "Node___B___2"]
        rows = sorted(tuple(r) for r in kept["Node___B___2"].select("month", "A_1", "AVG_x", "COUNT_All").collect())
        assert len(rows) == n and rows[0] == ("01", 1, 5.0, 1)
    assert searched == [["01"], ["02", "03"]]


def test_a_cluster_needs_a_shared_folder():
    from pathrank.sources.shared import shared_folder

    class Context:
        def __init__(self, master):
            self.master, self.folder = master, None

        def getCheckpointDir(self):  # noqa: N802
            return self.folder

        def setCheckpointDir(self, folder):  # noqa: N802
            self.folder = folder

    class Session:
        def __init__(self, master):
            self.sparkContext = Context(master)
            self.conf = {}

    for master in ("local", "local[4]"):
        assert shared_folder(Session(master))
    for master in ("local-cluster[3,2,1024]", "spark://host:7077"):
        with pytest.raises(ValueError, match="checkpoint"):
            shared_folder(Session(master))

"""Caps whose hashes are made after the shuffle, features looked up for edges instead of instances, months read once."""

import hashlib

import pytest
from pyspark.sql import functions as F

from pathrank.fixtures import Tables
from pathrank.operators import aggregate, path, sampling
from pathrank.plans.spec import Edge, Hop, NodeAttributes, PathSpec, Position, Relation
from pathrank.sources.catalog import EdgeTable, GraphCatalog, NodeTable

pytestmark = pytest.mark.usefixtures("plain_plans")


def md5(*keys):
    return hashlib.md5("|".join(map(str, (42, *keys))).encode()).hexdigest()


@pytest.mark.parametrize("kind", ["top", "random"])
def test_hashes_of_caps_are_not_shuffled(spark, kind):
    held = [(k % 7, k, float(k % 3)) for k in range(300)]
    df = spark.createDataFrame(held, "g long, k long, w double")
    found = sampling.top_n(df, ["g"], ["w"], ["k"], 20) if kind == "top" else sampling.random_n(df, ["g"], ["k"], 20)
    order = (lambda r: (-r[2], md5(r[0], r[1]), r[1])) if kind == "top" else (lambda r: (md5(r[0], r[1]), r[1]))
    want = [r for g in range(7) for r in sorted((r for r in held if r[0] == g), key=order)[:20]]
    assert sorted(map(tuple, found.collect())) == sorted(want)
    plan = found._jdf.queryExecution().executedPlan()
    text = plan.toString().split("Exchange")
    assert len(text) == 2 and ("substring(md5" in text[1] or "md5" not in text[1])  # below the shuffle at most a short prefix


def test_features_are_looked_up_for_edges(spark):
    """A left path with ends that no table has, null features, and starts without continuation."""
    a, b, c = Position("A", 1), Position("B", 2), Position("C", 3)
    ab = spark.createDataFrame([(x, y) for x in range(6) for y in range(5) if (x * y) % 3 != 1], "a long, b long")
    bc = spark.createDataFrame([(y, z, float(y + z)) for y in range(4) for z in range(5) if (y + z) % 2], "b long, c long, w double")
    nodes = spark.createDataFrame([(0, 2.0), (1, None), (2, -4.0)], "c long, v double")
    graph = GraphCatalog({"C": {"T": NodeTable(nodes, "c", ("v",))}}, {"ab": EdgeTable(ab, {"a": "A", "b": "B"}), "bc": EdgeTable(bc, {"b": "B", "c": "C"}, ("w",))})
    for limit in (None, "C_3 <> A_1"):
        spec = PathSpec("abc", (Hop((a,), (b,), (Relation(Edge("ab", 1, ((a, "a"),), ((b, "b"),))),)), Hop((b,), (c,), (Relation(Edge("bc", 2, ((b, "b"),), ((c, "c"),), features=("w",))),), (NodeAttributes("T", c, "c", ("v",)),), limit)))
        paths, functions, rows = path.find_paths(graph, spec), ["AVG", "SUM", "MIN", "MAX", "COUNT"], lambda df: sorted(tuple(r[k] for k in sorted(df.columns)) for r in df.collect())
        want = aggregate.aggregate_path(paths, spec, {"C": (nodes, "c", ["v"])}, functions)
        found = aggregate.aggregate_search(graph, spec, {"C": (nodes, "c", ["v"])}, functions)
        assert list(found) == list(want)
        for name, df in found.items():
            assert sorted(df.columns) == sorted(want[name].columns) and rows(df) == rows(want[name])
        one = aggregate.searched_node_aggregate(graph, spec, c, nodes, "c", ["v"], functions)
        assert rows(one) == rows(want["Node___C___3"])
    with pytest.raises(ValueError):
        path.find_paths(graph, spec, brought={"D_4": nodes})


def test_edges_of_wanted_months_are_read_once(spark, sf_dir):
    t = Tables(spark, sf_dir)
    kept = t.monthly_graph(["1996-03", "1996-04"]).edges["bought"].data
    assert "Join" not in kept._jdf.queryExecution().optimizedPlan().toString()
    months = F.col("month").isin(["1996-03", "1996-04"])
    assert sorted(kept.collect()) == sorted(t.bought_monthly().where(months).collect())

"""Shared sub-plans, hubs, batches at once, mergeable statistics, a growing index."""

import random

import pytest
from pyspark.sql import functions as F

from pathrank.operators import features, hubs, index, khop, path, profile, statistics
from pathrank.plans import shared
from pathrank.plans.spec import Edge, Hop, Nested, NodeAttributes, PathSpec, Position, Relation
from pathrank.sources.catalog import EdgeTable, GraphCatalog, NodeTable

pytestmark = pytest.mark.usefixtures("plain_plans")


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*(columns or df.columns)).collect()), key=repr)


def nested(first, k, name, limit=None):
    """A (k) -> B (k + 1) -> A (k + 2) as a nested path whose edges are numbered from ``first`` on."""
    a, b, c = Position("A", k), Position("B", k + 1), Position("A", k + 2)
    return PathSpec(name, (
        Hop((a,), (b,), (Relation(Edge("ab", first, ((a, "a"),), ((b, "b"),), features=("w",))),), (NodeAttributes("T", b, "b", ("x",)),), f"Edge_{first}_w > 0 and B_{k + 1}_x <> 'A_3'"),
        Hop((b,), (c,), (Relation(Edge("ba", first + 1, ((b, "b"),), ((c, "a"),))),), limit=limit and limit.format(k, k + 2)),
    ), "inner")


@pytest.fixture(scope="module")
def graph(spark):
    rng = random.Random(2)
    edge = lambda: list({(rng.randrange(6), rng.randrange(6)): 0 for _ in range(20)})
    ab = spark.createDataFrame([(a, b, float((a + b) % 3)) for a, b in edge()], "a long, b long, w double")
    ba = spark.createDataFrame(edge(), "b long, a long")
    x = spark.createDataFrame([(k, "A_3" if k % 2 else "A_1") for k in range(6)], "b long, x string")
    return GraphCatalog({"B": {"T": NodeTable(x, "b", ("x",))}}, {"ab": EdgeTable(ab, {"a": "A", "b": "B"}, ("w",)), "ba": EdgeTable(ba, {"b": "B", "a": "A"})})


def test_canonical_forms_differ_only_in_names(spark):
    a, b = nested(1, 1, "n", "A_{1} <> A_{0}"), nested(41, 7, "m", "A_{1} <> A_{0}")
    assert shared.canonical(a).spec == shared.canonical(b).spec and hash(shared.canonical(a).spec) == hash(shared.canonical(b).spec)
    assert shared.canonical(a).spec != shared.canonical(nested(1, 1, "n", "A_{1} = A_{0}")).spec
    assert dict(shared.canonical(b).columns) == {"A_7": "A_1", "B_8": "B_2", "A_9": "A_3", "Edge_41_w": "Edge_1_w"}
    assert shared.canonical(nested(1, 3, "n")).spec.hops[0].limit == "Edge_1_w > 0 and B_2_x <> 'A_3'"  # a literal is no column


def test_common_nested_paths_are_searched_once(spark, graph, monkeypatch):
    limit = "A_{1} <> A_{0}"
    one = PathSpec("one", (Hop((Position("A", 1),), (Position("A", 3),), (Relation(Nested(nested(1, 1, "n", limit))),)),))
    a, c, d = Position("A", 7), Position("A", 9), Position("B", 4)
    two = PathSpec("two", (Hop((a,), (c,), (Relation(Nested(nested(41, 7, "m", limit))),)), Hop((c,), (d,), (Relation(Edge("ab", 5, ((c, "a"),), ((d, "b"),))),))))
    assert list(shared.shared([one, two]).values()) == [2]
    want = {s.name: rows(path.find_paths(graph, s)) for s in (one, two)}
    asked, plain = [], path.find_paths
    monkeypatch.setattr(path, "find_paths", lambda g, spec, *x, **more: asked.append(spec.name) or plain(g, spec, *x, **more))
    found = path.find_all(graph, [one, two])
    assert {n: rows(df) for n, df in found.items()} == want and want["two"]
    assert sorted(asked) == ["", "one", "two"]
    assert found["two"].columns == plain(graph, two).columns
    starts = spark.createDataFrame([(1,), (2,)], "A_1 long")
    again = path.find_all(graph, [one, PathSpec("three", one.hops)], starts)
    assert rows(again["three"]) == rows(again["one"]) == rows(plain(graph, one, starts))


def test_hubs_are_spread(spark):
    """A node with 30 % of all edges: no task has over five times the median's rows."""
    n = 20_000
    edges = spark.range(n).select(F.when(F.col("id") % 10 < 3, F.lit(0)).otherwise(F.col("id") % 4001).cast("long").alias("b"), F.col("id").alias("a"))
    left = spark.createDataFrame([(k, k % 4001) for k in range(300)] + [(1000, 0), (1001, None), (1002, 9999)], "s long, b long")
    for how in ("inner", "left"):
        assert rows(hubs.hub_join(left, edges, ["b"], how, 16), "s", "b", "a") == rows(left.join(edges, "b", how), "s", "b", "a")
    settings = {"spark.sql.shuffle.partitions": "16", "spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        largest = {}
        for name, joined in (("plain", left.join(edges, "b")), ("spread", hubs.hub_join(left, edges, ["b"], "inner", 16))):
            sizes = sorted([r[1] for r in joined.groupBy(F.spark_partition_id().alias("p")).count().collect()] if name == "plain" else [r[1] for r in joined.select("a").withColumn("p", F.spark_partition_id()).groupBy("p").count().collect()])
            largest[name] = sizes[-1] / sizes[len(sizes) // 2]
        assert largest["plain"] > 5 >= largest["spread"]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert hubs.hubs(edges, ["b"], 16).count() == 1
    with pytest.raises(ValueError):
        hubs.hub_join(left, edges, ["b"], "full")


def test_paths_over_hubs_are_the_same(spark, graph):
    spec = PathSpec("p", (Hop((Position("A", 1),), (Position("B", 2),), (Relation(Edge("ab", 1, ((Position("A", 1), "a"),), ((Position("B", 2), "b"),))),)), Hop((Position("B", 2),), (Position("A", 3),), (Relation(Edge("ba", 2, ((Position("B", 2), "b"),), ((Position("A", 3), "a"),))),))))
    assert rows(path.find_paths(graph, spec, spread_hubs=True)) == rows(path.find_paths(graph, spec))


def test_an_epoch_of_batches_is_its_batches(spark):
    rng = random.Random(9)
    edges = spark.createDataFrame([(rng.randrange(60), rng.randrange(60)) for _ in range(500)], "head long, tail long")
    batches = spark.createDataFrame([(k % 12, rng.randrange(60)) for k in range(60)], "batch int, node long")
    for caps in ((), (3, 2)):
        found = khop.induced_batches(edges, batches, 2, caps).collect()
        assert {r["batch"] for r in found} == set(range(12))
        for b in (0, 5, 11):
            alone = khop.induced_batches(edges, batches.where(f"batch = {b}"), 2, caps)
            assert sorted(tuple(r) for r in found if r["batch"] == b) == sorted(tuple(r) for r in alone.collect())
            if not caps:
                assert rows(khop.induced(edges, batches.where(f"batch = {b}").select("node"), 2)) == rows(alone.drop("batch"))
            local = sorted({r[k] for r in found if r["batch"] == b for k in ("head_local", "tail_local")})
            assert local == list(range(len(local)))


@pytest.fixture(scope="module")
def monthly(spark):
    rng = random.Random(1)
    data = [(f"m{k % 4}", None if k % 11 == 0 else 1e6 + rng.random(), float(rng.randrange(1000))) for k in range(4000)] + [("empty", None, None)]
    return spark.createDataFrame(data, "month string, x double, y double").persist()


def close(a, b):
    assert len(a) == len(b) and a
    for r, q in zip(a, b, strict=True):
        assert r == tuple(pytest.approx(v, rel=1e-9) if isinstance(v, float) else v for v in q)


def test_statistics_merge(spark, monthly):
    kept = statistics.partition_statistics(monthly, ["x", "y"], "month")
    close(rows(statistics.summary(kept, ["month"])), rows(profile.column_summary(monthly.where("month <> 'empty'"), ["x", "y"], ["month"])))
    close(rows(statistics.summary(kept)), rows(profile.column_summary(monthly, ["x", "y"])))
    ordered = sorted(r[0] for r in monthly.where("y is not null").select("y").collect())
    shares = [0.1, 0.5, 0.9]
    found = statistics.sketched_quantiles(kept, shares).where("column_name = 'y'").first()["e"]
    for share, value in zip(shares, found, strict=True):
        low, high = (sum(f(v, value) for v in ordered) / len(ordered) for f in (lambda v, x: v < x, lambda v, x: v <= x))
        assert low - 0.03 <= share <= high + 0.03


def test_rows_are_scaled_by_kept_statistics(spark, monthly):
    table = monthly.where("month <> 'empty'").withColumn("node", F.monotonically_increasing_id())
    kept = statistics.partition_statistics(table, ["x", "y"], "month")
    some = table.where("node % 50 = 3")
    for how in ("norm", "std"):
        got = rows(statistics.scale_by_statistics(some, kept, "node", "month", ["x", "y"], how))
        close(got, rows(features.scale_by_partition(some, table, "node", "month", ["x", "y"], how)))


def test_only_new_and_changed_months_are_read(spark, monthly, tmp_path, monkeypatch):
    asked, plain = [], statistics.partition_statistics
    monkeypatch.setattr(statistics, "partition_statistics", lambda df, *x: asked.append(sorted(r[0] for r in df.select("month").distinct().collect())) or plain(df, *x))
    read = lambda df, months: statistics.kept_statistics(spark, str(tmp_path), df, ["x", "y"], "month", months)
    read(monthly, ["m0", "m1"])
    changed = monthly.where("not (month = 'm1' and y > 990)")
    whole = read(changed, ["m0", "m1", "m2"])
    assert asked == [["m0", "m1"], ["m1", "m2"]]
    close(rows(statistics.summary(whole)), rows(profile.column_summary(changed.where("month in ('m0', 'm1', 'm2')"), ["x", "y"])))


def test_an_index_grows(spark, tmp_path):
    nodes = lambda *x: spark.createDataFrame(list(x), "node_type string, node string")
    first = index.grown_index(None, nodes(("A", "b"), ("A", "d"), ("B", "x"), ("A", "b")))
    second = index.grown_index(first, nodes(("A", "a"), ("A", "d"), ("C", "z"), ("A", "c")))
    assert rows(second) == [("A", "a", 2, 2), ("A", "b", 0, 1), ("A", "c", 3, 2), ("A", "d", 1, 1), ("B", "x", 0, 1), ("C", "z", 0, 2)]
    assert rows(index.grown_index(second, nodes(("A", "a")))) == rows(second)
    with pytest.raises(ValueError, match="come first"):
        index.kept_index(spark, str(tmp_path), nodes(("A", "a")), 2)
    index.kept_index(spark, str(tmp_path), nodes(("A", "b"), ("A", "d"), ("B", "x")), 1)
    for _ in range(2):
        kept = index.kept_index(spark, str(tmp_path), nodes(("A", "a"), ("C", "z"), ("A", "c")), 2)
        assert rows(kept, "node_type", "node", "idx", "version") == rows(second)
    # a first load without nodes is a version too
    index.kept_index(spark, str(tmp_path / "empty"), nodes(("A", "b")).where("false"), 1)
    assert rows(index.kept_index(spark, str(tmp_path / "empty"), nodes(("A", "b")), 2)) == [("A", "b", 0, 2)]


def test_splits_are_evaluated_together(spark):
    from pathrank.operators import evaluate

    rng = random.Random(6)
    data = [(k, rng.choice("xyz"), float(rng.randrange(30)), int(rng.random() < 0.3)) for k in range(900)] + [(1000, "one", 1.0, 1), (1001, "one", 0.0, 1)]
    df = spark.createDataFrame(data, "node long, split string, s double, y int")
    together = {r["split"]: r for r in evaluate.split_aucs(df, "s", "y", ["split"]).collect()}
    hits = {(r["split"], r["cut"]): (r["k"], r["hits"], r["rate"]) for r in evaluate.hit_rates(df, "s", "y", "node", [7], [10], ["split"]).collect()}
    assert set(together) == {"x", "y", "z", "one"} and together["one"]["roc_auc"] is None
    for split in ("x", "one"):
        own = df.where(F.col("split") == split)
        assert together[split]["roc_auc"] == pytest.approx(evaluate.roc_auc(own, "s", "y").first()[0])
        assert together[split]["pr_auc"] == pytest.approx(evaluate.pr_auc(own, "s", "y").first()[0])
        assert {(split, r["cut"]): (r["k"], r["hits"], r["rate"]) for r in evaluate.hit_rates(own, "s", "y", "node", [7], [10]).collect()} == {k: v for k, v in hits.items() if k[0] == split}


def test_plans_are_cut_between_hops(spark, graph):
    a, b, c, d = (Position(t, k) for k, t in enumerate("ABAB", 1))
    hops = tuple(Hop((p,), (q,), (Relation(Edge(t, k, ((p, x),), ((q, y),))),)) for k, (p, q, t, x, y) in enumerate(((a, b, "ab", "a", "b"), (b, c, "ba", "b", "a"), (c, d, "ab", "a", "b")), 1))
    spec = PathSpec("long", hops)
    plain, whole = path.find_paths(graph, spec), path.find_paths(graph, spec, materialize=1)
    joins = lambda df: df._jdf.queryExecution().analyzed().toString().count("Join ")
    assert joins(plain) == 2 and joins(whole) == 1 and rows(plain) == rows(whole)


@pytest.mark.parametrize("cell", [100_000, 3])
def test_negatives_are_capped_whatever_the_cells(spark, monkeypatch, cell):
    from pathrank.operators import sampling

    monkeypatch.setattr(sampling, "ROWS_A_CELL", cell)
    df = spark.createDataFrame([(k, int(k % 10 == 0)) for k in range(500)], "k long, y int")
    kept = rows(sampling.negatives_capped(df, "y", 120, ["k"]))
    order = [r[0] for r in df.where("y = 0").orderBy(sampling.order_key(["k"]), "k").limit(70).collect()]
    assert kept == sorted([(k, 1) for k in range(0, 500, 10)] + [(k, 0) for k in order], key=repr)
    assert sampling.negatives_capped(df, "y", 30, ["k"]).count() == 50 and sampling.negatives_capped(df, "y", 900, ["k"]).count() == 500

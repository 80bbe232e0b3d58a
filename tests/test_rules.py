"""Rules that the driver's tables cannot reach, on tiny graphs, and the plans that Spark makes."""

import pytest
from pyspark.sql import functions as F

from pathrank.fixtures import Tables
from pathrank.functions import names, vectors
from pathrank.operators import aggregate, evaluate, khop, metapath, pairs, path, sampling
from pathrank.plans.spec import Edge, Hop, Nested, PathSpec, Position, Relation, Sample, chain, step
from pathrank.queries import FLAGSHIP, LOCAL_SUPPLIERS, flagship_paths
from pathrank.sources import scan, store
from pathrank.sources.catalog import EdgeTable, GraphCatalog, NodeTable

A, B, C = Position("A", 1), Position("B", 2), Position("A", 3)


def graph(spark, ab, ba=None, features=("w",)):
    edges = {"ab": EdgeTable(spark.createDataFrame(ab, "a long, b long, w double"), {"a": "A", "b": "B"}, features)}
    edges["ba"] = EdgeTable(spark.createDataFrame(ba or [], "b long, a long, w double"), {"b": "B", "a": "A"}, features)
    return GraphCatalog({}, edges)


def hop(edge, heads, tails, **more):
    return Hop(heads, tails, (Relation(edge),), **more)


AB = Edge("ab", 1, ((A, "a"),), ((B, "b"),), features=("w",))
BA = Edge("ba", 2, ((B, "b"),), ((C, "a"),))


def test_left_hops_keep_starts_and_inner_ones_do_not(spark):
    g = graph(spark, [(1, 10, 1.0), (2, 20, 1.0)], [(10, 7, 1.0)])
    for how, want in (("left", {(1, 7), (2, None)}), ("inner", {(1, 7)})):
        spec = PathSpec("p", (hop(AB, (A,), (B,)), hop(BA, (B,), (C,))), how)
        assert {(r.A_1, r.A_3) for r in path.find_paths(g, spec).collect()} == want


def test_null_ends_and_features_drop_edges(spark):
    g = graph(spark, [(1, None, 1.0), (None, 10, 1.0), (1, 10, None), (2, 20, 2.0)])
    assert [tuple(r) for r in path.find_paths(g, PathSpec("p", (hop(AB, (A,), (B,)),))).collect()] == [(2, 20, 2.0)]


def test_duplicate_edges_leave_the_smallest(spark):
    g = graph(spark, [(1, 10, 3.0), (1, 10, 2.0)])
    assert [r.Edge_1_w for r in scan.edge_scan(g, AB).collect()] == [2.0]
    assert [r.Edge_1_w for r in scan.edge_scan(g, AB, dedup="sum").collect()] == [5.0]


def test_missing_features_count_as_zero_or_not_at_all(spark):
    df = spark.createDataFrame([(1, 4.0), (1, None)], "a long, x double")
    zero = aggregate.aggregate_features(df, ["a"], ["x"], ["AVG", "MIN", "COUNT"]).first()
    assert (zero.AVG_x, zero.MIN_x, zero.COUNT_All) == (2.0, 0.0, 2)
    assert aggregate.aggregate_features(df, ["a"], ["x"], ["AVG", "COUNT"], "ignore").first().AVG_x == 4.0
    with pytest.raises(ValueError):
        aggregate.aggregate_features(df, ["a"], ["x"], ["AVG"], "none")


def test_self_avoidance(spark):
    r = khop.Relation("ab", spark.createDataFrame([(1, 10), (2, 10), (3, 30)], "a long, b long"), ("a", "A"), ("b", "B"))
    p = khop.PathType((("ab", "Head"), ("ab", "Tail")), ("A", "B", "A"))
    assert {tuple(x) for x in khop.instances([r], p).collect()} == {(1, 10, 2), (2, 10, 1)}


def test_path_types_are_guarded_and_caps_of_zero_forbid(spark):
    df = spark.createDataFrame([(1, 2)], "a long, b long")
    r = khop.Relation("ab", df, ("a", "A"), ("b", "B"), backward=(0,))
    assert [p.name for p in khop.path_types([r], "A", "B", 3)] == ["ab_Aim_Head"]
    with pytest.raises(ValueError):
        khop.path_types([khop.Relation(str(k), df, ("a", "A"), ("b", "A")) for k in range(20)], "A", "A", 3, most=1000)


def test_null_tails_give_no_negative_samples(spark):
    found = spark.createDataFrame([("p", 1, 5), ("p", 2, None)], "path string, start long, end long")
    main = spark.createDataFrame([("p",)], "path string")
    known = spark.createDataFrame([(1, 5)], "start long, end long")
    assert [tuple(r) for r in pairs.pair_samples(found, known, ["start", "end"], main).collect()] == [(1, 5, 1)]


def test_vote_of_absent_starts_and_ties_is_the_lowest_class(spark):
    labels = spark.createDataFrame([(7, 1.0, 0.0), (8, 0.0, 1.0)], "a long, x double, y double")
    found = spark.createDataFrame([(1, 7), (1, 8), (2, 8)], "A_1 long, A_3 long")
    targets = spark.createDataFrame([(1,), (2,), (3,)], "A_1 long")
    votes = aggregate.label_vote(found, "A_1", C, labels, "a", ["x", "y"], targets)
    assert {tuple(r) for r in votes.collect()} == {(1, 0), (2, 1), (3, 0)}


def test_specifications_are_checked():
    with pytest.raises(ValueError, match="unique"):
        PathSpec("p", (hop(AB, (A,), (B,)), hop(Edge("ba", 1, ((B, "b"),), ((C, "a"),)), (B,), (C,)))).validate()
    with pytest.raises(ValueError, match="not on the path"):
        PathSpec("p", (hop(AB, (A,), (B,)), hop(BA, (C,), (B,)))).validate()
    with pytest.raises(ValueError, match="hop"):
        PathSpec.from_json({"path_name": "p", "path_schema": [{"head_node_types": ["A"], "head_node_indexes": [1], "tail_node_types": ["B"], "tail_node_indexes": [2], "relation_list": [{"relation_type": "edge", "edge_schema": {"edge_table_name": "ab", "node_schemas": []}}]}]})
    assert FLAGSHIP.metapath() == "Customer__Part__Customer"
    assert FLAGSHIP.fingerprint("a") != FLAGSHIP.fingerprint("b")


def test_conjunction_lies_within_each_relation(spark, sf_dir):
    g = Tables(spark, sf_dir).graph()
    both = path.find_paths(g, LOCAL_SUPPLIERS).select("Customer_1", "Supplier_3")
    for relation in LOCAL_SUPPLIERS.hops[0].relations:
        if isinstance(relation.what, Nested):
            one = path.find_paths(g, relation.what.path)
        else:
            one = scan.edge_scan(g, relation.what)
        assert both.subtract(one.select("Customer_1", "Supplier_3")).count() == 0


def test_reduction_changes_nothing(spark, sf_dir):
    g = Tables(spark, sf_dir).graph()
    targets = spark.range(1, 20).select(F.col("id").alias("Customer_1"))
    a, b = path.find_paths(g, FLAGSHIP, targets, reduce=True), path.find_paths(g, FLAGSHIP, targets)
    # caps apply per head, which a restriction to heads keeps
    assert a.exceptAll(b).count() == b.exceptAll(a).count() == 0


def test_caps(spark, sf_dir):
    bought = Tables(spark, sf_dir).bought().select("customer", "part", "quantity")
    for kind in ("random", "top", "threshold"):
        some = sampling.capped(bought, ["customer"], ["part"], Sample(kind, 3, ("quantity",)))
        assert some.subtract(bought).count() == 0
        assert some.groupBy("customer").count().agg(F.max("count")).first()[0] <= 3
    with pytest.raises(ValueError):
        sampling.capped(bought, ["customer"], ["part"], Sample("other", 3))


def test_linear_paths_and_meta_paths_agree(spark):
    g = graph(spark, [(1, 10, 1.0), (1, 10, 2.0), (2, 20, 5.0)], [(10, 7, 1.0)])
    meta = metapath.metapath([metapath.Link(g.edges["ab"].data, "a", "b", "w"), metapath.Link(g.edges["ba"].data, "b", "a", "w")], ["A", "B", "C"])
    assert [tuple(r) for r in meta.collect()] == [(1, 10, 7, 3.0, 1.0)]
    line = chain("p", [step("ab", 1, ("A", 1, "a"), ("B", 2, "b")), step("ba", 2, ("B", 2, "b"), ("A", 3, "a"))])
    assert [tuple(r) for r in path.find_paths(g, line).collect()] == [(1, 10, 7)]


def test_areas(spark):
    df = spark.createDataFrame([(0.9, 1), (0.8, 0), (0.8, 1), (0.1, 0)], "s double, y int")
    up, down = evaluate.roc_auc(df, "s", "y").first()[0], evaluate.roc_auc(df.withColumn("s", -F.col("s")), "s", "y").first()[0]
    assert up == pytest.approx(0.875) and up + down == pytest.approx(1.0)
    assert evaluate.roc_auc(df.where("y = 1"), "s", "y").first()[0] is None


def test_partitions_are_resumed(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "x long, p string")
    asked = []

    def compute(wanted):
        asked.append(wanted)
        return df.where(F.col("p").isin(wanted))

    store.write_missing(spark, str(tmp_path / "t"), "p", ["a"], compute)
    assert store.write_missing(spark, str(tmp_path / "t"), "p", ["a", "b"], compute).count() == 2
    assert asked == [["a"], ["b"]]


def test_names_and_vectors(spark):
    with pytest.raises(ValueError):
        names.sanitized(spark.createDataFrame([(1, 2)], ["a b", "a.b"]))
    df = spark.createDataFrame([("[1, -2.5e1]",), ("(3,[1],[-4])",), ("x",), (None,)], "t string")
    assert [r[0] for r in df.select(vectors.parsed("t")).collect()] == [[1.0, -25.0], [0.0, -4.0, 0.0], None, None]
    assert store.stored(spark, "/nowhere/at/all") is None


def test_start_features_do_not_touch_ids(spark):
    nodes = GraphCatalog({"A": {"t": NodeTable(spark.createDataFrame([(1, None)], "a long, x double"), "a", ("x",))}}, {})
    found = spark.createDataFrame([(1,), (None,)], "A_1 long")
    rows = aggregate.start_features(found, A, [(nodes.node("A", "t").data, "a", ["x"])]).collect()
    assert {tuple(r) for r in rows} == {(1, 0.0), (None, 0.0)}


def test_plans(spark, sf_dir):
    t = Tables(spark, sf_dir)
    plan = flagship_paths(t)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "CartesianProduct" not in plan and "Python" not in plan
    scans = t.lineitem.where("l_quantity > 45").select("l_partkey")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(l_quantity), GreaterThan(l_quantity,45.0)]" in scans and "l_tax" not in scans


def test_json_path_with_all_parts_is_the_flagship():
    edge = lambda k, head, tail: {
        "edge_table_name": "bought", "edge_index": k, "feature_columns": ["quantity"], "edge_sample": {"type": "top", "count": 20, "features": ["quantity"]},
        "head_node_types": [head[0]], "head_node_indexes": [head[1]], "head_columns": [head[2]], "tail_node_types": [tail[0]], "tail_node_indexes": [tail[1]], "tail_columns": [tail[2]],
    }
    years = lambda k: [{"node_table_name": "First_Order", "node_type": "Customer", "node_index": k, "node_column": "customer", "feature_columns": ["first_order_year"]}]
    hops = [
        {"head_node_types": ["Customer"], "head_node_indexes": [1], "tail_node_types": ["Part"], "tail_node_indexes": [2], "node_schemas": years(1), "relation_list": [{"relation_type": "edge", "edge_schema": edge(1, ("Customer", 1, "customer"), ("Part", 2, "part"))}]},
        {"head_node_types": ["Part"], "head_node_indexes": [2], "tail_node_types": ["Customer"], "tail_node_indexes": [3], "node_schemas": years(3), "path_limit": FLAGSHIP.hops[1].limit, "relation_list": [{"relation_type": "edge", "edge_schema": edge(2, ("Part", 2, "part"), ("Customer", 3, "customer"))}]},
    ]
    config = {"path_name": FLAGSHIP.name, "path_schema": hops}
    assert PathSpec.from_json(config) == FLAGSHIP
    hops[1]["path_sample"] = {"type": "Random", "count": 3}
    assert PathSpec.from_json(config).hops[1].sample == Sample("random", 3)


def test_stored_paths_search_only_missing_partitions(spark, tmp_path, monkeypatch):
    edges = spark.createDataFrame([(1, 10, 1.0, "a"), (1, 20, 1.0, "b"), (2, 20, 1.0, "b")], "a long, b long, w double, month string")
    g, asked = GraphCatalog({}, {"ab": EdgeTable(edges, {"a": "A", "b": "B"}, ("w",))}, "month"), []
    plain = path.find_paths
    monkeypatch.setattr(path, "find_paths", lambda *x, **more: asked.append(list(more["partitions"])) or plain(*x, **more))
    spec = PathSpec("p", (hop(AB, (A,), (B,)),))
    for wanted, n in ((["a"], 1), (["a", "b"], 3), (["b"], 2)):
        assert path.stored_paths(g, spec, str(tmp_path), wanted, spark).count() == n
    assert asked == [["a"], ["b"]]
    path.stored_paths(g, PathSpec("p", (hop(AB, (A,), (B,)),), "inner"), str(tmp_path), ["a"], spark)
    assert asked[-1] == ["a"] and len(asked) == 3


def test_partitions_join_by_month(spark):
    rows = [(1, 10, 1.0, "a"), (10, 7, 1.0, "b"), (10, 8, 1.0, "a")]
    ab, ba = spark.createDataFrame(rows[:1], "a long, b long, w double, month string"), spark.createDataFrame(rows[1:], "b long, a long, w double, month string")
    g = GraphCatalog({}, {"ab": EdgeTable(ab, {"a": "A", "b": "B"}, ("w",)), "ba": EdgeTable(ba, {"b": "B", "a": "A"}, ("w",))}, "month")
    found = path.find_paths(g, PathSpec("p", (hop(AB, (A,), (B,)), hop(BA, (B,), (C,))), "inner"))
    assert [(r.A_1, r.A_3, r.month) for r in found.collect()] == [(1, 8, "a")]


def test_running_sums_and_quantiles(spark):
    from pathrank.operators.profile import quantiles
    from pathrank.operators.ranges import cumulated, numbered

    values = [((k * 7919) % 1000) / 4 for k in range(1000)]
    df = spark.createDataFrame([(float(v), k) for k, v in enumerate(values)], "v double, k long").repartition(5)
    want, total = {}, 0
    for v, k in sorted((v, k) for k, v in enumerate(values)):
        want[k], total = total, total + k
    assert {r.k: (r.before_k, r.all_k) for r in cumulated(df, [F.asc("v")], ["k"]).collect()} == {k: (n, total) for k, n in want.items()}
    assert sorted(r.i for r in numbered(df, [F.desc("v")], "i").collect()) == list(range(1000))
    few = spark.createDataFrame([(1.0,), (2.0,), (2.0,), (10.0,), (None,)], "v double")
    assert quantiles(few, "v", [0, 0.25, 0.5, 0.9, 1]).first().e == pytest.approx([1, 1.75, 2, 7.6, 10])
    assert quantiles(few.where("false"), "v", [0.5]).first().e == [None]


def test_scores_of_held_out_nodes_rank_better_than_chance(spark):
    rows = spark.createDataFrame([(k, float(k % 10), float((k * 31) % 7), int(k % 10 > 5)) for k in range(400)], "node long, x double, y double, label int")
    scores = evaluate.score_nodes(rows.where("node < 300"), rows.where("node >= 300"), ["x", "y"], "label", "node")
    assert evaluate.roc_auc(scores.join(rows, "node"), "score", "label").first()[0] > 0.95

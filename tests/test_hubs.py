"""Work that follows the edges, where hubs make instances many."""

import pytest
from pyspark.sql import functions as F
from test_semiring import A, B, C, Position, edge, hop, hubs, largest_join, random_graph

from pathrank.operators import path, semiring
from pathrank.plans.spec import Hop, Nested, PathSpec, Relation
from pathrank.sources.catalog import EdgeTable, GraphCatalog

pytestmark = pytest.mark.usefixtures("plain_plans")

M = Position("B", 8)


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*(columns or sorted(df.columns))).collect()), key=repr)


def around(how, limit=None):
    """A -> B 8 -> A 3."""
    return PathSpec("around", (hop(edge("ab", 11, A, M, features=("w",)), A, M), hop(edge("ba", 12, M, C), M, C, limit=limit)), how)


@pytest.mark.parametrize("how", ["inner", "left", "left_anti"])
@pytest.mark.parametrize(("inner", "limit"), [("inner", None), ("left", "Edge_11_w > 1 and A_1 <> A_3")])
def test_nested_paths_between_given_ends_are_those_of_all_ends(spark, how, inner, limit):
    graph, _ = random_graph(spark, 3)
    first = PathSpec("first", (hop(edge("ab", 1, A, Position("B", 5)), A, Position("B", 5)), hop(edge("ba", 2, Position("B", 5), C), Position("B", 5), C)), "inner")
    both = PathSpec("both", (Hop((A,), (C,), (Relation(Nested(first)), Relation(Nested(around(inner, limit)), how))),))
    one, two = path.find_paths(graph, first), path.find_paths(graph, around(inner, limit))
    want = one.join(two.select("A_1", "A_3").distinct() if how == "left_anti" else two, ["A_1", "A_3"], how)
    got = path.find_paths(graph, both)
    assert rows(got) == rows(want) and (how == "left_anti" or got.count() > 20)
    counts = semiring.fold_path(graph, both, [], ["COUNT"])
    assert rows(counts, "A_1", "COUNT_All") == rows(want.groupBy("A_1").count(), "A_1", "count")
    assert rows(semiring.starts(graph, both)) == rows(want.select("A_1").distinct())


def test_a_nested_path_over_hubs_joins_no_more_than_the_given_ends(spark):
    graph, _ = hubs(spark)
    pairs = spark.range(60).select(F.col("id").alias("a"), ((F.col("id") * 7) % 60).alias("c"))
    graph = GraphCatalog({}, graph.edges | {"ac": EdgeTable(pairs, {"a": "A", "c": "A"}, ())})
    from pathrank.plans.spec import Edge

    for how in ("inner", "left", "left_anti"):
        spec = PathSpec("p", (Hop((A,), (C,), (Relation(Edge("ac", 1, ((A, "a"),), ((C, "c"),))), Relation(Nested(around("inner")), how))),))
        assert largest_join(path.find_paths(graph, spec))[0] <= 60 * 3
        assert largest_join(semiring.fold_path(graph, spec, [], ["COUNT"]))[0] <= 60 * 3
    far = PathSpec("far", (Hop((A,), (C,), (Relation(Nested(around("inner"))),)), hop(edge("ab", 3, C, Position("B", 4)), C, Position("B", 4))), "inner")
    counts = semiring.fold_path(graph, far, [], ["COUNT"])
    assert largest_join(counts)[0] <= 60 * 3 and {r["COUNT_All"] for r in counts.collect()} == {3 * 60 * 3}


def test_attributes_are_joined_to_edges(spark):
    """Instances are 60 * 3 * 60; no join of an attribute meets more rows than there are edges."""
    from test_semiring import attribute

    from pathrank.sources.catalog import NodeTable

    graph, _ = hubs(spark)
    y = spark.range(60).select(F.col("id").alias("a"), (F.col("id") % 2).cast("double").alias("y"))
    graph = GraphCatalog({"A": {"T": NodeTable(y, "a", ("y",))}}, graph.edges)
    spec = PathSpec("p", (hop(edge("ab", 1, A, B), A, B, nodes=(attribute(A, "a"),)), hop(edge("ba", 2, B, C), B, C, nodes=(attribute(C, "a"),), limit="A_1_y >= A_3_y and A_1 <> A_3")), "left")
    found = path.find_paths(graph, spec)
    want = sum(3 for a in range(60) for c in range(60) if a % 2 >= c % 2 and a != c)
    assert found.count() == want
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    depth = [len(x) - len(x.lstrip(" :+-")) for x in plan.splitlines() if "Join" in x]
    assert "A_1#" in next(x for x in plan.splitlines() if "Join" in x) and depth.count(min(depth)) == 1 and "B_2" in next(x for x in plan.splitlines() if "Join" in x)


@pytest.mark.parametrize(("seed", "caps"), [(1, (-1,)), (2, (2,))])
def test_counts_of_types_are_those_of_their_instances(spark, seed, caps):
    from test_cover import relations

    from pathrank.operators import khop

    rs = relations(spark, seed, caps)
    some = [p for k, p in enumerate(khop.path_types(rs, "A", "B", 4)) if len(p.steps) < 3 or k % 23 == 0]
    found = khop.all_instances(rs, some).persist()
    want = found.groupBy("path").agg(F.count("*").alias("n"), F.countDistinct("start").alias("n_starts"), F.countDistinct("end").alias("n_ends"))
    assert rows(khop.Walks(rs).totals(some)) == rows(want)
    known = spark.createDataFrame([(a, b) for a in range(7) for b in range(7) if (a + b) % 2], "start long, end long")
    assert rows(khop.all_between(rs, some, known)) == rows(found.join(known, ["start", "end"], "left_semi"))
    found.unpersist()


def test_counts_and_covers_do_not_make_the_instances(spark):
    """A hub with 200 spokes: A -> B -> A -> C has 200 * 199 walks, no join more than 400 rows."""
    from pathrank.operators import khop, meet

    spokes = spark.range(200).select(F.col("id").alias("a"), F.lit(0).cast("long").alias("b"))
    own = spark.range(200).select(F.col("id").alias("a"), F.col("id").alias("c"))
    rs = [khop.Relation("ab", spokes, ("a", "A"), ("b", "B")), khop.Relation("ac", own, ("a", "A"), ("c", "C"))]
    path = khop.PathType((("ab", "Head"), ("ab", "Tail"), ("ac", "Head")), ("A", "B", "A", "C"))
    totals = khop.Walks(rs, materialize=False).totals([path])
    assert largest_join(totals)[0] <= 400 and rows(totals, "n", "n_starts", "n_ends") == [(200 * 199, 200, 200)]
    known = spark.range(200).select(F.col("id").alias("start"), ((F.col("id") * 3) % 200).alias("end"))
    cover = meet.both_ends_cover(rs, [path], known, materialize=False)
    assert largest_join(cover)[0] <= 400
    assert sum(r["cover_count"] for r in cover.collect()) == sum(3 * k % 200 != k for k in range(200))

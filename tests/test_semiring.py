"""Folded paths against aggregates over all instances, on random graphs and on the driver's tables."""

import math
import random

import pytest
from pyspark.sql import functions as F

from pathrank.fixtures import Tables
from pathrank.operators import aggregate, path, semiring
from pathrank.plans.spec import Edge, Hop, Nested, NodeAttributes, PathSpec, Position, Relation, Sample
from pathrank.queries import LOCAL_SUPPLIERS, MONTHLY, MONTHS
from pathrank.sources.catalog import EdgeTable, GraphCatalog, NodeTable

pytestmark = pytest.mark.usefixtures("plain_plans")

A, B, C, D, E = (Position(t, k) for k, t in enumerate("ABABA", 1))
W = Position("W", 7)
ALL = ["AVG", "SUM", "MIN", "MAX", "COUNT"]


def edge(table, index, head, tail, **more):
    columns = {"ab": ("a", "b"), "ba": ("b", "a")}[table]
    return Edge(table, index, ((head, columns[0]),), ((tail, columns[1]),), **more)


def hop(what, head, tail, **more):
    return Hop((head,), (tail,), (Relation(what),), **more)


def random_graph(spark, seed, month=False):
    rng = random.Random(seed)
    value = lambda: rng.choice([None, 0.5, 2.0, -3.0, 7.25])
    ab = {(rng.randrange(8), rng.randrange(8), rng.choice("xy")): float(rng.randrange(5)) for _ in range(30)}
    ba = {(rng.randrange(8), rng.randrange(8), rng.choice("xy")): float(rng.randrange(5)) for _ in range(30)}
    rows = lambda d: [(u, v, w) + ((m,) if month else ()) for (u, v, m), w in d.items()]
    more = ", month string" if month else ""
    edges = {"ab": EdgeTable(spark.createDataFrame(rows(ab), f"a long, b long, w double{more}"), {"a": "A", "b": "B"}, ("w",)), "ba": EdgeTable(spark.createDataFrame(rows(ba), f"b long, a long, w double{more}"), {"b": "B", "a": "A"}, ("w",))}
    a = spark.createDataFrame([(k, value(), float(k % 3)) for k in range(7)], "a long, x double, y double")
    b = spark.createDataFrame([(k, value(), float(k % 2)) for k in range(7)], "b long, x double, y double")
    nodes = {"A": {"T": NodeTable(a, "a", ("x", "y"))}, "B": {"T": NodeTable(b, "b", ("x", "y"))}}
    return GraphCatalog(nodes, edges, "month" if month else None), {"A": (a, "a", ["x", "y"]), "B": (b, "b", ["x"])}


def attribute(position, column, how="left", limit=None):
    return NodeAttributes("T", position, column, ("y",), how, limit)


AB, BA, CD, DE = edge("ab", 1, A, B, features=("w",)), edge("ba", 2, B, C, features=("w",)), edge("ab", 3, C, D), edge("ba", 4, D, E, features=("w",))
SHAPES = {
    "one": (hop(AB, A, B),),
    "chain": (hop(AB, A, B), hop(BA, B, C), hop(CD, C, D), hop(DE, D, E)),
    "own predicates": (hop(AB, A, B, limit="Edge_1_w > 0"), hop(BA, B, C, limit="Edge_2_w >= 1 and A_3 <> 2"), hop(CD, C, D, nodes=(attribute(D, "b"),), limit="B_4_y = 1")),
    "nulls pass": (hop(AB, A, B), hop(BA, B, C, limit="A_3 is null or A_3 > 2"), hop(CD, C, D, limit="B_4 is null or B_4 < 6")),
    "spanning": (hop(AB, A, B), hop(BA, B, C, limit="A_1 <> A_3"), hop(CD, C, D), hop(DE, D, E, limit="Edge_4_w > 0")),
    "late spanning": (hop(AB, A, B), hop(BA, B, C), hop(CD, C, D, limit="B_2 <> B_4 or Edge_1_w > 1"), hop(DE, D, E)),
    "attributes": (hop(AB, A, B, nodes=(attribute(A, "a"),)), hop(BA, B, C, nodes=(attribute(C, "a", "inner", "y < 2"),), limit="A_1_y >= A_3_y"), hop(CD, C, D)),
    "branches": (hop(AB, A, B), hop(BA, B, C), hop(edge("ba", 3, B, E), B, E), hop(edge("ab", 4, C, D), C, D)),
    "two heads": (hop(AB, A, B), hop(BA, B, C), Hop((B, C), (W,), (Relation(Edge("ba", 3, ((B, "b"), (C, "a")), ((W, "w"),))),)), hop(edge("ab", 4, C, D), C, D)),
    "conjunction": (Hop((A,), (B,), (Relation(AB), Relation(Nested(PathSpec("n", (hop(edge("ab", 11, A, Position("B", 8)), A, Position("B", 8)), hop(edge("ba", 12, Position("B", 8), Position("A", 9), features=("w",)), Position("B", 8), Position("A", 9)), hop(edge("ab", 13, Position("A", 9), B), Position("A", 9), B)), "inner"))))), hop(BA, B, C)),
    "negation": (Hop((A,), (B,), (Relation(AB), Relation(edge("ab", 5, A, B, limit="w > 2"), "left_anti"))), hop(BA, B, C)),
    "optional": (Hop((A,), (B,), (Relation(AB), Relation(edge("ab", 5, A, B, limit="w > 2", features=("w",)), "left"))), hop(BA, B, C)),
    "caps": (hop(AB, A, B, sample=Sample("random", 2)), hop(BA, B, C), hop(edge("ab", 3, C, D, sample=Sample("random", 2)), C, D)),
}


def same(got, want):
    assert set(got) == set(want)
    for element in want:
        columns = sorted(want[element].columns)
        assert sorted(got[element].columns) == columns
        rows = [sorted((tuple(None if r[c] is None else round(float(r[c]), 6) if not isinstance(r[c], str) else r[c] for c in columns) for r in df.collect()), key=repr) for df in (got[element], want[element])]
        assert rows[0] == rows[1], element


def counted(instances, values, nodes, missing, start=("A_1",)):
    """The aggregates of instances (dicts), one by one."""
    groups, out = {}, {}
    for r in instances:
        groups.setdefault(tuple(r[c] for c in start), []).append(r)
    for key, rows in groups.items():
        row = {"COUNT_All": len(rows)}
        for v in values:
            seen = [r[v.column] if v.table is None else nodes[v.column[0]].get(r[v.column], {}).get(v.name) for r in rows]
            seen = [x or 0.0 for x in seen] if missing == "zero" else [x for x in seen if x is not None]
            row |= {f"{f}_{v.name}__{v.element}": g(seen) if seen else None for f, g in (("AVG", lambda x: sum(x) / len(x)), ("SUM", sum), ("MIN", min), ("MAX", max))}
        out[key] = {c: None if x is None else round(x, 6) for c, x in row.items()}
    return out


def folded(df, start=("A_1",)):
    return {tuple(r[c] for c in start): {c: None if x is None else round(float(x), 6) for c, x in r.asDict().items() if c not in start} for r in df.collect()}


@pytest.mark.parametrize(("shape", "how"), [*[(s, "left") for s in SHAPES], *[(s, "inner") for s in ("chain", "own predicates", "late spanning", "attributes", "conjunction")]])
def test_folded_equals_aggregated_instances(spark, shape, how):
    graph, tables = random_graph(spark, len(shape))
    nodes = {t: {r[0]: r.asDict() for r in df.collect()} for t, (df, _, _) in tables.items()}
    spec = PathSpec(shape, SHAPES[shape], how)
    found = path.find_paths(graph, spec)
    instances = [r.asDict() for r in found.collect()]
    values = semiring._values(spec, tables)
    assert len(instances) > 20
    for missing in ("zero", "ignore") if how == "left" and shape in ("own predicates", "nulls pass", "conjunction") else ("zero",):
        assert folded(semiring.fold_path(graph, spec, values, ALL, missing)) == counted(instances, values, nodes, missing)
    assert {r[0] for r in semiring.starts(graph, spec).collect()} == {r["A_1"] for r in instances}
    if how == "inner":
        again = semiring.find_reduced(graph, spec, keep=False)
        assert again.columns == found.columns
        assert sorted(map(repr, again.collect())) == sorted(map(repr, found.collect()))


@pytest.mark.parametrize(("shape", "how"), [("own predicates", "inner"), ("spanning", "left")])
def test_partitions_and_targets(spark, shape, how):
    graph, tables = random_graph(spark, 5, month=True)
    nodes = {t: {r[0]: r.asDict() for r in df.collect()} for t, (df, _, _) in tables.items()}
    spec, targets, start = PathSpec(shape, SHAPES[shape], how), spark.createDataFrame([(k,) for k in range(5)], "A_1 long"), ("A_1", "month")
    instances = [r.asDict() for r in path.find_paths(graph, spec, targets, ["x"]).collect()]
    values = semiring._values(spec, tables)
    assert folded(semiring.fold_path(graph, spec, values, ALL, targets=targets, partitions=["x"]), start) == counted(instances, values, nodes, "zero", start)
    assert {tuple(r) for r in semiring.starts(graph, spec, targets, ["x"]).select(*start).collect()} == {(r["A_1"], r["month"]) for r in instances}


def test_weights_are_summed_by_node_first(spark):
    graph, _ = random_graph(spark, 3)
    spec = PathSpec("chain", SHAPES["chain"], "inner")
    want = aggregate.weight_aggregate(path.find_paths(graph, spec), "A_1", "A_5", "Edge_4_w")
    got = semiring.fold_weights(graph, spec, "A_5", "Edge_4_w")
    assert sorted(got.columns) == sorted(want.columns)
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(map(tuple, want.collect()))


def test_the_tables_paths(spark, sf_dir):
    t = Tables(spark, sf_dir)
    tables = {"Customer": (t.customers(), "customer", ["acctbal"]), "Part": (t.parts(), "part", ["retailprice", "size"]), "Supplier": (t.suppliers(), "supplier", ["acctbal"])}
    for graph, spec, partition in ((t.graph(), LOCAL_SUPPLIERS, None), (t.monthly_graph(), MONTHLY, "month")):
        partitions = MONTHS if partition else None
        want = aggregate.aggregate_path(path.find_paths(graph, spec, partitions=partitions), spec, tables, ["AVG", "MAX", "COUNT"], partition=partition)
        same(semiring.aggregate_spec(graph, spec, tables, ["AVG", "MAX", "COUNT"], partitions=partitions), {k: v for k, v in want.items() if k != "Node___Customer___1"})


def largest_join(df):
    """The most rows that a join of the executed plan put out, and the joins' names."""
    df.collect()
    most, names, held = 0, [], [df._jdf.queryExecution().executedPlan()]
    while held:
        plan = held.pop()
        kind = plan.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            held.append(plan.executedPlan())
            continue
        if kind.endswith("QueryStageExec"):
            held.append(plan.plan())
            continue
        if "Join" in kind:
            names.append(plan.toString().split("\n")[0])
            most = max(most, plan.metrics().apply("numOutputRows").value())
        children = plan.children()
        held += [children.apply(k) for k in range(children.size())]
    return most, names


def hubs(spark, n=60):
    """n starts and n ends on each of three hubs in a row: n * n * 9 instances and more."""
    ab = spark.range(n).select(F.col("id").alias("a"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(2).cast("long"))).alias("b"), F.lit(1.0).alias("w"))
    ba = spark.range(n).select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(2).cast("long"))).alias("b"), F.col("id").alias("a"), F.lit(1.0).alias("w"))
    x = spark.range(n).select(F.col("id").alias("a"), F.col("id").cast("double").alias("x"))
    return GraphCatalog({}, {"ab": EdgeTable(ab, {"a": "A", "b": "B"}, ("w",)), "ba": EdgeTable(ba, {"b": "B", "a": "A"}, ("w",))}), {"A": (x, "a", ["x"])}


def test_no_join_makes_the_instances(spark):
    graph, tables = hubs(spark)
    spec = PathSpec("hubs", (hop(edge("ab", 1, A, B), A, B), hop(edge("ba", 2, B, C), B, C), hop(edge("ab", 3, C, D), C, D), hop(edge("ba", 4, D, E), D, E)), "inner")
    instances = 60 * 3 * 60 * 3 * 60
    folded = semiring.fold_path(graph, spec, [semiring.Value("Node___A___5", "x", "A_5", (tables["A"][0], "a", "x"))], ["AVG", "COUNT"])
    most, names = largest_join(folded)
    assert names and most <= 60 * 3
    rows = folded.collect()
    assert len(rows) == 60 and {(r["COUNT_All"], r["AVG_x__Node___A___5"]) for r in rows} == {(instances // 60, 29.5)}


def test_messages_carry_what_is_summed_by(spark):
    """Weights by a node behind the path (F28): no join makes the instances, of which each start has 3 * 60 * 3."""
    graph, _ = hubs(spark)
    spec = PathSpec("hubs", (hop(edge("ab", 1, A, B), A, B), hop(edge("ba", 2, B, C, features=("w",)), B, C, limit="A_3 > 4"), hop(edge("ab", 3, C, D), C, D)), "inner")
    for parts in (None, 3):
        found = semiring.fold_weights(graph, spec, "B_4", "Edge_2_w", parts=parts)
        most, names = largest_join(found)
        assert names and most <= 60 * 3 * 3
        assert {tuple(r) for r in found.select("A_1", "SUM_Edge_2_w", "COUNT_All").collect()} == {(k, 3.0 * 55 * 3, 3) for k in range(60)}


@pytest.mark.parametrize(("shape", "node"), [("chain", "B_4"), ("own predicates", "B_4"), ("late spanning", "A_5"), ("branches", "A_5"), ("conjunction", "Edge_12_w")])
def test_sums_by_any_column(spark, shape, node):
    graph, tables = random_graph(spark, 6)
    for how in ("inner", "left"):
        spec = PathSpec(shape, SHAPES[shape], how)
        values = [v for v in semiring._values(spec, tables) if v.column != node]
        nodes = {t: {r[0]: r.asDict() for r in df.collect()} for t, (df, _, _) in tables.items()}
        want = counted([r.asDict() for r in path.find_paths(graph, spec).collect()], values, nodes, "zero", ("A_1", node))
        assert want
        for parts in (None, 3) if how == "inner" else (None,):
            assert folded(semiring.fold_path(graph, spec, values, ALL, by=[node], parts=parts), ("A_1", node)) == want


def test_starts_need_semi_joins_only(spark):
    graph, _ = hubs(spark)
    spec = PathSpec("hubs", (hop(edge("ab", 1, A, B), A, B), hop(edge("ba", 2, B, C, limit="a > 3"), B, C), hop(edge("ab", 3, C, D), C, D, limit="B_4 < 2")), "inner")
    most, names = largest_join(semiring.starts(graph, spec))
    assert names and all("LeftSemi" in n for n in names) and most <= 60 * 3
    spanning = PathSpec("hubs", (hop(edge("ab", 1, A, B), A, B), hop(edge("ba", 2, B, C), B, C, limit="A_3 > A_1")), "inner")
    assert {r[0] for r in semiring.starts(graph, spanning).collect()} == set(range(59))


def test_reduced_hops_have_no_dangling_rows(spark):
    ab = spark.createDataFrame([(1, 10, 1.0), (2, 20, 1.0), (3, 30, 1.0)], "a long, b long, w double")
    ba = spark.createDataFrame([(10, 7, 1.0), (20, 8, 1.0), (99, 7, 1.0)], "b long, a long, w double")
    graph = GraphCatalog({}, {"ab": EdgeTable(ab.union(spark.createDataFrame([(7, 70, 1.0)], "a long, b long, w double")), {"a": "A", "b": "B"}, ("w",)), "ba": EdgeTable(ba, {"b": "B", "a": "A"}, ("w",))})
    spec = PathSpec("p", (hop(AB, A, B), hop(BA, B, C), hop(CD, C, D)), "inner")
    assert [df.count() for df in semiring.reduced(graph, spec)] == [1, 1, 1]
    with pytest.raises(ValueError, match="left join"):
        semiring.reduced(graph, PathSpec("p", spec.hops, "left"))
    assert math.isclose(semiring.find_reduced(graph, spec).agg(F.sum("Edge_1_w")).first()[0], 1.0)

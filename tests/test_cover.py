"""Covers from both ends, prefixes searched once, and aggregates in one pass."""

import random

import pytest
from pyspark.sql import functions as F

from pathrank.operators import aggregate, index, khop, meet, pairs

pytestmark = pytest.mark.usefixtures("plain_plans")


def relations(spark, seed, caps=(-1,)):
    rng = random.Random(seed)
    df = lambda names: spark.createDataFrame(list({(rng.randrange(7), rng.randrange(7)): 0 for _ in range(22)}), f"{names[0]} long, {names[1]} long").withColumn("w", F.xxhash64(*names) % 5)
    return [khop.Relation("ab", df("ab"), ("a", "A"), ("b", "B"), "w", caps, caps), khop.Relation("ac", df("ac"), ("a", "A"), ("c", "C")), khop.Relation("bb", df("xy"), ("x", "B"), ("y", "B"))]


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


@pytest.mark.parametrize(("seed", "caps"), [(1, (-1,)), (2, (2,))])
def test_both_ends_count_what_instances_show(spark, seed, caps):
    rs = relations(spark, seed, caps)
    types = khop.path_types(rs, "A", "B", 4)
    some = [p for k, p in enumerate(types) if len(p.steps) < 4 or k % 7 == 0]
    assert any(len(set(p.types)) < len(p.types) - 2 for p in some)
    known = spark.createDataFrame([(a, b) for a in range(7) for b in range(7) if (a + b) % 2], "start long, end long")
    found = khop.all_instances(rs, some).persist()
    columns = ["start", "end", *[p.name for p in some], "n_kinds", "n_total"]
    assert rows(meet.both_ends_matrix(rs, some, known, materialize=False), *columns) == rows(pairs.cover_matrix(found, known, ["start", "end"], [p.name for p in some]), *columns)
    assert rows(meet.both_ends_cover(rs, some, known, materialize=False), "start", "end", "cover_count") == rows(pairs.pair_cover(found, known, ["start", "end"]), "start", "end", "cover_count")
    found.unpersist()


def test_halves_stay_near_the_pairs(spark):
    """A hub with 200 nodes on both sides: the instances are 200 * 200, the halves of one pair 200 and 1."""
    from test_semiring import largest_join

    spokes = spark.range(200).select(F.col("id").alias("a"), F.lit(0).cast("long").alias("b"))
    r = [khop.Relation("ab", spokes, ("a", "A"), ("b", "B"))]
    path = khop.PathType((("ab", "Head"), ("ab", "Tail"), ("ab", "Head")), ("A", "B", "A", "B"))
    known = spark.createDataFrame([(5, 0), (6, 0)], "start long, end long")
    ring = khop.PathType((("ab", "Head"), ("ab", "Tail")), ("A", "B", "A"))
    assert rows(meet.both_ends_cover(r, [path], known, materialize=False), "start", "end", "cover_count") == [(5, 0, 0), (6, 0, 0)]
    some = spark.createDataFrame([(5, 7), (6, 6)], "start long, end long")
    counted = meet.both_ends_cover(r, [ring], some, materialize=False)
    assert rows(counted, "start", "end", "cover_count") == [(5, 7, 1), (6, 6, 0)]
    assert largest_join(counted)[0] <= 2


def test_halves_are_walked_once(spark, monkeypatch):
    rs, asked, plain = relations(spark, 3), [], meet.hop_edges
    monkeypatch.setattr(meet, "hop_edges", lambda r, aim, k, *x: asked.append((r.name, aim, k)) or plain(r, aim, k, *x))
    types = [p for p in khop.path_types(rs, "A", "B", 3) if len(p.steps) == 3 and p.steps[:2] == (("ab", "Head"), ("bb", "Head"))]
    known = spark.createDataFrame([(1, 1)], "start long, end long")
    meet.both_ends_cover(rs, types, known, materialize=False)
    assert len(types) > 1 and asked.count(("ab", "Head", 0)) == 1


def test_prefixes_are_searched_once(spark, monkeypatch):
    rs, asked, plain = relations(spark, 4), [], khop.hop_edges
    types = khop.path_types(rs, "A", "B", 3)
    want = {p.name: rows(khop.instances(rs, p), *p.columns) for p in types}
    monkeypatch.setattr(khop, "hop_edges", lambda r, aim, k, *x: asked.append((r.name, aim, k)) or plain(r, aim, k, *x))
    trie = khop.Trie(rs, types)
    got = {p.name: rows(trie.instances(p), *p.columns) for p in types}
    assert repr(got) == repr(want)
    assert len(asked) == len({p.steps[:k] for p in types for k in range(1, len(p.steps) + 1)})
    assert sorted(map(tuple, trie.all_instances().collect()), key=repr) == sorted(map(tuple, khop.all_instances(rs, types).collect()), key=repr)


def test_a_search_goes_on_behind_finished_prefixes(spark, tmp_path, monkeypatch):
    rs, asked, plain = relations(spark, 5), [], khop.hop_edges
    types = khop.path_types(rs, "A", "B", 3)
    inner = {p.steps[:k] for p in types for k in range(1, len(p.steps))}
    starts = spark.createDataFrame([(1,), (2,), (3,)], "a long")
    monkeypatch.setattr(khop, "hop_edges", lambda r, aim, k, *x: asked.append(k) or plain(r, aim, k, *x))
    first = khop.Trie(rs, types, starts, str(tmp_path), "v1").all_instances()
    n = len(asked)
    again = khop.Trie(rs, types, starts, str(tmp_path), "v1").all_instances()
    assert len(asked) - n == len([p for p in types if p.steps not in inner])  # the leaves only
    assert sorted(map(tuple, first.collect())) == sorted(map(tuple, again.collect()))
    n = len(asked)
    khop.Trie(rs, types, starts, str(tmp_path), "v2").all_instances()
    assert len(asked) - n > len(types)


def scans(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("Relation [") + df._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD")


def test_wide_aggregates_read_once(spark):
    df = spark.createDataFrame([(k % 3, float(k) if k % 4 else None, float(-k), None) for k in range(20)], "g long, x double, y double, z double")
    functions = ["AVG", "SUM", "MAX", "MIN", "COUNT"]
    for missing in ("zero", "ignore"):
        wide, plain = (f(df, ["g"], ["x", "y", "z"], functions, missing=missing, **more) for f, more in ((aggregate.wide_aggregate, {"columns": 4}), (aggregate.aggregate_features, {})))
        assert wide.columns == plain.columns and rows(wide, *plain.columns) == rows(plain, *plain.columns)
        assert scans(wide) == 1


def test_reversed_edges_come_from_one_pass(spark):
    edges = spark.createDataFrame([("r", 1, 2), ("s", 3, 4)], "relation string, head long, tail long")
    both = index.with_reverse(edges)
    assert rows(both, "relation", "head", "tail") == [("r", 1, 2), ("r_by", 2, 1), ("s", 3, 4), ("s_by", 4, 3)]
    assert scans(both) == 1

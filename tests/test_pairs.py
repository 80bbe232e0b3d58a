"""Instances marked, chosen and made distinct without being shuffled."""

import pytest
from test_cover import relations, rows

from pathrank import queries
from pathrank.operators import khop, pairs

pytestmark = pytest.mark.usefixtures("plain_plans")
ENDS = ["start", "end"]


@pytest.fixture(scope="module")
def searched(spark):
    rs = relations(spark, 3)
    types = [p for k, p in enumerate(khop.path_types(rs, "A", "B", 3)) if len(p.steps) < 3 or k % 5 == 0]
    assert any(len(set(p.types)) == len(p.types) == 2 for p in types) and any(len(set(p.types)) < len(p.types) for p in types)
    return rs, types, khop.all_instances(rs, types).persist()


@pytest.mark.parametrize("most", [2, 1000])
def test_known_ends_travel_with_their_start(spark, searched, most):
    rs, types, found = searched
    known = spark.createDataFrame([(a, b) for a in range(7) for b in range(7) if (a + b) % 3 < a % 3 or (a, b) == (0, 3)], "start long, end long")
    want = pairs.path_cover(found, known, ENDS)
    assert rows(khop.marked_instances(rs, types, known, most=most), "path", *ENDS, "cover_mark") == rows(want, "path", *ENDS, "cover_mark")


def test_starts_are_chosen_before_the_search(spark, searched):
    rs, types, found = searched
    covered = spark.createDataFrame([(1, 0, 2), (2, 0, 0), (4, 1, 1)], "start long, end long, cover_count long")
    chosen = khop.all_instances(rs, types, starts=pairs.covered_starts(covered, "start"), dealt=True)
    assert rows(chosen, "path", *ENDS) == rows(pairs.starts_with_cover(found, covered, "start"), "path", *ENDS)


def test_connected_pairs_come_once(spark, searched):
    rs, types, found = searched
    assert rows(khop.connected(rs, types), *ENDS) == rows(found.select(*ENDS).distinct(), *ENDS)
    chain = [khop.Relation("ab", spark.createDataFrame([(1, 1), (1, 2), (2, 2)], "a long, b long"), ("a", "A"), ("b", "B")), khop.Relation("bc", spark.createDataFrame([(1, 5), (2, 5), (2, 6)], "b long, c long"), ("b", "B"), ("c", "C"))]
    assert rows(khop.connected(chain, khop.path_types(chain, "A", "C", 2)), *ENDS) == [(1, 5), (1, 6), (2, 5), (2, 6)]


def test_fanning_hops_are_dealt(spark, monkeypatch):
    """24 starts in one group of 50 ends: 1,200 instances in tasks of some 100."""
    monkeypatch.setattr(khop, "ROWS_A_TASK", 100)
    rs = [khop.Relation("in_a", spark.range(24).selectExpr("id AS a", "0L AS n"), ("a", "A"), ("n", "N")), khop.Relation("in_b", spark.range(50).selectExpr("id AS b", "0L AS n"), ("b", "B"), ("n", "N"))]
    found = khop.all_instances(rs, khop.path_types(rs, "A", "B", 2), dealt=True)
    sizes = found.rdd.mapPartitions(lambda part: [sum(1 for _ in part)]).collect()
    assert sum(sizes) == 1200 and max(sizes) <= 400


def test_only_main_types_are_searched_for_samples(spark, sf_dir, monkeypatch):
    asked = []
    search = khop.all_instances
    monkeypatch.setattr(khop, "all_instances", lambda relations, paths, *a, **k: asked.append([p.name for p in paths]) or search(relations, paths, *a, **k))
    assert queries.QUERIES["L02_pair_samples"](spark, sf_dir).count() > 0
    assert asked == [queries.TYPES[:1]]


def test_two_steps_are_summed_without_instances(spark):
    from pyspark.sql import functions as F
    from test_semiring import largest_join

    rs = relations(spark, 5)
    for path in (khop.PathType((("ab", "Head"), ("ab", "Tail")), ("A", "B", "A")), khop.PathType((("ab", "Tail"), ("ac", "Head")), ("B", "A", "C"))):
        a, b, c = path.columns
        want = khop.instances(rs, path).dropna().groupBy(F.col(a).alias("start")).agg(F.count("*").alias("n"), F.countDistinct(b).alias("n_middles"), F.sum(c).alias("sum_ends"))
        columns = ["start", "n", "n_middles", "sum_ends"]
        assert rows(khop.two_step_sums(rs, path), *columns) == rows(want, *columns)
    star = khop.Relation("ab", spark.range(200).selectExpr("id AS a", "0L AS b"), ("a", "A"), ("b", "B"))
    found = khop.two_step_sums([star], khop.PathType((("ab", "Head"), ("ab", "Tail")), ("A", "B", "A")))
    assert largest_join(found)[0] <= 400  # of 200 * 199 instances
    assert found.count() == 200 and found.where("n = 199 and sum_ends = 19900 - start").count() == 200


def test_dealt_edges_and_ends_are_the_same(spark):
    from pathrank.operators import index

    edges = spark.createDataFrame([(k % 5, k % 3, float(k)) for k in range(40)], "a long, b long, w double")
    more = spark.createDataFrame([(1, 1, 2.0), (9, 9, None)], "a long, b long, v double")
    found = index.merged_parallel([edges, more], ["a", "b"], 3)
    assert rows(found, "a", "b", "w", "v") == rows(index.merged_parallel([edges, more], ["a", "b"]), "a", "b", "w", "v")


@pytest.mark.parametrize("task", [1, 40])
def test_blocks_leave_instances_as_they_are(spark, searched, monkeypatch, task):
    """Also nodes without edges and types that meet a node type again."""
    rs, types, found = searched
    for name, value in (("ROWS_A_TASK", task), ("MOST_TASKS", 3), ("ROWS_A_GROUP", 5)):
        monkeypatch.setattr(khop, name, value)
    types = [p for p in types if len(p.steps) == 2][:4] + [p for p in types if len(p.steps) == 3][:2]
    names = [p.name for p in types]
    assert rows(khop.all_instances(rs, types, dealt=True), "path", *ENDS) == rows(found.where(found.path.isin(names)), "path", *ENDS)


def fans(spark, monkeypatch):
    """600 starts in each of 2 groups of 40 ends: 48,000 instances, 12 tasks."""
    monkeypatch.setattr(khop, "ROWS_A_TASK", 4000)
    rs = [khop.Relation("in_a", spark.range(1200).selectExpr("id AS a", "id % 2 AS n"), ("a", "A"), ("n", "N")), khop.Relation("in_b", spark.range(80).selectExpr("id AS b", "id % 2 AS n"), ("b", "B"), ("n", "N"))]
    return rs, khop.path_types(rs, "A", "B", 2)


def longest(found):
    """(instances, runs of equal ends as they are written, instances of the largest task)."""
    def counted(part):
        n, runs, last = 0, 0, None
        for r in part:
            n, runs, last = n + 1, runs + (r["end"] != last), r["end"]
        return [(n, runs)]

    sizes = found.rdd.mapPartitions(counted).collect()
    return sum(n for n, _ in sizes), sum(k for _, k in sizes), max(n for n, _ in sizes)


def test_fanning_hops_are_made_in_blocks(spark, monkeypatch):
    n, runs, most = longest(khop.all_instances(*fans(spark, monkeypatch), dealt=True))
    assert n == 48000 and runs <= n / 80 and most <= 9000


def test_marked_instances_are_made_in_blocks(spark, monkeypatch):
    rs, types = fans(spark, monkeypatch)
    known = spark.range(1200).selectExpr("id AS start", "id % 80 AS end")
    found = khop.marked_instances(rs, types, known)
    n, runs, most = longest(found)
    assert n == 48000 and runs <= n / 80 and most <= 9000
    assert found.where("cover_mark").count() == 1200 and found.where("cover_mark and end = start % 80").count() == 1200


def test_connected_pairs_are_made_in_blocks(spark, monkeypatch):
    rs, types = fans(spark, monkeypatch)
    found = khop.connected(rs, types)
    n, runs, most = longest(found)
    assert n == 48000 and runs <= n / 80 and most <= 9000
    assert found.distinct().count() == 48000 and found.where("start % 2 <> end % 2").isEmpty()


def test_starts_that_are_chosen_are_continued_in_blocks(spark, monkeypatch):
    rs, types = fans(spark, monkeypatch)
    found = khop.all_instances(rs, types, starts=spark.range(0, 1200, 3).toDF("start"), dealt=True)
    n, runs, most = longest(found)
    assert n == 16000 and runs <= n / 60 and most <= 9000
    assert found.where("start % 3 <> 0").isEmpty()


def test_blocks_do_not_depend_on_the_order_of_rows(spark, monkeypatch):
    """A task that is repeated, with rows in another order, makes the same blocks."""
    from pyspark.sql import functions as F

    rs, types = fans(spark, monkeypatch)
    known = spark.range(2400).selectExpr("id div 2 AS start", "(id div 2 + 2 * (id % 2)) % 80 AS end")

    def made(back):
        order = F.desc if back else F.asc
        turned = [khop.Relation(r.name, r.data.repartition(3 if back else 1).sortWithinPartitions(order(r.head[0])), r.head, r.tail) for r in rs]
        found = khop.marked_instances(turned, types, known.coalesce(1).sortWithinPartitions(order("end")))
        return found.rdd.mapPartitionsWithIndex(lambda k, part: [(k, tuple(sorted(map(tuple, part))))]).collect()

    assert made(False) == made(True)

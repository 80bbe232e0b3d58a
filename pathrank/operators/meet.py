"""How often path types connect known pairs of nodes, searched from both ends at once.

A type's steps are cut where the walks of both halves are fewest, as counted beforehand by their ends alone. The first half is walked forward from the pairs' starts, the second backward from
their ends, each as counts per (end of the pair, node in the middle), and the counts of both are multiplied where they
meet. Nothing is looked at that is not within half a path of a known pair, and instances are counted, not made.

Paths avoid their own nodes: a new node differs from all earlier ones of its type. Tests within a half are made as it is
walked; nodes of a half whose type comes up in the other half too are kept beside its ends (they split its counts), and
tested where the halves meet. Half paths that several types share are walked once.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathrank.operators.khop import PathType, Relation, hop_edges
from pathrank.operators.pairs import positive_columns
from pathrank.sources.shared import cut


def _kept(types: Sequence[str], own: range, others: range) -> list[int]:
    """The nodes of a half whose type comes up in the other half."""
    there = {types[k] for k in others}
    return [k for k in own if types[k] in there]


class Halves:
    """The half paths of one set of pairs; each is walked once and materialised."""

    def __init__(self, relations: Sequence[Relation], pairs: DataFrame, start: str, end: str, materialize: bool = True) -> None:
        self.relations = {r.name: r for r in relations}
        self.starts, self.ends = pairs.select(F.col(start).alias("n")).dropna().distinct(), pairs.select(F.col(end).alias("n")).dropna().distinct()
        self.held = cut if materialize else (lambda df: df)
        self.walked: dict[tuple, DataFrame] = {}
        self.edges: dict[tuple, DataFrame] = {}
        self.reached: dict[tuple, DataFrame] = {}

    def _step(self, path: PathType, k: int) -> DataFrame:
        """(node k, node k + 1) of the type's k-th step, under its cap; equal steps of all types are read once."""
        name, aim = path.steps[k]
        cap = self.relations[name].cap(aim, k)
        if (name, aim, cap) not in self.edges:
            self.edges[name, aim, cap] = self.held(hop_edges(self.relations[name], aim, k, "u", "v"))
        return self.edges[name, aim, cap].select(F.col("u").alias(f"n{k}"), F.col("v").alias(f"n{k + 1}"))

    def _walks(self, path: PathType, steps: range) -> DataFrame:
        """(n, w): by how many walks of these steps, forward from the pairs' starts or (a falling range) backward from their ends, each node is reached."""
        key = (steps.step, steps.start, tuple(path.steps[k] for k in steps))
        if not steps:
            return (self.starts if steps.step > 0 else self.ends).select("n", F.lit(1.0).alias("w"))
        if key not in self.reached:
            k = steps[-1]
            near, far = (f"n{k}", f"n{k + 1}") if steps.step > 0 else (f"n{k + 1}", f"n{k}")
            before = self._walks(path, steps[:-1]).withColumnRenamed("n", near)
            self.reached[key] = before.join(self._step(path, k), near).groupBy(F.col(far).alias("n")).agg(F.sum("w").alias("w"))
        return self.reached[key]

    def middle(self, path: PathType) -> int:
        """Where the type is cut: the larger half has the fewest walks there (of equals, the cut next to the middle)."""
        last = len(path.steps)
        cuts = sorted(range(1, last), key=lambda m: (abs(2 * m - last), -m))
        if len(cuts) < 2:
            return 1
        total = lambda df, m, half: df.agg(F.coalesce(F.sum("w"), F.lit(0.0)).alias("w")).select(F.lit(m).alias("m"), F.lit(half).alias("half"), "w")
        sides = [total(self._walks(path, range(m)), m, 0) for m in cuts] + [total(self._walks(path, range(last - 1, m - 1, -1)), m, 1) for m in cuts]
        walks = {(r["m"], r["half"]): r["w"] for r in reduce(DataFrame.unionByName, sides).collect()}  # two numbers for each step
        return min(cuts, key=lambda m: max(walks[m, 0], walks[m, 1]))

    def _extended(self, path: PathType, found: DataFrame, step: int, new: int, known: list[int], keep: list[int]) -> DataFrame:
        """One step further; nodes that are not needed any more are summed over."""
        edge = self._step(path, step)
        found = found.join(edge, f"n{step}" if new == step + 1 else f"n{step + 1}")
        for k in known:
            if path.types[k] == path.types[new]:
                found = found.where(F.col(f"n{k}") != F.col(f"n{new}"))
        return found.groupBy(*[f"n{k}" for k in sorted({*keep, new})]).agg(F.sum("c").alias("c"))

    def forward(self, path: PathType, middle: int, crossing: list[int]) -> DataFrame:
        """(n0, the middle, kept nodes, c) of the first ``middle`` steps from the pairs' starts."""
        key = ("forward", path.steps[:middle], tuple(crossing))
        if key not in self.walked:
            found, known = self.starts.select(F.col("n").alias("n0"), F.lit(1).cast("long").alias("c")), [0]
            for k in range(middle):
                later = set(path.types[k + 2 : middle + 1])  # types that the rest of this half brings
                keep = [j for j in known if j == 0 or j in crossing or path.types[j] in later]
                found = self._extended(path, found, k, k + 1, known, keep)
                known = sorted({*keep, k + 1})
            self.walked[key] = self.held(found)
        return self.walked[key]

    def backward(self, path: PathType, middle: int, crossing: list[int]) -> DataFrame:
        """(the middle, the last node, kept nodes, c) of the other steps, walked from the pairs' ends."""
        last = len(path.steps)
        key = ("backward", path.types[middle:], path.steps[middle:], middle, tuple(crossing))
        if key not in self.walked:
            found, known = self.ends.select(F.col("n").alias(f"n{last}"), F.lit(1).cast("long").alias("c")), [last]
            for k in range(last - 1, middle - 1, -1):
                later = set(path.types[middle:k])
                keep = [j for j in known if j == last or j in crossing or path.types[j] in later]
                found = self._extended(path, found, k, k, known, keep)
                known = sorted({*keep, k})
            self.walked[key] = self.held(found)
        return self.walked[key]

    def counts(self, pairs: DataFrame, path: PathType, start: str, end: str) -> DataFrame:
        """(start, end, n) of the pairs that the type connects, n its instances between them."""
        last, middle = len(path.steps), self.middle(path)
        first, second = range(middle), range(middle + 1, last + 1)
        there, back = _kept(path.types, first, second), _kept(path.types, second, first)
        a = self.forward(path, middle, there).withColumnRenamed("c", "a")
        b = self.backward(path, middle, back).withColumnRenamed("c", "b")
        known = pairs.select(F.col(start).alias("n0"), F.col(end).alias(f"n{last}")).distinct()
        if middle == last:
            found = known.join(a, ["n0", f"n{last}"]).withColumn("b", F.lit(1))
        else:
            found = known.join(a, "n0").join(b, [f"n{last}", f"n{middle}"])
        for j in there:
            for k in back:
                if path.types[j] == path.types[k]:
                    found = found.where(F.col(f"n{j}") != F.col(f"n{k}"))
        return found.groupBy(F.col("n0").alias(start), F.col(f"n{last}").alias(end)).agg(F.sum(F.col("a") * F.col("b")).alias("n"))


def cover_counts(relations: Sequence[Relation], paths: Sequence[PathType], pairs: DataFrame, start: str = "start", end: str = "end", materialize: bool = True) -> DataFrame:
    """(path, start, end, n) for every type and every known pair that it connects."""
    halves = Halves(relations, pairs, start, end, materialize)
    return reduce(DataFrame.unionByName, [halves.counts(pairs, p, start, end).select(F.lit(p.name).alias("path"), start, end, "n") for p in paths])


def both_ends_cover(relations: Sequence[Relation], paths: Sequence[PathType], pairs: DataFrame, start: str = "start", end: str = "end", materialize: bool = True) -> DataFrame:
    """Each known pair with the number of instances of all types between its ends, 0 included."""
    pairs = cut(pairs) if materialize else pairs  # read for each type
    counts = cover_counts(relations, paths, pairs, start, end, materialize).groupBy(start, end).agg(F.sum("n").alias("cover_count"))
    return pairs.join(counts, [start, end], "left").withColumn("cover_count", F.coalesce("cover_count", F.lit(0).cast("long")))


def both_ends_matrix(relations: Sequence[Relation], paths: Sequence[PathType], pairs: DataFrame, start: str = "start", end: str = "end", materialize: bool = True) -> DataFrame:
    """Each known pair with a count per path type, the number of types and the total."""
    names = [p.name for p in paths]
    pairs = cut(pairs) if materialize else pairs  # read for each type
    counts = cover_counts(relations, paths, pairs, start, end, materialize).groupBy(start, end).pivot("path", names).agg(F.sum("n"))
    out = pairs.select(start, end).distinct().join(counts, [start, end], "left").fillna(0, subset=names)
    return out.withColumn("n_kinds", positive_columns(names)).withColumn("n_total", sum((F.col(n) for n in names), F.lit(0).cast("long")))

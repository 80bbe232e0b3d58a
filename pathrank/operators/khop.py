"""K-hop path types, k-hop subgraphs and batch-induced subgraphs. Schemas are enumerated on the driver, data never."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathrank.operators.index import dense_index
from pathrank.operators.pairs import path_cover
from pathrank.operators.sampling import random_n, top_n
from pathrank.sources.manifest import resumed
from pathrank.sources.shared import cut


#: Instances that one task makes where hops fan out, and the tasks that these are dealt to at most.
ROWS_A_TASK, MOST_TASKS = 1 << 22, 20_000
#: Instances that fan out at a node together, those of a node that are collected to be cut into such blocks, and edges of such a
#: hop at most that every task holds.
ROWS_A_BLOCK, ROWS_A_GROUP, EDGES_HELD = 256, 4096, 1_000_000
#: Known ends that travel with their start.
ENDS_A_START = 1000


@dataclass(frozen=True)
class Relation:
    """A relation that may be walked both ways; caps per hop and direction: 0 forbids it, below 0 there is none."""

    name: str
    data: DataFrame
    head: tuple[str, str]  # column, node type
    tail: tuple[str, str]
    weight: str | None = None
    forward: tuple[int, ...] = (-1,)
    backward: tuple[int, ...] = (-1,)

    def cap(self, aim: str, hop: int) -> int:
        caps = self.forward if aim == "Head" else self.backward
        return caps[min(hop, len(caps) - 1)]

    def ends(self, aim: str) -> tuple[tuple[str, str], tuple[str, str]]:
        return (self.head, self.tail) if aim == "Head" else (self.tail, self.head)


@dataclass(frozen=True)
class PathType:
    """A feasible sequence of steps: (relation, direction) and the node types it goes through."""

    steps: tuple[tuple[str, str], ...]
    types: tuple[str, ...]

    @property
    def name(self) -> str:
        return "__".join(f"{r}_Aim_{aim}" for r, aim in self.steps)

    @property
    def columns(self) -> list[str]:
        return [f"{t}_{k}" for k, t in enumerate(self.types, 1)]


def path_types(relations: Sequence[Relation], start: str, end: str, hops: int, most: int = 10_000) -> list[PathType]:
    """All types of up to ``hops`` steps from ``start`` that end in ``end``."""
    found, held = [], [PathType((), (start,))]
    for hop in range(hops):
        new = []
        for path in held:
            for r in relations:
                for aim in ("Head", "Tail"):
                    (_, a), (_, b) = r.ends(aim)
                    if a == path.types[-1] and r.cap(aim, hop) != 0:
                        new.append(PathType((*path.steps, (r.name, aim)), (*path.types, b)))
        if len(new) > most:
            raise ValueError(f"{len(new)} path types after {hop + 1} hops; at most {most} are allowed")
        found += [p for p in new if p.types[-1] == end]
        held = new
    return found


def hop_edges(r: Relation, aim: str, hop: int, head: str, tail: str) -> DataFrame:
    """The distinct (head, tail) of a relation walked in one direction, under the cap of this hop."""
    (a, _), (b, _) = r.ends(aim)
    cap = r.cap(aim, hop)
    if cap <= 0:
        return r.data.select(F.col(a).alias(head), F.col(b).alias(tail)).dropna().distinct()
    weight = F.col(r.weight).cast("double") if r.weight else F.lit(1.0)
    edges = r.data.select(F.col(a).alias(head), F.col(b).alias(tail), weight.alias("_w")).dropna().groupBy(head, tail).agg(F.sum("_w").alias("_w"))
    return top_n(edges, [head], ["_w"], [tail], cap).drop("_w")


def _restricted(edges: DataFrame, starts: DataFrame | None, column: str) -> DataFrame:
    return edges if starts is None else edges.join(starts.select(F.col(starts.columns[0]).alias(column)).distinct(), column, "left_semi")


def _fanned(found: DataFrame, edges: DataFrame, node: str, how: str) -> DataFrame:
    """``found`` joined with ``edges`` on ``node``; many continuations are made in tasks of some ROWS_A_TASK rows.

    Rows of a node are continued in blocks: a new node comes once for each row of the block, then the next one. Files take such
    runs and short cycles in a small part of the bytes that single rows need (cycles best if their length is a multiple of 8).
    """
    held, met = found.groupBy(node).agg(F.count("*").alias("a")), edges.groupBy(node).agg(F.count("*").alias("b"))
    n, most, fan, n_edges = held.join(met, node, "full").agg(F.sum(F.col("a") * F.col("b")), F.max("a"), F.max("b"), F.sum("b")).first()
    if (n or 0) < 2 * ROWS_A_TASK:
        return found.join(edges, node, how)
    rows = max(1, min(ROWS_A_BLOCK, ROWS_A_TASK // fan))
    rows -= rows % 8 if rows > 8 else 0
    others, firsts = [c for c in found.columns if c != node], F.sequence(F.lit(1), F.size("_rows"), F.lit(rows))
    groups = found.groupBy(node, F.pmod(F.xxhash64(*found.columns), F.lit(most // ROWS_A_GROUP + 1)).alias("_group")).agg(F.sort_array(F.collect_list(F.struct(*others))).alias("_rows"))  # a repeated task makes the same blocks
    blocks = groups.select(node, F.explode(F.transform(firsts, lambda k: F.slice("_rows", k, F.lit(rows)))).alias("_block")).repartition(min(MOST_TASKS, n // ROWS_A_TASK + 1))
    made = blocks.join(F.broadcast(edges) if n_edges <= EDGES_HELD else edges, node, how).withColumn("_row", F.explode("_block"))
    return made.select(node, *[F.col(f"_row.{c}").alias(c) for c in others], *[c for c in edges.columns if c != node])


def extended(found: DataFrame | None, relations: dict[str, Relation], path: PathType, hop: int, starts: DataFrame | None, dealt: bool = False) -> DataFrame:
    """The instances of a type's first ``hop`` steps with the next one; a new node differs from the earlier ones of its type."""
    columns, (name, aim) = path.columns, path.steps[hop]
    edges = hop_edges(relations[name], aim, hop, columns[hop], columns[hop + 1])
    if found is None:
        found = _restricted(edges, starts, columns[0])
    else:
        found = _fanned(found, edges, columns[hop], "left") if dealt else found.join(edges, columns[hop], "left")
    for k in range(hop + 1):
        if path.types[k] == path.types[hop + 1]:
            found = found.where(F.col(columns[hop + 1]) != F.col(columns[k]))
    return found


def instances(relations: Sequence[Relation], path: PathType, starts: DataFrame | None = None, dealt: bool = False) -> DataFrame:
    """The self-avoiding instances of a path type; hops are left joins, whose null ends a test for a type's earlier nodes drops.

    dealt: continuations of the last hop are counted first, and made in blocks, in tasks of some ROWS_A_TASK instances.
    """
    by_name, found = {r.name: r for r in relations}, None
    for hop in range(len(path.steps)):
        found = extended(found, by_name, path, hop, starts, dealt and hop + 1 == len(path.steps))
    return found.select(*path.columns)


class Trie:
    """The prefixes of path types, each searched once: a prefix that others continue is kept, and continued from there.

    Kept prefixes are materialised, or, in a ``folder``, stored under a manifest: a search that starts again with the same
    ``state`` (what the relations and starts depend on) goes on behind the prefixes that are finished.
    """

    def __init__(self, relations: Sequence[Relation], paths: Sequence[PathType], starts: DataFrame | None = None, folder: str | None = None, state: str = "") -> None:
        self.relations, self.paths, self.starts = {r.name: r for r in relations}, list(paths), starts
        self.folder, self.state = folder, state
        self.inner = {p.steps[:k] for p in paths for k in range(1, len(p.steps))}
        self.held: dict[tuple, DataFrame] = {}

    def _prefix(self, path: PathType, steps: int) -> DataFrame | None:
        if steps == 0:
            return None
        key = path.steps[:steps]
        if key not in self.held:
            short = PathType(key, path.types[: steps + 1])
            compute = lambda: extended(self._prefix(path, steps - 1), self.relations, short, steps - 1, self.starts).select(*short.columns)
            if self.folder is None:
                self.held[key] = cut(compute())
            else:
                spark = self.relations[key[0][0]].data.sparkSession
                named = f"{self.folder.rstrip('/')}/{hashlib.md5(short.name.encode()).hexdigest()}"
                self.held[key] = resumed(spark, named, "prefix", [short.name], lambda _: compute().withColumn("prefix", F.lit(short.name)), self.state).drop("prefix")
        return self.held[key]

    def instances(self, path: PathType) -> DataFrame:
        if path.steps in self.inner:
            return self._prefix(path, len(path.steps))
        return extended(self._prefix(path, len(path.steps) - 1), self.relations, path, len(path.steps) - 1, self.starts).select(*path.columns)

    def all_instances(self, start: str = "start", end: str = "end") -> DataFrame:
        """(path, start, end) of every instance of every type, ends that are null left out."""
        return _ends({p.name: (self.instances(p), p) for p in self.paths}, start, end)


def _ends(found: dict[str, tuple[DataFrame, PathType]], start: str, end: str) -> DataFrame:
    parts = [df.select(F.lit(name).alias("path"), F.col(p.columns[0]).alias(start), F.col(p.columns[-1]).alias(end)).where(f"{end} is not null") for name, (df, p) in found.items()]
    return reduce(DataFrame.unionByName, parts)


def all_instances(relations: Sequence[Relation], paths: Sequence[PathType], start: str = "start", end: str = "end", starts: DataFrame | None = None, dealt: bool = False) -> DataFrame:
    """(path, start, end) of every instance of every type, ends that are null left out; prefixes are searched for each type.

    starts: only instances that leave these nodes are made. dealt: as ``instances`` has it.
    """
    return _ends({p.name: (instances(relations, p, starts, dealt), p) for p in paths}, start, end)


def marked_instances(relations: Sequence[Relation], paths: Sequence[PathType], pairs: DataFrame, start: str = "start", end: str = "end", most: int = ENDS_A_START) -> DataFrame:
    """(path, start, end, cover_mark) of every instance: whether its ends are a known pair.

    Known ends travel with their start, so that instances are marked where they are made and not shuffled. Instances of a
    start with more than ``most`` known ends are joined with the pairs.
    """
    by_name, known = {r.name: r for r in relations}, cut(pairs.select(start, end).dropna().distinct())
    many = cut(known.groupBy(start).agg(F.count("*").alias("n")).where(F.col("n") > most).select(start))
    lists, parts = known.join(many, start, "left_anti").groupBy(start).agg(F.sort_array(F.collect_list(end)).alias("_known")), []
    for p in paths:
        first, last = p.columns[0], p.columns[-1]
        found = extended(None, by_name, p, 0, None).join(many.withColumnRenamed(start, first), first, "left_anti").join(lists.withColumnRenamed(start, first), first, "left")
        for hop in range(1, len(p.steps)):
            found = extended(found, by_name, p, hop, None, hop + 1 == len(p.steps))
        mark = F.coalesce(F.array_contains("_known", F.col(last)), F.lit(False))
        parts.append(found.where(F.col(last).isNotNull()).select(F.lit(p.name).alias("path"), F.col(first).alias(start), F.col(last).alias(end), mark.alias("cover_mark")))
    if not many.isEmpty():
        parts.append(path_cover(all_instances(relations, paths, start, end, many, True), known, [start, end]))
    return reduce(DataFrame.unionByName, parts)


def type_pairs(relations: Sequence[Relation], path: PathType) -> DataFrame:
    """The distinct ends of a type's instances, as its first and last column.

    Pairs whose end has one node before it come up once, so only the others are compared.
    """
    columns, (name, aim) = path.columns, path.steps[-1]
    if len(set(path.types)) < len(path.types):  # whether a node is new depends on the whole instance
        return instances(relations, path, dealt=True).select(columns[0], columns[-1]).dropna().distinct()
    edges = hop_edges({r.name: r for r in relations}[name], aim, len(path.steps) - 1, columns[-2], columns[-1])
    if len(path.steps) == 1:
        return edges
    before = type_pairs(relations, PathType(path.steps[:-1], path.types[:-1]))
    several = edges.groupBy(columns[-1]).agg(F.count("*").alias("n")).where("n > 1").select(columns[-1])
    once, rest = edges.join(several, columns[-1], "left_anti"), edges.join(several, columns[-1], "left_semi")
    made = lambda e: _fanned(before, e, columns[-2], "inner").select(columns[0], columns[-1])
    return made(once).unionByName(made(rest).distinct())


def connected(relations: Sequence[Relation], paths: Sequence[PathType], start: str = "start", end: str = "end") -> DataFrame:
    """(start, end) of all pairs that some type connects, once each.

    A type's pairs are added to those of shorter ones, of which the ones that it connects too are taken away first: these are
    walked from the shorter types' pairs.
    """
    found = None
    for p in sorted(paths, key=lambda p: len(p.steps)):
        own = type_pairs(relations, p).toDF(start, end)
        if found is not None:
            found = cut(found)
            again = instances_between(relations, p, found, start, end).select(F.col(p.columns[0]).alias(start), F.col(p.columns[-1]).alias(end)).distinct()
            own = found.join(again, [start, end], "left_anti").unionByName(own)
        found = own
    return found


def instances_between(relations: Sequence[Relation], path: PathType, pairs: DataFrame, start: str = "start", end: str = "end") -> DataFrame:
    """The self-avoiding instances of a type between the ends of known pairs: walked from these, each with its end at hand."""
    by_name, columns, last = {r.name: r for r in relations}, path.columns, len(path.steps)
    found = pairs.select(F.col(start).alias(columns[0]), F.col(end).alias(columns[last])).dropna().distinct()
    for hop, (name, aim) in enumerate(path.steps):
        edges = hop_edges(by_name[name], aim, hop, columns[hop], columns[hop + 1])
        found = found.join(edges, [columns[hop], *([columns[last]] if hop + 1 == last else [])])
        for k in range(last + 1):
            if k != hop + 1 and (k <= hop or k == last) and path.types[k] == path.types[hop + 1]:
                found = found.where(F.col(columns[hop + 1]) != F.col(columns[k]))
    return found.select(*columns)


def all_between(relations: Sequence[Relation], paths: Sequence[PathType], pairs: DataFrame, start: str = "start", end: str = "end") -> DataFrame:
    """(path, start, end) of every instance between the ends of known pairs; the work grows with the pairs, not with all instances."""
    return _ends({p.name: (instances_between(relations, p, pairs, start, end), p) for p in paths}, start, end)


def two_step_sums(relations: Sequence[Relation], path: PathType) -> DataFrame:
    """(start, n, n_middles, sum_ends): of each start's self-avoiding instances of a type of two steps with numbered ends, none of which is made.

    Ends are counted and added up for each node in the middle; if the start itself is among them, it is taken away.
    """
    if len(path.steps) != 2 or path.types[1] in (path.types[0], path.types[2]):
        raise ValueError(f"{path.name}: two steps are wanted, with another type in the middle")
    by_name = {r.name: r for r in relations}
    first, second = (hop_edges(by_name[name], aim, k, f"n{k}", f"n{k + 1}") for k, (name, aim) in enumerate(path.steps))
    found = first.join(second.groupBy("n1").agg(F.count("*").alias("a"), F.sum("n2").alias("s")), "n1").withColumn("own", F.lit(0).cast("long"))
    if path.types[0] == path.types[2]:
        itself = second.select("n1", F.col("n2").alias("n0"), F.lit(1).cast("long").alias("own"))
        found = found.drop("own").join(itself, ["n0", "n1"], "left").withColumn("own", F.coalesce("own", F.lit(0).cast("long")))
    n = F.col("a") - F.col("own")
    sums = found.groupBy(F.col("n0").alias("start")).agg(F.sum(n).alias("n"), F.count_if(n > 0).alias("n_middles"), F.sum(F.col("s") - F.col("own") * F.col("n0")).alias("sum_ends"))
    return sums.where("n > 0")


class Walks:
    """How many self-avoiding instances of path types leave each start or reach each end; none of them is made.

    A type is walked node by node, with a count for each node reached. Nodes stay beside it as long as a later node of their
    type is to come. A new node with which its type ends is not compared with those: from all continuations, those in which it
    equals one of them are taken away (it equals one at most, as they differ). Edges are materialised once; what several types
    begin with is one part of their plans.
    """

    def __init__(self, relations: Sequence[Relation], materialize: bool = True) -> None:
        self.relations = {r.name: r for r in relations}
        self.held = cut if materialize else (lambda df: df)
        self.edges: dict[tuple, DataFrame] = {}
        self.walked: dict[tuple, DataFrame] = {}

    def _step(self, path: PathType, k: int) -> DataFrame:
        name, aim = path.steps[k]
        key = (name, aim, self.relations[name].cap(aim, k))
        if key not in self.edges:
            self.edges[key] = self.held(hop_edges(self.relations[name], aim, k, "u", "v"))
        return self.edges[key].select(F.col("u").alias(f"n{k}"), F.col("v").alias(f"n{k + 1}"))

    def _reached(self, path: PathType, order: list[int], t: int) -> tuple[DataFrame, list[int]]:
        """(the t-th node of the order, kept nodes, c) and which nodes are kept."""
        node, last, types = order[t], order[t - 1], path.types
        later = {types[j] for j in order[t + 1 :]}
        before, kept = (None, []) if t == 1 else self._reached(path, order, t - 1)
        keep = [j for j in (*kept, last) if types[j] in later]
        key = (order[0], tuple(path.steps[min(a, b)] for a, b in zip(order[:t], order[1 : t + 1], strict=True)), tuple(order[: t + 1]), tuple(keep))
        if key in self.walked:
            return self.walked[key], keep
        edge = self._step(path, min(node, last))
        if types[node] == types[last]:
            edge = edge.where(F.col(f"n{node}") != F.col(f"n{last}"))
        names, sums = [f"n{j}" for j in (node, *keep)], F.sum("c").alias("c")
        added = lambda df, more=(): df.groupBy(*dict.fromkeys([f"n{last}", *[f"n{j}" for j in keep], *more])).agg(sums)
        same = [j for j in kept if types[j] == types[node]]
        if before is None:
            found = edge.withColumn("c", F.lit(1).cast("long"))
        elif types[node] in later:  # they stay, so they can be compared
            found = before.join(edge, f"n{last}")
            for j in same:
                found = found.where(F.col(f"n{j}") != F.col(f"n{node}"))
        else:
            found = added(before).join(edge, f"n{last}").select(*names, "c")
            for j in same:
                equal = added(before, (f"n{j}",)).withColumnRenamed(f"n{j}", f"n{node}").join(edge, [f"n{last}", f"n{node}"])
                found = found.unionByName(equal.select(*names, (-F.col("c")).alias("c")))
        self.walked[key] = found.groupBy(*names).agg(sums).where("c > 0")
        return self.walked[key], keep

    def counts(self, path: PathType, of: str = "start") -> DataFrame:
        """(node, n): the instances of each start, or of each end, that has any."""
        last = len(path.steps)
        order = list(range(last, -1, -1)) if of == "start" else list(range(last + 1))
        return self._reached(path, order, last)[0].select(F.col(f"n{order[-1]}").alias("node"), F.col("c").alias("n"))

    def totals(self, paths: Sequence[PathType]) -> DataFrame:
        """(path, n, n_starts, n_ends) of the types that have instances."""
        parts = []
        for p in paths:
            starts = self.counts(p).agg(F.sum("n").alias("n"), F.count("*").alias("n_starts"))
            ends = self.counts(p, "end").agg(F.count("*").alias("n_ends"))
            parts.append(starts.crossJoin(F.broadcast(ends)).select(F.lit(p.name).alias("path"), "n", "n_starts", "n_ends"))  # a row each
        return reduce(DataFrame.unionByName, parts).where("n > 0")


def subgraph(relations: Sequence[Relation], seeds: DataFrame, seed_type: str, hops: int, sample: str = "top") -> DataFrame:
    """(hop, relation, direction, head, tail, weight) of the edges that touch each hop's seeds, under its caps.

    The other ends of a hop's edges, with all its relations and directions, are the next hop's seeds of their type.
    """
    current = {seed_type: seeds.select(F.col(seeds.columns[0]).alias("node")).distinct()}
    out = []
    for hop in range(hops):
        reached: dict[str, list[DataFrame]] = {}
        for r in relations:
            weight = F.col(r.weight).cast("double") if r.weight else F.lit(1.0)
            edges = r.data.select(F.col(r.head[0]).alias("head"), F.col(r.tail[0]).alias("tail"), weight.alias("weight")).dropna().groupBy("head", "tail").agg(F.sum("weight").alias("weight"))
            for aim in ("Head", "Tail"):
                (_, a), (_, b) = r.ends(aim)
                cap = r.cap(aim, hop)
                if cap == 0 or a not in current:
                    continue
                near, far = ("head", "tail") if aim == "Head" else ("tail", "head")
                new = edges.join(current[a].withColumnRenamed("node", near), near, "left_semi")
                if cap > 0:
                    new = top_n(new, [near], ["weight"], [far], cap) if sample == "top" else random_n(new, [near], [far], cap)
                out.append(new.select(F.lit(hop + 1).alias("hop"), F.lit(r.name).alias("relation"), F.lit(f"Aim_{aim}").alias("direction"), "head", "tail", "weight"))
                reached.setdefault(b, []).append(new.select(F.col(far).alias("node")))
        current = {t: reduce(DataFrame.unionByName, parts).distinct() for t, parts in reached.items()}
    return reduce(DataFrame.unionByName, out)


def induced(edges: DataFrame, batch: DataFrame, hops: int) -> DataFrame:
    """(hop, head, tail, head_local, tail_local): edges reached from a batch hop by hop, with the subgraph's own node numbers."""
    return induced_batches(edges, batch.select(F.lit(0).alias("batch"), F.col(batch.columns[0]).alias("node")), hops).drop("batch")


def induced_batches(edges: DataFrame, batches: DataFrame, hops: int, caps: Sequence[int] = ()) -> DataFrame:
    """The same for all batches (batch, node) at once, with ``batch`` in front: one search whose frontier carries the batch.

    caps: at most so many edges of a head in each batch, by hop; a batch draws its own. A batch's result does not depend on
    which other batches are searched with it.
    """
    seeds, parts = batches.select("batch", F.col("node").alias("head")).distinct(), []
    edges = edges.select("head", "tail").distinct()
    for hop in range(1, hops + 1):
        new = edges.join(seeds, "head").select("batch", "head", "tail")
        if hop <= len(caps):
            new = random_n(new, ["batch", "head"], ["tail"], caps[hop - 1])
        parts.append(new.withColumn("hop", F.lit(hop)))
        seeds = new.select("batch", F.col("tail").alias("head")).distinct()
    found = reduce(DataFrame.unionByName, parts).groupBy("batch", "head", "tail").agg(F.min("hop").alias("hop"))
    nodes = found.select("batch", F.col("head").alias("node")).union(found.select("batch", "tail"))
    local = dense_index(nodes, "batch", "node")
    found = found.join(local.select("batch", F.col("node").alias("head"), F.col("idx").alias("head_local")), ["batch", "head"])
    found = found.join(local.select("batch", F.col("node").alias("tail"), F.col("idx").alias("tail_local")), ["batch", "tail"])
    return found.select("batch", "hop", "head", "tail", "head_local", "tail_local")

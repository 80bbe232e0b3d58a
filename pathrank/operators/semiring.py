"""Aggregates over all instances of a path without a table of them: elimination in semirings.

A table of partial instances is kept *folded*: a row for each value of the columns that are still needed, with the
number of instances that it stands for (``_c``) and, for each feature that is asked for, their sum, minimum, maximum
and, where missing values do not count, the number of values. Joining two folded tables multiplies: counts are
multiplied, a sum is multiplied by the other side's count, minima and maxima stay. Dropping columns adds: counts and
sums are added up, the smallest minimum and the largest maximum are kept.

Hops whose columns nobody else needs are eliminated from the end of the path: each becomes a *message* to the hop that
brings its heads, a row for each head, so that the instances behind a head are never enumerated. A hop is kept out
of that where a predicate, an attribute or another hop needs its columns beside those of earlier hops; such hops are joined in
order, and columns are dropped as soon as nothing needs them. With inner joins, messages carry the columns that the result
is grouped by besides the starts: a row for each head and value of theirs. Several relations of a hop are a product, and a nested path
is folded to the ends of its hop. A cap on whole paths needs instances: up to the last such hop they are built.

Left joins keep a head without continuation as one instance with nulls, unless a predicate rejects it, and a head all of
whose continuations fail the predicate is lost: messages keep such heads with a count of 0.

The same elimination with sets instead of counts answers which start nodes have an instance (``starts``): messages
are semi-joins. ``reduced`` uses them in both directions, so that instances can be built from rows that all take part.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathrank.operators.aggregate import aggregate_features
from pathrank.operators.path import find_paths
from pathrank.plans.spec import Edge, Hop, Nested, NodeAttributes, PathSpec, Relation, bound
from pathrank.sources.catalog import GraphCatalog
from pathrank.sources.scan import edge_scan, node_scan, restricted
from pathrank.sources.shared import cut


@dataclass(frozen=True)
class Value:
    """A feature whose aggregates are asked for: its element, its name, and the path's column that brings it.

    ``table``: the node table (data, id, feature) that ``column``'s nodes are looked up in; None for an edge's feature.
    """

    element: str
    name: str
    column: str
    table: tuple[DataFrame, str, str] | None = None


@dataclass(frozen=True)
class Folded:
    """Partial instances: a row for each combination of ``columns``; ``_c`` and the parts of ``values`` (by number)."""

    df: DataFrame
    columns: tuple[str, ...]
    values: tuple[int, ...] = ()


class _Ring:
    """How instances are added and multiplied: with counts and the asked aggregates, or (``sets``) only whether there are any."""

    def __init__(self, functions: Sequence[str] = (), missing: str = "zero", sets: bool = False) -> None:
        if missing not in ("zero", "ignore"):
            raise ValueError(f"missing is zero or ignore, not {missing}")
        wanted = set(functions)
        self.sets, self.missing = sets, missing
        self.parts = [p for p, of in (("s", {"AVG", "SUM"}), ("n", {"AVG"} if missing == "ignore" else set()), ("lo", {"MIN"}), ("hi", {"MAX"})) if wanted & of]
        if missing == "ignore" and "SUM" in wanted and "n" not in self.parts:
            self.parts.append("n")  # a sum of no value is null

    def lift(self, f: Folded, number: int, value: Column) -> Folded:
        """Takes a column's value into the annotation."""
        x = F.coalesce(value.cast("double"), F.lit(0.0)) if self.missing == "zero" else value.cast("double")
        made = {"s": F.coalesce(x, F.lit(0.0)) * F.col("_c"), "n": F.when(x.isNull(), F.lit(0)).otherwise(F.col("_c")), "lo": F.when(F.col("_c") > 0, x), "hi": F.when(F.col("_c") > 0, x)}
        return replace(f, df=f.df.withColumns({f"_{p}_{number}": made[p] for p in self.parts}), values=(*f.values, number))

    def added(self, f: Folded, columns: Sequence[str]) -> Folded:
        """Drops all columns but these."""
        columns = tuple(c for c in f.columns if c in set(columns))
        if self.sets:
            return Folded(f.df.select(*columns).distinct(), columns)
        sums = [F.sum("_c").alias("_c")] + [{"s": F.sum, "n": F.sum, "lo": F.min, "hi": F.max}[p](f"_{p}_{v}").alias(f"_{p}_{v}") for v in f.values for p in self.parts]
        return Folded(f.df.groupBy(*columns).agg(*sums) if columns else f.df.agg(*sums), columns, f.values)

    def zeroed(self, f: Folded, holds: Column) -> Folded:
        """Rows that do not hold stand for no instance any more, but stay."""
        change = {"_c": F.when(holds, F.col("_c")).otherwise(0)}
        for v in f.values:
            change |= {f"_{p}_{v}": F.when(holds, F.col(f"_{p}_{v}")).otherwise(F.lit(0.0 if p == "s" else 0) if p in "sn" else F.lit(None)) for p in self.parts}
        return replace(f, df=f.df.withColumns(change))

    def times(self, a: Folded, b: Folded, on: Sequence[str], how: str, default: bool = True) -> Folded:
        """The join; where ``b`` has no row (left joins), it stands for one instance of nulls, if ``default``."""
        extra = [c for c in b.columns if c not in on]
        columns = (*a.columns, *[c for c in extra if c not in a.columns])
        if self.sets:
            return Folded(a.df.join(b.df.select(*on, *extra), list(on), how), columns)
        names = {"_c": "_d", **{f"_{p}_{v}": f"_{p}_{v}" for v in b.values for p in self.parts}}
        joined = a.df.join(b.df.select(*on, *extra, *[F.col(c).alias(n) for c, n in names.items()]), list(on), "inner" if how == "left" and not default else how)
        other, own = F.coalesce("_d", F.lit(1)), F.col("_c")
        zero = self.missing == "zero"
        out: dict[str, Column] = {}
        for v in a.values:
            alive = {"lo": F.when(other > 0, F.col(f"_lo_{v}")), "hi": F.when(other > 0, F.col(f"_hi_{v}"))}
            out |= {f"_{p}_{v}": alive[p] if p in alive else F.col(f"_{p}_{v}") * other for p in self.parts}
        for v in b.values:
            nothing = {"s": F.lit(0.0), "n": F.lit(0).cast("long"), "lo": F.lit(0.0) if zero else F.lit(None).cast("double"), "hi": F.lit(0.0) if zero else F.lit(None).cast("double")}
            for p in self.parts:
                mine = F.when(F.col("_d").isNull(), nothing[p]).otherwise(F.col(f"_{p}_{v}"))
                out[f"_{p}_{v}"] = mine * own if p in ("s", "n") else F.when(own > 0, mine)
        joined = joined.withColumns(out | {"_c": own * other}).drop("_d")
        return Folded(joined, columns, (*a.values, *b.values))


_NAME = re.compile(r"[A-Za-z_]\w*")


def _mentioned(predicate: str | None, columns: Iterable[str]) -> set[str]:
    """The columns whose names stand in a predicate, outside its string literals."""
    words = {w.lower() for w in _NAME.findall(re.sub(r"'[^']*'", " ", predicate or ""))}
    return {c for c in columns if c.lower() in words}


def _attributes(node: NodeAttributes) -> list[str]:
    return [f"{node.position.column}_{f}" for f in node.features]


def _brought(hop: Hop) -> list[str]:
    """The columns that a hop brings: tails, positions and edge features of its relations, attributes."""
    found = [p.column for p in hop.tails]
    for r in hop.relations:
        if isinstance(r.what, Edge):
            found += [f"Edge_{r.what.index}_{f}" for f in r.what.features]
        elif r.how != "left_anti":
            for inner in r.what.path.hops:
                found += [p.column for p in inner.heads if p not in hop.heads] + [c for c in _brought(inner)]
    return list(dict.fromkeys([*found, *[a for n in hop.nodes for a in _attributes(n)]]))


class _Elimination:
    def __init__(self, graph: GraphCatalog, spec: PathSpec, values: Sequence[Value], ring: _Ring, partitions: Sequence | None, carried: Sequence[str] = (), parts: int | None = None) -> None:
        """carried: kept columns that messages may bring; parts: tasks that rows are dealt to before they are multiplied and added."""
        self.carried, self.parts = (set(carried) if spec.hop_join == "inner" else set()), parts
        self.graph, self.spec, self.values, self.ring, self.partitions = graph, spec, values, ring, partitions
        self.heads = [p.column for p in spec.start]
        self.brought = [_brought(h) for h in spec.hops]
        self.every = list(dict.fromkeys([*self.heads, *[c for cs in self.brought for c in cs]]))
        self.origin = {c: 0 for c in self.heads}
        for k, columns in enumerate(self.brought):
            for c in columns:
                self.origin.setdefault(c, k)
        self.parent = [None, *[self._parent(h) for h in spec.hops[1:]]]

    def _parent(self, hop: Hop) -> int | None:
        """The hop that brings all heads of this one, if it is one."""
        origins = {self.origin[p.column] for p in hop.heads}
        return origins.pop() if len(origins) == 1 else None

    def key(self, df: DataFrame) -> list[str]:
        return [self.graph.partition_key] if self.graph.partition_key and self.graph.partition_key in df.columns else []

    def dealt(self, f: Folded, columns: Sequence[str]) -> Folded:
        return replace(f, df=f.df.repartition(self.parts, *columns)) if self.parts else f

    # ---- what a hop needs

    def uses(self, k: int) -> set[str]:
        """Columns of earlier hops or of its own that hop k's joins, attributes and predicate mention."""
        hop = self.spec.hops[k]
        return {p.column for p in hop.heads} | {n.position.column for n in hop.nodes} | _mentioned(hop.limit, self.every)

    def detached(self, keep: Sequence[str]) -> set[int]:
        """The hops that are eliminated into messages."""
        found: set[int] = set()
        for k in range(len(self.spec.hops) - 1, 0, -1):
            hop, own = self.spec.hops[k], set(self.brought[k])
            local = own | ({p.column for p in hop.heads} if self.spec.hop_join == "inner" else set())
            children = [j for j in range(k + 1, len(self.spec.hops)) if self.parent[j] == k]
            others = [j for j in range(len(self.spec.hops)) if j != k and j not in found]
            if (
                self.parent[k] is not None
                and all(j in found for j in children)
                and not own & set(keep) - self.carried
                and not any(own & self.uses(j) for j in others)
                and _mentioned(hop.limit, self.every) <= local
                and all(n.position.column in local and (n.how == "left" or self.spec.hop_join == "inner") for n in hop.nodes)
                and not hop.sample
            ):
                found.add(k)
        return found

    # ---- the rows of a hop

    def rows(self, k: int, need: set[str], targets: DataFrame | None) -> Folded:
        """All relations of hop k at once, folded to its heads and tails and to what is needed besides."""
        hop = self.spec.hops[k]
        ends = [p.column for p in (*hop.heads, *hop.tails)]
        found: Folded | None = None
        for r in hop.relations:
            if found is not None and bound(hop, r, found.columns):
                inner = self.asked_of(r, ends)
                nested = _Elimination(self.graph, flattened(r.what.path), self.values, self.ring, self.partitions)
                if r.how == "inner":
                    found = nested.folded([*found.columns, *ends, *need], inner, targets, found)
                    continue
                on = [p.column for p in (*hop.heads, *hop.tails) if p.column in found.columns and p in r.what.path.positions()] + self.key(found.df)
                pairs = found.df.select(*on).distinct()
                new = nested.folded([*ends, *need], inner, targets, Folded(pairs if self.ring.sets else pairs.withColumn("_c", F.lit(1).cast("long")), tuple(on)))
            elif isinstance(r.what, Edge):
                df = edge_scan(self.graph, r.what, targets, self.partitions)
                asked = {v.column for v in self.values}
                columns = [c for c in df.columns if c in ends or c in need or c in asked or c in self.key(df)]
                new = Folded(df.select(*columns, *([] if self.ring.sets else [F.lit(1).cast("long").alias("_c")])), tuple(columns))
            else:
                new = _Elimination(self.graph, flattened(r.what.path), self.values, self.ring, self.partitions).folded([*ends, *need], self.asked_of(r, ends), targets)
            if found is None:
                found = new
                continue
            on = [c for c in ends if c in found.columns and c in new.columns] + [c for c in self.key(found.df) if c in new.columns]
            found = replace(found, df=found.df.join(new.df.select(*on).distinct(), on, "left_anti")) if r.how == "left_anti" else self.ring.times(found, new, on, r.how)
        return found

    def asked_of(self, r: Relation, ends: Sequence[str]) -> list[int]:
        """The values that a nested path brings."""
        return [i for i, v in enumerate(self.values) if r.how != "left_anti" and v.column in {c for h in r.what.path.hops for c in _brought(h)} and v.column not in ends]

    def attached(self, f: Folded, k: int, nodes: Sequence[NodeAttributes] | None = None) -> Folded:
        """With the attributes of hop k's nodes, or of these of them."""
        for node in self.spec.hops[k].nodes if nodes is None else nodes:
            side = node_scan(self.graph, node, self.partitions)
            on = [node.position.column] + [c for c in self.key(f.df) if c in side.columns]
            f = replace(f, df=f.df.join(side, on, node.how), columns=(*f.columns, *_attributes(node)))
        return f

    def lifted(self, f: Folded, numbers: Sequence[int]) -> Folded:
        """Looks up the values of these numbers, each node table once, and takes them into the annotation."""
        tables: dict[tuple, list[int]] = {}
        for i in numbers:
            value = self.values[i]
            if value.table is None:
                f = self.ring.lift(f, i, F.col(value.column))
            else:
                tables.setdefault((id(value.table[0]), value.table[1], value.column), []).append(i)
        for (_, id_column, column), own in tables.items():
            side = self.values[own[0]].table[0].select(F.col(id_column).alias(column), *[F.col(self.values[i].table[2]).alias(f"_x_{i}") for i in own]).dropDuplicates([column])
            f = replace(f, df=f.df.join(side, column, "left"))
            for i in own:
                f = self.ring.lift(f, i, F.col(f"_x_{i}"))
            f = replace(f, df=f.df.drop(*[f"_x_{i}" for i in own]))
        return f

    def own_values(self, k: int, numbers: Sequence[int], f: Folded) -> list[int]:
        return [i for i in numbers if i not in f.values and self.values[i].column in f.columns and self.origin.get(self.values[i].column, -1) == k]

    # ---- messages

    def nulls_pass(self, k: int, gone: set[int]) -> bool:
        """Whether a head without continuation stands for an instance: hop k's predicate, and those below, hold on nulls."""
        if self.spec.hop_join == "inner":
            return False
        hop = self.spec.hops[k]
        if hop.limit:
            schema = {f.name: f.dataType.simpleString() for f in self.attached(self.rows(k, set(self.every), None), k).df.schema}
            one = self.graph.edges[next(self.spec.edges()).table].data.sparkSession.sql("SELECT " + ", ".join(f"cast(null AS {t}) AS `{c}`" for c, t in schema.items()))
            if not one.select(F.coalesce(F.expr(hop.limit), F.lit(False)).alias("x")).first()["x"]:  # one row that Spark makes up: no job
                return False
        return all(self.nulls_pass(j, gone) for j in gone if self.parent[j] == k)

    def message(self, k: int, numbers: Sequence[int], gone: set[int]) -> Folded:
        """What hop k and all below it amount to for each of its heads; heads without an instance have a count of 0."""
        hop = self.spec.hops[k]
        need = self.uses(k) | self.carried | {c for j in gone if self.parent[j] == k for c in self.uses(j)}
        f = self.attached(self.rows(k, need, None), k)
        f = self.lifted(f, self.own_values(k, numbers, f))
        if hop.limit:
            holds = F.coalesce(F.expr(hop.limit), F.lit(False))
            f = replace(f, df=f.df.where(holds)) if self.spec.hop_join == "inner" or self.ring.sets else self.ring.zeroed(f, holds)
        f = self.with_messages(f, k, numbers, gone)
        heads = [p.column for p in hop.heads] + self.key(f.df)
        return self.ring.added(self.dealt(f, heads), [*heads, *self.carried])

    def with_messages(self, f: Folded, k: int, numbers: Sequence[int], gone: set[int]) -> Folded:
        """Multiplied by the messages of the hops that hang on hop k."""
        for j in sorted(gone):
            if self.parent[j] != k:
                continue
            m, default = self.message(j, numbers, gone), self.nulls_pass(j, gone)
            on = [p.column for p in self.spec.hops[j].heads] + [c for c in self.key(f.df) if c in m.columns]
            if not self.ring.sets:
                f = self.ring.times(self.dealt(f, on), m, on, self.spec.hop_join, default)
            elif not default:
                f = replace(f, df=f.df.join(m.df.select(*on).distinct(), on, "left_semi"))
            else:  # heads stay unless they have continuations and all of them fail
                every = self.rows(j, set(), None).df.select(*on).distinct()
                f = replace(f, df=f.df.join(every.join(m.df.select(*on), on, "left_anti"), on, "left_anti"))
        return f

    # ---- the whole path

    def folded(self, keep: Sequence[str], numbers: Sequence[int], targets: DataFrame | None, within: Folded | None = None) -> Folded:
        """The path folded to the columns ``keep`` (and the partition key), with the values of these numbers.

        within: partial instances that have the start and maybe further positions already; only what agrees with them is joined.
        """
        held = set() if within is None else set(within.columns) & set(self.every)
        hops, built = self.spec.hops, max((k for k, h in enumerate(self.spec.hops) if h.sample), default=-1)
        gone = {k for k in self.detached(keep) if k > built}
        f: Folded | None = within
        if built >= 0:  # a cap on whole paths: instances up to there
            prefix = replace(self.spec, hops=hops[: built + 1])
            attributes = {a for h in hops[: built + 1] for n in h.nodes for a in _attributes(n)}
            if any(attributes & self.uses(k) for k in range(built + 1, len(hops))):
                prefix, built = self.spec, len(hops) - 1
                gone = set()
            df = find_paths(self.graph, prefix, targets, self.partitions)
            f = Folded(df if self.ring.sets else df.withColumn("_c", F.lit(1).cast("long")), tuple(df.columns))
            f = self.lifted(f, [i for i in numbers if self.values[i].column in f.columns])
            for k in range(built + 1):
                f = self.with_messages(f, k, numbers, gone)
        for k in range(built + 1, len(hops)):
            if k in gone:
                continue
            hop, heads = hops[k], [p.column for p in hops[k].heads]
            later = {c for j in range(k, len(hops)) for c in self.uses(j)}
            new = self.rows(k, later | set(keep), targets if k == 0 else None)
            early: list[NodeAttributes] = []
            if f is not None:  # the path has more rows than the hop
                early = [n for n in hop.nodes if n.position in hop.tails and n.position.column in new.columns and n.position.column not in held and (n.how == "left" or self.spec.hop_join == "inner")]
                new = self.attached(new, k, early)
                if not self.ring.sets:
                    new = self.lifted(new, [i for i in self.own_values(k, numbers, new) if self.values[i].column not in f.columns])
            if f is None:
                shared = [c for c in heads if targets is not None and c in targets.columns]
                f = replace(new, df=restricted(new.df, targets, shared)) if shared else new
            else:
                also = [c for c in new.columns if c in held and c not in heads]
                f = self.ring.times(f, new, heads + also + [c for c in self.key(f.df) if c in new.columns], "inner" if k == 0 or also else self.spec.hop_join)
            f = self.attached(f, k, [n for n in hop.nodes if n not in early])
            f = self.lifted(f, self.own_values(k, numbers, f))
            if hop.limit:
                f = replace(f, df=f.df.where(F.expr(hop.limit)))
            f = self.with_messages(f, k, numbers, gone)
            left = {c for j in range(k + 1, len(hops)) if j not in gone for c in self.uses(j)} | set(keep) | set(self.key(f.df))
            if k + 1 < len(hops) and not set(f.columns) <= left:
                f = self.ring.added(f, list(left))
        f = f if self.ring.sets else replace(f, df=f.df.where("_c > 0"))
        return self.ring.added(self.dealt(f, [c for c in self.heads if c in keep]), [*keep, *self.key(f.df)])


def flattened(spec: PathSpec) -> PathSpec:
    """With inner joins, a hop that is nothing but a nested path is replaced by that path's hops, which are eliminated one by one."""
    for k, hop in enumerate(spec.hops):
        inner = hop.relations[0].what.path if len(hop.relations) == 1 and isinstance(hop.relations[0].what, Nested) else None
        if inner is None or not (spec.hop_join == inner.hop_join == "inner") or hop.sample or any(h.sample or h.nodes for h in inner.hops) or set(inner.start) != set(hop.heads):
            continue
        last = inner.hops[-1]
        limit = " and ".join(f"({x})" for x in (last.limit, hop.limit) if x) or None
        flat = replace(spec, hops=(*spec.hops[:k], *inner.hops[:-1], replace(last, nodes=hop.nodes, limit=limit), *spec.hops[k + 1 :]))
        try:
            return flattened(flat.validate())
        except ValueError:  # a position comes up twice
            continue
    return spec


def _values(spec: PathSpec, tables: dict[str, tuple[DataFrame, str, Sequence[str]]]) -> list[Value]:
    found = []
    for p in spec.positions():
        if p.type in tables and p not in spec.start:
            data, id_column, features = tables[p.type]
            found += [Value(f"Node___{p.type}___{p.index}", f, p.column, (data, id_column, f)) for f in features]
    for e in spec.edges():
        found += [Value(f"Edge___{e.table}___{e.index}", f"Edge_{e.index}_{f}", f"Edge_{e.index}_{f}") for f in e.features]
    return found


def fold_path(graph: GraphCatalog, spec: PathSpec, values: Sequence[Value], functions: Sequence[str], missing: str = "zero", targets: DataFrame | None = None, partitions: Sequence | None = None, by: Sequence[str] = (), parts: int | None = None) -> DataFrame:
    """A row for each start node (and partition): ``COUNT_All`` and ``FUNC_feature__element`` over all instances.

    It equals ``find_paths`` followed by ``aggregate_features``, and holds all elements in one table. ``by``: further columns
    of the path, each combination of which has a row of its own; best of few values, as messages have a row for each of them and each
    head. ``parts``: tasks that rows are dealt to, by heads or starts, instead of being summed before they are shuffled.
    """
    spec.validate()
    ring = _Ring(functions, missing)
    start = [p.column for p in spec.start] + list(by)
    f = _Elimination(graph, flattened(spec), values, ring, partitions, by, parts).folded(start, range(len(values)), targets)
    out = []
    for i, v in enumerate(values):
        if i not in f.values:
            raise ValueError(f"{spec.name}: {v.column} is not on the path")
        n = F.col(f"_n_{i}") if missing == "ignore" and "n" in ring.parts else F.col("_c")
        made = {"AVG": lambda i=i, n=n: F.try_divide(F.col(f"_s_{i}"), n), "SUM": lambda i=i, n=n: F.when(n > 0, F.col(f"_s_{i}")), "MIN": lambda i=i: F.col(f"_lo_{i}"), "MAX": lambda i=i: F.col(f"_hi_{i}")}
        out += [made[fn]().alias(f"{fn}_{v.name}__{v.element}") for fn in functions if fn != "COUNT"]
    return f.df.select(*f.columns, *out, F.col("_c").alias("COUNT_All"))


def aggregate_spec(graph: GraphCatalog, spec: PathSpec, tables: dict[str, tuple[DataFrame, str, Sequence[str]]], functions: Sequence[str], missing: str = "zero", targets: DataFrame | None = None, partitions: Sequence | None = None) -> dict[str, DataFrame]:
    """As ``aggregate_path`` over the path's instances, without building them; start nodes' own features are left out.

    The results are parts of one folded table, which is materialised, so that the path is searched once.
    """
    values = _values(spec, tables)
    whole = cut(fold_path(graph, spec, values, functions, missing, targets, partitions))
    made = {f"{fn}_{v.name}__{v.element}" for fn in functions for v in values} | {"COUNT_All"}
    keys, out = [c for c in whole.columns if c not in made], {}
    for element in dict.fromkeys(v.element for v in values):
        columns = [F.col(f"{fn}_{v.name}__{element}").alias(f"{fn}_{v.name}") for fn in functions if fn != "COUNT" for v in values if v.element == element]
        out[element] = whole.select(*keys, *columns, *([F.col("COUNT_All")] if "COUNT" in functions else []))
    return out


def fold_weights(graph: GraphCatalog, spec: PathSpec, node: str, weight: str, functions: Sequence[str] = ("AVG", "SUM", "MAX", "MIN", "COUNT"), targets: DataFrame | None = None, partitions: Sequence | None = None, parts: int | None = None) -> DataFrame:
    """As ``weight_aggregate``: an edge's weights summed per start and ``node``, then aggregated per start; no instance is made."""
    sums = fold_path(graph, spec, [Value("w", weight, weight)], ["SUM"], targets=targets, partitions=partitions, by=[node], parts=parts)
    start = [c for c in sums.columns if c not in (node, f"SUM_{weight}__w", "COUNT_All")]
    return aggregate_features(sums.withColumnRenamed(f"SUM_{weight}__w", weight).where(F.col(node).isNotNull()), start, [weight], functions)


def starts(graph: GraphCatalog, spec: PathSpec, targets: DataFrame | None = None, partitions: Sequence | None = None) -> DataFrame:
    """The start nodes (and partitions) that have an instance, by semi-joins from the end of the path."""
    spec.validate()
    return _Elimination(graph, flattened(spec), (), _Ring(sets=True), partitions).folded([p.column for p in spec.start], (), targets).df


def reduced(graph: GraphCatalog, spec: PathSpec, targets: DataFrame | None = None, partitions: Sequence | None = None, keep: bool = True) -> list[DataFrame]:
    """The rows of each hop that take part in an instance, for paths with inner joins: a full reducer.

    Backward semi-joins take the rows without continuation, forward ones those that no start leads to; predicates that a hop's own
    columns decide are applied before, others are not. ``keep``: each hop's rows are materialised after each pass,
    as they are read twice.
    """
    spec.validate()
    if spec.hop_join != "inner":
        raise ValueError(f"{spec.name}: a left join keeps rows without continuation")
    e = _Elimination(graph, spec, (), _Ring(sets=True), partitions)
    held = (lambda df: cut(df)) if keep else (lambda df: df)
    rows = []
    for k, hop in enumerate(spec.hops):
        f = e.rows(k, set(e.every), targets if k == 0 else None)
        if k == 0 and targets is not None and (shared := [c for c in e.heads if c in targets.columns]):
            f = replace(f, df=restricted(f.df, targets, shared))
        own = set(f.columns)
        inner = [n for n in hop.nodes if n.position.column in own]
        with_nodes = f.df
        for node in inner:
            side = node_scan(graph, node, partitions)
            with_nodes = with_nodes.join(side, [node.position.column] + [c for c in e.key(with_nodes) if c in side.columns], node.how)
        if hop.limit and _mentioned(hop.limit, e.every) <= set(with_nodes.columns):
            with_nodes = with_nodes.where(F.expr(hop.limit))
        rows.append(held(with_nodes.select(*f.columns)))
    linked = [(k, p) for k, p in enumerate(e.parent) if p is not None and not any(h.sample for h in spec.hops[: k + 1])]

    def semi(a: int, b: int, heads: list[str]) -> None:
        on = heads + [c for c in e.key(rows[a]) if c in rows[b].columns]
        if set(on) <= set(rows[a].columns):
            rows[a] = held(rows[a].join(rows[b].select(*on).distinct(), on, "left_semi"))

    for k, p in reversed(linked):
        semi(p, k, [c.column for c in spec.hops[k].heads])
    for k, p in linked:
        semi(k, p, [c.column for c in spec.hops[k].heads])
    return rows


def find_reduced(graph: GraphCatalog, spec: PathSpec, targets: DataFrame | None = None, partitions: Sequence | None = None, keep: bool = True) -> DataFrame:
    """``find_paths`` of a path with inner joins, built from reduced hops: no join makes a row that no instance needs.

    Where a predicate spans hops, rows that only it rejects are still made.
    """
    return find_paths(graph, spec, targets, partitions, hop_rows=reduced(graph, spec, targets, partitions, keep))

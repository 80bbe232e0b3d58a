"""Path instances: hops, conjunctions, nested paths, attributes, predicates and caps, as one lazy plan."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathrank.operators.hubs import hub_join
from pathrank.operators.sampling import capped
from pathrank.plans.shared import canonical, shared
from pathrank.plans.spec import Edge, Hop, Nested, NodeAttributes, PathSpec, bound
from pathrank.sources.catalog import GraphCatalog
from pathrank.sources.manifest import content_versions, resumed
from pathrank.sources.scan import edge_scan, node_scan, restricted
from pathrank.sources.shared import cut


#: Finds the instances of a path, given the targets that its start may be restricted to.
Search = Callable[[PathSpec, DataFrame | None], DataFrame]


def _key(graph: GraphCatalog, df: DataFrame) -> list[str]:
    return [graph.partition_key] if graph.partition_key and graph.partition_key in df.columns else []


def relation(graph: GraphCatalog, hop: Hop, targets: DataFrame | None, partitions: Sequence | None, reduce: bool, nested: Search | None = None) -> DataFrame:
    """The rows of a hop: all its relations hold on its heads and tails (and partition).

    A nested path beside others is searched between the ends that these have, so that none of its instances between other
    ends is made.
    """
    found: DataFrame | None = None
    for r in hop.relations:
        if found is not None and bound(hop, r, found.columns):
            inner = r.what.path
            if r.how == "inner":
                new = find_paths(graph, inner, targets, partitions, reduce, nested=nested, within=found)
                on = [p.column for p in (*hop.heads, *hop.tails) if p in inner.positions() and p.column in found.columns] + _key(graph, found)
                found = new.select(*dict.fromkeys([*on, *found.columns, *new.columns]))  # as a join has them: caps hash columns in order
                continue
            ends = [p.column for p in (*hop.heads, *hop.tails) if p in inner.positions() and p.column in found.columns]
            new = find_paths(graph, inner, targets, partitions, reduce, nested=nested, within=found.select(*ends, *_key(graph, found)).distinct())
        elif isinstance(r.what, Edge):
            new = edge_scan(graph, r.what, targets, partitions)
        elif isinstance(r.what, Nested):
            new = nested(r.what.path, targets) if nested else find_paths(graph, r.what.path, targets, partitions, reduce)
        if found is None:
            found = new
            continue
        ends = [p.column for p in (*hop.heads, *hop.tails) if p.column in found.columns and p.column in new.columns]
        on = ends + [k for k in _key(graph, found) if k in new.columns]
        found = found.join(new.select(*on).distinct() if r.how == "left_anti" else new, on, r.how)
    return found


def find_paths(graph: GraphCatalog, spec: PathSpec, targets: DataFrame | None = None, partitions: Sequence | None = None, reduce: bool = False, hop_rows: Sequence[DataFrame] | None = None, nested: Search | None = None, spread_hubs: bool = False, materialize: int = 0, within: DataFrame | None = None, brought: Mapping[str, DataFrame] | None = None) -> DataFrame:
    """A row for each instance of the path.

    targets: start nodes (columns named like start positions) to which the search is restricted; all if None.
    reduce: restrict each further hop's edges to the tails found so far; pays off when targets are few.
    hop_rows: the rows of each hop's relations, where they are known already.
    nested: what finds the instances of nested paths, if another search than this one.
    spread_hubs: further hops' edges of nodes that have a large share of them are spread over several tasks.
    materialize: after so many hops, and again after as many, instances are written and the plan is cut; never if 0.
    within: rows that have the start and some further positions of the path already; each is joined with the instances that
    agree with it there, and keeps its other columns.
    brought: (column of a tail: rows with it, each value once, and further columns) of features that instances take along; they
    are left-joined to the edges that bring the tail, and stay behind the path's own columns. Caps do not see them.

    Attributes of a hop's tails are joined to its edges before these are joined to the path, which has more rows.
    """
    spec.validate()
    path: DataFrame | None = within
    held = set() if within is None else {p.column for p in spec.positions()} & set(within.columns)
    attributes: list[str] = []
    taken: list[str] = []
    for k, hop in enumerate(spec.hops):
        heads = [p.column for p in hop.heads]
        if k == 0:
            seeds = None if targets is None else targets
        else:
            seeds = path.select(*heads, *_key(graph, path)).distinct() if reduce else None
        new = hop_rows[k] if hop_rows else relation(graph, hop, seeds, partitions, reduce, nested)
        how = "inner" if k == 0 or held & set(new.columns) - set(heads) else spec.hop_join
        early = [n for n in hop.nodes if n.position in hop.tails and n.position.column in new.columns and n.position.column not in held and (n.how == "left" or how == "inner")]
        order = new.columns
        for node in early:
            new = _attributed(graph, new, node, partitions)
        sides = {c: (brought or {})[c] for c in (p.column for p in hop.tails) if c in (brought or {}) and c in new.columns and c not in held}
        for column, side in sides.items():
            new = new.join(side, column, "left")
        more = [c for side in sides.values() for c in side.columns if c not in sides]
        attributes += more
        taken += more
        new = new.select(*dict.fromkeys([*order, *new.columns]))
        if path is None:
            path = restricted(new, targets, [c for c in heads if targets is not None and c in targets.columns]) if targets is not None and any(c in targets.columns for c in heads) else new
        else:
            on = heads + [c for c in new.columns if c in held and c not in heads] + [c for c in _key(graph, path) if c in new.columns]
            path = hub_join(path, new, on, how) if spread_hubs else path.join(new, on, how)
        for node in hop.nodes:
            own = [f"{node.position.column}_{f}" for f in node.features]
            if node in early:  # columns as a join has them: caps hash columns in order
                path = path.select(node.position.column, *[c for c in path.columns if c != node.position.column and c not in own], *own)
            else:
                path = _attributed(graph, path, node, partitions)
            attributes += own
        if hop.limit:
            path = path.where(F.expr(hop.limit))
        if hop.sample:
            start = [p.column for p in spec.start]
            path = capped(path, start + _key(graph, path), [c for c in path.columns if c not in start and c not in attributes], hop.sample)
        if materialize and (k + 1) % materialize == 0 and k + 1 < len(spec.hops):
            path = cut(path)
    if missing := set(brought or {}) - set(path.columns):
        raise ValueError(f"no hop has a tail {sorted(missing)}")
    own = [*_columns(graph, spec, path), *taken]
    return path.select(*own, *[c for c in (within.columns if within is not None else ()) if c not in own])


def _attributed(graph: GraphCatalog, df: DataFrame, node: NodeAttributes, partitions: Sequence | None) -> DataFrame:
    side = node_scan(graph, node, partitions)
    return df.join(side, [node.position.column] + [c for c in _key(graph, df) if c in side.columns], node.how)


def _columns(graph: GraphCatalog, spec: PathSpec, path: DataFrame) -> list[str]:
    """The columns of a path's instances in order: nodes, edge features, partition key."""
    nodes = [p.column for p in spec.positions() if p.column in path.columns]
    edges = [f"Edge_{e.index}_{f}" for e in spec.edges() for f in e.features if f"Edge_{e.index}_{f}" in path.columns]
    return [*nodes, *edges, *_key(graph, path)]


def find_all(graph: GraphCatalog, specs: Iterable[PathSpec], targets: DataFrame | None = None, partitions: Sequence | None = None) -> dict[str, DataFrame]:
    """Instances of several paths by name. Paths and nested paths that come up more than once are searched once and kept."""
    specs = list(specs)
    common, kept = shared(specs), {}

    def search(spec: PathSpec, own: DataFrame | None) -> DataFrame:
        form = canonical(spec)
        if form.spec not in common:
            return find_paths(graph, spec, own, partitions, nested=search)
        key = (form.spec, None if own is None else id(own))  # restricted to other starts it is another result
        if key not in kept:
            names = dict(form.columns)
            starts = None if own is None else own.withColumnsRenamed({c: n for c, n in names.items() if c in own.columns})
            kept[key] = (cut(find_paths(graph, form.spec, starts, partitions, nested=search)), own)
        found = kept[key][0]
        found = found.select(*[F.col(n).alias(c) for c, n in form.columns if n in found.columns], *_key(graph, found))
        return found.select(*_columns(graph, spec, found))

    return {s.name: search(s, targets) for s in specs}


def source_tables(graph: GraphCatalog, spec: PathSpec) -> list[tuple[DataFrame, list[str]]]:
    """The tables that a path reads, nested paths included, each with the columns that decide what is found."""
    found = [(graph.edges[e.table].data, [c for c in graph.edges[e.table].data.columns if c in graph.edges[e.table].ends or c in graph.edges[e.table].features or c == graph.partition_key]) for e in spec.edges()]
    for hop in spec.all_hops():
        for node in hop.nodes:
            table = graph.node(node.position.type, node.table)
            found.append((table.data, [c for c in table.data.columns if c == table.id_column or c in table.features or c == graph.partition_key]))
    return found


def stored_paths(graph: GraphCatalog, spec: PathSpec, folder: str, partitions: Sequence, spark: SparkSession, targets: DataFrame | None = None, versions: Mapping[str, str] | None = None) -> DataFrame:
    """Instances of the wanted partitions, of which only those that are not finished yet are searched.

    They are kept under the specification's fingerprint. A partition is finished if it was searched, whether it has
    instances or not, for the same targets and the same version of its source: ``versions`` (partition: version), or else a
    version by the content of the tables that the path reads.
    """
    key = graph.partition_key
    place = f"{folder.rstrip('/')}/{spec.name}-{spec.fingerprint(str(key))}"
    versions = content_versions(source_tables(graph, spec), key, partitions) if versions is None else versions
    return resumed(spark, place, key, partitions, lambda missing: find_paths(graph, spec, targets, partitions=missing), targets_state(targets), versions)


def targets_state(targets: DataFrame | None) -> str:
    """Which targets a result is for: equal sets of rows have equal states."""
    if targets is None:
        return "all"
    one = targets.select(*sorted(targets.columns)).distinct().agg(F.count("*").alias("n"), F.sum(F.xxhash64(*sorted(targets.columns)).cast("decimal(20,0)")).alias("h")).first()
    return f"{','.join(sorted(targets.columns))}:{one['n']}:{one['h']}"


def grouped_by_metapath(specs: Iterable[PathSpec]) -> dict[str, list[str]]:
    """Names of paths that go through the same node types."""
    groups: dict[str, list[str]] = {}
    for s in specs:
        groups.setdefault(s.metapath(), []).append(s.name)
    return groups


def endpoints(paths: DataFrame, spec: PathSpec, what: str = "ends", stop: str | None = None, parts: int | None = None) -> DataFrame:
    """Distinct head and tail (``ends``, up to column ``stop`` if given), ``nodes``, ``edges``, or ``all`` columns.

    parts: instances are dealt into so many before they are compared, which bounds the memory of a task; by default as many as
    shuffles have, after a first comparison that leaves most of them.
    """
    nodes = [p.column for p in spec.positions() if p.column in paths.columns]
    edges = [c for c in paths.columns if c.startswith("Edge_")]
    chosen = {"ends": [nodes[0], stop or nodes[-1]], "nodes": nodes, "edges": edges, "all": nodes + edges}[what]
    found = paths.select(*chosen)
    return (found if parts is None else found.repartition(parts, *chosen)).distinct()

"""Declarative conditional paths.

A path is a sequence of hops. A hop leads from head positions to tail positions by one relation or by several
that must hold at once; a relation is an edge table or a whole nested path. Predicates are SQL strings over
an edge's columns, a node table's columns, or the path's columns (``Type_index``, ``Edge_index_feature`` and,
for joined attributes, ``Type_index_feature``).
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field, replace


@dataclass(frozen=True, order=True)
class Position:
    type: str
    index: int

    @property
    def column(self) -> str:
        return f"{self.type}_{self.index}"


@dataclass(frozen=True)
class Sample:
    """At most ``n`` rows of a group: ``random``, ``top`` by features, or ``threshold`` (any, in a stable order)."""

    kind: str
    n: int
    features: tuple[str, ...] = ()


@dataclass(frozen=True)
class Edge:
    table: str
    index: int
    heads: tuple[tuple[Position, str], ...]  # position and the edge table's column
    tails: tuple[tuple[Position, str], ...]
    limit: str | None = None
    sample: Sample | None = None
    features: tuple[str, ...] = ()


@dataclass(frozen=True)
class Nested:
    path: PathSpec


@dataclass(frozen=True)
class Relation:
    what: Edge | Nested
    how: str = "inner"  # how it joins the relations before it: inner, left or left_anti


@dataclass(frozen=True)
class NodeAttributes:
    """Attributes of a node table joined at a position; they may be used in path predicates."""

    table: str
    position: Position
    column: str
    features: tuple[str, ...]
    how: str = "left"
    limit: str | None = None


@dataclass(frozen=True)
class Hop:
    heads: tuple[Position, ...]
    tails: tuple[Position, ...]
    relations: tuple[Relation, ...]
    nodes: tuple[NodeAttributes, ...] = ()
    limit: str | None = None
    sample: Sample | None = None


@dataclass(frozen=True)
class PathSpec:
    name: str
    hops: tuple[Hop, ...]
    hop_join: str = "left"
    features: bool = field(default=True, compare=False)

    @property
    def start(self) -> tuple[Position, ...]:
        return self.hops[0].heads

    def edges(self) -> Iterator[Edge]:
        for hop in self.hops:
            for relation in hop.relations:
                if isinstance(relation.what, Edge):
                    yield relation.what
                else:
                    yield from relation.what.path.edges()

    def all_hops(self) -> Iterator[Hop]:
        """The hops, those of nested paths included."""
        for hop in self.hops:
            yield hop
            for relation in hop.relations:
                if isinstance(relation.what, Nested):
                    yield from relation.what.path.all_hops()

    def positions(self) -> list[Position]:
        """All node positions, in the order in which they come up."""
        found: dict[Position, None] = {}
        for hop in self.hops:
            found.update(dict.fromkeys(hop.heads))
            for relation in hop.relations:
                if isinstance(relation.what, Nested):
                    found.update(dict.fromkeys(relation.what.path.positions()))
            found.update(dict.fromkeys(hop.tails))
        return list(found)

    def sequence(self) -> list[tuple[str, str, int]]:
        """Nodes and edges along the path: (kind, type or table, index)."""
        return [("Node", p.type, p.index) for p in self.positions()] + [("Edge", e.table, e.index) for e in self.edges()]

    def metapath(self) -> str:
        return "__".join(p.type for p in self.positions())

    def fingerprint(self, *more: str) -> str:
        """Names a stored result: the specification and whatever else it depends on."""
        return hashlib.md5("|".join([repr(self), *more]).encode()).hexdigest()

    def validate(self) -> PathSpec:
        if not self.hops:
            raise ValueError(f"{self.name}: a path needs a hop")
        if self.hop_join not in ("left", "inner"):
            raise ValueError(f"{self.name}: hop_join is left or inner")
        indexes = [e.index for e in self.edges()]
        if len(indexes) != len(set(indexes)):
            raise ValueError(f"{self.name}: edge indexes must be unique, nested paths included: {sorted(indexes)}")
        known = set(self.start)
        for k, hop in enumerate(self.hops):
            if not hop.relations:
                raise ValueError(f"{self.name}, hop {k}: no relation")
            if missing := set(hop.heads) - known:
                raise ValueError(f"{self.name}, hop {k}: heads not on the path yet: {sorted(missing)}")
            if again := set(hop.tails) & known:
                raise ValueError(f"{self.name}, hop {k}: tails are on the path already: {sorted(again)}")
            for j, relation in enumerate(hop.relations):
                if relation.how not in ("inner", "left", "left_anti") or (j == 0 and relation.how != "inner"):
                    raise ValueError(f"{self.name}, hop {k}: relation {j} cannot join by {relation.how}")
                if isinstance(relation.what, Nested):
                    relation.what.path.validate()
            known |= set(hop.tails)
            for relation in hop.relations:
                if isinstance(relation.what, Nested) and relation.how != "left_anti":
                    known |= set(relation.what.path.positions())
        return self

    @classmethod
    def from_json(cls, text: str | dict) -> PathSpec:
        config = json.loads(text) if isinstance(text, str) else text
        return _path(config, ()).validate()


def bound(hop: Hop, relation: Relation, columns: Iterable[str]) -> bool:
    """Whether a relation of a hop is a nested path whose instances are looked for only between ends that are there (``columns``).

    Caps on whole paths choose among all instances of a start, so that a path with such a cap is searched as it is.
    """
    if not isinstance(relation.what, Nested) or any(h.sample for h in relation.what.path.hops):
        return False
    inner, ends = relation.what.path, {*hop.heads, *hop.tails}
    clash = {p.column for p in inner.positions() if p not in ends} & set(columns)
    return {p.column for p in inner.start} <= set(columns) and set(inner.start) <= ends and not clash


def _positions(config: dict, side: str) -> tuple[Position, ...]:
    return tuple(Position(t, int(i)) for t, i in zip(config.get(f"{side}_node_types", ()), config.get(f"{side}_node_indexes", ()), strict=True))


def _sample(config: dict | None) -> Sample | None:
    if not config:
        return None
    return Sample(config["type"].lower(), int(config["count"]), tuple(config.get("features", ())))


def _edge(config: dict) -> Edge:
    if "node_schemas" in config:
        raise ValueError(f"{config['edge_table_name']}: node_schemas belong to a hop, not to an edge")
    ends = {side: tuple(zip(_positions(config, side), config[f"{side}_columns"], strict=True)) for side in ("head", "tail")}
    return Edge(config["edge_table_name"], int(config["edge_index"]), ends["head"], ends["tail"], config.get("edge_limit"), _sample(config.get("edge_sample")), tuple(config.get("feature_columns", ())))


def _path(config: dict, heads: tuple[Position, ...]) -> PathSpec:
    hops = []
    for hop in config["path_schema"]:
        own = _positions(hop, "head") or heads  # a nested path may leave its first heads to the enclosing hop
        relations = []
        for relation in hop["relation_list"]:
            if relation["relation_type"] == "edge":
                what: Edge | Nested = _edge(relation["edge_schema"])
            else:
                what = Nested(_path(relation, own))
            relations.append(Relation(what, relation.get("join_type", "inner")))
        nodes = tuple(NodeAttributes(n["node_table_name"], Position(n["node_type"], int(n["node_index"])), n["node_column"], tuple(n["feature_columns"]), n.get("join_type", "left"), n.get("node_limit")) for n in hop.get("node_schemas", ()))
        hops.append(Hop(own, _positions(hop, "tail"), tuple(relations), nodes, hop.get("path_limit"), _sample(hop.get("path_sample"))))
    return PathSpec(config["path_name"], tuple(hops), config.get("hop_join", "left"))


def chain(name: str, steps: list[tuple[Position, Edge, Position]], hop_join: str = "inner", limits: dict[int, str] | None = None, samples: dict[int, Sample] | None = None) -> PathSpec:
    """A linear path: one edge a hop, with a predicate or a cap on whole paths after some hops."""
    hops = tuple(Hop((a,), (b,), (Relation(e),), limit=(limits or {}).get(k), sample=(samples or {}).get(k)) for k, (a, e, b) in enumerate(steps))
    return PathSpec(name, hops, hop_join).validate()


def step(table: str, index: int, head: tuple[str, int, str], tail: tuple[str, int, str], **more) -> tuple[Position, Edge, Position]:
    """A step for ``chain``: (type, index, column) of both ends."""
    a, b = Position(*head[:2]), Position(*tail[:2])
    return a, replace(Edge(table, index, ((a, head[2]),), ((b, tail[2]),)), **more), b

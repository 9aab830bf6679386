"""Query graphs: named pattern nodes and edges with constraints, as the driver handles them."""

from __future__ import annotations

import copy
from dataclasses import dataclass, field
from typing import Any


class BadQuery(ValueError):
    """A request that cannot be answered; status is the HTTP status a service would give."""

    def __init__(self, message: str, status: int = 400) -> None:
        super().__init__(message)
        self.status = status


@dataclass
class QNode:
    key: str
    ids: list[str] | None = None
    categories: list[str] = field(default_factory=list)
    interpretation: str = "BATCH"
    constraints: list[dict] = field(default_factory=list)
    #: The synthetic node that holds the queried ids of this one (subclass expansion).
    superclass: str | None = None
    is_superclass: bool = False

    @property
    def pinned(self) -> bool:
        return self.ids is not None


@dataclass
class QEdge:
    key: str
    subject: str
    object: str
    predicates: list[str] = field(default_factory=list)
    qualifier_constraints: list[dict] = field(default_factory=list)
    attribute_constraints: list[dict] = field(default_factory=list)
    is_subclass: bool = False

    @property
    def ends(self) -> tuple[str, str]:
        return self.subject, self.object


@dataclass
class QueryGraph:
    nodes: dict[str, QNode]
    edges: dict[str, QEdge]

    def incident(self, node: str) -> list[QEdge]:
        return [e for e in self.edges.values() if node in e.ends]

    def without_orphans(self) -> QueryGraph:
        used = {n for e in self.edges.values() for n in e.ends}
        return QueryGraph({k: n for k, n in self.nodes.items() if k in used}, self.edges)

    def copy(self) -> QueryGraph:
        return copy.deepcopy(self)


def strip_nulls(query_graph: dict) -> dict:
    """The query graph without fields that are null in its nodes, edges and paths."""
    out = dict(query_graph)
    for part in ("nodes", "edges", "paths"):
        if isinstance(out.get(part), dict):
            out[part] = {k: {f: v for f, v in x.items() if v is not None} for k, x in out[part].items()}
    return out


def parse(query_graph: dict[str, Any]) -> QueryGraph:
    """A checked query graph of its JSON form.

    MANY is not supported (422), ALL needs ids, COLLATE must have none; edges must
    name nodes that exist (400); an empty list of ids is an error; variable-length
    paths are known but not executed.
    """
    q = strip_nulls(query_graph)
    if q.get("paths"):
        raise NotImplementedError("variable-length paths are not executed")
    nodes, edges = {}, {}
    for k, n in (q.get("nodes") or {}).items():
        how, ids = n.get("set_interpretation") or "BATCH", n.get("ids")
        if how == "MANY":
            raise BadQuery(f"node {k}: set_interpretation MANY is not supported", 422)
        if how == "ALL" and not ids:
            raise BadQuery(f"node {k}: ALL needs ids", 422)
        if how == "COLLATE" and ids:
            raise BadQuery(f"node {k}: COLLATE must not have ids", 422)
        if ids is not None and not ids:
            raise BadQuery(f"node {k}: ids is empty")
        nodes[k] = QNode(k, list(dict.fromkeys(ids)) if ids else None, list(n.get("categories") or []), how, list(n.get("constraints") or []))
    for k, e in (q.get("edges") or {}).items():
        for end in ("subject", "object"):
            if e.get(end) not in nodes:
                raise BadQuery(f"edge {k}: its {end} {e.get(end)!r} is no node of the query")
        edges[k] = QEdge(k, e["subject"], e["object"], list(e.get("predicates") or []), list(e.get("qualifier_constraints") or []), list(e.get("attribute_constraints") or []))
    return QueryGraph(nodes, edges)


def path_order(q: QueryGraph) -> list[str]:
    """Pattern nodes in the order of a walk from a node that is never an object (the first one if there is none)."""
    objects = {e.object for e in q.edges.values()}
    starts = [n for n in q.nodes if n not in objects] or list(q.nodes)[:1]
    seen: dict[str, None] = {}
    todo = starts[:1]
    while todo:
        n = todo.pop(0)
        if n in seen:
            continue
        seen[n] = None
        todo += [x for e in q.incident(n) for x in e.ends if x not in seen]
    return [*seen, *[n for n in q.nodes if n not in seen]]

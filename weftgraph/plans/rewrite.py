"""Ontology rewrites of a query graph, all on the driver."""

from __future__ import annotations

from dataclasses import dataclass, replace

from weftgraph.ontology import Ontology
from weftgraph.plans.ir import QEdge, QNode, QueryGraph
from weftgraph.schema import QUALIFIED_PREDICATE


@dataclass(frozen=True)
class Wanted:
    """Predicates of one direction: any, or those listed (none if the list is empty)."""

    any: bool = False
    names: tuple[str, ...] = ()

    @property
    def none(self) -> bool:
        return not self.any and not self.names


def expand_predicates(onto: Ontology, predicates: list[str]) -> tuple[Wanted, Wanted]:
    """(along, against): what stored edges may be called along and against the direction of the query.

    No predicate, or the one above all, means any in both directions. Queried
    predicates always count; of their descendants those that are canonical or
    symmetric. Against the direction: inverses, symmetric ones, and their descendants.
    """
    if not predicates or onto.any_predicate in predicates:
        return Wanted(any=True), Wanted(any=True)

    def below(ps: list[str]) -> Wanted:
        return Wanted(names=tuple(dict.fromkeys([*ps, *[d for p in ps for d in onto.usable_descendants(p)]])))

    against = [x for p in predicates for x in (onto.inverse(p), p if onto.is_symmetric(p) else None) if x]
    return below(predicates), below(against)


def expand_qualifiers(onto: Ontology, constraints: list[dict]) -> list[list[tuple[str, list[str]]]]:
    """Alternatives of (type, accepted values) that must all hold; [] as an alternative accepts every edge.

    A qualifier without type or value constrains what is given of it.
    """
    out = []
    for c in constraints:
        one = []
        for q in c.get("qualifier_set") or []:
            t, v = q.get("qualifier_type_id"), q.get("qualifier_value")
            values = [] if not v else onto.predicate_value_descendants(v) if t == QUALIFIED_PREDICATE else onto.value_descendants(v)
            one.append((t, values if t else [v]))
        out.append(one)
    return out


def expand_subclasses(q: QueryGraph, onto: Ontology) -> QueryGraph:
    """Pinned nodes hand their ids and categories to a superclass node that they hang below.

    Nodes on an edge that asks for the hierarchy itself are left alone.
    """
    hierarchy = {onto.subclass_of, onto.superclass_of}
    nodes, edges = {}, dict(q.edges)
    for k, n in q.nodes.items():
        if not n.pinned or any(hierarchy & set(e.predicates) for e in q.incident(k)):
            nodes[k] = n
            continue
        top = f"{k}_superclass"
        nodes[k] = replace(n, ids=None, categories=[], superclass=top)
        nodes[top] = QNode(top, n.ids, n.categories, is_superclass=True)
        edge = f"{k}_subclass_edge"
        edges[edge] = QEdge(edge, k, top, [onto.subclass_of], is_subclass=True)
    return QueryGraph(nodes, edges)

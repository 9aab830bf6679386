"""Hierarchies of predicates, categories and qualifier values.

The ontology is a parameter of a graph and small (thousands of terms), so that
patterns are rewritten by the driver and reach Spark as literal lists. tables()
gives the same facts as DataFrames for joins.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession


def _closure(children: dict[str, list[str]], root: str) -> list[str]:
    """Terms below root in breadth-first order, without root."""
    found: dict[str, None] = {}
    level = [root]
    while level:
        level = [c for t in level for c in children.get(t, []) if c != root and c not in found]
        level = list(dict.fromkeys(level))
        found.update(dict.fromkeys(level))
    return list(found)


@dataclass
class Ontology:
    """children maps a term to its direct children; inverses need to be given in one direction only."""

    symmetric: set[str] = field(default_factory=set)
    canonical: set[str] = field(default_factory=set)
    inverses: dict[str, str] = field(default_factory=dict)
    predicate_children: dict[str, list[str]] = field(default_factory=dict)
    category_children: dict[str, list[str]] = field(default_factory=dict)
    value_children: dict[str, list[str]] = field(default_factory=dict)
    any_predicate: str = "biolink:related_to"
    subclass_of: str = "biolink:subclass_of"
    superclass_of: str = "biolink:superclass_of"

    def __post_init__(self) -> None:
        self.inverses = self.inverses | {b: a for a, b in self.inverses.items() if b not in self.inverses}

    def is_symmetric(self, p: str) -> bool:
        return p in self.symmetric

    def is_canonical(self, p: str) -> bool:
        return p in self.canonical

    def inverse(self, p: str) -> str | None:
        return self.inverses.get(p)

    def descendants(self, p: str) -> list[str]:
        return _closure(self.predicate_children, p)

    def usable_descendants(self, p: str) -> list[str]:
        """Descendants that are canonical or symmetric: in others no edge is stored."""
        return [d for d in self.descendants(p) if d in self.canonical or d in self.symmetric]

    def category_descendants(self, c: str) -> list[str]:
        return _closure(self.category_children, c)

    def value_descendants(self, v: str) -> list[str]:
        return [v, *_closure(self.value_children, v)]

    def predicate_value_descendants(self, p: str) -> list[str]:
        return [p, *self.descendants(p)]

    def reversed_predicate(self, p: str) -> str | None:
        """What to look for from the other end of an edge: p itself if symmetric, its inverse, or None."""
        return p if self.is_symmetric(p) else self.inverse(p)

    def either_direction(self, predicates: Iterable[str]) -> set[str]:
        """The predicates and their inverses."""
        own = set(predicates)
        return own | {i for p in own if (i := self.inverse(p))}

    def most_specific(self, categories: list[str] | None, fallback: str) -> str:
        """The first category that is no ancestor of another one listed."""
        for c in categories or []:
            below = set(self.category_descendants(c))
            if not any(d in below for d in categories or [] if d != c):
                return c
        return fallback

    def tables(self, spark: SparkSession) -> dict[str, DataFrame]:
        """predicate, predicate_descendant, category_descendant and qualifier_value_descendant."""
        names = sorted({*self.symmetric, *self.canonical, *self.inverses, *self.predicate_children, *[c for v in self.predicate_children.values() for c in v]})
        rows = [(p, p in self.symmetric, p in self.canonical, self.inverses.get(p)) for p in names]
        pairs = lambda children: [(a, d) for a in children for d in _closure(children, a)]
        make = lambda rows, ddl: spark.createDataFrame(rows, ddl)
        return {
            "predicate": make(rows, "name string, is_symmetric boolean, is_canonical boolean, inverse string"),
            "predicate_descendant": make(pairs(self.predicate_children), "ancestor string, descendant string"),
            "category_descendant": make(pairs(self.category_children), "ancestor string, descendant string"),
            "qualifier_value_descendant": make(pairs(self.value_children), "value string, descendant string"),
        }


def closure_table(links: DataFrame, depth: int = 64) -> DataFrame:
    """(ancestor, descendant) of a table (parent, child) of any size, by joins until nothing is new (at most depth levels)."""
    from weftgraph.operators.durable import cut

    links = links.select("parent", "child").distinct()
    found = cut(links.selectExpr("parent as ancestor", "child as descendant"))
    newest = found
    for _ in range(depth):
        newest = newest.join(links, newest["descendant"] == links["parent"]).select("ancestor", links["child"].alias("descendant")).distinct()
        newest = cut(newest.join(found, ["ancestor", "descendant"], "left_anti"))
        if newest.isEmpty():
            break
        found = found.unionByName(newest)
    return found

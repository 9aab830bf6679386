"""Matches of one pattern edge.

One scan of edges serves both directions: what can match along or against the
direction of the query is one pushed-down condition, and an edge that does both
comes out twice (via_inverse tells them apart). Columns: s, o (as the query has
them), edge_idx, predicate, via_inverse.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftgraph import plugins
from weftgraph.graph import KnowledgeGraph
from weftgraph.operators.constraints import attributes_match, has_category, qualifiers_match
from weftgraph.plans.ir import QEdge, QNode
from weftgraph.plans.rewrite import Wanted, expand_predicates, expand_qualifiers

#: Queried ids that go into the plan as literals; longer lists are joined.
LITERAL_IDS = 2_000
Pins = list[str] | DataFrame | None


def _predicate_is(wanted: Wanted) -> Column:
    return F.lit(True) if wanted.any else F.col("predicate").isin(list(wanted.names)) if wanted.names else F.lit(False)


def _at(end: str, pins: Pins) -> Column:
    return F.col(end).isin(pins) if isinstance(pins, list) and len(pins) <= LITERAL_IDS else F.lit(True)


def _semi(df: DataFrame, end: str, pins: Pins) -> DataFrame:
    """Restricts an end to ids that are too many for literals."""
    if isinstance(pins, DataFrame):
        return df.join(pins.select(F.col("id").alias(end)), end, "left_semi")
    if isinstance(pins, list) and len(pins) > LITERAL_IDS:
        ids = df.sparkSession.createDataFrame([(i,) for i in pins], f"{end} string")
        return df.join(ids, end, "left_semi")
    return df


def nodes_allowed(kg: KnowledgeGraph, node: QNode, pinned: bool, filters: dict | None = None, found: DataFrame | None = None) -> DataFrame | None:
    """Ids that a pattern node may take, or None if all: categories count for unpinned nodes only, attributes always. Filters look at the ids found (id) only."""
    tests: list[Column] = []
    # What a node without a record passes, too, has to be asked of all nodes.
    passes_empty = any(c.get("not") for c in node.constraints) and not (node.categories and not pinned)
    source = kg.nodes if passes_empty else kg.node_records
    if node.categories and not pinned:
        tests.append(has_category(F.col("categories"), node.categories))
    condition = plugins.node_condition(filters)
    if condition is not None:
        source = kg.nodes_with_degrees(found)
        tests.append(condition)
    if node.constraints:
        tests.append(attributes_match(F.col("attributes"), node.constraints))
    return source.filter(reduce(and_, tests)).select("id") if tests else None


def match_edge(kg: KnowledgeGraph, edge: QEdge, s_pins: Pins = None, o_pins: Pins = None) -> DataFrame:
    """All bindings of an edge between pinned ends (None: any id), by predicates, qualifiers and attributes.

    Forward, backward and both-pinned are the same plan: ids become conditions on
    the scan, in whichever direction an edge is stored.
    """
    along, against = expand_predicates(kg.ontology, edge.predicates)
    forth = _predicate_is(along) & _at("subject", s_pins) & _at("object", o_pins)
    back = _predicate_is(against) & _at("object", s_pins) & _at("subject", o_pins)
    found = kg.edges.filter(forth if against.none else forth | back)
    if edge.subject == edge.object:
        found = found.filter(F.col("subject") == F.col("object"))
    quals = expand_qualifiers(kg.ontology, edge.qualifier_constraints)
    if quals:
        found = found.filter(qualifiers_match(F.col("qualifiers"), quals))

    def way(s: str, o: str, inverse: bool) -> Column:
        return F.struct(F.col(s).alias("s"), F.col(o).alias("o"), F.lit(inverse).alias("via_inverse"))

    if against.none:
        out = found.select(F.col("subject").alias("s"), F.col("object").alias("o"), "edge_idx", "predicate", F.lit(False).alias("via_inverse"))
    else:
        ways = F.filter(F.array(F.when(forth, way("subject", "object", False)), F.when(back, way("object", "subject", True))), lambda w: w.isNotNull())
        out = found.select(F.explode(ways).alias("w"), "edge_idx", "predicate").select("w.s", "w.o", "edge_idx", "predicate", "w.via_inverse")
    out = _semi(_semi(out, "s", s_pins), "o", o_pins)
    if edge.attribute_constraints:
        passing = kg.edge_attributes.filter(attributes_match(F.col("attributes"), edge.attribute_constraints)).select("edge_idx")
        known = kg.edge_attributes.select("edge_idx")
        if all(c.get("not") for c in edge.attribute_constraints):
            # Edges without attributes pass what is only denied.
            out = out.join(known.join(passing, "edge_idx", "left_anti"), "edge_idx", "left_anti")
        else:
            out = out.join(passing, "edge_idx", "left_semi")
    return out.select("s", "o", "edge_idx", "predicate", "via_inverse")


def match_subclass(kg: KnowledgeGraph, top_pins: Pins, depth: int) -> DataFrame:
    """Nodes at most depth hierarchy edges below pinned ones: s is the lower node, o the pinned one.

    Each pinned node is its own match (edge_idx null). A lower node comes once, with
    the first edge of the shortest way. Rounds stop at depth, so cycles do no harm.
    """
    sub = kg.ontology.subclass_of
    null = F.lit(None).cast(kg.edges.schema["edge_idx"].dataType)
    if isinstance(top_pins, list):
        tops = kg.spark.createDataFrame([(i,) for i in top_pins], "id string")  # unknown ones meet no edge
    else:
        tops = kg.nodes.select("id") if top_pins is None else top_pins.select("id")
    level = tops.select(F.col("id").alias("s"), F.col("id").alias("o"), null.alias("edge_idx"))
    found = level
    links = kg.edges.filter(F.col("predicate") == sub).select(F.col("subject").alias("child"), F.col("object").alias("s"), F.col("edge_idx").alias("e"))
    for _ in range(depth):
        below = level.select("s", "o").join(links, "s").groupBy("o", "child").agg(F.min("e").alias("edge_idx"))
        level = below.select(F.col("child").alias("s"), "o", "edge_idx").join(found.select("s", "o"), ["s", "o"], "left_anti")
        found = found.unionByName(level)
    return found.select("s", "o", "edge_idx", F.lit(sub).alias("predicate"), F.lit(False).alias("via_inverse"))


def first_of_parallel(edges: DataFrame) -> DataFrame:
    """edges with their ordinal among parallel ones (same subject, predicate and object), from 1."""
    w = Window.partitionBy("subject", "predicate", "object").orderBy("edge_idx")
    return edges.withColumn("ordinal", F.row_number().over(w))

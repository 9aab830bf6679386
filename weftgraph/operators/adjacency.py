"""Neighbours, degrees and edges between nodes, as filters that reach the scan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.graph import KnowledgeGraph


def _some(df: DataFrame, predicates: list[str] | None) -> DataFrame:
    return df if predicates is None else df.filter(F.col("predicate").isin(list(predicates)))


def out_edges(kg: KnowledgeGraph, node: str, predicates: list[str] | None = None) -> DataFrame:
    """Edges from a node, parallel ones included; an unknown predicate or node gives none."""
    return _some(kg.edges.filter(F.col("subject") == node), predicates)


def in_edges(kg: KnowledgeGraph, node: str, predicates: list[str] | None = None) -> DataFrame:
    return _some(kg.edges.filter(F.col("object") == node), predicates)


def neighbors(kg: KnowledgeGraph, node: str, predicates: list[str] | None = None, incoming: bool = False) -> DataFrame:
    """(neighbor, predicate) of each edge."""
    e, other = (in_edges(kg, node, predicates), "subject") if incoming else (out_edges(kg, node, predicates), "object")
    return e.select(F.col(other).alias("neighbor"), "predicate")


def out_edges_to(kg: KnowledgeGraph, node: str, targets: DataFrame, predicates: list[str] | None = None) -> DataFrame:
    """Edges from a node to any of targets (id)."""
    return out_edges(kg, node, predicates).join(targets.select(F.col("id").alias("object")), "object", "left_semi")


def edges_between(kg: KnowledgeGraph, subject: str, object: str, predicates: list[str] | None = None) -> DataFrame:
    return out_edges(kg, subject, predicates).filter(F.col("object") == object)


def first_edge(kg: KnowledgeGraph, subject: str, object: str, predicate: str) -> DataFrame:
    """The first of the parallel edges (one row or none)."""
    e = edges_between(kg, subject, object, [predicate])
    return e.orderBy("edge_idx").limit(1)


def edges_either_way(kg: KnowledgeGraph, a: str, b: str) -> DataFrame:
    """(direction, predicate, edge_idx): edges between two nodes; 'forward' from a to b."""
    both = kg.edges.filter(((F.col("subject") == a) & (F.col("object") == b)) | ((F.col("subject") == b) & (F.col("object") == a)))
    return both.select(F.when(F.col("subject") == a, "forward").otherwise("reverse").alias("direction"), "predicate", "edge_idx")


def with_properties(kg: KnowledgeGraph, edges: DataFrame) -> DataFrame:
    """Edges (edge_idx) with qualifiers, sources and attributes; attributes are joined last."""
    found = edges.select("edge_idx").distinct().join(kg.edges, "edge_idx")
    return found.join(kg.edge_attributes, "edge_idx", "left").withColumn("attributes", F.coalesce("attributes", F.array().cast(kg.edge_attributes.schema["attributes"].dataType)))


def node_records(kg: KnowledgeGraph, ids: DataFrame) -> DataFrame:
    """Nodes of ids (id); unknown ones are left out."""
    known = kg.edges.select(F.explode(F.array("subject", "object")).alias("id")).join(ids.select("id").distinct(), "id", "left_semi").distinct()
    empty = {c: F.coalesce(c, F.array().cast(kg.nodes.schema[c].dataType)) for c in ("categories", "attributes")}
    return kg.nodes.join(ids.select("id").distinct(), "id", "left_semi") if kg.records is None else known.join(kg.records, "id", "left").withColumns(empty)


def out_degree(kg: KnowledgeGraph, by_predicate: bool = False) -> DataFrame:
    keys = ["subject", "predicate"] if by_predicate else ["subject"]
    return kg.edges.groupBy(*keys).agg(F.count(F.lit(1)).alias("out_degree")).withColumnRenamed("subject", "id")


def degree_of(kg: KnowledgeGraph, node: str) -> int:
    """Edges in and out of a node (a loop counts twice); KeyError if there is no such node."""
    row = kg.edges.filter((F.col("subject") == node) | (F.col("object") == node)).agg(F.sum((F.col("subject") == node).cast("int") + (F.col("object") == node).cast("int"))).first()
    if row[0] is None and kg.nodes.filter(F.col("id") == node).isEmpty():
        raise KeyError(node)
    return row[0] or 0


def degrees_of(kg: KnowledgeGraph, ids: DataFrame) -> DataFrame:
    """(id, total_degree) of every given id, null for unknown ones."""
    ids = ids.select("id").distinct()
    alone = kg.node_records.select("id", F.lit(0).cast("bigint").alias("z")) if kg.records is None else kg.spark.createDataFrame([], "id string, z bigint")
    found = ids.join(kg.degrees_of(ids).select("id", "total_degree"), "id", "left").join(alone, "id", "left")
    return found.select("id", F.coalesce("total_degree", "z").alias("total_degree"))

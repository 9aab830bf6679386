"""Extension points: node filters, node enrichers, result annotators, metadata of nodes."""

from __future__ import annotations

import json
from collections.abc import Callable
from typing import TYPE_CHECKING, Any
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

if TYPE_CHECKING:
    from weftgraph.graph import KnowledgeGraph

#: A filter makes of its configuration a condition on node columns (with degrees), or None if it is not asked for.
NodeFilter = Callable[[dict], Column | None]
Annotator = Callable[[dict], Callable[[dict, Any], None] | None]
Enricher = Callable[["KnowledgeGraph"], DataFrame]

_filters: dict[str, NodeFilter] = {}
_annotators: dict[str, Annotator] = {}
_enrichers: dict[str, Enricher] = {}


def register_filter(name: str, make: NodeFilter) -> None:
    _filters[name] = make


def register_annotator(name: str, make: Annotator) -> None:
    _annotators[name] = make


def register_enricher(name: str, make: Enricher) -> None:
    _enrichers[name] = make


def node_condition(config: dict | None) -> Column | None:
    """All active filters in the order of registration; None if none is active."""
    out = None
    for make in _filters.values() if config else ():
        c = make(config)
        if c is not None:
            out = c if out is None else out & c
    return out


def annotators(config: dict | None) -> list[tuple[str, Callable[[dict, Any], None]]]:
    found = [(name, make(config)) for name, make in _annotators.items()] if config else []
    return [(n, a) for n, a in found if a is not None]


def run_enrichers(kg: KnowledgeGraph, store: NodeMetadata) -> None:
    """Fills the namespaces of all enrichers that the store does not have yet."""
    for name, make in _enrichers.items():
        if name not in store.namespaces():
            store.put_many(name, make(kg))


class NodeMetadata:
    """(namespace, node_id, value_json): facts on nodes that answers do not show; a null node_id is the namespace itself."""

    DDL = "namespace string, node_id string, value_json string"

    def __init__(self, spark: SparkSession, table: DataFrame | None = None) -> None:
        self.spark = spark
        self.table = table if table is not None else spark.createDataFrame([], self.DDL)

    def put(self, namespace: str, node_id: str | None, value: Any) -> None:
        self.put_many(namespace, self.spark.createDataFrame([(node_id, json.dumps(value))], "node_id string, value_json string"))

    def put_many(self, namespace: str, values: DataFrame) -> None:
        """values: node_id and value_json; they replace what the namespace has of the same nodes."""
        new = values.select(F.lit(namespace).alias("namespace"), "node_id", "value_json")
        same = (self.table["namespace"] == namespace) & self.table["node_id"].eqNullSafe(new["node_id"])
        self.table = self.table.join(new, same, "left_anti").unionByName(new)

    def get(self, namespace: str, node_id: str | None) -> Any:
        row = self.table.filter((F.col("namespace") == namespace) & F.col("node_id").eqNullSafe(F.lit(node_id))).first()
        return json.loads(row["value_json"]) if row else None

    def of(self, namespace: str) -> DataFrame:
        return self.table.filter(F.col("namespace") == namespace).select("node_id", "value_json")

    def contains(self, namespace: str, node_id: str | None) -> bool:
        return self.get(namespace, node_id) is not None

    def namespaces(self) -> list[str]:
        return sorted(r[0] for r in self.table.select("namespace").distinct().collect())

    def save(self, path: str) -> None:
        self.table.write.mode("overwrite").partitionBy("namespace").parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> NodeMetadata:
        return NodeMetadata(spark, spark.read.schema(NodeMetadata.DDL).parquet(path))


def _max_node_degree(config: dict) -> Column | None:
    most = config.get("max_node_degree")
    return None if most is None else F.col("total_degree") <= F.lit(most)


def _min_information_content(config: dict) -> Column | None:
    least = config.get("min_information_content")
    return None if least is None else F.coalesce(F.col("information_content") >= F.lit(least), F.lit(False))


#: What attributes of counts and edges of pairs are called, and what counts if a request does not say (fixed values).
COUNT_TYPE, PAIR_PREDICATE = "biolink:occurrences_in_literature", "biolink:occurs_together_in_literature_with"
LEAST_PAIRS, LITERATURE = 50, "infores:literature_cooccurrence"


def cooccurrence_edges(nodes: DataFrame, pair_counts: DataFrame, least: int = LEAST_PAIRS) -> DataFrame:
    """(subject, object, n) of pairs between given nodes (id), from a table (subject, object, n)."""
    ids = nodes.select("id").distinct()
    return pair_counts.filter(F.col("n") >= least).join(ids.withColumnRenamed("id", "subject"), "subject", "left_semi").join(ids.withColumnRenamed("id", "object"), "object", "left_semi")


def node_counts_of(nodes: DataFrame, counts: DataFrame) -> DataFrame:
    """(id, n) of given nodes (id), from a table (id, n)."""
    return counts.select("id", "n").join(nodes.select("id").distinct(), "id", "left_semi")


def cooccurrence_annotator(counts: DataFrame, pairs: DataFrame) -> Annotator:
    """An annotator from tables of counts (id, n) and pairs (subject, object, n): a message's nodes get their counts as attributes, and edges join those written about together. Only rows of the message's nodes are read to the driver."""

    def make(config: dict) -> Callable[[dict, Any], None] | None:
        asked = config.get("literature_cooccurrence")
        if asked is None:
            return None
        if not isinstance(asked, dict):
            raise ValueError("annotator_config['literature_cooccurrence'] must be an object")
        source = asked.get("infores_id") or LITERATURE

        def annotate(response: dict, graph: Any) -> None:
            own = response["message"].get("knowledge_graph") or {}
            if not own.get("nodes"):
                return
            ids = counts.sparkSession.createDataFrame([(i,) for i in own["nodes"]], "id string")
            described = lambda n: [{"attribute_type_id": COUNT_TYPE, "value": n, "value_type_id": "linkml:Integer", "attribute_source": source}]
            for r in node_counts_of(ids, counts).collect():
                node = own["nodes"][r["id"]]
                node["attributes"] = [*(node.get("attributes") or []), *described(r["n"])]
            if not asked.get("include_pair_edges", True):
                return
            for r in cooccurrence_edges(ids, pairs, int(asked.get("min_cooccurrence", LEAST_PAIRS))).orderBy("subject", "object").collect():
                edge = {"subject": r["subject"], "predicate": PAIR_PREDICATE, "object": r["object"], "attributes": described(r["n"]), "sources": [{"resource_id": source, "resource_role": "primary_knowledge_source"}]}
                own.setdefault("edges", {})[f"litcoocc:{uuid4().hex[:12]}"] = edge

        return annotate

    return make


def register_literature(counts: DataFrame, pairs: DataFrame) -> None:
    """The built-in annotator, once its tables are known."""
    register_annotator("literature_cooccurrence", cooccurrence_annotator(counts, pairs))


def register_builtin() -> None:
    register_filter("max_node_degree", _max_node_degree)
    register_filter("min_information_content", _min_information_content)


register_builtin()

"""A property graph as DataFrames."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from functools import cached_property
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph import schema
from weftgraph.ontology import Ontology


@dataclass
class KnowledgeGraph:
    """nodes, edges and, apart from them, the edges' attributes, which are joined only to what has matched.

    edge_idx names a physical edge; parallel edges differ in it. It is a text here
    (a position after sorting, or a digest), ordered as text.
    """

    spark: SparkSession
    nodes: DataFrame
    edges: DataFrame
    edge_attributes: DataFrame
    ontology: Ontology = field(default_factory=Ontology)
    metadata: dict[str, Any] = field(default_factory=dict)
    #: Node records on their own, also of ids that no edge mentions: what is joined to matches needs no look at all edges first.
    records: DataFrame | None = None

    @property
    def node_records(self) -> DataFrame:
        return self.nodes if self.records is None else self.records

    def _degrees(self, ids: DataFrame | None) -> DataFrame:
        e = self.edges
        ends = e.select(F.explode(F.array(F.struct(F.col("subject").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("object").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("x")).select("x.*")
        if ids is not None:
            ends = ends.join(ids.select("id"), "id", "left_semi")
        return ends.groupBy("id").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"), F.count(F.lit(1)).alias("total_degree"))

    @cached_property
    def degrees(self) -> DataFrame:
        """(id, out_degree, in_degree, total_degree) of every node with an edge; a loop counts twice in total."""
        return self._degrees(None)

    def degrees_of(self, ids: DataFrame) -> DataFrame:
        """degrees of some nodes (id): edges of other nodes are left out before they are counted; stored degrees are looked up."""
        if "total_degree" in self.node_records.columns:
            return self.node_records.select("id", "out_degree", "in_degree", "total_degree").join(ids.select("id"), "id", "left_semi")
        return self._degrees(ids)

    def nodes_with_degrees(self, ids: DataFrame | None = None) -> DataFrame:
        """nodes with their degrees; only those of ids (id), if given."""
        names = ("out_degree", "in_degree", "total_degree")
        if ids is None:
            nodes, degrees = self.nodes, self.degrees
        else:
            ids = ids.select("id").distinct()
            nodes, degrees = ids.join(self.node_records, "id", "left"), self.degrees_of(ids)
        zero = {c: F.coalesce(c, F.lit(0)) for c in names}
        return nodes.drop(*names).join(degrees, "id", "left").withColumns(zero)

    def save(self, path: str) -> None:
        """Three Parquet tables, edges sorted by subject in files of subject ranges, nodes with their degrees, and the metadata."""
        self.nodes_with_degrees().write.mode("overwrite").parquet(f"{path}/nodes")
        self.edges.repartitionByRange("subject", "object", "predicate").sortWithinPartitions("subject", "object", "predicate").write.mode("overwrite").parquet(f"{path}/edges")
        self.edge_attributes.write.mode("overwrite").parquet(f"{path}/edge_attributes")
        row = [(json.dumps(self.metadata), json.dumps(_onto_json(self.ontology)))]
        self.spark.createDataFrame(row, "metadata string, ontology string").coalesce(1).write.mode("overwrite").json(f"{path}/info")

    def save_bucketed(self, name: str, buckets: int) -> None:
        """edges as two bucketed tables, by subject and mirrored by object: joins on either end need no shuffle."""
        for end, other in (("subject", "object"), ("object", "subject")):
            self.edges.write.mode("overwrite").bucketBy(buckets, end).sortBy(end, other, "predicate").saveAsTable(f"{name}_by_{end}")

    @staticmethod
    def load(spark: SparkSession, path: str, metadata: str | None = None) -> KnowledgeGraph:
        """What save() wrote; metadata: a JSON file to be shown in place of the graph's own metadata, as it is."""
        info = spark.read.schema("metadata string, ontology string").json(f"{path}/info").first()
        read = lambda t: spark.read.parquet(f"{path}/{t}")
        return KnowledgeGraph(spark, read("nodes"), read("edges"), read("edge_attributes"), _onto_of(json.loads(info["ontology"])), json.loads(spark.read.text(metadata, wholetext=True).first()[0] if metadata else info["metadata"]))

    @staticmethod
    def from_rows(spark: SparkSession, nodes: list, edges: list, edge_attributes: list = (), ontology: Ontology | None = None) -> KnowledgeGraph:
        """From lists of rows in the order of the schemas."""
        make = spark.createDataFrame
        return KnowledgeGraph(spark, make(list(nodes), schema.NODES), make(list(edges), schema.EDGES), make(list(edge_attributes), schema.EDGE_ATTRIBUTES), ontology or Ontology())


def _onto_json(o: Ontology) -> dict:
    return {k: sorted(v) if isinstance(v, set) else v for k, v in vars(o).items()}


def _onto_of(d: dict) -> Ontology:
    return Ontology(**{k: set(v) if k in ("symmetric", "canonical") else v for k, v in d.items()})

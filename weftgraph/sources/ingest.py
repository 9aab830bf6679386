"""Graphs from line-delimited JSON and from tables.

Lines are read as text, so that unknown fields survive; a batch of lines is parsed
once into columns. Positions of edges come from one range-partitioned sort by
subject, object and predicate.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from weftgraph import schema
from weftgraph.graph import KnowledgeGraph
from weftgraph.ontology import Ontology
from weftgraph.operators.durable import cut
from weftgraph.sources import normalize

RAW_EDGES = f"edge_id string, subject string, predicate string, object string, qualifiers array<{schema.QUALIFIER}>, sources array<{schema.SOURCE}>, attributes array<{schema.ATTRIBUTE}>"
RAW_NODES = f"id string, name string, categories array<string>, attributes array<{schema.ATTRIBUTE}>, line bigint"


class GraphSource:
    """Where a graph comes from: subclasses give edge and node records as DataFrames, any number of times.

    edges() has the columns of RAW_EDGES and line, nodes() those of RAW_NODES (None if
    there are no node records); line is the order of records, whatever partition they are in.
    """

    def edges(self) -> DataFrame:
        raise NotImplementedError

    def nodes(self) -> DataFrame | None:
        return None


class JsonLines(GraphSource):
    """Files of raw records, or of graph records such as a document store exports (normalized)."""

    def __init__(self, spark: SparkSession, edge_path: str, node_path: str | None = None, normalized: bool = False) -> None:
        self.spark, self.edge_path, self.node_path, self.normalized = spark, edge_path, node_path, normalized

    def edges(self) -> DataFrame:
        return edges_of_lines(self.spark.read.text(self.edge_path), self.normalized)

    def nodes(self) -> DataFrame | None:
        return nodes_of_lines(self.spark.read.text(self.node_path), self.normalized) if self.node_path else None


class Documents(GraphSource):
    """Collections of a document store, through any client that lists the parts of a collection and reads one.

    parts(name) gives descriptions of parts (texts, such as ranges of ids), read(name, part)
    the documents of one; executors read the parts, so both must be picklable. Documents are
    graph records; `_id` is left out, and texts that say the same as JSON are read as it.
    """

    def __init__(self, spark: SparkSession, parts: Callable[[str], list[str]], read: Callable[[str, str], Iterator[dict]], edges: str = "edges", nodes: str | None = "nodes") -> None:
        self.spark, self.parts, self.read, self.names = spark, parts, read, (edges, nodes)

    def _lines(self, name: str) -> DataFrame:
        parts, read = self.parts(name), self.read

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for part in b.column(0).to_pylist():
                    docs = ({k: v for k, v in d.items() if k != "_id"} for d in read(name, part))
                    while some := list(islice(docs, 1000)):
                        yield pa.RecordBatch.from_arrays([pa.array([json.dumps(d) for d in some])], ["value"])

        listed = self.spark.createDataFrame([(p,) for p in parts], "part string").repartition(max(1, len(parts)))
        return listed.mapInArrow(run, "value string")

    def edges(self) -> DataFrame:
        return edges_of_lines(self._lines(self.names[0]), normalized=True)

    def nodes(self) -> DataFrame | None:
        return nodes_of_lines(self._lines(self.names[1]), normalized=True) if self.names[1] else None


def triples_of_lines(spark: SparkSession, path: str) -> DataFrame:
    """(subject, object, predicate) only: other fields are not parsed."""
    return spark.read.schema("subject string, object string, predicate string").json(path)


def _parsed(lines: DataFrame, to_record: Callable[[dict], dict | None], ddl: str) -> DataFrame:
    """Records of lines, each line read once: what Python makes of its values goes to Spark as Arrow columns, without a second JSON."""
    schema = T.StructType.fromDDL(f"{ddl}, line bigint")
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for text, line in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if text and text.strip() and (r := to_record(json.loads(text))) is not None:
                    rows.append(r | {"line": line})
            yield pa.RecordBatch.from_pylist(rows, arrow)

    return lines.select("value", "line").mapInArrow(run, schema)


def _numbered(lines: DataFrame) -> DataFrame:
    return lines.select("value", F.monotonically_increasing_id().alias("line"))


def edges_of_lines(lines: DataFrame, normalized: bool = False, qualifier_fields: frozenset[str] = normalize.QUALIFIER_FIELDS) -> DataFrame:
    """Edge records of lines (value); the first record that breaks the contract fails the job.

    normalized: the lines are graph records already and only checked.
    """

    def record(raw: dict) -> dict:
        if normalized:
            raw = {k: v for k, v in raw.items() if k != "_id"}
            e = raw | {"attributes": [normalize.attribute(a["attribute_type_id"], a["value"], a.get("original_attribute_name")) for a in raw["attributes"]]} if isinstance(raw.get("attributes"), list) else raw
        else:
            e = normalize.edge(raw, qualifier_fields)
        normalize.check_edge(e)
        return {"edge_id": e.get("id")} | {k: e[k] for k in ("subject", "predicate", "object", "qualifiers", "sources", "attributes")}

    return _parsed(_numbered(lines), record, RAW_EDGES)


def nodes_of_lines(lines: DataFrame, normalized: bool = False) -> DataFrame:
    """Node records of lines (value); records without id are skipped."""

    def record(raw: dict) -> dict | None:
        if not raw.get("id"):
            return None
        if normalized:
            n = {k: v for k, v in raw.items() if k != "_id"}
            n["attributes"] = [normalize.attribute(a["attribute_type_id"], a["value"], a.get("original_attribute_name")) for a in n.get("attributes") or []]
        else:
            n = normalize.node(raw)
        normalize.check_node(n)
        return {k: n.get(k) for k in ("id", "name", "categories", "attributes")}

    return _parsed(_numbered(lines), record, RAW_NODES.rpartition(",")[0])


def build(spark: SparkSession, edges: DataFrame, nodes: DataFrame | None, ontology: Ontology | None = None) -> KnowledgeGraph:
    """A graph of edge records (with line) and node records (with line).

    Nodes are those that edges mention, with the last of their records if there is
    one. edge_idx is the edge's place in the order of subject, object, predicate, line.
    """
    by = ["subject", "object", "predicate", "line"]
    ordered = edges.repartitionByRange(*by).sortWithinPartitions(*by)
    # Unique and in order (partition number, then row), as text of fixed width; kept, since it is not to be computed twice.
    ordered = cut(ordered.withColumn("edge_idx", F.lpad(F.monotonically_increasing_id().cast("string"), 20, "0")))
    attr_type = f"array<{schema.ATTRIBUTE}>"
    mentioned = ordered.select(F.explode(F.array("subject", "object")).alias("id")).distinct()
    if nodes is None:
        found = mentioned.withColumns({"name": F.lit(None).cast("string"), "categories": F.array().cast("array<string>"), "attributes": F.array().cast(attr_type)})
    else:
        last = nodes.groupBy("id").agg(F.max_by(F.struct("name", "categories", "attributes"), "line").alias("r"))
        found = mentioned.join(last, "id", "left").select("id", "r.name", F.coalesce("r.categories", F.array().cast("array<string>")).alias("categories"), F.coalesce("r.attributes", F.array().cast(attr_type)).alias("attributes"))
    ic = F.get(F.filter("attributes", lambda a: a["original_attribute_name"] == "information_content"), F.lit(0))["value_num"]
    found = found.withColumn("information_content", ic)
    narrow = ordered.select("edge_idx", "edge_id", "subject", "predicate", "object", "qualifiers", "sources")
    return KnowledgeGraph(spark, found, narrow, ordered.select("edge_idx", "attributes"), ontology or Ontology())


def from_jsonl(spark: SparkSession, edge_path: str, node_path: str | None = None, ontology: Ontology | None = None, normalized: bool = False) -> KnowledgeGraph:
    """From files of raw (or normalized) records; the node file is optional."""
    return from_source(JsonLines(spark, edge_path, node_path, normalized), ontology)


def from_source(source: GraphSource, ontology: Ontology | None = None) -> KnowledgeGraph:
    edges = source.edges()
    return build(edges.sparkSession, edges, source.nodes(), ontology)


def source_chain(sources: Column, own: str = normalize.OWN_SOURCE) -> Column:
    """normalize.source_chain as a column expression, for sources that are there."""
    chain = F.transform(sources, lambda s: F.struct(s["resource_id"].alias("resource_id"), s["resource_role"].alias("resource_role"), F.coalesce(s["upstream_resource_ids"], F.array().cast("array<string>")).alias("upstream_resource_ids")))
    drawn = F.flatten(F.transform(chain, lambda s: s["upstream_resource_ids"]))
    tops = F.filter(F.transform(chain, lambda s: s["resource_id"]), lambda i: ~F.coalesce(F.array_contains(drawn, i), F.lit(False)))
    first = F.struct(F.lit(own).alias("resource_id"), F.lit("aggregator_knowledge_source").alias("resource_role"), tops.alias("upstream_resource_ids"))
    return F.concat(F.array(first), chain)

"""Do nodes, edges and answers exist in the graph; how do two answers differ."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.graph import KnowledgeGraph
from weftgraph.operators import adjacency

ERRORS = "error_type string, subject string, predicate string, object string"


def missing_nodes(kg: KnowledgeGraph, ids: DataFrame) -> DataFrame:
    return ids.select("id").distinct().join(kg.nodes.select("id"), "id", "left_anti")


def _stored_forms(kg: KnowledgeGraph, edges: DataFrame, check_inverse: bool) -> DataFrame:
    """edges (subject, predicate, object) with the statements s, p, o that would prove each: itself; reversed if symmetric; reversed under its inverse; under the inverse's name."""
    form = lambda s, p, o: F.struct(F.col(s).alias("s"), F.col(p).alias("p"), F.col(o).alias("o"))
    forms = [form("subject", "predicate", "object")]
    if check_inverse:
        known = kg.ontology.tables(kg.spark)["predicate"].select(F.col("name").alias("predicate"), "is_symmetric", "inverse")
        # Of which predicates a predicate is the inverse: what is stored under those says the same.
        of = kg.ontology.tables(kg.spark)["predicate"].filter(F.col("inverse").isNotNull()).groupBy(F.col("inverse").alias("predicate")).agg(F.collect_set("name").alias("stored_as"))
        edges = edges.join(F.broadcast(known), "predicate", "left").join(F.broadcast(of), "predicate", "left")  # one row for each predicate of the ontology
        forms.append(F.when(F.col("is_symmetric"), form("object", "predicate", "subject")))
        turned = F.transform("stored_as", lambda q: F.struct(F.col("object").alias("s"), q.alias("p"), F.col("subject").alias("o")))
        named = F.transform("stored_as", lambda q: F.struct(F.col("subject").alias("s"), q.alias("p"), F.col("object").alias("o")))
        none = F.array().cast("array<struct<s:string,p:string,o:string>>")
        every = F.concat(F.array_compact(F.array(*forms)), F.coalesce(turned, none), F.coalesce(named, none))
    else:
        every = F.array(*forms)
    return edges.select("subject", "predicate", "object", F.explode(every).alias("f")).select("subject", "predicate", "object", "f.*")


def edge_errors(kg: KnowledgeGraph, edges: DataFrame, check_inverse: bool = True) -> DataFrame:
    """(error_type, subject, predicate, object) of edges whose subject, object or statement is not in the graph; one error each.

    The given edges are turned into what would prove them and looked up; the graph's
    own edges are read once for statements and once for ends, and not multiplied.
    """
    key = ["subject", "predicate", "object"]
    e = edges.select(*key).distinct()
    stored = kg.edges.select(F.col("subject").alias("s"), F.col("predicate").alias("p"), F.col("object").alias("o"))
    proved = _stored_forms(kg, e, check_inverse).join(stored, ["s", "p", "o"], "left_semi").select(*key).distinct()
    lost = e.join(proved, key, "left_anti")
    ends = lost.select(F.explode(F.array("subject", "object")).alias("id")).distinct().join(kg.nodes.select("id"), "id", "left_semi").withColumn("known", F.lit(True))
    for end in ("subject", "object"):
        lost = lost.join(ends.select(F.col("id").alias(end), F.col("known").alias(f"has_{end}")), end, "left")
    error = F.when(F.col("has_subject").isNull(), "EDGE_SUBJECT_NOT_FOUND").when(F.col("has_object").isNull(), "EDGE_OBJECT_NOT_FOUND").otherwise("EDGE_NOT_FOUND")
    return lost.select(error.alias("error_type"), *key)


def edge_exists(kg: KnowledgeGraph, subject: str, predicate: str, object: str, check_inverse: bool = True) -> str | None:
    """None if the edge exists, else the type of error."""
    one = kg.spark.createDataFrame([(subject, predicate, object)], "subject string, predicate string, object string")
    row = edge_errors(kg, one, check_inverse).first()
    return row["error_type"] if row else None


def response_errors(kg: KnowledgeGraph, response: dict) -> dict:
    """Errors of an answer in JSON: nodes and edges that the graph lacks, bindings that the answer's own graph lacks; valid results."""
    message = response.get("message", response)
    own = message.get("knowledge_graph") or {}
    nodes, edges = own.get("nodes") or {}, own.get("edges") or {}
    errors = []
    if nodes:
        errors += [{"error_type": "NODE_NOT_FOUND", "node_id": r["id"]} for r in missing_nodes(kg, kg.spark.createDataFrame([(n,) for n in nodes], "id string")).collect()]
    # Derived edges are in the answer only.
    stored = {k: e for k, e in edges.items() if not any(a.get("attribute_type_id") == "biolink:support_graphs" for a in e.get("attributes") or [])}
    if stored:
        rows = [(e["subject"], e["predicate"], e["object"]) for e in stored.values()]
        errors += [r.asDict() for r in edge_errors(kg, kg.spark.createDataFrame(rows, "subject string, predicate string, object string")).collect()]
    valid = 0
    for i, r in enumerate(message.get("results") or []):
        bad = [{"error_type": "NODE_BINDING_NOT_IN_KG", "result": i, "node_id": b["id"]} for bs in r["node_bindings"].values() for b in bs if b["id"] not in nodes]
        bad += [{"error_type": "EDGE_BINDING_NOT_IN_KG", "result": i, "edge_id": b["id"]} for a in r["analyses"] for bs in a["edge_bindings"].values() for b in bs if b["id"] not in edges]
        errors += bad
        valid += not bad
    return {"valid": not errors, "errors": errors, "valid_results": valid, "total_results": len(message.get("results") or [])}


def summary(report: dict, most: int = 10) -> str:
    """A report in words, with its first errors."""
    lines = [f"{'valid' if report['valid'] else 'not valid'}: {report['valid_results']} of {report['total_results']} results"]
    lines += [", ".join(f"{k}={v}" for k, v in e.items()) for e in report["errors"][:most]]
    return "\n".join(lines + ([f"... and {len(report['errors']) - most} more"] if len(report["errors"]) > most else []))


def result_diff(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """(side, keys): results (by their bindings) that only one answer has."""
    x, y = a.select(*keys).distinct(), b.select(*keys).distinct()
    only = lambda p, q, side: p.exceptAll(q).select(F.lit(side).alias("side"), *keys)
    return only(x, y, "a").unionByName(only(y, x, "b"))


def edge_set_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """(side, subject, predicate, object) of statements in one set only."""
    return result_diff(a, b, ["subject", "predicate", "object"])


def explain_missing_edge(kg: KnowledgeGraph, subject: str, predicate: str, object: str) -> str:
    """What the graph has instead of an edge."""
    found = adjacency.edges_either_way(kg, subject, object).select("direction", "predicate").distinct().collect()
    state = edge_exists(kg, subject, predicate, object)
    lines = [f"{subject} -[{predicate}]-> {object}: {state or 'found'}", f"inverse: {kg.ontology.inverse(predicate)}, symmetric: {kg.ontology.is_symmetric(predicate)}"]
    lines += sorted(f"  {r['direction']}: {r['predicate']}" for r in found) or ["  no edge between them"]
    return "\n".join(lines)


def edge_storage_report(kg: KnowledgeGraph, node: str) -> DataFrame:
    """(direction, predicate, n) of a node's edges."""
    e = kg.edges.filter((F.col("subject") == node) | (F.col("object") == node))
    return e.groupBy(F.when(F.col("subject") == node, "out").otherwise("in").alias("direction"), "predicate").agg(F.count(F.lit(1)).alias("n"))


def format_result(result: dict, message: dict, order: list[str]) -> str:
    """A result's nodes along the pattern, with their names."""
    nodes = message["knowledge_graph"]["nodes"]
    return " -> ".join("|".join(f"{b['id']} ({(nodes.get(b['id']) or {}).get('name')})" for b in result["node_bindings"].get(n, [])) for n in order)


def sentence(paths: DataFrame, names: list[str], predicates: list[str]) -> DataFrame:
    """paths with a column sentence: names and predicates in turn."""
    words = [F.col(names[0])]
    for p, n in zip(predicates, names[1:]):
        words += [F.regexp_replace(F.regexp_replace(p, "^[^:]*:", ""), "_", " "), F.col(n)]
    return paths.withColumn("sentence", F.concat_ws(" ", *words))


def is_connected(result: dict, message: dict) -> bool:
    """Whether the bound edges of one result join all its bound nodes."""
    edges = message["knowledge_graph"]["edges"]
    bound = {b["id"] for bs in result["node_bindings"].values() for b in bs}
    links = [(edges[b["id"]]["subject"], edges[b["id"]]["object"]) for a in result["analyses"] for bs in a["edge_bindings"].values() for b in bs]
    reached = set(list(bound)[:1])
    while more := {y for x, o in links for y in (x, o) if (x in reached or o in reached) and y not in reached}:
        reached |= more
    return bound <= reached

"""Answers as JSON messages, and operations on them."""

from __future__ import annotations

import datetime
import json
import time
from collections.abc import Callable
from dataclasses import replace
from typing import Any

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftgraph import plugins
from weftgraph.graph import KnowledgeGraph
from weftgraph.operators.adjacency import node_records
from weftgraph.operators.durable import cut
from weftgraph.operators.lookup import INFORES, LookupResult, lookup
from weftgraph.plans.ir import BadQuery


#: Paths of an answer that may become one message.
MOST_PATHS = 1_000_000


class Stages:
    """Times of the stages of a request, stages within stages, as log entries and as a tree."""

    def __init__(self) -> None:
        self.logs: list[dict] = []
        self.tree: list[dict] = []
        self._open: list[dict] = []

    def run(self, name: str, f: Callable[[], Any], **facts: Any) -> Any:
        """f() as a stage of the one that is running; facts go with it."""
        stage = {"name": name, "seconds": None, "facts": facts, "stages": []}
        (self._open[-1]["stages"] if self._open else self.tree).append(stage)
        self._open.append(stage)
        began = time.perf_counter()
        try:
            return f()
        finally:
            stage["seconds"] = round(time.perf_counter() - began, 3)
            self.note("INFO", f"{' / '.join(s['name'] for s in self._open)}: {stage['seconds']:.3f} s", "StageTime")
            self._open.pop()

    def fact(self, name: str, value: Any) -> None:
        """Something counted in the stage that is running."""
        if self._open:
            self._open[-1]["facts"][name] = value

    def note(self, level: str, message: str, code: str | None = None) -> None:
        self.logs.append({"timestamp": datetime.datetime.now(datetime.timezone.utc).isoformat(), "level": level, "code": code, "message": message})


def _attributes(rows) -> list[dict]:
    out = []
    for a in rows or []:
        d = {"attribute_type_id": a["attribute_type_id"], "value": json.loads(a["value_json"]) if a["value_json"] is not None else None}
        d |= {k: a[k] for k in ("original_attribute_name", "attribute_source", "value_type_id") if a[k] is not None}
        out.append(d)
    return out


def _derived(edge: dict, aux: str) -> dict:
    attr = lambda t, v: {"attribute_type_id": f"biolink:{t}", "value": v}
    return edge | {
        "attributes": [attr("knowledge_level", "logical_entailment"), attr("agent_type", "automated_agent"), attr("support_graphs", [aux])],
        "sources": [{"resource_id": INFORES, "resource_role": "primary_knowledge_source"}],
    }


def assemble(r: LookupResult, query_graph: dict | None = None, compat: bool = False, most_paths: int = MOST_PATHS, stages: Stages | None = None) -> dict:
    """The whole answer as one message on the driver, for answers of a size that is sent to someone.

    The pattern is run once; its paths are kept and counted. Above most_paths the answer is
    refused, whole: it is read from the tables of LookupResult instead.
    """
    kg, stages = r.kg, stages or Stages()
    r = replace(r, paths=stages.run("match", lambda: cut(r.paths)))
    stages.fact("paths", n := r.paths.count())
    if n > most_paths:
        raise BadQuery(f"the answer has {n} paths; one message holds at most {most_paths}", 413)
    nodes = {}
    for n in r.kg_nodes.collect():
        nodes[n["id"]] = {"name": n["name"], "categories": list(n["categories"] or [])} | ({} if r.dehydrated else {"attributes": _attributes(n["attributes"])})
    edges = {}
    e = r.kg_edges(compat)
    if not r.dehydrated:
        full = kg.edges.select("edge_idx", "qualifiers", "sources").join(kg.edge_attributes, "edge_idx", "left")
        e = e.join(full, "edge_idx", "left")
    for x in e.collect():
        edge = {"subject": x["subject"], "predicate": x["predicate"], "object": x["object"]}
        if x["support"]:
            edge = _derived(edge, x["support"])
        elif not r.dehydrated:
            edge |= {"qualifiers": [q.asDict() for q in x["qualifiers"] or []], "sources": [s.asDict() for s in x["sources"] or []], "attributes": _attributes(x["attributes"])}
        edges[x["kg_edge"]] = edge
    results: dict[str, dict] = {}
    for b in r.node_bindings.orderBy("result_id", "qnode", "id").collect():
        res = results.setdefault(b["result_id"], {"node_bindings": {}, "analyses": [{"resource_id": INFORES, "edge_bindings": {}}]})
        res["node_bindings"].setdefault(b["qnode"], []).append({"id": b["id"], "attributes": []})
    for b in r.edge_bindings(compat).orderBy("result_id", "qedge", "kg_edge").collect():
        results[b["result_id"]]["analyses"][0]["edge_bindings"].setdefault(b["qedge"], []).append({"id": b["kg_edge"], "attributes": []})
    aux: dict[str, dict] = {}
    for a in r.aux_graphs(compat).orderBy("aux_graph", "kg_edge").collect():
        aux.setdefault(a["aux_graph"], {"edges": [], "attributes": []})["edges"].append(a["kg_edge"])
    return {"message": {"query_graph": query_graph or {}, "knowledge_graph": {"nodes": nodes, "edges": edges}, "results": list(results.values()), "auxiliary_graphs": aux}, "logs": list(r.logs)}


def top_n(response: dict, n: int | None) -> dict:
    """The first n results as given."""
    if n is None:
        raise BadQuery("filter_results_top_n needs max_results")
    response["message"]["results"] = response["message"]["results"][:n]
    return response


def annotate(response: dict, graph: Any, config: dict | None) -> dict:
    """Runs the active annotators in order; one that fails is logged and leaves the others alone."""
    stages = Stages()
    for name, run in plugins.annotators(config):
        try:
            run(response, graph)
        except Exception as e:  # noqa: BLE001
            stages.note("WARNING", f"annotator {name} failed: {e}", "AnnotatorFailed")
    response.setdefault("logs", []).extend(stages.logs)
    return response


def resolve_edges(kg: KnowledgeGraph, wanted: DataFrame) -> DataFrame:
    """(key, edge_idx): for each wanted edge (key, subject, predicate, object, qualifiers JSON, sources JSON) the stored one.

    Of parallel edges the one that agrees in what is given of qualifiers and sources,
    else the first; unknown edges have no row.
    """
    stored = kg.edges.select("subject", "predicate", "object", "edge_idx", F.to_json("qualifiers").alias("q"), F.to_json(F.transform("sources", lambda s: s["resource_id"])).alias("s"))
    both = wanted.join(stored, ["subject", "predicate", "object"])
    agrees = F.when(F.col("qualifiers").isNull(), 0).otherwise((F.col("qualifiers") == F.col("q")).cast("int")) + F.when(F.col("sources").isNull(), 0).otherwise((F.col("sources") == F.col("s")).cast("int"))
    w = Window.partitionBy("key").orderBy(F.desc("agrees"), "edge_idx")
    return both.withColumn("agrees", agrees).withColumn("n", F.row_number().over(w)).filter("n = 1").select("key", "edge_idx")


def enrich(kg: KnowledgeGraph, response: dict) -> dict:
    """Fills absent fields of a message's nodes and edges from the graph; what is there stays, unresolved edges get empty lists."""
    own = response["message"].get("knowledge_graph") or {}
    nodes, edges = own.get("nodes") or {}, own.get("edges") or {}
    if nodes:
        ids = kg.spark.createDataFrame([(n,) for n in nodes], "id string")
        for n in node_records(kg, ids).collect():
            for k, v in (("name", n["name"]), ("categories", list(n["categories"] or [])), ("attributes", _attributes(n["attributes"]))):
                if nodes[n["id"]].get(k) is None:
                    nodes[n["id"]][k] = v
    if edges:
        q_json = lambda e: None if e.get("qualifiers") is None else json.dumps([{k: q[k] for k in ("qualifier_type_id", "qualifier_value")} for q in e["qualifiers"]], separators=(",", ":"))
        s_json = lambda e: None if e.get("sources") is None else json.dumps([s["resource_id"] for s in e["sources"]], separators=(",", ":"))
        rows = [(k, e["subject"], e["predicate"], e["object"], q_json(e), s_json(e)) for k, e in edges.items()]
        wanted = kg.spark.createDataFrame(rows, "key string, subject string, predicate string, object string, qualifiers string, sources string")
        found = resolve_edges(kg, wanted).join(kg.edges.select("edge_idx", "qualifiers", "sources"), "edge_idx").join(kg.edge_attributes, "edge_idx", "left")
        known = {r["key"]: r for r in found.collect()}
        for k, e in edges.items():
            r = known.get(k)
            for f in ("qualifiers", "sources", "attributes"):
                if e.get(f) is None:
                    e[f] = [] if r is None else _attributes(r[f]) if f == "attributes" else [x.asDict() for x in r[f] or []]
    return response


def query(kg: KnowledgeGraph, body: dict) -> dict:
    """A request as a service would take it: {message: {query_graph | knowledge_graph}, parameters, workflow}."""
    stages = Stages()
    p = body.get("parameters") or {}
    workflow = body.get("workflow") or [{"id": "lookup"}]
    if len(workflow) != 1:
        raise BadQuery("a workflow has exactly one operation")
    op = workflow[0]
    if op["id"] == "filter_results_top_n":
        return top_n(dict(body), (op.get("parameters") or {}).get("max_results"))
    if op["id"] != "lookup":
        raise BadQuery(f"operation {op['id']} is not supported")
    if p.get("rehydrate"):
        return stages.run("enrich", lambda: enrich(kg, dict(body)))
    q = body["message"]["query_graph"]
    found = stages.run("plan", lambda: lookup(kg, q, p.get("subclass", True), p.get("subclass_depth", 1), p.get("filter_config"), p.get("dehydrated", False)))
    out = stages.run("answer", lambda: assemble(found, q, stages=stages))
    out["logs"] += stages.logs
    if str(body.get("log_level") or "").upper() == "DEBUG":
        out["logs"].append({"timestamp": stages.logs[-1]["timestamp"], "level": "DEBUG", "code": "Profile", "message": json.dumps(stages.tree)})
    return annotate(out, kg, p.get("annotator_config"))


def submit(kg: KnowledgeGraph, body: dict, on_done: Callable[[dict], None]) -> Any:
    """query() on another thread; on_done gets the answer, or a message with the error in its logs."""
    import threading

    def run() -> None:
        try:
            out = query(kg, body)
        except Exception as e:  # noqa: BLE001
            stages = Stages()
            stages.note("ERROR", str(e), "QueryFailed")
            out = {"message": {}, "logs": stages.logs}
        on_done(out)

    t = threading.Thread(target=run, daemon=True)
    t.start()
    return t


def write_paths_tsv(r: LookupResult, path: str) -> None:
    """One row for each path: nodes and edges in turn along the pattern."""
    from weftgraph.plans.ir import path_order

    order = path_order(r.pattern)
    cols = [f"n_{n}" for n in order if f"n_{n}" in r.paths.columns] + [c for k in r.pattern.edges for c in (f"p_{k}", f"e_{k}")]
    r.paths.select(*cols).write.mode("overwrite").option("sep", "\t").csv(path, header=True)

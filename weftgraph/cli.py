"""python -m weftgraph.cli build|query|paths|diagnose ...: graphs of files, questions to them."""

from __future__ import annotations

import argparse
import json
import sys
import time

from pyspark.sql import SparkSession

from weftgraph.graph import KnowledgeGraph
from weftgraph.operators import paths, response
from weftgraph.plans.ship import ship
from weftgraph.sources.ingest import from_jsonl
from weftgraph.sources.tables import ONTOLOGY


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="weftgraph", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    b = sub.add_parser("build", help="a graph folder of line-delimited JSON")
    b.add_argument("--edges", required=True)
    b.add_argument("--nodes")
    b.add_argument("--normalized", action="store_true", help="the lines are graph records already")
    b.add_argument("--output", required=True)
    q = sub.add_parser("query", help="the answer to a request in a JSON file")
    q.add_argument("graph")
    q.add_argument("request")
    q.add_argument("--output")
    t = sub.add_parser("paths", help="paths of three edges")
    t.add_argument("graph")
    t.add_argument("start")
    t.add_argument("end")
    t.add_argument("--allow", nargs="*")
    t.add_argument("--exclude", nargs="*")
    t.add_argument("--mechanistic", action="store_true")
    t.add_argument("--with-properties", action="store_true")
    t.add_argument("--limit", type=int, default=20)
    t.add_argument("--output", help="folder for all paths as JSON lines")
    g = sub.add_parser("diagnose", help="why there are so many paths")
    g.add_argument("graph")
    g.add_argument("start")
    g.add_argument("end")
    return p


def main(argv: list[str] | None = None) -> int:
    a = _parser().parse_args(argv)
    spark = SparkSession.builder.appName("weftgraph").getOrCreate()
    ship(spark)
    if a.command == "build":
        from_jsonl(spark, a.edges, a.nodes, ONTOLOGY, a.normalized).save(a.output)
        return 0
    kg = KnowledgeGraph.load(spark, a.graph)
    if a.command == "query":
        with open(a.request) as f:
            out = json.dumps(response.query(kg, json.load(f)))
        if a.output:
            with open(a.output, "w") as f:
                f.write(out)
        else:
            print(out)
        return 0
    if a.command == "diagnose":
        print(json.dumps(paths.explosion_report(kg, a.start, a.end).first().asDict(), indent=1))
        for r in paths.top_middle_nodes(kg, a.start, a.end).collect():
            print(f"{r['n2']}: {r['ways']}")
        return 0
    began = time.perf_counter()
    found = paths.mechanistic_paths(kg, a.start, a.end) if a.mechanistic else paths.paths3(kg, a.start, a.end, a.allow, a.exclude)
    if a.with_properties:
        found = paths.hydrate(kg, found)
    if a.output:
        found.write.mode("overwrite").json(a.output)
        found = spark.read.json(a.output)
    first = found.orderBy("e1", "e2", "e3").limit(a.limit).collect()
    summary = {"query": {"start": a.start, "end": a.end}, "num_paths": found.count(), "elapsed_seconds": round(time.perf_counter() - began, 3)}
    print(json.dumps(summary))
    for r in first:
        print(" -> ".join(r[f"n{i}"] for i in range(4)))
    return 0


if __name__ == "__main__":
    sys.exit(main())

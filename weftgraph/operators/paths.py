"""Directed paths of three edges between two nodes, and why there are so many."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.graph import KnowledgeGraph

#: Predicates of mechanisms (fixed values).
MECHANISTIC = [
    "biolink:treats", "biolink:affects", "biolink:regulates", "biolink:increases_expression_of", "biolink:decreases_expression_of",
    "biolink:gene_associated_with_condition", "biolink:has_metabolite", "biolink:metabolized_by", "biolink:applied_to_treat", "biolink:contraindicated_for",
    "biolink:directly_physically_interacts_with", "biolink:has_contraindication",
    "biolink:subject_of_treatment_application_or_study_for_treatment_by", "biolink:contribution_from",
]


def _hop(edges: DataFrame, i: int) -> DataFrame:
    return edges.select(F.col("subject").alias(f"n{i - 1}"), F.col("predicate").alias(f"p{i}"), F.col("edge_idx").alias(f"e{i}"), F.col("object").alias(f"n{i}"))


def _pinned(edges: DataFrame, start: str, end: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three hops; both pins reach the scans, and no path goes through its own ends; a node has no paths to itself."""
    if start == end:
        edges = edges.limit(0)
    e1 = _hop(edges.filter(F.col("subject") == start), 1).filter(F.col("n1") != end)
    e2 = _hop(edges, 2)
    e3 = _hop(edges.filter(F.col("object") == end), 3).filter(F.col("n2") != start)
    return e1, e2, e3


def paths3(kg: KnowledgeGraph, start: str, end: str, allowed: list[str] | None = None, excluded: list[str] | None = None, limit: int = 0) -> DataFrame:
    """n0..n3 and p1..p3, e1..e3: each combination of parallel edges is a path of its own.

    allowed and excluded are predicates of every hop; empty lists are no conditions. limit keeps the first paths in
    the order of their edges (0: all).
    """
    edges = kg.edges.select("subject", "predicate", "object", "edge_idx")
    if allowed:
        edges = edges.filter(F.col("predicate").isin(list(allowed)))
    if excluded:
        edges = edges.filter(~F.col("predicate").isin(list(excluded)))
    e1, e2, e3 = _pinned(edges, start, end)
    out = e1.join(e2, "n1").join(e3, "n2").select("n0", "n1", "n2", "n3", "p1", "p2", "p3", "e1", "e2", "e3")
    return out.orderBy("e1", "e2", "e3").limit(limit) if limit else out


def paths3_nodes(kg: KnowledgeGraph, start: str, end: str, limit: int = 0) -> DataFrame:
    """Different node sequences n0..n3 with the first predicate of each hop (by edge_idx)."""
    edges = kg.edges.select("subject", "predicate", "object", "edge_idx")
    if start == end:
        edges = edges.limit(0)
    first = lambda df: df.groupBy("subject", "object").agg(F.min(F.struct("edge_idx", "predicate")).alias("f")).select("subject", "object", F.col("f.predicate").alias("predicate"), F.col("f.edge_idx").alias("edge_idx"))
    e1 = _hop(first(edges.filter(F.col("subject") == start)), 1).filter(F.col("n1") != end)
    e3 = _hop(first(edges.filter(F.col("object") == end)), 3).filter(F.col("n2") != start)
    # Only middle edges between what both pins reach are grouped.
    mid = edges.join(e1.select(F.col("n1").alias("subject")), "subject", "left_semi").join(e3.select(F.col("n2").alias("object")), "object", "left_semi")
    out = e1.join(_hop(first(mid), 2), "n1").join(e3, "n2").select("n0", "n1", "n2", "n3", "p1", "p2", "p3")
    return out.orderBy("n1", "n2").limit(limit) if limit else out


def paths_upto(kg: KnowledgeGraph, start: str, end: str, most: int, allowed: list[str] | None = None) -> DataFrame:
    """(n_hops, nodes, edges): directed paths of at most `most` edges from start to end, no node twice; parallel edges make paths of their own.

    What cannot reach end in the hops that are left is pruned before each join. A node
    has no paths to itself.
    """
    edges = kg.edges.select("subject", "predicate", "object", "edge_idx")
    if allowed:
        edges = edges.filter(F.col("predicate").isin(list(allowed)))
    if start == end:
        edges = edges.limit(0)
    links = edges.select(F.col("subject").alias("last"), F.col("object").alias("to"), "edge_idx")
    # near[k]: nodes from which end is k hops away or less.
    near = [kg.spark.createDataFrame([(end,)], "to string")]
    for _ in range(most):
        near.append(near[-1].union(links.join(near[-1], "to", "left_semi").select(F.col("last").alias("to"))).distinct())
    found = None
    front = links.filter(F.col("last") == start).select(F.array("last", "to").alias("nodes"), F.array("edge_idx").alias("edges"), F.col("to").alias("last"))
    for hop in range(1, most + 1):
        if hop > 1:
            front = front.join(links, "last").filter(~F.array_contains("nodes", F.col("to")))
            front = front.select(F.concat("nodes", F.array("to")).alias("nodes"), F.concat("edges", F.array("edge_idx")).alias("edges"), F.col("to").alias("last"))
        done = front.filter(F.col("last") == end).select(F.lit(hop).alias("n_hops"), "nodes", "edges")
        found = done if found is None else found.unionByName(done)
        front = front.filter(~F.col("last").isin(start, end)).join(near[max(most - hop, 0)].withColumnRenamed("to", "last"), "last", "left_semi")
    return found


def mechanistic_paths(kg: KnowledgeGraph, start: str, end: str) -> DataFrame:
    return paths3(kg, start, end, allowed=MECHANISTIC)


def hydrate(kg: KnowledgeGraph, paths: DataFrame) -> DataFrame:
    """Paths with name and categories of their inner nodes."""
    for i in (1, 2):
        info = kg.node_records.select(F.col("id").alias(f"n{i}"), F.col("name").alias(f"name{i}"), F.col("categories").alias(f"categories{i}"))
        paths = paths.join(info, f"n{i}", "left")
    return paths


def path_count(kg: KnowledgeGraph, start: str, end: str, end_outgoing: bool = False) -> DataFrame:
    """n_paths without making the paths: parallel edges count on the first two hops, the last counts once.

    end_outgoing counts start -> n1 -> n2 <- end instead of directed paths.
    """
    e = kg.edges.select("subject", "object")
    near, far = ("object", "subject") if end_outgoing else ("subject", "object")
    last = e.filter(F.col(far) == end).select(F.col(near).alias("n2")).filter(F.col("n2") != start).distinct()
    hop1 = e.filter(F.col("subject") == start).filter(F.col("object") != end).groupBy(F.col("object").alias("n1")).agg(F.count(F.lit(1)).alias("k1"))
    hop2 = e.select(F.col("subject").alias("n1"), F.col("object").alias("n2")).join(last, "n2", "left_semi")
    return hop1.join(hop2, "n1").agg(F.coalesce(F.sum("k1"), F.lit(0)).alias("n_paths"))


def two_hop_multiplicity(kg: KnowledgeGraph, start: str) -> DataFrame:
    """(n2, ways): by how many pairs of edges each node two hops away is reached."""
    e = kg.edges.select("subject", "object")
    hop1 = e.filter(F.col("subject") == start).groupBy(F.col("object").alias("n1")).agg(F.count(F.lit(1)).alias("k1"))
    return hop1.join(e.select(F.col("subject").alias("n1"), F.col("object").alias("n2")), "n1").groupBy("n2").agg(F.sum("k1").alias("ways"))


def one_row(*frames: DataFrame) -> DataFrame:
    """The columns of frames of one row each, in one row."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out.agg(*[F.max(c).alias(c) for c in out.columns])


def multiplicity_distribution(ways: DataFrame) -> DataFrame:
    """(ways, n_nodes) of two_hop_multiplicity."""
    return ways.groupBy("ways").agg(F.count(F.lit(1)).alias("n_nodes"))


def mean_fan_out(kg: KnowledgeGraph, start: str) -> DataFrame:
    """avg_fan_out: mean out-degree of the neighbours of start."""
    hop1 = kg.edges.filter(F.col("subject") == start).select(F.col("object").alias("id")).distinct()
    n = hop1.join(kg.edges.select(F.col("subject").alias("id"), F.lit(1).alias("one")), "id", "left").groupBy("id").agg(F.count("one").alias("n"))
    return n.agg(F.avg("n").alias("avg_fan_out"))


def explosion_report(kg: KnowledgeGraph, start: str, end: str) -> DataFrame:
    """One row: degrees, nodes two hops away, their overlap with the neighbours of end, how many ways lead to one, paths."""
    e = kg.edges
    ways = two_hop_multiplicity(kg, start)
    ends = e.filter(F.col("object") == end).select(F.col("subject").alias("n2")).distinct()
    overlap = ways.join(ends, "n2", "left_semi").agg(F.count(F.lit(1)).alias("middle_nodes"))
    stats = ways.agg(F.count(F.lit(1)).alias("two_hop_nodes"), F.avg("ways").alias("avg_ways"), F.max("ways").alias("max_ways"), F.median("ways").alias("median_ways"))
    deg = e.agg(F.count(F.when(F.col("subject") == start, 1)).alias("start_degree"), F.count(F.when(F.col("subject") == end, 1)).alias("end_degree"))
    return one_row(deg, stats, overlap, path_count(kg, start, end)).withColumn("overlap_percent", F.col("middle_nodes") * 100.0 / F.greatest("two_hop_nodes", F.lit(1)))


def top_middle_nodes(kg: KnowledgeGraph, start: str, end: str, k: int = 10) -> DataFrame:
    """(n2, ways): the k middle nodes that most paths go through."""
    ends = kg.edges.filter(F.col("object") == end).select(F.col("subject").alias("n2")).distinct()
    return two_hop_multiplicity(kg, start).join(ends, "n2", "left_semi").orderBy(F.desc("ways"), "n2").limit(k)


def category_histogram(kg: KnowledgeGraph, paths: DataFrame) -> DataFrame:
    """(hop, category, n): first category of the nodes at hop 1 and 2."""
    both = paths.select(F.explode(F.array(F.struct(F.lit(1).alias("hop"), F.col("n1").alias("id")), F.struct(F.lit(2).alias("hop"), F.col("n2").alias("id")))).alias("x")).select("x.*")
    return both.groupBy("hop", "id").agg(F.count(F.lit(1)).alias("k")).join(kg.node_records.select("id", _first_category().alias("category")), "id", "left").groupBy("hop", F.coalesce("category", F.lit("biolink:NamedThing")).alias("category")).agg(F.sum("k").alias("n"))


def predicate_patterns(paths: DataFrame) -> DataFrame:
    """(pattern, n): predicates along the paths."""
    return paths.groupBy(F.concat_ws(" -> ", "p1", "p2", "p3").alias("pattern")).agg(F.count(F.lit(1)).alias("n"))


def predicate_histogram(paths: DataFrame) -> DataFrame:
    """(hop, predicate, n)."""
    hops = F.explode(F.array(*[F.struct(F.lit(i).alias("hop"), F.col(f"p{i}").alias("predicate")) for i in (1, 2, 3)]))
    return paths.select(hops.alias("x")).select("x.*").groupBy("hop", "predicate").agg(F.count(F.lit(1)).alias("n"))


def _first_category() -> Column:
    return F.coalesce(F.get("categories", F.lit(0)), F.lit("biolink:NamedThing"))

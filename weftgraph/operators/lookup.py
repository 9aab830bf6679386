"""Answers of a pattern: bindings, results, the induced subgraph.

The pattern is folded into one join plan; nothing runs before an answer's table is
read, unless node filters make the plan adaptive (what they apply to depends on
which nodes are bound when an edge is matched).
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.graph import KnowledgeGraph
from weftgraph.operators.durable import cut
from weftgraph.operators.match import LITERAL_IDS, match_edge, match_subclass, nodes_allowed
from weftgraph.plans import planner
from weftgraph.plans.ir import BadQuery, QEdge, QueryGraph, parse
from weftgraph.plans.rewrite import expand_subclasses
from weftgraph.plugins import node_condition

#: Above so many paths the answer leaves attributes out, if the request does not say.
DEHYDRATE_ABOVE = 10_000_000
INFORES = "infores:weftgraph"


@dataclass
class LookupResult:
    """Tables of an answer; result_id joins them.

    paths: n_<node> (ids), and e_<edge>, p_<edge>, v_<edge> (edge_idx, predicate, via_inverse), result_id.
    node_bindings: result_id, qnode, id. edge_bindings: result_id, qedge, kg_edge.
    kg_edges: kg_edge, subject, predicate, object, edge_idx (null for derived edges), support (their auxiliary graph).
    aux_graphs: aux_graph, kg_edge.
    """

    kg: KnowledgeGraph
    pattern: QueryGraph
    paths: DataFrame
    dehydrated: bool = False
    logs: list[dict] = field(default_factory=list)

    @property
    def shown(self) -> list[str]:
        return [k for k, n in self.pattern.nodes.items() if not n.is_superclass]

    def bound(self, node: str) -> Column:
        """What a node counts as bound to: the queried id, if it was found below it."""
        n = self.pattern.nodes[node]
        return F.col(f"n_{n.superclass}") if n.superclass else F.col(f"n_{node}")

    @property
    def key_nodes(self) -> list[str]:
        return [k for k in self.shown if self.pattern.nodes[k].interpretation == "BATCH"]

    @property
    def results(self) -> DataFrame:
        """result_id and k_<node> of every BATCH node, with the number of paths."""
        keys = [self.bound(k).alias(f"k_{k}") for k in self.key_nodes]
        return self.paths.select("result_id", *keys).groupBy("result_id", *[f"k_{k}" for k in self.key_nodes]).agg(F.count(F.lit(1)).alias("n_paths"))

    def first_results(self, n: int) -> DataFrame:
        """The first n results in the order that messages have them."""
        return self.results.orderBy("result_id").limit(n)

    def widest(self, node: str, k: int = 10) -> DataFrame:
        """(id, n_paths): the k bindings of a node that most paths go through, which cost most."""
        return self.paths.groupBy(F.col(f"n_{node}").alias("id")).agg(F.count(F.lit(1)).alias("n_paths")).orderBy(F.desc("n_paths"), "id").limit(k)

    @property
    def node_bindings(self) -> DataFrame:
        one = F.explode(F.array(*[F.struct(F.lit(k).alias("qnode"), self.bound(k).alias("id")) for k in self.shown]))
        return self.paths.select("result_id", one.alias("b")).select("result_id", "b.qnode", "b.id").distinct()

    def _bound_edges(self) -> DataFrame:
        """result_id, qedge, edge_idx, predicate, direct, tops, subs: a row for each path and ordinary edge."""
        rows = []
        null = F.lit(None).cast(self.kg.edges.schema["edge_idx"].dataType)
        for k, e in self.pattern.edges.items():
            if e.is_subclass:
                continue
            tops, subs, direct = [], [], F.lit(True)
            for end in e.ends:
                top = self.pattern.nodes[end].superclass
                tops.append(F.col(f"n_{top}") if top else F.col(f"n_{end}"))
                sub = f"e_{end}_subclass_edge" if top else None
                if top:
                    direct = direct & (F.col(f"n_{end}") == F.col(f"n_{top}"))
                subs.append(F.col(sub) if sub else null)
            rows.append(F.struct(F.lit(k).alias("qedge"), F.col(f"e_{k}").alias("edge_idx"), direct.alias("direct"), F.array(*tops).alias("tops"), F.array(*subs).alias("subs")))
        return self.paths.select("result_id", F.explode(F.array(*rows)).alias("b")).select("result_id", "b.*")

    def _kept(self, by_matching_child: bool = True) -> DataFrame:
        """_bound_edges once each, without those that a direct edge makes superfluous, with the stored edge's columns."""
        seen = self._bound_edges().groupBy("result_id", "qedge", "edge_idx", "direct").agg(F.first("tops").alias("tops"), F.flatten(F.collect_set("subs")).alias("subs"))
        w = Window.partitionBy("result_id", "qedge")
        seen = seen.withColumn("any_direct", F.max("direct").over(w)).filter(F.col("direct") | ~F.col("any_direct"))
        if not by_matching_child:
            seen = seen.withColumn("subs", F.flatten(F.collect_set("subs").over(w)))
        seen = seen.withColumn("subs", F.array_sort(F.array_distinct(F.array_compact("subs"))))
        cols = ["subject", "predicate", "object"] + ([] if self.dehydrated else ["qualifiers", "sources"])
        found = seen.join(self.kg.edges.select("edge_idx", "edge_id", *cols), "edge_idx")
        same = ["subject", "predicate", "object"] + ([] if self.dehydrated else ["qk", "sk"])
        if not self.dehydrated:  # only of edges that have matched
            sources = F.transform("sources", lambda s: F.struct(s["resource_id"], s["resource_role"]))
            found = found.withColumns({"qk": F.to_json("qualifiers"), "sk": F.to_json(sources)}).drop("qualifiers", "sources")
        first = Window.partitionBy("result_id", "qedge", *same).orderBy("edge_idx")
        return found.withColumn("nth", F.row_number().over(first)).filter("nth = 1").drop("nth")

    def _hierarchy(self) -> DataFrame:
        """The stored edges that subclass edges can be: those of the hierarchy only."""
        return self.kg.edges.filter(F.col("predicate") == self.kg.ontology.subclass_of)

    def edges(self, compat: bool = False) -> DataFrame:
        """result_id, qedge, kg_edge, composite, edge_idx, subject, predicate, object, subs, tops of the edges of every result.

        An edge found below the queried ids is derived: it joins the queried ids, its
        name lists the stored edge and the subclass edges that support it. compat
        attaches all subclass edges of a result to each of them, not only the matching ones.
        """
        kept = self._kept(not compat)
        name = _edge_name()
        ids = self._hierarchy().select(F.col("edge_idx").alias("sub"), name.alias("sub_name"))
        if not any(e.is_subclass for e in self.pattern.edges.values()):
            return kept.withColumns({"stored_edge": name, "kg_edge": name, "composite": F.lit(False), "sub_names": F.array().cast("array<string>")})
        key = ["result_id", "qedge", "edge_idx"]
        named = kept.select(*key, F.explode("subs").alias("sub")).join(ids, "sub").groupBy(*key).agg(F.array_sort(F.collect_set("sub_name")).alias("sub_names"))
        out = kept.join(named, key, "left").withColumn("sub_names", F.when(F.col("direct"), F.array().cast("array<string>")).otherwise(F.coalesce("sub_names", F.array().cast("array<string>"))))
        composite = F.size("sub_names") > 0
        return out.withColumns({"stored_edge": name, "composite": composite, "kg_edge": F.when(composite, F.concat_ws("_", name, F.concat_ws("_", "sub_names"))).otherwise(name)})

    def edge_bindings(self, compat: bool = False) -> DataFrame:
        return self.edges(compat).select("result_id", "qedge", "kg_edge").distinct()

    def kg_edges(self, compat: bool = False) -> DataFrame:
        e = self.edges(compat)
        stored = e.select(F.col("stored_edge").alias("kg_edge"), "subject", "predicate", "object", "edge_idx", F.lit(None).cast("string").alias("support"))
        derived = e.filter("composite").select("kg_edge", F.col("tops")[0].alias("subject"), "predicate", F.col("tops")[1].alias("object"), F.lit(None).cast(self.kg.edges.schema["edge_idx"].dataType).alias("edge_idx"), F.concat(F.lit("aux_"), F.col("kg_edge")).alias("support"))
        subs = e.filter("composite").select(F.explode("subs").alias("sub")).distinct()
        of_subs = self._hierarchy().join(subs, F.col("edge_idx") == F.col("sub"), "left_semi").select(_edge_name().alias("kg_edge"), "subject", "predicate", "object", "edge_idx", F.lit(None).cast("string").alias("support"))
        return stored.unionByName(derived).unionByName(of_subs).dropDuplicates(["kg_edge"])

    def aux_graphs(self, compat: bool = False) -> DataFrame:
        e = self.edges(compat).filter("composite")
        return e.select(F.concat(F.lit("aux_"), F.col("kg_edge")).alias("aux_graph"), F.explode(F.concat(F.array("stored_edge"), F.col("sub_names"))).alias("kg_edge")).distinct()

    @property
    def kg_nodes(self) -> DataFrame:
        """Nodes of bindings and of kept edges; dehydrated: name and most specific category only."""
        ids = self.node_bindings.select("id").union(self.kg_edges().select(F.explode(F.array("subject", "object")))).distinct()
        found = ids.join(self.kg.node_records, "id", "left").withColumn("categories", F.coalesce("categories", F.array().cast("array<string>")))
        if self.dehydrated:
            return found.select("id", "name", F.array(most_specific(self.kg, F.col("categories"))).alias("categories"))
        return found.select("id", "name", "categories", "attributes")


def _edge_name() -> Column:
    """What a stored edge is called: its id, or a digest if it has none."""
    return F.coalesce("edge_id", F.concat(F.lit("e:"), F.substring(F.md5(F.col("edge_idx").cast("string")), 1, 12)))


def most_specific(kg: KnowledgeGraph, categories: Column) -> Column:
    """The first category that is no ancestor of another one listed."""
    onto = kg.ontology
    pairs = {a: onto.category_descendants(a) for a in onto.category_children}
    flat = [x for a, ds in pairs.items() for x in (F.lit(a), F.array(*map(F.lit, ds)))]
    below = F.create_map(*flat) if flat else F.create_map().cast("map<string,array<string>>")
    leaf = lambda c: ~F.coalesce(F.arrays_overlap(F.coalesce(F.try_element_at(below, c), F.array().cast("array<string>")), F.filter(categories, lambda d: d != c)), F.lit(False))
    return F.coalesce(F.get(F.filter(categories, leaf), F.lit(0)), F.lit("biolink:NamedThing"))


def _columns(m: DataFrame, e: QEdge) -> DataFrame:
    """A match under the names of its pattern edge."""
    cols = [F.col("s").alias(f"n_{e.subject}")] + ([F.col("o").alias(f"n_{e.object}")] if e.object != e.subject else [])
    return m.select(*cols, F.col("edge_idx").alias(f"e_{e.key}"), F.col("predicate").alias(f"p_{e.key}"), F.col("via_inverse").alias(f"v_{e.key}"))


def _join(paths: DataFrame, m: DataFrame, e: QEdge, bound: set[str]) -> DataFrame:
    shared = [f"n_{n}" for n in dict.fromkeys(e.ends) if n in bound]
    return paths.join(m, shared) if shared else paths.crossJoin(m)


def _fold(kg: KnowledgeGraph, q: QueryGraph, order: list[QEdge], depth: int, max_paths: int) -> DataFrame:
    """One lazy join plan over all edges, in order."""
    paths, bound = None, set()
    for e in order:
        s, o = q.nodes[e.subject], q.nodes[e.object]
        m = match_subclass(kg, o.ids, depth) if e.is_subclass else match_edge(kg, e, s.ids, o.ids)
        for n, col in ((s, "s"), (o, "o")):
            if n.key not in bound and not (e.is_subclass and n.is_superclass):
                allowed = nodes_allowed(kg, n, n.pinned or n.superclass is not None)
                if allowed is not None:
                    m = m.join(allowed.select(F.col("id").alias(col)), col, "left_semi").select("s", "o", "edge_idx", "predicate", "via_inverse")
        m = _columns(m, e)
        paths = m if paths is None else _join(paths, m, e, bound)
        bound |= set(e.ends)
        if max_paths:
            paths = paths.orderBy(*[c for c in paths.columns if c[:2] == "e_"], *[c for c in paths.columns if c[:2] == "n_"]).limit(max_paths)
    return paths


def _adaptive(kg: KnowledgeGraph, q: QueryGraph, depth: int, filters: dict | None, max_paths: int) -> DataFrame:
    """Edge by edge with the ids found so far: each match is kept, its ids narrow both its nodes.

    Up to LITERAL_IDS found ids become conditions on the next scan, more are joined.
    Filters test unbound nodes when they are discovered, and both ends of an edge
    whose ends are both bound.
    """
    left, order = q.copy(), []
    pins = {k: n.ids for k, n in q.nodes.items()}
    counts: dict[str, int] = {}
    matches: dict[str, DataFrame] = {}
    while left.edges:
        e = planner.next_edge(left, counts, planner.Sizes.of(kg.metadata))
        s, o = q.nodes[e.subject], q.nodes[e.object]
        if e.is_subclass:
            m = match_subclass(kg, pins[e.object], depth)
        else:
            if pins[e.subject] is None and pins[e.object] is None:
                raise BadQuery("no node of the pattern has ids")
            both = pins[e.subject] is not None and pins[e.object] is not None
            m = match_edge(kg, e, pins[e.subject], pins[e.object])
            for n, col in ((s, "s"), (o, "o")):
                tested = both or pins[n.key] is None
                allowed = nodes_allowed(kg, n, pins[n.key] is not None, filters if tested else None, m.select(F.col(col).alias("id")))
                if allowed is not None:
                    m = m.join(allowed.select(F.col("id").alias(col)), col, "left_semi").select("s", "o", "edge_idx", "predicate", "via_inverse")
        m = cut(m)
        for n, col in ((e.subject, "s"), (e.object, "o")):
            ids = cut(m.select(F.col(col).alias("id")).distinct())
            first = [r["id"] for r in ids.limit(LITERAL_IDS + 1).collect()]
            pins[n], counts[n] = (first, len(first)) if len(first) <= LITERAL_IDS else (ids, ids.count())
        matches[e.key] = _columns(m, e)
        order.append(e)
        del left.edges[e.key]
        left = left.without_orphans()
    paths, bound, waiting = None, set(), list(order)
    while waiting:
        e = next((x for x in waiting if paths is None or bound & set(x.ends)), None)
        if e is None:
            raise BadQuery("the pattern is not connected")
        waiting.remove(e)
        paths = matches[e.key] if paths is None else _join(paths, matches[e.key], e, bound)
        bound |= set(e.ends)
        if max_paths:
            paths = paths.orderBy(*sorted(paths.columns)).limit(max_paths)
    return paths


def lookup(
    kg: KnowledgeGraph, query_graph: dict | QueryGraph, subclass: bool = True, subclass_depth: int = 1, filter_config: dict | None = None,
    dehydrated: bool | None = False, max_paths: int = 0, adaptive: bool = False, allow_full_scan: bool = False, allow_product: bool = False,
) -> LookupResult:
    """All answers of a pattern.

    Pinned nodes also match what lies at most subclass_depth below their ids. A
    pattern without edges has no answers; one that is not connected, or reaches no
    ids, is refused unless allowed. max_paths cuts intermediate paths in the order
    of their edges (0: no limit). adaptive matches edge by edge, so that few ids found
    on one narrow the scan of the next: for selective patterns over very large graphs;
    the answer is the same. dehydrated None decides by the number of paths.
    """
    q = query_graph if isinstance(query_graph, QueryGraph) else parse(query_graph)
    q = q.without_orphans()
    original = q
    if subclass and subclass_depth >= 0:
        q = expand_subclasses(q, kg.ontology)
    if not q.edges:
        return LookupResult(kg, q, kg.spark.createDataFrame([], "result_id string"), bool(dehydrated))
    order = planner.join_order(q, allow_product, planner.Sizes.of(kg.metadata))
    planner.check_pinned(q, order, allow_full_scan)
    filters = filter_config if node_condition(filter_config) is not None else None
    paths = _adaptive(kg, q, subclass_depth, filters, max_paths) if filters or adaptive else _fold(kg, q, order, subclass_depth, max_paths)
    out = LookupResult(kg, q, paths, bool(dehydrated))
    keys = [F.concat(F.lit(f"{k}="), out.bound(k)) for k in sorted(out.key_nodes)]
    out.paths = paths.withColumn("result_id", F.md5(F.concat_ws("\x1f", *keys)) if keys else F.md5(F.lit("")))
    needed = {k: n.ids for k, n in original.nodes.items() if n.interpretation == "ALL"}
    if needed:
        seen = [F.collect_set(F.when(F.col(f"n_{k}").isin(ids), F.col(f"n_{k}"))).alias(f"seen_{k}") for k, ids in needed.items()]
        whole = reduce(lambda a, b: a & b, [F.size(f"seen_{k}") == len(ids) for k, ids in needed.items()])
        out.paths = out.paths.join(out.paths.groupBy("result_id").agg(*seen).filter(whole), "result_id", "left_semi")
    if dehydrated is None:
        out.paths = cut(out.paths)
        out.dehydrated = out.paths.count() > DEHYDRATE_ABOVE
    return out

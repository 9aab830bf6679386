"""Graph queries over the whole tables nodes and edges, each with the SQL that gives the same.

Pinned ids are chosen by the data (the most frequent subject, the object it is most
linked with), so that the queries mean the same on any of its sizes.
"""

from __future__ import annotations

from collections.abc import Callable
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.graph import KnowledgeGraph
from weftgraph.operators import adjacency, explore, metadata, paths, response, validate
from weftgraph.operators.durable import shared_dir
from weftgraph.operators.lookup import LookupResult, lookup, most_specific
from weftgraph.plugins import NodeMetadata, cooccurrence_edges, node_counts_of
from weftgraph.sources.ingest import build, edges_of_lines, nodes_of_lines, source_chain, triples_of_lines
from weftgraph.sources.normalize import OWN_SOURCE
from weftgraph.sources.tables import ONTOLOGY, graph_of_tables

B = "biolink:"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def graph(spark: SparkSession, d: str) -> KnowledgeGraph:
    kg = graph_of_tables(spark, spark.read.parquet(f"{d}/edges.parquet"), spark.read.parquet(f"{d}/nodes.parquet"))
    kg.metadata["folder"] = d
    return kg


#: Ids that have been chosen, by application and folder: once for each table, not for each query.
_chosen: dict[tuple, str] = {}


def _once(kg: KnowledgeGraph, what: str, choose: Callable[[], DataFrame]) -> str:
    key = (kg.spark.sparkContext.applicationId, kg.metadata.get("folder"), what)
    if kg.metadata.get("folder") is None or key not in _chosen:
        row = choose().first()  # one row comes to the driver
        _chosen[key] = row[0] if row else ""
    return _chosen[key]


def hub(kg: KnowledgeGraph) -> str:
    """The most frequent subject."""
    return _once(kg, "hub", lambda: kg.edges.groupBy("subject").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "subject"))


def partner(kg: KnowledgeGraph, h: str) -> str:
    """The object that the hub has most edges to."""
    return _once(kg, f"partner {h}", lambda: kg.edges.filter(F.col("subject") == h).groupBy("object").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "object"))


def tree_top(kg: KnowledgeGraph) -> str:
    """The node with most direct subclasses."""
    return _once(kg, "top", lambda: kg.edges.filter(F.col("predicate") == B + "subclass_of").groupBy("object").agg(F.countDistinct("subject").alias("n")).orderBy(F.desc("n"), "object"))


_NOT_BLANK = " and ".join(f"trim({c}) <> ''" for c in ("subject", "predicate", "object"))
#: The graph, the pinned ids and degrees in SQL.
GRAPH = f"""with recursive e as (select edge_row as edge_idx, id as edge_id, subject, predicate, object, object_aspect_qualifier as aspect, object_direction_qualifier as direction,
  sources, knowledge_level, agent_type, publications, p_value, evidence_count from edges where {_NOT_BLANK}),
ends as (select subject as id from e union select object from e),
rec as (select id, max(node_row) as r from nodes where trim(id) <> '' group by id),
v as (select ends.id, n.name, coalesce(list_filter(n.category, lambda c: c is not null), []) as categories, n.information_content as ic, n.equivalent_identifiers as eq
  from ends left join rec on rec.id = ends.id left join nodes n on n.node_row = rec.r),
hub as (select subject as id from e group by subject order by count(*) desc, subject limit 1),
mate as (select object as id from e where subject = (select id from hub) group by object order by count(*) desc, object limit 1),
top as (select object as id from e where predicate = 'biolink:subclass_of' group by object order by count(distinct subject) desc, object limit 1),
deg as (select id, count(*) as total from (select subject as id from e union all select object from e) group by id)
"""


def query(sql: str | None = None) -> Callable:
    def add(f: Callable[[KnowledgeGraph], DataFrame]) -> Callable:
        QUERIES[f.__name__] = lambda spark, d: f(graph(spark, d))
        if sql is not None:
            SQL[f.__name__] = GRAPH + sql
        return f

    return add


def _names(ps: list[str]) -> str:
    return "(" + ", ".join(f"'{B}{p}'" for p in ps) + ")"


def _m(along: list[str] | None, against: list[str] | None, extra: str = "true") -> str:
    """SQL of a pattern edge: s, o, edge_idx, predicate, inv. None: any predicate; []: not at all."""
    cond = lambda ps: "true" if ps is None else f"predicate in {_names(ps)}"
    out = f"select subject as s, object as o, edge_idx, predicate, false as inv from e where {cond(along)} and ({extra})"
    if against is None or against:
        out += f" union all select object, subject, edge_idx, predicate, true from e where {cond(against)} and ({extra})"
    return f"({out})"


def _is(c: str, alias: str = "v") -> str:
    return f"list_contains({alias}.categories, '{B}{c}')"


def _one(kg: KnowledgeGraph, edge: dict, n0: dict, n1: dict, **kw) -> LookupResult:
    return lookup(kg, {"nodes": {"n0": n0, "n1": n1}, "edges": {"e0": {"subject": "n0", "object": "n1"} | edge}}, **({"subclass": False} | kw))


def _paths(r: LookupResult) -> DataFrame:
    return r.paths.select(F.col("n_n0").alias("n0"), F.col("n_n1").alias("n1"), F.col("e_e0").alias("edge_idx"), F.col("p_e0").alias("predicate"), F.col("v_e0").alias("via_inverse"))


_ROW = "select s as n0, o as n1, edge_idx, predicate, inv as via_inverse from"
_H, _MATE, _TOP = "(select id from hub)", "(select id from mate)", "(select id from top)"

# Pattern edges -----------------------------------------------------------------


@query(f"{_ROW} {_m(['affects'], ['affected_by'])} m join v on v.id = m.o where s = {_H} and {_is('Gene')}")
def onehop_forward(kg):
    return _paths(_one(kg, {"predicates": [B + "affects"]}, {"ids": [hub(kg)]}, {"categories": [B + "Gene"]}))


@query(f"{_ROW} {_m(['affects'], ['affected_by'])} m where o = {_MATE}")
def onehop_backward(kg):
    return _paths(_one(kg, {"predicates": [B + "affects"]}, {}, {"ids": [partner(kg, hub(kg))]}))


@query(f"{_ROW} {_m(None, None)} m where s = {_H} and o = {_MATE}")
def both_pinned(kg):
    h = hub(kg)
    return _paths(_one(kg, {}, {"ids": [h]}, {"ids": [partner(kg, h)]}))


@query(f"{_ROW} {_m(['interacts_with'], ['interacts_with'])} m where s = {_H}")
def symmetric_both_dirs(kg):
    return _paths(_one(kg, {"predicates": [B + "interacts_with"]}, {"ids": [hub(kg)]}, {}))


@query(f"{_ROW} {_m(['treated_by'], ['treats', 'ameliorates_condition', 'preventative_for_condition'])} m where o = {_H}")
def inverse_predicate(kg):
    return _paths(_one(kg, {"predicates": [B + "treated_by"]}, {}, {"ids": [hub(kg)]}))


@query(f"{_ROW} {_m(None, None)} m where s = {_H}")
def wildcard_any_predicate(kg):
    return _paths(_one(kg, {"predicates": [B + "related_to"]}, {"ids": [hub(kg)]}, {}))


@query(f"{_ROW} {_m(['treats', 'ameliorates_condition', 'preventative_for_condition'], ['treated_by'])} m where s = {_H}")
def predicate_descendants(kg):
    return _paths(_one(kg, {"predicates": [B + "treats"]}, {"ids": [hub(kg)]}, {}))


@query(f"{_ROW} {_m(None, None)} m join v on v.id = m.o where s = {_H} and ({_is('Disease')} or {_is('PhenotypicFeature')})")
def category_filter(kg):
    return _paths(_one(kg, {}, {"ids": [hub(kg)]}, {"categories": [B + "Disease", B + "PhenotypicFeature"]}))


@query(f"{_ROW} {_m(['affects'], ['affected_by'])} m where s in (select subject from e group by subject order by count(*) desc, subject limit 50) and o in (select object from e group by object order by count(*) desc, object limit 50)")
def many_pins(kg):
    top = lambda end: [r[0] for r in kg.edges.groupBy(end).count().orderBy(F.desc("count"), end).limit(50).collect()]
    return _paths(_one(kg, {"predicates": [B + "affects"]}, {"ids": top("subject")}, {"ids": top("object")}))


# Constraints --------------------------------------------------------------------


@query(f"{_ROW} {_m(['affects'], ['affected_by'], chr(10) + "(aspect in ('activity', 'abundance', 'activity_or_abundance') and direction = 'increased') or aspect = 'expression'")} m where s = {_H}")
def qualifier_and_or(kg):
    q = lambda t, v: {"qualifier_type_id": B + t, "qualifier_value": v}
    sets = [[q("object_aspect_qualifier", "activity_or_abundance"), q("object_direction_qualifier", "increased")], [q("object_aspect_qualifier", "expression")]]
    return _paths(_one(kg, {"predicates": [B + "affects"], "qualifier_constraints": [{"qualifier_set": s} for s in sets]}, {"ids": [hub(kg)]}, {}))


@query(f"{_ROW} {_m(['affects'], ['affected_by'], 'evidence_count > 5 and p_value < 0.5')} m where s = {_H}")
def attr_gt_lt(kg):
    c = [{"id": B + "evidence_count", "operator": ">", "value": 5}, {"id": "p_value", "operator": "<", "value": 0.5}]
    return _paths(_one(kg, {"predicates": [B + "affects"], "attribute_constraints": c}, {"ids": [hub(kg)]}, {}))


@query(f"{_ROW} {_m(['affects'], ['affected_by'], "knowledge_level in ('prediction', 'observation')")} m where s = {_H}")
def attr_eq_list(kg):
    c = [{"id": B + "knowledge_level", "operator": "==", "value": ["prediction", "observation"]}]
    return _paths(_one(kg, {"predicates": [B + "affects"], "attribute_constraints": c}, {"ids": [hub(kg)]}, {}))


@query(f"{_ROW} {_m(None, None, 'not coalesce(evidence_count > 1, false)')} m where s = {_H}")
def attr_not_missing(kg):
    c = [{"id": B + "evidence_count", "operator": ">", "value": 1, "not": True}]
    return _paths(_one(kg, {"attribute_constraints": c}, {"ids": [hub(kg)]}, {}))


@query(f"{_ROW} {_m(['affects'], ['affected_by'], "coalesce(regexp_matches(agent_type, 'auto|man.al'), false)")} m where s = {_H}")
def attr_regex(kg):
    c = [{"id": B + "agent_type", "operator": "matches", "value": "auto|man.al"}]
    return _paths(_one(kg, {"predicates": [B + "affects"], "attribute_constraints": c}, {"ids": [hub(kg)]}, {}))


@query(f"{_ROW} {_m(['affects'], ['affected_by'])} m join v on v.id = m.o where s = {_H} and v.ic > 60")
def node_attr_constraint(kg):
    c = [{"id": "information_content", "operator": ">", "value": 60}]
    return _paths(_one(kg, {"predicates": [B + "affects"]}, {"ids": [hub(kg)]}, {"constraints": c}))


@query(f"{_ROW} {_m(['affects'], ['affected_by'])} m join v on v.id = m.o where s = {_H} and not coalesce(v.ic > 60, false)")
def node_attr_not(kg):
    c = [{"id": "information_content", "operator": ">", "value": 60, "not": True}]
    return _paths(_one(kg, {"predicates": [B + "affects"]}, {"ids": [hub(kg)]}, {"constraints": c}))


# Joins --------------------------------------------------------------------------


def _cols(r: LookupResult, nodes: list[str], edges: list[str]) -> DataFrame:
    return r.paths.select(*[F.col(f"n_{n}").alias(n) for n in nodes], *[F.col(f"e_{e}").alias(e) for e in edges])


def _chain(kg, *preds, end=None, cats=()):
    nodes = {f"n{i}": {} for i in range(len(preds) + 1)}
    nodes["n0"] = {"ids": [hub(kg)]}
    for i, c in cats:
        nodes[f"n{i}"]["categories"] = [B + c]
    if end:
        nodes[f"n{len(preds)}"] = {"ids": [end]}
    edges = {f"e{i}": {"subject": f"n{i}", "object": f"n{i + 1}"} | ({"predicates": [B + p]} if p else {}) for i, p in enumerate(preds)}
    return lookup(kg, {"nodes": nodes, "edges": edges}, subclass=False)


_AFF, _CAUSE, _INT, _TREAT = _m(["affects"], ["affected_by"]), _m(["causes"], ["caused_by"]), _m(["interacts_with"], ["interacts_with"]), _m(["treats", "ameliorates_condition", "preventative_for_condition"], ["treated_by"])


@query(f"select a.s as n0, a.o as n1, b.o as n2, a.edge_idx as e0, b.edge_idx as e1 from {_AFF} a join {_CAUSE} b on b.s = a.o join v on v.id = a.o where a.s = {_H} and {_is('Gene')}")
def twohop_chain(kg):
    return _cols(_chain(kg, "affects", "causes", cats=[(1, "Gene")]), ["n0", "n1", "n2"], ["e0", "e1"])


@query(f"select a.s as n0, a.o as n1, b.o as n2, a.edge_idx as e0, b.edge_idx as e1, c.edge_idx as e2 from {_AFF} a join {_CAUSE} b on b.s = a.o join {_TREAT} c on c.s = a.s and c.o = b.o where a.s = {_H}")
def triangle_cycle(kg):
    q = {"nodes": {"n0": {"ids": [hub(kg)]}, "n1": {}, "n2": {}}, "edges": {
        "e0": {"subject": "n0", "object": "n1", "predicates": [B + "affects"]}, "e1": {"subject": "n1", "object": "n2", "predicates": [B + "causes"]},
        "e2": {"subject": "n0", "object": "n2", "predicates": [B + "treats"]}}}
    return _cols(lookup(kg, q, subclass=False), ["n0", "n1", "n2"], ["e0", "e1", "e2"])


@query(f"select count(*) as n_paths, count(distinct d.o) as n_ends from {_m(['treats', 'ameliorates_condition', 'preventative_for_condition'], ['treated_by'])} a join {_CAUSE} b on b.s = a.o join {_m(['has_phenotype'], ['phenotype_of'])} c on c.s = b.o join {_m(['participates_in'], ['has_participant'])} d on d.s = c.o where a.s = {_H}")
def fourhop_chain(kg):
    p = _chain(kg, "treats", "causes", "has_phenotype", "participates_in").paths
    return p.agg(F.count(F.lit(1)).alias("n_paths"), F.countDistinct("n_n4").alias("n_ends"))


@query(f"select a.o as n1, count(*) as n_paths from {_m(None, None)} a join {_m(None, None)} b on b.s = a.o where a.s = {_H} and b.o = {_MATE} group by a.o")
def edge_narrowing_equivalence(kg):
    p = _chain(kg, None, None, end=partner(kg, hub(kg))).paths
    return p.groupBy(F.col("n_n1").alias("n1")).agg(F.count(F.lit(1)).alias("n_paths"))


@query("select subject as n0, edge_idx from e where subject = object")
def self_loops(kg):
    p = lookup(kg, {"nodes": {"n0": {}}, "edges": {"e0": {"subject": "n0", "object": "n0"}}}, subclass=False, allow_full_scan=True).paths
    return p.filter(~F.col("v_e0")).select(F.col("n_n0").alias("n0"), F.col("e_e0").alias("edge_idx"))


# Subclasses ---------------------------------------------------------------------

_KIDS = f"kids as (select {_TOP} as s, {_TOP} as o, null::bigint as edge_idx union all select subject, object, min(edge_idx) from e where predicate = 'biolink:subclass_of' and object = {_TOP} and subject <> object group by subject, object)"


@query(f", {_KIDS} select k.s as child, m.o as n1, m.edge_idx, m.predicate from kids k join {_m(None, None)} m on m.s = k.s")
def subclass_depth1(kg):
    r = _one(kg, {}, {"ids": [tree_top(kg)]}, {}, subclass=True)
    return r.paths.select(F.col("n_n0").alias("child"), F.col("n_n1").alias("n1"), F.col("e_e0").alias("edge_idx"), F.col("p_e0").alias("predicate"))


@query(f"select {_TOP} as child, m.o as n1, m.edge_idx, m.predicate from {_m(None, None)} m where m.s = {_TOP}")
def subclass_depth0(kg):
    r = _one(kg, {}, {"ids": [tree_top(kg)]}, {}, subclass=True, subclass_depth=0)
    return r.paths.select(F.col("n_n0").alias("child"), F.col("n_n1").alias("n1"), F.col("e_e0").alias("edge_idx"), F.col("p_e0").alias("predicate"))


_SUBDEEP = f""", walk as (select {_TOP} as s, 0 as d union select e.subject, walk.d + 1 from walk join e on e.object = walk.s and e.predicate = 'biolink:subclass_of' where walk.d < 3)
select s as child, min(d) as depth from walk group by s"""


@query(_SUBDEEP)
def subclass_depth3(kg):
    from weftgraph.operators.match import match_subclass

    t = tree_top(kg)
    by = [match_subclass(kg, [t], d).select(F.col("s").alias("child"), F.lit(d).alias("depth")) for d in range(4)]
    return by[0].unionByName(by[1]).unionByName(by[2]).unionByName(by[3]).groupBy("child").agg(F.min("depth").alias("depth"))


# m: edges below the pinned id; direct ones make the others superfluous.
_DIRECT = f""", {_KIDS}, m as (select k.s as child, x.o as n1, x.edge_idx, k.edge_idx as sub from kids k join {_m(None, None)} x on x.s = k.s),
d as (select *, bool_or(sub is null) over (partition by n1) as any_direct from m),
k as (select n1, edge_idx, min(case when sub is null then 0 else 1 end) as derived, min(sub) as sub from d where sub is null or not any_direct group by n1, edge_idx),
f as (select k.*, row_number() over (partition by n1, subject, predicate, object, to_json(list_value(aspect, direction)), to_json(list_transform(list_filter(sources, lambda x: x is not null), lambda x: struct_pack(i := x.resource_id, r := x.resource_role))) order by k.edge_idx) as nth
  from k join e on e.edge_idx = k.edge_idx)
"""


@query(f"{_DIRECT} select n1, edge_idx, derived = 1 as derived from f where nth = 1")
def direct_edge_priority(kg):
    r = _one(kg, {}, {"ids": [tree_top(kg)]}, {}, subclass=True)
    return r.edges().join(r.results.select("result_id", F.col("k_n1").alias("n1")), "result_id").select("n1", "edge_idx", F.col("composite").alias("derived"))


@query(f"{_DIRECT} select {_TOP} as n0, n1, edge_idx, sub as sub_idx from f where nth = 1 and derived = 1")
def composite_edges(kg):
    r = _one(kg, {}, {"ids": [tree_top(kg)]}, {}, subclass=True)
    return r.edges().filter("composite").select(F.col("tops")[0].alias("n0"), F.col("tops")[1].alias("n1"), "edge_idx", F.col("subs")[0].cast("bigint").alias("sub_idx"))


# Grouping -----------------------------------------------------------------------


@query(f"select o as n1, count(*) as n_paths from {_m(None, None)} m where s = {_H} group by o")
def group_batch(kg):
    return _one(kg, {}, {"ids": [hub(kg)]}, {}).results.select(F.col("k_n1").alias("n1"), "n_paths")


_TWO = "select o from (select o, s from {} x join two on two.id = x.s) group by o having count(distinct s) = 2"
_TWOS = ", two as (select subject as id from e group by subject order by count(*) desc, subject limit 2)"


@query(f"{_TWOS} {_TWO.format(_m(['affects'], ['affected_by']))}".replace("select o from", "select o as n1 from", 1))
def set_all(kg):
    two = [r[0] for r in kg.edges.groupBy("subject").count().orderBy(F.desc("count"), "subject").limit(2).collect()]
    r = _one(kg, {"predicates": [B + "affects"]}, {"ids": two, "set_interpretation": "ALL"}, {})
    return r.results.select(F.col("k_n1").alias("n1"))


@query(f"select a.s as n0, a.o as n1 from {_AFF} a where a.s in (select subject from e group by subject order by count(*) desc, subject limit 20) group by a.s, a.o")
def set_collate(kg):
    top = [r[0] for r in kg.edges.groupBy("subject").count().orderBy(F.desc("count"), "subject").limit(20).collect()]
    r = _one(kg, {"predicates": [B + "affects"]}, {"ids": top}, {"set_interpretation": "COLLATE"})
    n0 = r.results.select("result_id", F.col("k_n0").alias("n0"))
    return r.node_bindings.filter("qnode = 'n1'").join(n0, "result_id").select("n0", F.col("id").alias("n1"))


@query(f"""select o as n1, min(m.edge_idx) as edge_idx from {_m(None, None)} m join e using (edge_idx) where s = {_H}
group by o, subject, e.predicate, object, to_json(list_value(aspect, direction)), to_json(list_transform(list_filter(sources, lambda x: x is not null), lambda x: struct_pack(i := x.resource_id, r := x.resource_role)))""")
def edge_binding_dedup(kg):
    r = _one(kg, {}, {"ids": [hub(kg)]}, {})
    return r.edges().join(r.results.select("result_id", F.col("k_n1").alias("n1")), "result_id").select("n1", "edge_idx")


# Filters ------------------------------------------------------------------------


@query(f"select o as n1, m.edge_idx from {_AFF} m join deg on deg.id = m.o where s = {_H} and deg.total <= 30")
def max_degree(kg):
    r = _one(kg, {"predicates": [B + "affects"]}, {"ids": [hub(kg)]}, {}, filter_config={"max_node_degree": 30})
    return _paths(r).select("n1", "edge_idx")


@query(f"select o as n1, m.edge_idx from {_AFF} m join v on v.id = m.o where s = {_H} and v.ic >= 70")
def min_ic(kg):
    r = _one(kg, {"predicates": [B + "affects"]}, {"ids": [hub(kg)]}, {}, filter_config={"min_information_content": 70})
    return _paths(r).select("n1", "edge_idx")


@query(f"select o as n1, m.edge_idx from {_AFF} m join v on v.id = m.o join deg on deg.id = m.o where s = {_H} and v.ic >= 50 and deg.total <= 60 and {_is('Gene')}")
def combined_filters(kg):
    r = _one(kg, {"predicates": [B + "affects"]}, {"ids": [hub(kg)]}, {"categories": [B + "Gene"]}, filter_config={"min_information_content": 50, "max_node_degree": 60})
    return _paths(r).select("n1", "edge_idx")


# Statistics ---------------------------------------------------------------------


@query("select v.id, coalesce(total, 0) as total_degree from v left join deg on deg.id = v.id")
def node_degree(kg):
    return kg.nodes_with_degrees().select("id", "total_degree")


@query("select subject as id, predicate, count(*) as out_degree from e group by all")
def out_degree_by_predicate(kg):
    return adjacency.out_degree(kg, by_predicate=True)


@query(f"select x.id, total as total_degree from (select object as id from e where subject = {_H} union select 'UNKNOWN:1') x left join deg on deg.id = x.id")
def degrees_of_neighbors(kg):
    ids = kg.edges.filter(F.col("subject") == hub(kg)).select(F.col("object").alias("id")).union(kg.spark.createDataFrame([("UNKNOWN:1",)], "id string"))
    return adjacency.degrees_of(kg, ids)


@query("select predicate, count(*) as n from e group by predicate")
def predicate_stats(kg):
    return metadata.predicate_stats(kg)


_CAT = "coalesce(v.categories[1], 'biolink:NamedThing')"


@query(f"select {_CAT} as category, string_agg(distinct split_part(id, ':', 1), ',' order by split_part(id, ':', 1)) as id_prefixes from v group by 1")
def category_prefixes(kg):
    return metadata.category_prefixes(kg).withColumn("id_prefixes", F.array_join("id_prefixes", ","))


_TRIPLES = f", c as (select id, {_CAT} as cat from v), t as (select a.cat as subject_category, e.predicate, b.cat as object_category, e.* exclude (predicate) from e join c a on a.id = e.subject join c b on b.id = e.object) "


@query(f"{_TRIPLES} select subject_category, predicate, object_category, count(*) as n, min_by(subject, edge_idx) as subject, min_by(object, edge_idx) as object from t group by 1, 2, 3")
def triple_counts(kg):
    return metadata.triple_counts(kg)


@query(f"{_TRIPLES} select subject_category, predicate, object_category, min_by(subject, edge_idx) as subject, min_by(object, edge_idx) as object from t group by 1, 2, 3")
def testing_edges(kg):
    return metadata.testing_edges(kg).drop("n")


@query(f"select {_CAT} as category, count(distinct split_part(id, ':', 1)) as n_prefixes, (bool_or(ic is not null))::int + (bool_or(eq is not null))::int as n_attributes from v group by 1")
def meta_nodes(kg):
    return metadata.meta_nodes(kg).select("category", F.size("id_prefixes").alias("n_prefixes"), F.coalesce(F.size("attributes"), F.lit(0)).alias("n_attributes"))


@query(f"""{_TRIPLES} select subject_category, predicate, object_category,
  (bool_or(knowledge_level is not null))::int + (bool_or(agent_type is not null))::int + (bool_or(publications is not null))::int + (bool_or(p_value is not null))::int + (bool_or(evidence_count is not null))::int as n_attributes,
  count(distinct aspect) as n_aspects, count(distinct direction) as n_directions from t group by 1, 2, 3""")
def meta_edges(kg):
    n = lambda t: F.aggregate(F.filter(F.coalesce("qualifiers", F.array().cast("array<struct<qualifier_type_id:string,applicable_values:array<string>>>")), lambda q: q["qualifier_type_id"] == B + t), F.lit(0), lambda a, q: a + F.size(q["applicable_values"]))
    return metadata.meta_edges(kg).select(*metadata.TRIPLE, F.coalesce(F.size("attributes"), F.lit(0)).alias("n_attributes"), n("object_aspect_qualifier").alias("n_aspects"), n("object_direction_qualifier").alias("n_directions"))


@query("""select count(*) as n_edges, count(distinct to_json(list_transform(list_filter(coalesce(sources, []), lambda x: x is not null), lambda x: struct_pack(i := x.resource_id, r := x.resource_role, u := coalesce(x.upstream_resource_ids, []))))) as n_source_sets,
  count(distinct to_json(list_value(aspect, direction))) as n_qualifier_sets from e""")
def dedup_stats(kg):
    return metadata.dedup_stats(kg)


@query("select (select count(*) from e) as n_edges, (select count(distinct predicate) from e) as n_predicates, (select count(*) from v) as n_nodes, (select count(*) from e) * 1.0::double / (select count(*) from v) as avg_out_degree, (select max(n) from (select count(*) as n from e group by subject)) as max_out_degree")
def graph_stats(kg):
    return metadata.graph_stats(kg)


@query(f"select 'category' as kind, {_CAT} as name, count(*) as n from v group by 2 union all select 'predicate', predicate, count(*) from e group by 2")
def graph_metadata(kg):
    return metadata.graph_metadata(kg)


@query(f"{_TRIPLES} select predicate, object_category, count(*) as n from t group by 1, 2")
def edge_summary(kg):
    return metadata.edge_summary(kg)


# Paths --------------------------------------------------------------------------


def _far(kg: KnowledgeGraph) -> tuple[str, str]:
    h = hub(kg)
    return h, partner(kg, h)


_E1 = f"(select * from e where subject = {_H} and object <> {_MATE})"
_E3 = f"(select * from e where object = {_MATE} and subject <> {_H})"
_P3 = f"from {_E1} a join e b on b.subject = a.object join {_E3} c on c.subject = b.object"


@query(f"""select distinct a.subject as n0, a.object as n1, b.object as n2, c.object as n3, first_value(a.predicate) over (partition by a.object order by a.edge_idx) as p1,
  first_value(b.predicate) over (partition by b.subject, b.object order by b.edge_idx) as p2, first_value(c.predicate) over (partition by c.subject order by c.edge_idx) as p3 {_P3}""")
def paths3_unfiltered(kg):
    return paths.paths3_nodes(kg, *_far(kg))


@query(f"select a.object as n1, b.object as n2, a.edge_idx as e1, b.edge_idx as e2, c.edge_idx as e3 {_P3} where a.predicate in {_names(['affects', 'treats', 'causes'])} and b.predicate in {_names(['affects', 'treats', 'causes'])} and c.predicate in {_names(['affects', 'treats', 'causes'])}")
def paths3_filtered(kg):
    return paths.paths3(kg, *_far(kg), allowed=[B + "affects", B + "treats", B + "causes"]).select("n1", "n2", "e1", "e2", "e3")


@query(f"select a.object as n1, b.object as n2, a.edge_idx as e1, b.edge_idx as e2, c.edge_idx as e3 {_P3} where not list_contains(['biolink:related_to', 'biolink:interacts_with'], a.predicate) and not list_contains(['biolink:related_to', 'biolink:interacts_with'], b.predicate) and not list_contains(['biolink:related_to', 'biolink:interacts_with'], c.predicate)")
def paths3_excluded(kg):
    return paths.paths3(kg, *_far(kg), excluded=[B + "related_to", B + "interacts_with"]).select("n1", "n2", "e1", "e2", "e3")


@query(f"select a.object as n1, b.object as n2, a.edge_idx as e1, b.edge_idx as e2, c.edge_idx as e3 {_P3} where {' and '.join(x + '.predicate in ' + '(' + ', '.join(repr(p) for p in paths.MECHANISTIC) + ')' for x in 'abc')}")
def paths3_mechanistic(kg):
    return paths.mechanistic_paths(kg, *_far(kg)).select("n1", "n2", "e1", "e2", "e3")


@query(f"select count(*) as n_paths from (select a.edge_idx, b.edge_idx {_P3.replace(_E3, f'(select distinct subject from e where object = {_MATE} and subject <> {_H})')})")
def path_count(kg):
    return paths.path_count(kg, *_far(kg))


@query(f"select count(*) as n_paths from {_E1} a join e b on b.subject = a.object join (select distinct object as n2 from e where subject = {_MATE} and object <> {_H}) c on c.n2 = b.object")
def path_count_outgoing(kg):
    return paths.path_count(kg, *_far(kg), end_outgoing=True)


_WAYS = f", w as (select b.object as n2, count(*) as ways from e a join e b on b.subject = a.object where a.subject = {_H} group by 1)"


@query(f"{_WAYS} select n2, ways from w")
def explosion_multiplicity(kg):
    return paths.two_hop_multiplicity(kg, hub(kg))


@query(f"{_WAYS} select ways, count(*) as n_nodes from w group by ways")
def multiplicity_distribution(kg):
    return paths.multiplicity_distribution(paths.two_hop_multiplicity(kg, hub(kg)))


@query(f", h as (select distinct object as id from e where subject = {_H}) select avg(n) as avg_fan_out from (select h.id, count(e.edge_idx) as n from h left join e on e.subject = h.id group by h.id)")
def mean_fan_out(kg):
    return paths.mean_fan_out(kg, hub(kg))


@query(f"""{_WAYS}, m as (select distinct subject as n2 from e where object = {_MATE}) select (select count(*) from e where subject = {_H}) as start_degree, (select count(*) from e where subject = {_MATE}) as end_degree,
  count(*) as two_hop_nodes, avg(ways) as avg_ways, max(ways)::bigint as max_ways, median(ways) as median_ways, (select count(*) from w join m using (n2)) as middle_nodes,
  (select count(*) from {_E1} a join e b on b.subject = a.object join (select distinct subject from e where object = {_MATE} and subject <> {_H}) c on c.subject = b.object) as n_paths,
  (select count(*) from w join m using (n2)) * 100.0::double / count(*) as overlap_percent from w""")
def explosion_report(kg):
    return paths.explosion_report(kg, *_far(kg))


@query(f"{_WAYS} select n2, ways from w where n2 in (select subject from e where object = {_MATE}) order by ways desc, n2 limit 10")
def top_contributors(kg):
    return paths.top_middle_nodes(kg, *_far(kg))


@query(f", p as (select a.object as n1, b.object as n2 {_P3}) select 1 as hop, {_CAT} as category, count(*) as n from p join v on v.id = n1 group by 2 union all select 2, {_CAT}, count(*) from p join v on v.id = n2 group by 2")
def hop_category_hist(kg):
    return paths.category_histogram(kg, paths.paths3(kg, *_far(kg)))


@query(f"select a.predicate || ' -> ' || b.predicate || ' -> ' || c.predicate as pattern, count(*) as n {_P3} group by 1")
def predicate_patterns(kg):
    return paths.predicate_patterns(paths.paths3(kg, *_far(kg)))


@query(f", p as (select a.predicate as p1, b.predicate as p2, c.predicate as p3 {_P3}) select 1 as hop, p1 as predicate, count(*) as n from p group by 2 union all select 2, p2, count(*) from p group by 2 union all select 3, p3, count(*) from p group by 2")
def predicate_histogram(kg):
    return paths.predicate_histogram(paths.paths3(kg, *_far(kg)))


# Answers ------------------------------------------------------------------------


@query(f"select x.id, v.name, len(v.categories) as n_categories from (select distinct object as id from e where subject = {_H}) x join v on v.id = x.id")
def enrich_left_join(kg):
    ids = adjacency.out_edges(kg, hub(kg)).select(F.col("object").alias("id"))
    return adjacency.node_records(kg, ids).select("id", "name", F.size("categories").alias("n_categories"))


@query("""select id, name, coalesce(list_filter(categories, lambda c: not (
    (c = 'biolink:Drug' and list_contains(categories, 'biolink:SmallMolecule')) or (c = 'biolink:GeneOrGeneProduct' and list_contains(categories, 'biolink:Gene'))
    or (c = 'biolink:ChemicalEntity' and (list_contains(categories, 'biolink:SmallMolecule') or list_contains(categories, 'biolink:Drug')))))[1], 'biolink:NamedThing') as category from v""")
def dehydrated_nodes(kg):
    return kg.nodes.select("id", "name", most_specific(kg, F.col("categories")).alias("category"))


@query(f"select o as n1, count(*) as n_paths from {_m(None, None)} m where s = {_H} group by o order by n_paths desc, n1 limit 25")
def top_n_results(kg):
    r = _one(kg, {}, {"ids": [hub(kg)]}, {}).results.select(F.col("k_n1").alias("n1"), "n_paths")
    return r.orderBy(F.desc("n_paths"), "n1").limit(25)


_PAIRS = "pairs as (select subject, object, count(*) as n from e group by all)"


@query(f", {_PAIRS}, ids as (select distinct object as id from e where subject = {_H}) select subject, object, n from pairs where n >= 2 and subject in (select id from ids) and object in (select id from ids)")
def cooccurrence_pairs(kg):
    pairs = kg.edges.groupBy("subject", "object").agg(F.count(F.lit(1)).alias("n"))
    ids = adjacency.out_edges(kg, hub(kg)).select(F.col("object").alias("id"))
    return cooccurrence_edges(ids, pairs, 2)


@query(f", a as (select distinct o from {_AFF} m where s = {_H}), b as (select distinct o from {_TREAT} m where s = {_H}) select 'a' as side, o as n1 from a where o not in (select o from b) union all select 'b', o from b where o not in (select o from a)")
def result_diff(kg):
    h = {"ids": [hub(kg)]}
    a, b = (_one(kg, {"predicates": [B + p]}, h, {}).results.select(F.col("k_n1").alias("n1")) for p in ("affects", "treats"))
    return validate.result_diff(a, b, ["n1"])


@query(", a as (select distinct subject, predicate, object from e where evidence_count > 3), b as (select distinct subject, predicate, object from e where p_value < 0.3) select 'a' as side, * from (select * from a except select * from b) union all select 'b', * from (select * from b except select * from a)")
def edge_set_diff(kg):
    full = kg.edges.join(kg.edge_attributes, "edge_idx")
    some = lambda name, f: full.filter(F.exists("attributes", lambda x: (x["original_attribute_name"] == name) & f(x["value_num"])))
    return validate.edge_set_diff(some("evidence_count", lambda v: v > 3), some("p_value", lambda v: v < 0.3))


_INV = """inv(p, q) as (values ('biolink:treats', 'biolink:treated_by'), ('biolink:affects', 'biolink:affected_by'), ('biolink:gene_associated_with_condition', 'biolink:condition_associated_with_gene'), ('biolink:has_phenotype', 'biolink:phenotype_of'),
  ('biolink:participates_in', 'biolink:has_participant'), ('biolink:subclass_of', 'biolink:superclass_of'), ('biolink:ameliorates_condition', 'biolink:ameliorated_by'), ('biolink:causes', 'biolink:caused_by'), ('biolink:preventative_for_condition', 'biolink:prevented_by')),
both_inv as (select p, q from inv union all select q, p from inv),
ok as (select subject, predicate, object from e union select object, predicate, subject from e where predicate in ('biolink:interacts_with', 'biolink:correlated_with', 'biolink:related_to')
  union select object, q, subject from e join both_inv on p = predicate union select subject, q, object from e join both_inv on p = predicate)"""


@query(f", {_INV}, w as (select distinct object as subject, predicate, subject as object from e) select 'EDGE_NOT_FOUND' as error_type, * from (select * from w except select * from ok)")
def edge_exists_inverse(kg):
    turned = kg.edges.select(F.col("object").alias("subject"), "predicate", F.col("subject").alias("object"))
    return validate.edge_errors(kg, turned)


QUERIES["validate_nodes"] = lambda spark, d: validate.missing_nodes(graph(spark, d), spark.read.parquet(f"{d}/nodes.parquet").filter(F.trim("id") != "").select("id"))
SQL["validate_nodes"] = GRAPH + ", w as (select distinct n.id from nodes n where trim(n.id) <> '') select w.id from w where w.id not in (select id from v)"

# Exploring ----------------------------------------------------------------------

_EXP = f"x as (select distinct 'out' as direction, predicate, object as neighbor from e where subject = {_H} and object <> {_H} union select 'in', predicate, subject from e where object = {_H} and subject <> {_H})"


@query(f", {_EXP} select direction, predicate, count(*) as n_neighbors from x group by all")
def expand_groups(kg):
    return explore.expand_groups(kg, hub(kg))


@query(f", {_EXP} select x.neighbor as id, coalesce(v.name, x.neighbor) as name, deg.total as degree from x left join v on v.id = x.neighbor left join deg on deg.id = x.neighbor where direction = 'out' and predicate = 'biolink:affects'")
def expand_ranked(kg):
    return explore.ranked_neighbors(kg, hub(kg), "out", B + "affects")


_RANK = "case c " + " ".join(f"when '{B}{k}' then {r}" for k, r in explore.RANKS.items()) + f" else {explore.DEFAULT_RANK} end"


@query(f""", {_EXP}, y as (select distinct v.id, v.categories from x join v on v.id = x.neighbor),
r as (select id, c, row_number() over (partition by id order by {_RANK} desc, i) as nth from (select id, unnest(categories) as c, generate_subscripts(categories, 1) as i from y)),
z as (select y.id, r.c as category from y left join r on r.id = y.id and r.nth = 1) select category, count(*) as n from z group by category""")
def primary_category_groups(kg):
    ids = explore.expand(kg, hub(kg)).select(F.col("neighbor").alias("id"))
    return explore.category_groups(kg, ids)


@query(f"select case when subject = {_H} then 'forward' else 'reverse' end as direction, predicate, edge_idx from e where (subject = {_H} and object = {_MATE}) or (object = {_H} and subject = {_MATE})")
def edges_either_way(kg):
    return adjacency.edges_either_way(kg, *_far(kg))


@query(f"select object as neighbor, predicate from e where subject = {_H} and predicate in {_names(['affects', 'treats'])}")
def neighbors_out(kg):
    return adjacency.neighbors(kg, hub(kg), [B + "affects", B + "treats"])


@query(f"select subject as neighbor, predicate from e where object = {_MATE}")
def neighbors_in(kg):
    return adjacency.neighbors(kg, partner(kg, hub(kg)), incoming=True)


@query(f"select edge_idx, aspect is not null as has_aspect, ((knowledge_level is not null)::int + (agent_type is not null)::int + (publications is not null)::int + (p_value is not null)::int + (evidence_count is not null)::int) as n_attributes from e where subject = {_H} and object in (select object from e where predicate = 'biolink:treats')")
def edges_to_targets(kg):
    targets = kg.edges.filter(F.col("predicate") == B + "treats").select(F.col("object").alias("id"))
    found = adjacency.with_properties(kg, adjacency.out_edges_to(kg, hub(kg), targets))
    return found.select("edge_idx", F.exists("qualifiers", lambda q: q["qualifier_type_id"] == B + "object_aspect_qualifier").alias("has_aspect"), F.size("attributes").alias("n_attributes"))


@query("select subject, predicate, object, count(*) as n from e group by all having count(*) > 1")
def parallel_edges(kg):
    from weftgraph.operators.match import first_of_parallel

    return first_of_parallel(kg.edges).groupBy("subject", "predicate", "object").agg(F.max("ordinal").cast("bigint").alias("n")).filter("n > 1")


# Ingest -------------------------------------------------------------------------

_SRC = "list_filter(sources, lambda x: x is not null)"


@query(f"""select edge_idx, len(s) + 1 as n_sources, array_to_string(list_transform(list_filter(s, lambda x: x.resource_id is not null and not coalesce(list_contains(flatten(list_transform(s, lambda y: coalesce(y.upstream_resource_ids, []))), x.resource_id), false)), lambda x: x.resource_id), ',') as tops
from (select edge_idx, {_SRC} as s from e where sources is not null) where len(s) > 0""")
def normalize_sources(kg):
    c = kg.edges.filter(F.size("sources") > 0).select("edge_idx", source_chain(F.col("sources"), OWN_SOURCE).alias("c"))
    return c.select("edge_idx", F.size("c").alias("n_sources"), F.array_join(F.col("c")[0]["upstream_resource_ids"], ",").alias("tops"))


@query("select edge_idx, 'biolink:object_aspect_qualifier' as qualifier_type_id, aspect as qualifier_value from e where aspect is not null union all select edge_idx, 'biolink:object_direction_qualifier', direction from e where direction is not null")
def normalize_qualifiers(kg):
    return kg.edges.select("edge_idx", F.explode("qualifiers").alias("q")).select("edge_idx", "q.*")


@query("""select edge_idx, 'evidence_count' as name, evidence_count::double as value_num, 'int' as value_type from e where evidence_count is not null union all select edge_idx, 'p_value', p_value, 'float' from e where p_value is not null
union all select edge_idx, 'knowledge_level', null, 'string' from e where knowledge_level is not null union all select edge_idx, 'agent_type', null, 'string' from e where agent_type is not null union all select edge_idx, 'publications', null, 'list' from e where publications is not null""")
def normalize_attributes(kg):
    a = kg.edge_attributes.select("edge_idx", F.explode("attributes").alias("a"))
    return a.select("edge_idx", F.col("a.original_attribute_name").alias("name"), F.col("a.value_num").alias("value_num"), F.col("a.value_type").alias("value_type"))


def _lines(spark: SparkSession, d: str, *drop: str, **more) -> DataFrame:
    """Edges as raw lines of JSON: with whole sources, without empty qualifiers, which the contract of records forbids."""
    e = spark.read.parquet(f"{d}/edges.parquet").filter((F.trim("subject") != "") & (F.trim("predicate") != "") & (F.trim("object") != ""))
    named = lambda c: F.coalesce(c != "", F.lit(False))
    whole = F.filter("sources", lambda x: x.isNotNull() & named(x["resource_id"]) & named(x["resource_role"]))
    given = {q: F.nullif(q, F.lit("")) for q in ("object_aspect_qualifier", "object_direction_qualifier")}
    e = e.withColumns({"sources": whole, **given}).filter(F.size("sources") > 0).drop("category", "asserted_at", "loaded_at").withColumns(more).drop(*drop)
    return e.select(F.to_json(F.struct("*")).alias("value"))


_WHOLE = "(select *, list_filter(sources, lambda x: x is not null and coalesce(x.resource_id, '') <> '' and coalesce(x.resource_role, '') <> '') as s from e where sources is not null)"


def _with_row(edges: DataFrame) -> DataFrame:
    return edges.withColumn("edge_idx", F.filter("attributes", lambda a: a["original_attribute_name"] == "edge_row")[0]["value_num"].cast("bigint"))


def _from_tables(sql: str | None = None) -> Callable:
    """Registers a query of the tables' folder."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = GRAPH + sql
        return f

    return add


@_from_tables(f"""select edge_idx, edge_id, subject, predicate, object, len(s) + 1 as n_sources, array_to_string(list_transform(list_filter(s, lambda x: not coalesce(list_contains(flatten(list_transform(s, lambda y: coalesce(y.upstream_resource_ids, []))), x.resource_id), false)), lambda x: x.resource_id), ',') as tops,
  (coalesce(aspect, '') <> '')::int + (coalesce(direction, '') <> '')::int as n_qualifiers, 1 + (knowledge_level is not null)::int + (agent_type is not null)::int + (publications is not null)::int + (p_value is not null)::int + (evidence_count is not null)::int as n_attributes
from {_WHOLE} where len(s) > 0""")
def ingest_edges(spark, d):
    """Edge records of raw lines: sources with our own before them, qualifiers, attributes."""
    e = _with_row(edges_of_lines(_lines(spark, d)))
    return e.select("edge_idx", "edge_id", "subject", "predicate", "object", F.size("sources").alias("n_sources"), F.array_join(F.col("sources")[0]["upstream_resource_ids"], ",").alias("tops"), F.size("qualifiers").alias("n_qualifiers"), F.size("attributes").alias("n_attributes"))


@_from_tables(f"select edge_idx, 'biolink:object_aspect_qualifier' as qualifier_type_id, aspect as qualifier_value from {_WHOLE} where len(s) > 0 and aspect <> '' union all select edge_idx, 'biolink:object_direction_qualifier', direction from {_WHOLE} where len(s) > 0 and direction <> ''")
def ingest_qualifiers(spark, d):
    return _with_row(edges_of_lines(_lines(spark, d))).select("edge_idx", F.explode("qualifiers").alias("q")).select("edge_idx", "q.*")


@_from_tables(f""", w as (select * from {_WHOLE} where len(s) > 0)
select edge_idx, 'evidence_count' as name, evidence_count::double as value_num, 'int' as value_type from w where evidence_count is not null union all select edge_idx, 'p_value', p_value, 'float' from w where p_value is not null
union all select edge_idx, 'publications', null, 'list' from w where publications is not null union all select edge_idx, 'edge_row', edge_idx::double, 'int' from w""")
def ingest_attributes(spark, d):
    """But those of texts."""
    a = _with_row(edges_of_lines(_lines(spark, d))).select("edge_idx", F.explode("attributes").alias("a")).filter("a.value_type <> 'string'")
    return a.select("edge_idx", F.col("a.original_attribute_name").alias("name"), F.col("a.value_num").alias("value_num"), F.col("a.value_type").alias("value_type"))


@_from_tables(f"""select edge_idx, s[1].resource_id || case when len(s) > 1 then '<' || array_to_string(list_reverse(list_transform(s[2:], lambda x: x.resource_id)), '<') else '' end as chain from {_WHOLE}
  where len(s) > 0 and len(list_distinct(list_transform(s, lambda x: x.resource_id))) = len(s)""")
def ingest_flat_sources(spark, d):
    """Of lines that give a primary source and its aggregators instead of sources: who draws from whom."""
    flat = {"primary_knowledge_source": F.col("sources")[0]["resource_id"], "aggregator_knowledge_source": F.transform(F.slice("sources", F.lit(2), F.greatest(F.size("sources") - 1, F.lit(0))), lambda x: x["resource_id"])}
    e = _with_row(edges_of_lines(_lines(spark, d, "sources", **flat)))
    own = F.slice("sources", F.lit(2), F.size("sources"))
    e = e.withColumn("own", own).filter(F.size(F.array_distinct(F.transform("own", lambda x: x["resource_id"]))) == F.size("own"))
    linked = F.transform(F.slice("own", F.lit(2), F.size("own")), lambda x, i: F.element_at("own", i + 1)["resource_id"] == x["upstream_resource_ids"][0])
    return e.filter(F.forall(linked, lambda x: x)).select("edge_idx", F.array_join(F.transform("own", lambda x: x["resource_id"]), "<").alias("chain"))


@_from_tables("select n.id, n.name, len(coalesce(n.category, [])) as n_categories, 1 + (n.equivalent_identifiers is not null)::int + (n.information_content is not null)::int as n_attributes from nodes n where n.id <> ''")
def ingest_nodes(spark, d):
    """Node records of raw lines; records without id are left out."""
    n = spark.read.parquet(f"{d}/nodes.parquet").drop("loaded_at", "retired_at")
    out = nodes_of_lines(n.select(F.to_json(F.struct("*")).alias("value")))
    return out.select("id", "name", F.size("categories").alias("n_categories"), F.size("attributes").alias("n_attributes"))


@_from_tables(f"select subject, predicate, object, count(*) as n from {_WHOLE} where len(s) > 0 group by all")
def ingest_triples(spark, d):
    """Statements of a file of lines, of which nothing else is parsed."""
    path = f"{shared_dir(spark)}/lines-{uuid4().hex}"
    _lines(spark, d).write.text(path)
    return triples_of_lines(spark, path).groupBy("subject", "predicate", "object").agg(F.count(F.lit(1)).alias("n"))


@_from_tables(f"select subject as id, count(*) as out_degree from {_WHOLE} where len(s) > 0 group by subject")
def saved_graph(spark, d):
    """Out-degrees of a graph that was built of lines, saved, and loaded again."""
    path = f"{shared_dir(spark)}/graph-{uuid4().hex}"
    build(spark, edges_of_lines(_lines(spark, d)), None, ONTOLOGY).save(path)
    return KnowledgeGraph.load(spark, path).nodes.filter("out_degree > 0").select("id", "out_degree")


@query(f"{_DIRECT}, k2 as (select n1, edge_idx, derived, sub from f where nth = 1) select e.subject, e.predicate, e.object, count(*) as n from (select edge_idx from k2 union select sub from k2 where derived = 1) x join e using (edge_idx) group by all")
def answer_edges(kg):
    """The stored edges of an answer's own graph, those that support derived ones included."""
    r = _one(kg, {}, {"ids": [tree_top(kg)]}, {}, subclass=True)
    e = r.edges()
    ids = e.select("edge_idx").union(e.filter("composite").select(F.explode("subs"))).distinct()
    return kg.edges.join(ids, "edge_idx", "left_semi").groupBy("subject", "predicate", "object").agg(F.count(F.lit(1)).alias("n"))


@query(f"{_DIRECT}, k2 as (select n1, edge_idx, derived, sub from f where nth = 1), ids as (select {_TOP} as id union select n1 from k2 union select subject from k2 join e using (edge_idx) union select object from k2 join e using (edge_idx) union select subject from k2 join e on e.edge_idx = k2.sub where derived = 1) select ids.id, v.name, len(coalesce(v.categories, [])) as n_categories from ids left join v on v.id = ids.id")
def answer_nodes(kg):
    r = _one(kg, {}, {"ids": [tree_top(kg)]}, {}, subclass=True)
    return r.kg_nodes.select("id", "name", F.size("categories").alias("n_categories"))


@query(f"{_DIRECT} select count(*) as n_graphs, count(*) * 2 as n_members from f where nth = 1 and derived = 1 and sub is not null")
def answer_supports(kg):
    """Auxiliary graphs of derived edges, each with its stored edge and one subclass edge."""
    e = _one(kg, {}, {"ids": [tree_top(kg)]}, {}, subclass=True).edges().filter("composite")
    return e.agg(F.count(F.lit(1)).alias("n_graphs"), F.coalesce(F.sum(F.size("sub_names") + 1), F.lit(0)).alias("n_members"))


@query(f"select a.s as n0, a.o as n1, b.o as n2, a.edge_idx as e0, b.edge_idx as e1 from {_AFF} a join {_CAUSE} b on b.s = a.o join v on v.id = a.o where a.s = {_H} and {_is('Gene')}")
def twohop_adaptive(kg):
    """twohop_chain, edge by edge: ids found on one narrow the next."""
    q = {"nodes": {"n0": {"ids": [hub(kg)]}, "n1": {"categories": [B + "Gene"]}, "n2": {}}, "edges": {
        "e0": {"subject": "n0", "object": "n1", "predicates": [B + "affects"]}, "e1": {"subject": "n1", "object": "n2", "predicates": [B + "causes"]}}}
    return _cols(lookup(kg, q, subclass=False, adaptive=True), ["n0", "n1", "n2"], ["e0", "e1"])


@query("select subject, predicate, object, min(edge_idx) as edge_idx from e group by all")
def resolved_edges(kg):
    """For every statement, as an answer from elsewhere would name it, the stored edge that it is filled from."""
    wanted = kg.edges.select("subject", "predicate", "object").distinct()
    key = F.to_json(F.struct("subject", "predicate", "object"))
    found = response.resolve_edges(kg, wanted.withColumns({"key": key, "qualifiers": F.lit(None).cast("string"), "sources": F.lit(None).cast("string")}))
    return found.join(kg.edges.select("edge_idx", "subject", "predicate", "object"), "edge_idx").select("subject", "predicate", "object", "edge_idx")


@query(f", ids as (select distinct object as id from e where subject = {_H}) select d.id, d.total as n from deg d join ids using (id)")
def literature_counts(kg):
    """Counts that the literature annotator gives nodes, from a table of counts."""
    ids = adjacency.out_edges(kg, hub(kg)).select(F.col("object").alias("id"))
    return node_counts_of(ids, kg.degrees.select("id", F.col("total_degree").alias("n")))


@query("select id as node_id, total::varchar as value_json from deg")
def node_metadata(kg):
    """Facts on nodes kept by an enricher, saved and loaded again."""
    store = NodeMetadata(kg.spark)
    store.put_many("degree", kg.degrees.select(F.col("id").alias("node_id"), F.col("total_degree").cast("string").alias("value_json")))
    path = f"{shared_dir(kg.spark)}/facts-{uuid4().hex}"
    store.save(path)
    return NodeMetadata.load(kg.spark, path).of("degree")


@query(f""", w as (select [subject, object] as nodes, object as last, 1 as n from e where subject = {_H} union all
  select list_append(w.nodes, e.object), e.object, n + 1 from w join e on e.subject = w.last where n < 3 and w.last <> {_MATE} and not list_contains(w.nodes, e.object))
select n as n_hops, count(*) as n_paths from w where last = {_MATE} and {_MATE} <> {_H} and nodes[1] <> nodes[2] group by n""")
def paths_upto_three(kg):
    """Paths of variable length, counted by their edges."""
    return paths.paths_upto(kg, *_far(kg), 3).groupBy("n_hops").agg(F.count(F.lit(1)).alias("n_paths"))


@query(f"select a.o as id, count(*) as n_paths from {_m(None, None)} a join {_CAUSE} b on b.s = a.o where a.s = {_H} group by 1 order by 2 desc, 1 limit 10")
def widest_nodes(kg):
    """The middle nodes of a pattern that most of its paths go through."""
    return _chain(kg, None, "causes").widest("n1")

"""Known answers of the small graph, through ingest from lines."""

import json

import pytest
from small_graph import CVD, DM, GCK, GLU, HYP, INSR, MET, PPARG, T2D, TNF, raw_edges, raw_nodes

from weftgraph.operators import adjacency, explore, metadata, paths, response, validate
from weftgraph.operators.lookup import lookup
from weftgraph.operators.match import match_subclass
from weftgraph.plans.ir import BadQuery, parse, path_order
from weftgraph.plugins import NodeMetadata, register_annotator, register_enricher, register_literature, run_enrichers
from weftgraph.sources.ingest import from_jsonl
from weftgraph.sources.tables import ONTOLOGY

B = "biolink:"


@pytest.fixture(scope="module")
def kg(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("kg")
    (d / "e.jsonl").write_text("".join(json.dumps(e) + "\n" for e in raw_edges()))
    (d / "n.jsonl").write_text("".join(json.dumps(n) + "\n" for n in [*raw_nodes(), {"id": "", "name": "no id"}, {"id": "X:1", "name": "on no edge"}]))
    return from_jsonl(spark, str(d / "e.jsonl"), str(d / "n.jsonl"), ONTOLOGY)


def q(nodes, *edges):
    """edges: (subject, predicate or None, object, more)."""
    es = {f"e{i}": {"subject": s, "object": o, "predicates": [B + p] if p else []} | (more[0] if more else {}) for i, (s, p, o, *more) in enumerate(edges)}
    return {"nodes": {k: {"ids": v} if isinstance(v, list) else {"categories": [B + v]} if isinstance(v, str) else v for k, v in nodes.items()}, "edges": es}


def bound(kg, query, node, **kw):
    r = lookup(kg, query, **kw)
    return {x["id"] for x in r.node_bindings.filter(f"qnode = '{node}'").collect()}


def n_results(kg, query, **kw):
    return lookup(kg, query, **kw).results.count()


AFFECTS = q({"a": [MET], "g": "Gene"}, ("a", "affects", "g"))
TWO = q({"a": [MET], "g": "Gene", "d": [T2D]}, ("a", "affects", "g"), ("g", "gene_associated_with_condition", "d"))


def test_treats_with_parallel_and_descendant_edges(kg):
    r = lookup(kg, q({"a": [MET], "d": [T2D]}, ("a", "treats", "d")))
    assert r.results.count() == 1
    assert sorted(x["kg_edge"] for x in r.edge_bindings().collect()) == ["edge1", "edge11", "edge12", "edge19"]


def test_one_hop_both_ways(kg):
    assert bound(kg, AFFECTS, "g") == {PPARG, INSR, GCK, TNF} and n_results(kg, AFFECTS) == 4
    assert bound(kg, q({"g": "Gene", "d": [T2D]}, ("g", "gene_associated_with_condition", "d")), "g") == {PPARG, INSR, GCK}


def test_two_hops(kg):
    assert bound(kg, TWO, "g") == {PPARG, INSR, GCK}


@pytest.mark.parametrize("nodes", [{"a": ["NO:1"], "g": "Gene"}, {"a": [MET], "g": ["NO:1"]}])
def test_unknown_ids_find_nothing(kg, nodes):
    assert n_results(kg, q(nodes, ("a", "affects", "g"))) == 0


def test_three_hops_without_subclasses(kg):
    r = lookup(kg, q({"a": [MET], "g": "Gene", "d": "Disease", "p": [HYP]}, ("a", "affects", "g"), ("g", "gene_associated_with_condition", "d"), ("d", "has_phenotype", "p")), subclass=False)
    assert r.results.count() == 3 and r.node_bindings.count() == 12


def test_qualifier_sets(kg):
    sets = [[("object_aspect_qualifier", "activity"), ("object_direction_qualifier", "increased")], [("object_aspect_qualifier", "abundance"), ("object_direction_qualifier", "increased")]]
    c = [{"qualifier_set": [{"qualifier_type_id": B + t, "qualifier_value": v} for t, v in s]} for s in sets]
    assert bound(kg, q({"a": [MET], "g": "Gene"}, ("a", "affects", "g", {"qualifier_constraints": c})), "g") == {INSR, TNF}
    assert n_results(kg, q({"a": [MET], "g": "Gene"}, ("a", "affects", "g", {"qualifier_constraints": [{"qualifier_set": []}]}))) == 4


@pytest.mark.parametrize(
    ("constraint", "genes"),
    [
        ({"id": B + "p_value", "operator": "<", "value": 0.01}, {PPARG, TNF}),
        ({"id": "evidence_count", "operator": ">", "value": "1e1"}, {PPARG, TNF}),
        ({"id": "evidence_count", "operator": "==", "value": [12, 20.0]}, {PPARG, TNF}),
        ({"id": "evidence_count", "operator": "===", "value": 12.0}, set()),
        ({"id": "evidence_count", "operator": "===", "value": 12}, {PPARG}),
        ({"id": "evidence_count", "operator": ">", "value": 10, "not": True}, {INSR, GCK}),
        ({"id": "no_such", "operator": "==", "value": 1, "not": True}, {PPARG, INSR, GCK, TNF}),
        ({"id": "no_such", "operator": "==", "value": 1}, set()),
        ({"id": "agent_type", "operator": "matches", "value": "(?P<x>man)ual"}, {PPARG, INSR, GCK, TNF}),
        ({"id": "agent_type", "operator": "matches", "value": "(bad"}, set()),
        ({"id": "agent_type", "operator": "~", "value": "x"}, set()),
    ],
)
def test_attribute_constraints(kg, constraint, genes):
    assert bound(kg, q({"a": [MET], "g": "Gene"}, ("a", "affects", "g", {"attribute_constraints": [constraint]})), "g") == genes


def test_constraint_on_second_hop(kg):
    c = {"attribute_constraints": [{"id": "evidence_count", "operator": ">", "value": 10}]}
    assert bound(kg, q({"a": [MET], "g": "Gene", "d": [T2D]}, ("a", "affects", "g"), ("g", "gene_associated_with_condition", "d", c)), "g") == {PPARG}


@pytest.mark.parametrize(("most", "genes"), [(2, {TNF}), (3, {TNF, PPARG, GCK}), (0, set())])
def test_degree_filter(kg, most, genes):
    assert bound(kg, AFFECTS, "g", filter_config={"max_node_degree": most}) == genes


def test_information_filter_also_tests_the_closing_pin(kg):
    assert n_results(kg, TWO, filter_config={"min_information_content": 85}) == 0
    assert bound(kg, q({"g": "Gene", "d": [T2D]}, ("g", "gene_associated_with_condition", "d")), "g", filter_config={"min_information_content": 90}) == {PPARG}


def test_adaptive_plans_find_the_same(kg, monkeypatch):
    from weftgraph.operators import lookup as module

    for most in (2_000, 1):
        monkeypatch.setattr(module, "LITERAL_IDS", most)
        for query in (TWO, q({"p": [HYP], "d": [DM]}, ("p", "related_to", "d"))):
            a, b = lookup(kg, query), lookup(kg, query, adaptive=True)
            assert a.edge_bindings().exceptAll(b.edge_bindings()).count() == 0 and a.results.count() == b.results.count() > 0


def test_all_and_collate(kg):
    query = lambda ids: q({"g": {"ids": ids, "set_interpretation": "ALL"}, "d": "Disease"}, ("g", "gene_associated_with_condition", "d"))
    r = lookup(kg, query([PPARG, INSR]), subclass=False)
    assert r.results.count() == 1 and bound(kg, query([PPARG, INSR]), "g", subclass=False) == {PPARG, INSR}
    assert n_results(kg, query([PPARG, "NO:1"]), subclass=False) == 0
    collate = q({"a": [MET], "g": {"categories": [B + "Gene"], "set_interpretation": "COLLATE"}, "d": [T2D]}, ("a", "affects", "g"), ("g", "gene_associated_with_condition", "d"))
    assert n_results(kg, collate, subclass=False) == 1 and bound(kg, collate, "g", subclass=False) == {PPARG, INSR, GCK}


def test_direct_edge_makes_subclasses_superfluous(kg):
    r = lookup(kg, q({"a": [MET], "d": [DM]}, ("a", "treats", "d")))
    assert r.results.count() == 1 and bound(kg, q({"a": [MET], "d": [DM]}, ("a", "treats", "d")), "d") == {DM}
    assert [x["kg_edge"] for x in r.edge_bindings().collect()] == ["edge18"] and r.aux_graphs().count() == 0
    assert {x["id"] for x in r.kg_nodes.collect()} == {MET, DM}


def test_derived_edge_with_support(kg):
    query = q({"p": [HYP], "d": [DM]}, ("p", "related_to", "d"))
    m = response.assemble(lookup(kg, query), query)["message"]
    derived = {k: e for k, e in m["knowledge_graph"]["edges"].items() if "support_graphs" in json.dumps(e)}
    assert len(m["results"]) == 1 and list(derived) == ["edge5_edge16"]
    assert {derived["edge5_edge16"]["subject"], derived["edge5_edge16"]["object"]} == {HYP, DM}
    assert m["auxiliary_graphs"]["aux_edge5_edge16"]["edges"] == ["edge16", "edge5"]
    assert T2D in m["knowledge_graph"]["nodes"]
    assert validate.response_errors(kg, {"message": m})["valid"]


def test_symmetric_triangle(kg):
    query = q({"x": "Gene", "y": "Gene", "d": [T2D]}, ("x", "interacts_with", "y"), ("x", "gene_associated_with_condition", "d"), ("y", "gene_associated_with_condition", "d"))
    assert {(r["n_x"], r["n_y"]) for r in lookup(kg, query, subclass=False).paths.collect()} == {(PPARG, INSR), (INSR, PPARG)}


def test_inverse_predicate_with_hierarchy_edge(kg):
    query = q({"d": [T2D], "m": {}, "top": [DM]}, ("d", "treated_by", "m"), ("d", "subclass_of", "top"))
    r = lookup(kg, query)
    assert {(x["k_d"], x["k_m"], x["k_top"]) for x in r.results.collect()} == {(T2D, MET, DM)}


def test_mirrored_queries_agree(kg):
    one = q({"a": [MET], "m": {}, "d": [T2D]}, ("a", "related_to", "m"), ("m", "related_to", "d"))
    other = q({"a": [MET], "m": {}, "d": [T2D]}, ("d", "related_to", "m"), ("m", "related_to", "a"))
    assert bound(kg, one, "m") == bound(kg, other, "m") and n_results(kg, one) == n_results(kg, other) > 0


def test_depth_zero_is_no_expansion(kg):
    query = q({"a": [MET], "d": [T2D]}, ("a", "treats", "d"))
    assert n_results(kg, query, subclass_depth=0) == n_results(kg, query, subclass=False) == 1


def test_subclass_depths(kg):
    below = lambda d: {r["s"] for r in match_subclass(kg, [CVD], d).collect()}
    assert below(0) == {CVD} and below(1) == {CVD, DM} and below(2) == {CVD, DM, T2D} == below(5)


def test_dehydrated_answers_have_the_same_bindings(kg):
    a, b = lookup(kg, TWO), lookup(kg, TWO, dehydrated=True)
    assert a.node_bindings.exceptAll(b.node_bindings).count() == 0
    m = response.assemble(b, TWO)["message"]
    assert all(validate.is_connected(r, m) for r in m["results"])
    assert all(set(e) == {"subject", "predicate", "object"} for e in m["knowledge_graph"]["edges"].values())
    assert m["knowledge_graph"]["nodes"][MET]["categories"] == [B + "SmallMolecule"]


def test_rehydrate_fills_only_what_is_absent(kg):
    m = response.assemble(lookup(kg, TWO, dehydrated=True), TWO)
    m["message"]["knowledge_graph"]["nodes"][PPARG]["name"] = "mine"
    m["message"]["knowledge_graph"]["edges"]["lost"] = {"subject": MET, "predicate": "x", "object": PPARG}
    out = response.query(kg, m | {"parameters": {"rehydrate": True}})["message"]["knowledge_graph"]
    assert out["nodes"][PPARG]["name"] == "mine" and out["nodes"][PPARG]["attributes"]
    assert out["edges"]["lost"]["sources"] == [] and out["edges"]["edge2"]["sources"][1]["resource_id"] == "infores:ctd"


@pytest.mark.parametrize(
    ("nodes", "status"),
    [({"a": {"ids": [MET], "set_interpretation": "MANY"}}, 422), ({"a": {"set_interpretation": "ALL"}}, 422), ({"a": {"ids": [MET], "set_interpretation": "COLLATE"}}, 422), ({"a": {"ids": []}}, 400)],
)
def test_refused_nodes(nodes, status):
    with pytest.raises(BadQuery) as e:
        parse({"nodes": nodes, "edges": {}})
    assert e.value.status == status


def test_refused_patterns(kg):
    with pytest.raises(BadQuery):
        parse(q({"a": [MET]}, ("a", "treats", "zz")))
    with pytest.raises(BadQuery):
        lookup(kg, q({"a": {}, "b": {}}, ("a", "treats", "b")))
    with pytest.raises(BadQuery):
        lookup(kg, q({"a": [MET], "b": {}, "c": [T2D], "d": {}}, ("a", "treats", "b"), ("c", None, "d")))
    with pytest.raises(NotImplementedError):
        parse({"nodes": {}, "edges": {}, "paths": {"p": {}}})
    assert lookup(kg, {"nodes": {"a": {"ids": [MET]}}, "edges": {}}).paths.count() == 0


def test_what_is_refused_can_be_allowed(kg):
    p = lookup(kg, q({"a": {}, "b": {}}, ("a", "has_phenotype", "b")), subclass=False, allow_full_scan=True).paths
    assert [(r["n_a"], r["n_b"]) for r in p.collect()] == [(T2D, HYP)]
    apart = q({"a": [GLU], "b": {}, "c": [T2D], "d": {}}, ("a", "participates_in", "b"), ("c", "has_phenotype", "d"))
    assert lookup(kg, apart, subclass=False, allow_product=True).paths.count() == 1


def test_bucketed_copies(kg, spark):
    kg.save_bucketed("small_edges", 2)
    try:
        for end in ("subject", "object"):
            plan = spark.table(f"small_edges_by_{end}").groupBy(end).count()
            assert plan.count() == kg.edges.select(end).distinct().count() and "Exchange" not in plan._jdf.queryExecution().executedPlan().toString().replace("SinglePartition", "")
    finally:
        for end in ("subject", "object"):
            spark.sql(f"drop table small_edges_by_{end}")


def test_self_loop_and_cap(kg):
    assert n_results(kg, q({"a": [MET]}, ("a", None, "a"))) == 0
    assert lookup(kg, AFFECTS, subclass=False, max_paths=2).paths.count() == 2


def test_requests(kg):
    body = {"message": {"query_graph": AFFECTS}, "parameters": {"subclass": False}}
    out = response.query(kg, body)
    assert len(out["message"]["results"]) == 4 and any("plan" in x["message"] for x in out["logs"])
    assert len(response.query(kg, out | {"workflow": [{"id": "filter_results_top_n", "parameters": {"max_results": 2}}]})["message"]["results"]) == 2
    for flow in ([{"id": "filter_results_top_n"}], [{"id": "lookup"}] * 2, [{"id": "other"}]):
        with pytest.raises(BadQuery):
            response.query(kg, body | {"workflow": flow})
    got = []
    response.submit(kg, body, got.append).join(120)
    response.submit(kg, {"message": {"query_graph": {"nodes": {"a": {"ids": []}}}}}, got.append).join(120)
    assert len(got[0]["message"]["results"]) == 4 and got[1]["logs"][0]["level"] == "ERROR"


def test_annotators(kg):
    counts = kg.spark.createDataFrame([(MET, 7), ("X:9", 5)], "id string, n long")
    register_literature(counts, kg.spark.createDataFrame([(MET, PPARG, 3), (MET, TNF, 1), (MET, "X:9", 9)], "subject string, object string, n long"))
    register_annotator("broken", lambda cfg: (lambda r, g: 1 / 0) if cfg.get("broken") else None)
    body = {"message": {"query_graph": AFFECTS}, "parameters": {"annotator_config": {"literature_cooccurrence": {"min_cooccurrence": 3}, "broken": True}}}
    out = response.query(kg, body)
    new = {k: e for k, e in out["message"]["knowledge_graph"]["edges"].items() if k.startswith("litcoocc")}
    assert [(e["subject"], e["object"]) for e in new.values()] == [(MET, PPARG)]
    assert out["message"]["knowledge_graph"]["nodes"][MET]["attributes"][-1]["value"] == 7
    assert any(x["code"] == "AnnotatorFailed" for x in out["logs"])


def test_node_metadata(kg, spark, tmp_path):
    from pyspark.sql import functions as F

    register_enricher("degree", lambda g: g.degrees.select(F.col("id").alias("node_id"), F.col("total_degree").cast("string").alias("value_json")))
    store = NodeMetadata(spark)
    run_enrichers(kg, store)
    store.put("own", None, {"version": 1})
    store.put("own", None, {"version": 2})
    store.save(str(tmp_path / "m"))
    back = NodeMetadata.load(spark, str(tmp_path / "m"))
    assert back.get("degree", MET) == 11 and back.get("own", None) == {"version": 2} and back.namespaces() == ["degree", "own"] and not back.contains("own", MET)


def test_degrees_and_neighbours(kg, spark):
    assert adjacency.degree_of(kg, MET) == 11 and adjacency.degree_of(kg, T2D) == 9
    with pytest.raises(KeyError):
        adjacency.degree_of(kg, "NO:1")
    ids = spark.createDataFrame([(MET,), ("NO:1",)], "id string")
    assert {r["id"]: r["total_degree"] for r in adjacency.degrees_of(kg, ids).collect()} == {MET: 11, "NO:1": None}
    assert adjacency.neighbors(kg, MET, [B + "treats"]).count() == 3 and adjacency.neighbors(kg, MET, ["no"]).count() == 0
    assert adjacency.first_edge(kg, MET, T2D, B + "treats").first()["edge_id"] == "edge1"
    assert adjacency.edges_either_way(kg, INSR, PPARG).first()["direction"] == "reverse"
    assert {r["direction"] for r in explore.expand(kg, T2D).collect()} == {"in", "out"}


def test_statistics(kg):
    s = metadata.dedup_stats(kg).first()
    assert (s["n_edges"], s["n_source_sets"], s["n_qualifier_sets"]) == (20, 11, 5)
    g = metadata.graph_stats(kg).first()
    assert (g["n_nodes"], g["n_predicates"]) == (11, 9 + 0) and g["max_out_degree"] == 11
    m = metadata.meta_kg(kg)
    assert m["nodes"][B + "Gene"]["id_prefixes"] == ["NCBIGene"]
    edge = next(e for e in m["edges"] if e["predicate"] == B + "affects" and e["object"] == B + "Gene")
    assert [x["qualifier_type_id"] for x in edge["qualifiers"]] == [B + "object_aspect_qualifier", B + "object_direction_qualifier"]


def test_paths(kg):
    p = paths.paths3(kg, MET, HYP)
    assert {(r["n1"], r["n2"]) for r in p.collect()} == {(PPARG, T2D), (INSR, T2D), (GCK, T2D)} and p.count() == 4
    assert paths.paths3_nodes(kg, MET, HYP).count() == 3
    assert paths.path_count(kg, MET, HYP).first()[0] == 4
    assert paths.paths3(kg, MET, HYP, excluded=[B + "affects"]).count() == 0 and paths.paths3(kg, MET, HYP, limit=1).count() == 1
    assert paths.hydrate(kg, p).filter("name2 = 'Type 2 Diabetes'").count() == 4
    assert "treats" in validate.sentence(kg.edges.limit(100), ["subject", "object"], ["predicate"]).filter(f"subject = '{MET}' and predicate = 'biolink:treats'").first()["sentence"]


def test_edge_existence(kg):
    assert validate.edge_exists(kg, MET, B + "treats", T2D) is None
    assert validate.edge_exists(kg, T2D, B + "treated_by", MET) is None
    assert validate.edge_exists(kg, MET, B + "treated_by", T2D) is None
    assert validate.edge_exists(kg, INSR, B + "interacts_with", PPARG) is None
    assert validate.edge_exists(kg, INSR, B + "interacts_with", PPARG, check_inverse=False) == "EDGE_NOT_FOUND"
    assert validate.edge_exists(kg, "NO:1", B + "treats", T2D) == "EDGE_SUBJECT_NOT_FOUND"
    assert validate.edge_exists(kg, MET, B + "treats", "NO:1") == "EDGE_OBJECT_NOT_FOUND"
    assert "reverse" in validate.explain_missing_edge(kg, T2D, B + "treats", MET)
    bad = {"message": {"knowledge_graph": {"nodes": {"NO:1": {}}, "edges": {}}, "results": [{"node_bindings": {"a": [{"id": MET}]}, "analyses": [{"edge_bindings": {"e": [{"id": "x"}]}}]}]}}
    report = validate.response_errors(kg, bad)
    assert {e["error_type"] for e in report["errors"]} == {"NODE_NOT_FOUND", "NODE_BINDING_NOT_IN_KG", "EDGE_BINDING_NOT_IN_KG"} and "0 of 1" in validate.summary(report)


def test_save_and_load(kg, spark, tmp_path):
    from weftgraph.graph import KnowledgeGraph

    kg.save(str(tmp_path / "g"))
    back = KnowledgeGraph.load(spark, str(tmp_path / "g"))
    assert bound(back, TWO, "g") == {PPARG, INSR, GCK} and back.ontology == kg.ontology
    response.write_paths_tsv(lookup(back, TWO, subclass=False), str(tmp_path / "t"))
    assert spark.read.csv(str(tmp_path / "t"), sep="\t", header=True).columns[:3] == ["n_a", "n_g", "n_d"]


def test_pattern_order():
    assert path_order(parse(q({"d": [T2D], "g": {}, "a": [MET]}, ("a", "affects", "g"), ("g", None, "d")))) == ["a", "g", "d"]


def test_forward_and_reverse_lists_agree(kg):
    out = kg.edges.select("subject", "predicate", "object")
    back = adjacency.in_edges(kg, T2D).select("subject", "predicate", "object")
    assert back.exceptAll(out).count() == 0 and back.count() == 7 and GLU in {r["object"] for r in out.collect()}


def test_paths_of_a_node_to_itself_and_empty_filters(kg):
    assert paths.paths3(kg, MET, MET).count() == 0 and paths.paths3_nodes(kg, MET, MET).count() == 0 and paths.paths_upto(kg, MET, MET, 3).count() == 0
    assert paths.paths3(kg, MET, HYP, allowed=[], excluded=[]).count() == paths.paths3(kg, MET, HYP).count() > 0
    assert {r["n_hops"] for r in paths.paths_upto(kg, MET, HYP, 3).collect()} == {2, 3}


def test_answers_of_too_many_paths_are_refused(kg):
    with pytest.raises(BadQuery) as e:
        response.assemble(lookup(kg, AFFECTS), most_paths=1)
    assert e.value.status == 413

"""Records, lines, ontology, planner and the random-graph oracle."""

import itertools
import json
import random

import pytest
from pyspark.sql import functions as F
from small_graph import raw_edges, raw_nodes

from weftgraph.graph import KnowledgeGraph
from weftgraph.ontology import Ontology, closure_table
from weftgraph.operators.lookup import lookup
from weftgraph.plans import planner
from weftgraph.plans.ir import parse
from weftgraph.plans.rewrite import expand_predicates
from weftgraph.sources import ingest, tables
from weftgraph.sources import normalize as N
from weftgraph.sources.ingest import edges_of_lines, from_jsonl, nodes_of_lines, source_chain, triples_of_lines
from weftgraph.sources.tables import ONTOLOGY
from weftgraph.streaming.edges import append_edges


def test_source_chain_from_aggregators():
    raw = {"primary_knowledge_source": "p", "aggregator_knowledge_source": ["a2", "a1"]}
    own, *chain = N.source_chain(raw)
    assert [(s["resource_id"], s["upstream_resource_ids"]) for s in chain] == [("p", []), ("a1", ["p"]), ("a2", ["a1"])]
    assert own["upstream_resource_ids"] == ["a2"] and raw["aggregator_knowledge_source"] == ["a2", "a1"]
    with pytest.raises(N.SourceValidationError):
        N.source_chain({})


def test_source_chain_as_a_column(spark):
    rows = [([("p", "primary_knowledge_source", None), ("a", "aggregator_knowledge_source", ["p"])],), ([("x", "r", []), ("x", "r", [])],)]
    df = spark.createDataFrame(rows, "s array<struct<resource_id:string,resource_role:string,upstream_resource_ids:array<string>>>")
    got = [r[0] for r in df.select(source_chain(df["s"])).collect()]
    for (given,), made in zip(rows, got):
        want = N.source_chain({"sources": [dict(zip(("resource_id", "resource_role", "upstream_resource_ids"), s)) for s in given]})
        assert [x.asDict() for x in made] == want


def test_qualifiers_and_attributes():
    raw = {"object_aspect_qualifier": ["a", 1], "qualified_predicate": "x:causes", "qualifiers": [1], "subject": "s", "p_value": 0.1, "primary_knowledge_source": "p"}
    assert N.qualifiers(raw) == [
        {"qualifier_type_id": "biolink:object_aspect_qualifier", "qualifier_value": '["a", 1]'}, {"qualifier_type_id": "biolink:qualified_predicate", "qualifier_value": "biolink:causes"},
    ]
    assert N.qualifiers({"qualified_predicate": "causes"})[0]["qualifier_value"] == "biolink:causes"
    assert [a["attribute_type_id"] for a in N.edge(raw)["attributes"]] == ["biolink:p_value"]
    assert N.node({"id": "x", "z": [1, "a"]})["attributes"][0]["value_text"] == "[1, 'a']"


@pytest.mark.parametrize(("value", "number", "text", "kind"), [(True, 1.0, "True", "bool"), (" 1e-3 ", 0.001, " 1e-3 ", "string"), ("1d", None, "1d", "string"), ("1_000", 1000.0, "1_000", "string"), (None, None, "None", "null"), ([1], None, "[1]", "list"), (12.0, 12.0, "12.0", "float")])
def test_shadows_of_values(value, number, text, kind):
    a = N.attribute("t", value)
    assert (a["value_num"], a["value_text"], a["value_type"]) == (number, text, kind)


@pytest.mark.parametrize("change", [{"subject": ""}, {"predicate": None}, {"object": 3}, {"id": 1}, {"sources": [{"resource_id": "x"}]}])
def test_bad_edges_stop_the_job(spark, change):
    line = json.dumps(raw_edges()[0] | change)
    with pytest.raises(Exception, match="must be|KeyError|resource_role"):
        edges_of_lines(spark.createDataFrame([(line,)], "value string")).collect()


def test_bad_nodes_and_skipped_ones(spark):
    lines = lambda *xs: spark.createDataFrame([(json.dumps(x),) for x in xs] + [("",)], "value string")
    assert nodes_of_lines(lines({"id": ""}, {"name": "x"}, {"id": "A:1"})).count() == 1
    with pytest.raises(Exception, match="must be"):
        nodes_of_lines(lines({"id": "A:1", "name": 3})).collect()


def test_build_order_last_node_and_missing_file(spark, tmp_path):
    edges = [*raw_edges(), raw_edges()[0]]
    (tmp_path / "e").write_text("\n".join(map(json.dumps, edges)))
    (tmp_path / "n").write_text("\n".join(map(json.dumps, [{"id": "CHEBI:6801", "name": "old"}, *raw_nodes()])))
    kg = from_jsonl(spark, str(tmp_path / "e"), str(tmp_path / "n"), ONTOLOGY)
    order = [(r["subject"], r["object"], r["predicate"]) for r in kg.edges.orderBy("edge_idx").collect()]
    assert order == sorted(order) and len({r["edge_idx"] for r in kg.edges.collect()}) == 21
    assert kg.nodes.filter("id = 'CHEBI:6801'").first()["name"] == "Metformin"
    assert from_jsonl(spark, str(tmp_path / "e")).nodes.filter("size(categories) = 0").count() == 11
    assert triples_of_lines(spark, str(tmp_path / "e")).count() == 21


def test_normalized_documents(spark):
    doc = {"_id": 1, "id": "e", "subject": "a", "predicate": "p", "object": "b", "sources": [], "qualifiers": [], "attributes": [{"attribute_type_id": "t", "value": 2}]}
    r = edges_of_lines(spark.createDataFrame([(json.dumps(doc),)], "value string"), normalized=True).first()
    assert r["edge_id"] == "e" and r["sources"] == [] and r["attributes"][0]["value_num"] == 2.0


def test_streamed_edges(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1").write_text(json.dumps(raw_edges()[0]))
    run = lambda: append_edges(spark, str(tmp_path / "in"), str(tmp_path / "t"), str(tmp_path / "s")).awaitTermination(120)
    run()
    (tmp_path / "in" / "2").write_text(json.dumps(raw_edges()[1]))
    run()
    assert {r["edge_id"] for r in spark.read.parquet(str(tmp_path / "t")).collect()} == {"edge1", "edge2"}


def test_ontology(spark):
    o = Ontology(predicate_children={"a": ["b"], "b": ["c", "a"]}, canonical={"a", "c"}, inverses={"a": "ia"}, symmetric={"s"}, category_children={"X": ["Y"]}, any_predicate="any")
    assert o.descendants("a") == ["b", "c"] and o.usable_descendants("a") == ["c"] and o.descendants("zz") == []
    assert o.inverse("ia") == "a" and o.reversed_predicate("s") == "s" and o.reversed_predicate("c") is None and o.either_direction(["a"]) == {"a", "ia"}
    assert o.most_specific(["X", "Y"], "F") == "Y" and o.most_specific([], "F") == "F"
    along, against = expand_predicates(o, ["a"])
    assert along.names == ("a", "c") and against.names == ("ia",) and expand_predicates(o, ["c"])[1].none and expand_predicates(o, ["any", "a"])[0].any
    t = o.tables(spark)
    assert {tuple(r) for r in t["predicate_descendant"].collect()} == {("a", "b"), ("a", "c"), ("b", "c"), ("b", "a")}
    links = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")], "parent string, child string")
    assert closure_table(links).count() == 12


def test_planner_prefers_pins_and_keeps_together():
    q = parse({"nodes": {"a": {}, "b": {}, "c": {"ids": ["x"]}}, "edges": {"e0": {"subject": "a", "object": "b"}, "e1": {"subject": "b", "object": "c"}}})
    assert [e.key for e in planner.join_order(q)] == ["e1", "e0"]
    assert planner.next_edge(q, {"a": 1, "b": 1}).key == "e0" or planner.next_edge(q, {"a": 1, "b": 1}).key == "e1"


def _brute(edges, onto, query):
    """All bindings by trying every edge for every pattern edge."""
    q = parse(query)
    ways = {}
    for k, e in q.edges.items():
        along, against = expand_predicates(onto, e.predicates)
        ok = lambda w, p: w.any or p in w.names
        ways[k] = [(s, o, i, False) for i, s, p, o in edges if ok(along, p)] + [(o, s, i, True) for i, s, p, o in edges if ok(against, p)]
    found = set()
    for combo in itertools.product(*ways.values()):
        b = {}
        fine = True
        for e, (s, o, _, _) in zip(q.edges.values(), combo):
            fine = fine and b.setdefault(e.subject, s) == s and b.setdefault(e.object, o) == o
        if fine and all(n.ids is None or b[k] in n.ids for k, n in q.nodes.items()):
            found.add((tuple(sorted(b.items())), tuple((i, inv) for _, _, i, inv in combo)))
    return found


@pytest.mark.parametrize("seed", range(3))
def test_random_graphs_against_brute_force(spark, seed):
    rnd = random.Random(seed)
    preds = ["biolink:treats", "biolink:treated_by", "biolink:interacts_with", "biolink:affects", "biolink:ameliorates_condition"]
    edges = [(f"{i:02}", f"N:{rnd.randrange(6)}", rnd.choice(preds), f"N:{rnd.randrange(6)}") for i in range(22)]
    kg = KnowledgeGraph.from_rows(spark, [(f"N:{i}", None, [], [], None) for i in range(6)], [(i, None, s, p, o, [], []) for i, s, p, o in edges], ontology=ONTOLOGY)
    query = {"nodes": {"a": {"ids": ["N:0", "N:1"]}, "b": {}, "c": {}}, "edges": {
        "e0": {"subject": "a", "object": "b", "predicates": ["biolink:treats"]}, "e1": {"subject": "b", "object": "c", "predicates": ["biolink:interacts_with"]}, "e2": {"subject": "c", "object": "a"}}}
    r = lookup(kg, query, subclass=False)
    got = {(tuple((n, x[f"n_{n}"]) for n in "abc"), tuple((x[f"e_{k}"], x[f"v_{k}"]) for k in ("e0", "e1", "e2"))) for x in r.paths.collect()}
    assert got == _brute(edges, ONTOLOGY, query)


def test_command_line(spark, tmp_path, capsys):
    from small_graph import HYP, MET

    from weftgraph.cli import main

    (tmp_path / "e").write_text("\n".join(map(json.dumps, raw_edges())))
    (tmp_path / "n").write_text("\n".join(map(json.dumps, raw_nodes())))
    g = str(tmp_path / "g")
    assert main(["build", "--edges", str(tmp_path / "e"), "--nodes", str(tmp_path / "n"), "--output", g]) == 0
    (tmp_path / "q").write_text(json.dumps({"message": {"query_graph": {"nodes": {"a": {"ids": [MET]}, "b": {}}, "edges": {"e": {"subject": "a", "object": "b", "predicates": ["biolink:treats"]}}}}}))
    assert main(["query", g, str(tmp_path / "q"), "--output", str(tmp_path / "a")]) == 0
    assert len(json.loads((tmp_path / "a").read_text())["message"]["results"]) == 2
    capsys.readouterr()
    assert main(["paths", g, MET, HYP, "--with-properties", "--output", str(tmp_path / "p")]) == 0
    assert '"num_paths": 4' in capsys.readouterr().out
    assert main(["diagnose", g, MET, HYP]) == 0 and '"n_paths": 4' in capsys.readouterr().out


def test_documents_of_a_store(spark):
    store = {"edges": [{"_id": i} | N.edge(e) for i, e in enumerate(raw_edges())], "nodes": [{"_id": 1} | N.node(n) for n in raw_nodes()]}
    bare = lambda a: {k: a[k] for k in ("attribute_type_id", "original_attribute_name")} | {"value": json.loads(a["value_json"])}
    store = {k: [d | {"attributes": [bare(a) for a in d["attributes"]]} for d in v] for k, v in store.items()}
    source = ingest.Documents(spark, lambda name: ["0", "1", "2"], lambda name, part: (d for i, d in enumerate(store[name]) if i % 3 == int(part)))
    kg = ingest.from_source(source, ONTOLOGY)
    assert kg.edges.count() == 20 and kg.nodes.count() == 11 and {r["edge_id"] for r in kg.edges.collect()} == {f"edge{i}" for i in range(1, 21)}
    assert ingest.Documents(spark, lambda name: [], lambda name, part: iter(())).edges().count() == 0


def test_qualifier_fields_of_a_model():
    model = {"qualifier": ["aspect qualifier", "biolink:stage_qualifier"], "aspect qualifier": ["my own qualifier", "qualifier"], "other": ["x"]}
    assert N.qualifier_fields(model) == {"aspect_qualifier", "stage_qualifier", "my_own_qualifier"} and N.qualifier_fields() == N.QUALIFIER_FIELDS
    assert N.qualifiers({"my_own_qualifier": 3, "stage_qualifier": "a"}, N.qualifier_fields(model)) == [
        {"qualifier_type_id": "biolink:my_own_qualifier", "qualifier_value": "3"}, {"qualifier_type_id": "biolink:stage_qualifier", "qualifier_value": "a"},
    ]


def test_shadows_of_text_columns(spark):
    texts = ['say "hi"', "a\\b", " 1.5 ", "1_000", "1d", "0x1", "nan", "-Infinity", "", "it's", 'both " and \'', "1e400"]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", tables.json_text(F.col("t")), tables.number_of(F.col("t")), tables._quoted(F.col("t"))).collect()
    for i, j, n, q in got:
        want = N.attribute("x", texts[i])
        assert json.loads(j) == texts[i] and q == repr(texts[i]) and (n == want["value_num"] or (n is not None and n != n and want["value_num"] != want["value_num"])), texts[i]


def test_loaded_metadata_and_stages(spark, tmp_path):
    from weftgraph.graph import KnowledgeGraph
    from weftgraph.operators.response import Stages

    KnowledgeGraph.from_rows(spark, [("a", "A", ["c"], [], None)], []).save(str(tmp_path / "g"))
    (tmp_path / "m.json").write_text('{"shown": [1]}')
    assert KnowledgeGraph.load(spark, str(tmp_path / "g"), str(tmp_path / "m.json")).metadata == {"shown": [1]} and KnowledgeGraph.load(spark, str(tmp_path / "g")).metadata == {}
    s = Stages()
    s.run("outer", lambda: s.run("inner", lambda: s.fact("n", 3)), k=1)
    assert s.tree[0]["facts"] == {"k": 1} and s.tree[0]["stages"][0]["facts"] == {"n": 3} and [x["message"].split(":")[0] for x in s.logs] == ["outer / inner", "outer"]

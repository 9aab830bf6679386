"""Summaries of a graph: predicates, categories, triples of categories, the meta graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.functions.text import id_prefix
from weftgraph.graph import KnowledgeGraph
from weftgraph.operators.paths import one_row
from weftgraph.schema import FALLBACK_CATEGORY


def first_category(categories: Column | str = "categories") -> Column:
    return F.coalesce(F.get(categories, F.lit(0)), F.lit(FALLBACK_CATEGORY))


def predicate_stats(kg: KnowledgeGraph) -> DataFrame:
    """(predicate, n), most frequent first."""
    return kg.edges.groupBy("predicate").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "predicate")


def category_prefixes(kg: KnowledgeGraph) -> DataFrame:
    """(category, id_prefixes): id prefixes of the nodes of each first category, sorted."""
    return kg.nodes.select(first_category().alias("category"), id_prefix("id").alias("p")).groupBy("category").agg(F.array_sort(F.collect_set("p")).alias("id_prefixes"))


def with_categories(kg: KnowledgeGraph, edges: DataFrame) -> DataFrame:
    """edges with subject_category and object_category: first categories of their ends."""
    cat = kg.node_records.select("id", first_category().alias("c"))
    for end in ("subject", "object"):
        edges = edges.join(cat.select(F.col("id").alias(end), F.col("c").alias(f"{end}_category")), end, "left").withColumn(f"{end}_category", F.coalesce(f"{end}_category", F.lit(FALLBACK_CATEGORY)))
    return edges


TRIPLE = ["subject_category", "predicate", "object_category"]


def triple_counts(kg: KnowledgeGraph) -> DataFrame:
    """Each triple of categories with its edges and its first edge (by edge_idx) as an example."""
    e = with_categories(kg, kg.edges.select("edge_idx", "subject", "predicate", "object"))
    return e.groupBy(*TRIPLE).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("edge_idx", "subject", "object")).alias("x")).select(*TRIPLE, "n", F.col("x.subject").alias("subject"), F.col("x.object").alias("object"))


testing_edges = triple_counts


def _descriptors(attributes: DataFrame, keys: list[str]) -> DataFrame:
    """Different (type, source, name) of attributes that have a name, per key, sorted."""
    a = attributes.select(*keys, F.explode("attributes").alias("a")).filter(F.coalesce(F.col("a.original_attribute_name"), F.lit("")) != "")
    a = a.select(*keys, F.col("a.attribute_type_id").alias("attribute_type_id"), F.col("a.attribute_source").alias("attribute_source"), F.col("a.original_attribute_name").alias("original_attribute_name")).distinct()
    return a.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("attribute_type_id", "attribute_source", "original_attribute_name"))).alias("attributes"))


def meta_nodes(kg: KnowledgeGraph) -> DataFrame:
    """(category, id_prefixes, attributes)."""
    attrs = _descriptors(kg.nodes.select(first_category().alias("category"), "attributes"), ["category"])
    return category_prefixes(kg).join(attrs, "category", "left")


def meta_edges(kg: KnowledgeGraph) -> DataFrame:
    """(triple of categories, attributes, qualifiers): what its edges' attributes are called, and the values of their qualifiers."""
    qs = F.transform("qualifiers", lambda q: F.struct(q["qualifier_type_id"].alias("t"), q["qualifier_value"].alias("v")))
    kinds = F.transform(F.filter("attributes", lambda a: F.coalesce(a["original_attribute_name"], F.lit("")) != ""), lambda a: F.struct(*[a[c].alias(c) for c in ("attribute_type_id", "attribute_source", "original_attribute_name")]))
    e = kg.edges.select("edge_idx", "subject", "predicate", "object", qs.alias("qs")).join(kg.edge_attributes.select("edge_idx", kinds.alias("kinds")), "edge_idx", "left")
    # Edges come down to their different lists first, then to the different elements of these; only elements are gathered.
    lists = with_categories(kg, e).groupBy(*TRIPLE, "kinds", "qs").agg(F.lit(1).alias("one")).drop("one")
    some = lambda c: F.explode(F.when(F.size(c) > 0, F.col(c)).otherwise(F.array(F.lit(None).cast(lists.schema[c].dataType.elementType))))
    a = lists.select(*TRIPLE, some("kinds").alias("a")).distinct().groupBy(*TRIPLE).agg(F.array_sort(F.collect_list("a")).alias("attributes"))
    q = lists.select(*TRIPLE, F.explode("qs").alias("q")).filter(F.col("q.t").isNotNull()).distinct()
    q = q.groupBy(*TRIPLE, F.col("q.t").alias("qualifier_type_id")).agg(F.array_sort(F.collect_list("q.v")).alias("applicable_values"))
    q = q.groupBy(*TRIPLE).agg(F.array_sort(F.collect_list(F.struct("qualifier_type_id", "applicable_values"))).alias("qualifiers"))
    none = F.array().cast(q.schema["qualifiers"].dataType)
    return a.join(q, TRIPLE, "left").withColumn("qualifiers", F.coalesce("qualifiers", none))


def meta_kg(kg: KnowledgeGraph) -> dict:
    """The meta graph as JSON; its size is that of the schema, not of the data."""
    describe = lambda x: {"attribute_type_id": x["attribute_type_id"], "attribute_source": x["attribute_source"], "original_attribute_names": [x["original_attribute_name"]], "constraint_use": False, "constraint_name": None}
    nodes = {r["category"]: {"id_prefixes": r["id_prefixes"], "attributes": [describe(x) for x in r["attributes"] or []]} for r in meta_nodes(kg).collect()}
    edges = [
        {"subject": r["subject_category"], "predicate": r["predicate"], "object": r["object_category"], "attributes": [describe(x) for x in r["attributes"] or []], "qualifiers": [x.asDict() for x in r["qualifiers"] or []]}
        for r in meta_edges(kg).orderBy(*TRIPLE).collect()
    ]
    return {"nodes": nodes, "edges": edges}


def dedup_stats(kg: KnowledgeGraph) -> DataFrame:
    """One row: edges, different source lists, different qualifier sets."""
    return kg.edges.agg(F.count(F.lit(1)).alias("n_edges"), F.countDistinct(F.to_json("sources")).alias("n_source_sets"), F.countDistinct(F.to_json("qualifiers")).alias("n_qualifier_sets"))


def interned(kg: KnowledgeGraph, column: str) -> DataFrame:
    """(key, value, n_edges): the different values of edges.sources or edges.qualifiers under a digest of their canonical JSON."""
    return kg.edges.groupBy(F.sha2(F.to_json(column), 256).alias("key")).agg(F.any_value(column).alias("value"), F.count(F.lit(1)).alias("n_edges"))


def graph_stats(kg: KnowledgeGraph) -> DataFrame:
    """One row: nodes, edges, predicates, mean and largest out-degree over all nodes."""
    e = kg.edges.agg(F.count(F.lit(1)).alias("n_edges"), F.countDistinct("predicate").alias("n_predicates"))
    d = kg.nodes_with_degrees().agg(F.count(F.lit(1)).alias("n_nodes"), F.avg("out_degree").alias("avg_out_degree"), F.max("out_degree").alias("max_out_degree"))
    return one_row(e, d)


def graph_metadata(kg: KnowledgeGraph) -> DataFrame:
    """(kind, name, n): nodes per category and edges per predicate."""
    c = kg.nodes.groupBy(first_category().alias("name")).agg(F.count(F.lit(1)).alias("n"))
    p = kg.edges.groupBy(F.col("predicate").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    return c.select(F.lit("category").alias("kind"), "name", "n").unionByName(p.select(F.lit("predicate").alias("kind"), "name", "n"))


def edge_summary(kg: KnowledgeGraph) -> DataFrame:
    """(predicate, object_category, n)."""
    return with_categories(kg, kg.edges.select("subject", "predicate", "object")).groupBy("predicate", "object_category").agg(F.count(F.lit(1)).alias("n"))

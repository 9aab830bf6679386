"""The graph that lies in the tables nodes and edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph import schema
from weftgraph.graph import KnowledgeGraph
from weftgraph.ontology import Ontology

_P = "biolink:"
#: Hierarchies for the graph of the tables and of tests (fixed values: names, inverses and children).
ONTOLOGY = Ontology(
    symmetric={_P + p for p in ("interacts_with", "correlated_with", "related_to")},
    canonical={
        _P + p
        for p in (
            "treats", "affects", "gene_associated_with_condition", "has_phenotype", "participates_in", "subclass_of", "ameliorates_condition", "causes",
            "preventative_for_condition", "interacts_with", "related_to",
        )
    },
    inverses={
        _P + a: _P + b
        for a, b in (
            ("treats", "treated_by"), ("affects", "affected_by"), ("gene_associated_with_condition", "condition_associated_with_gene"), ("has_phenotype", "phenotype_of"),
            ("participates_in", "has_participant"), ("subclass_of", "superclass_of"), ("ameliorates_condition", "ameliorated_by"), ("causes", "caused_by"),
            ("preventative_for_condition", "prevented_by"),
        )
    },
    predicate_children={_P + "treats": [_P + "ameliorates_condition", _P + "preventative_for_condition"], _P + "contributes_to": [_P + "causes"]},
    category_children={_P + "Drug": [_P + "SmallMolecule"], _P + "GeneOrGeneProduct": [_P + "Gene"], _P + "ChemicalEntity": [_P + "SmallMolecule", _P + "Drug"]},
    value_children={"activity_or_abundance": ["activity", "abundance"]},
)

EDGE_ATTRIBUTES = ("knowledge_level", "agent_type", "publications", "p_value", "evidence_count")


def json_text(c: Column) -> Column:
    """A text as JSON: what to_json makes of it as the only element of a list, without the brackets."""
    whole = F.to_json(F.array(c))
    return F.substring(whole, F.lit(2), F.length(whole) - 2)


def number_of(c: Column) -> Column:
    """What float() makes of a text: blanks around it and single underscores between digits do not matter, suffixes as in '1d' are no numbers."""
    plain = F.trim(F.regexp_replace(c, "[\\t\\n\\r\\f\\x0b]", " "))
    plain = F.regexp_replace(plain, "(?<=[0-9])_(?=[0-9])", "")
    named = F.lower(F.regexp_replace(plain, "^[+-]", ""))
    sign = F.when(plain.startswith("-"), F.lit(-1.0)).otherwise(F.lit(1.0))
    return F.when(named.isin("inf", "infinity"), sign * F.lit(float("inf"))).when(named == "nan", F.lit(float("nan"))).when(plain.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"), plain.try_cast("double"))


def _quoted(c: Column) -> Column:
    """A text as repr() writes it, but for characters that cannot be printed."""
    c = F.replace(F.replace(F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")), F.lit("\r"), F.lit("\\r")), F.lit("\t"), F.lit("\\t"))
    double = F.contains(c, F.lit("'")) & ~F.contains(c, F.lit('"'))
    return F.when(double, F.concat(F.lit('"'), c, F.lit('"'))).otherwise(F.concat(F.lit("'"), F.replace(c, F.lit("'"), F.lit("\\'")), F.lit("'")))


def _shadow(name: str, kind: str, type_id: str) -> Column:
    """An attribute of a typed column, with the shadows that float() and str() would give."""
    c = F.col(name)
    null = F.lit(None).cast("string")
    if kind == "list":
        c = F.array_compact(c)
        parts = {"value_json": F.to_json(c), "value_type": F.lit("list"), "value_num": F.lit(None).cast("double"), "value_text": F.concat(F.lit("["), F.array_join(F.transform(c, _quoted), ", "), F.lit("]"))}
    elif kind == "string":
        parts = {"value_json": json_text(c), "value_type": F.lit("string"), "value_num": number_of(c), "value_text": c}
    else:
        parts = {"value_json": c.cast("string"), "value_type": F.lit(kind), "value_num": c.cast("double"), "value_text": c.cast("string")}
    fields = {"attribute_type_id": F.lit(type_id), "original_attribute_name": F.lit(name), "attribute_source": null, "value_type_id": null} | parts
    return F.when(F.col(name).isNotNull(), F.struct(*[v.alias(k) for k, v in fields.items()]))


def _kinds(df: DataFrame) -> dict[str, str]:
    return {f.name: {"string": "string", "double": "float", "bigint": "int", "array<string>": "list"}.get(f.dataType.simpleString(), "string") for f in df.schema}


def graph_of_tables(spark: SparkSession, edges: DataFrame, nodes: DataFrame) -> KnowledgeGraph:
    """Edges with subject, predicate and object, as written; nodes that they mention with the last of their rows.

    Blank and null ends make no edge. edge_idx is edge_row, which names a row for good.
    """
    e = edges.filter((F.trim("subject") != "") & (F.trim("predicate") != "") & (F.trim("object") != ""))
    quals = F.array(*[F.when(F.col(q).isNotNull(), F.struct(F.lit(_P + q).alias("qualifier_type_id"), F.col(q).alias("qualifier_value"))) for q in ("object_aspect_qualifier", "object_direction_qualifier")])
    sources = F.transform(F.filter("sources", lambda s: s.isNotNull()), lambda s: F.struct(s["resource_id"].alias("resource_id"), s["resource_role"].alias("resource_role"), F.coalesce(s["upstream_resource_ids"], F.array().cast("array<string>")).alias("upstream_resource_ids")))
    narrow = e.select(
        F.col("edge_row").alias("edge_idx"), F.col("id").alias("edge_id"), "subject", "predicate", "object", F.array_compact(quals).alias("qualifiers"),
        F.coalesce(sources, F.array().cast(f"array<{schema.SOURCE}>")).alias("sources"),
    )
    kinds = _kinds(edges)
    attrs = e.select(F.col("edge_row").alias("edge_idx"), F.array_compact(F.array(*[_shadow(a, kinds[a], f"{_P}{a}") for a in EDGE_ATTRIBUTES])).alias("attributes"))
    mentioned = narrow.select(F.explode(F.array("subject", "object")).alias("id")).distinct()
    of_nodes = _kinds(nodes)
    attr = F.array_compact(F.array(*[_shadow(a, of_nodes[a], f"{_P}Attribute") for a in ("equivalent_identifiers", "information_content")]))
    last = nodes.filter(F.trim("id") != "").groupBy("id").agg(F.max_by(F.struct("name", "category", "equivalent_identifiers", "information_content"), "node_row").alias("r")).select("id", "r.*")
    records = last.select("id", "name", F.coalesce(F.array_compact("category"), F.array().cast("array<string>")).alias("categories"), attr.alias("attributes"), "information_content")
    empty = {"categories": F.coalesce("categories", F.array().cast("array<string>")), "attributes": F.coalesce("attributes", F.array().cast(f"array<{schema.ATTRIBUTE}>"))}
    return KnowledgeGraph(spark, mentioned.join(records, "id", "left").withColumns(empty), narrow, attrs, ONTOLOGY, records=records)

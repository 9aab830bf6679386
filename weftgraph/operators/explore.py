"""What lies around a node, for browsing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.graph import KnowledgeGraph

#: Ranks of categories for browsing, the higher the more specific (fixed values, for equal groups).
RANKS = {
    "Entity": 1, "NamedThing": 5, "PhysicalEssenceOrOccurrent": 5, "Occurrent": 6, "PhysicalEssence": 6, "ThingWithTaxon": 6, "SubjectOfInvestigation": 6,
    "Attribute": 8, "OntologyClass": 8, "InformationContentEntity": 8, "BiologicalEntity": 10, "ChemicalEntityOrGeneOrGeneProduct": 12,
    "ChemicalEntityOrProteinOrPolypeptide": 12, "ChemicalOrDrugOrTreatment": 12, "GenomicEntity": 14, "MacromolecularMachineMixin": 14, "GeneOrGeneProduct": 16,
    "DiseaseOrPhenotypicFeature": 16, "BiologicalProcessOrActivity": 16, "PhysiologicalEntity": 16, "ChemicalEntity": 18, "AnatomicalEntity": 18,
    "OrganismTaxon": 20, "MolecularEntity": 22, "ChemicalMixture": 22, "MolecularMixture": 24, "ComplexMolecularMixture": 24,
    "SmallMolecule": 30, "Drug": 30, "Food": 30, "Disease": 30, "PhenotypicFeature": 30, "ClinicalFinding": 30, "Pathway": 30, "BiologicalProcess": 30,
    "MolecularActivity": 30, "PhysiologicalProcess": 30, "Behavior": 30, "Cell": 30, "GrossAnatomicalStructure": 30, "Genotype": 30, "Haplotype": 30,
    "Treatment": 28, "DrugExposure": 28, "Procedure": 28, "ClinicalIntervention": 28, "Device": 28, "DiagnosticAid": 28, "BehavioralFeature": 32,
    "CellularComponent": 32, "SequenceVariant": 32, "MacromolecularComplex": 32, "Gene": 34, "GeneProduct": 34, "Transcript": 34, "Polypeptide": 34, "Snv": 34,
    "Protein": 36, "RNAProduct": 36, "NoncodingRNAProduct": 38, "ProteinIsoform": 38, "MicroRNA": 40, "SiRNA": 40,
}
#: The rank of all others (fixed value).
DEFAULT_RANK = 26


def expand(kg: KnowledgeGraph, node: str) -> DataFrame:
    """(direction, predicate, neighbor): different neighbours of a node, itself left out."""
    e = kg.edges.filter((F.col("subject") == node) | (F.col("object") == node))
    ways = F.array(
        F.when(F.col("subject") == node, F.struct(F.lit("out").alias("direction"), F.col("object").alias("neighbor"))),
        F.when(F.col("object") == node, F.struct(F.lit("in").alias("direction"), F.col("subject").alias("neighbor"))),
    )
    out = e.select("predicate", F.explode(F.array_compact(ways)).alias("w")).select("w.direction", "predicate", "w.neighbor")
    return out.filter(F.col("neighbor").isNotNull() & (F.col("neighbor") != node)).distinct()


def expand_groups(kg: KnowledgeGraph, node: str) -> DataFrame:
    """(direction, predicate, n_neighbors), largest first."""
    return expand(kg, node).groupBy("direction", "predicate").agg(F.count(F.lit(1)).alias("n_neighbors")).orderBy(F.desc("n_neighbors"), "direction", "predicate")


def ranked_neighbors(kg: KnowledgeGraph, node: str, direction: str, predicate: str) -> DataFrame:
    """Neighbours of one group by degree, largest first and unknown last, then by name (the id if it has none)."""
    n = expand(kg, node).filter((F.col("direction") == direction) & (F.col("predicate") == predicate)).select(F.col("neighbor").alias("id"))
    out = n.join(kg.node_records.select("id", "name"), "id", "left").join(kg.degrees_of(n).select("id", F.col("total_degree").alias("degree")), "id", "left")
    return out.withColumn("name", F.coalesce("name", "id")).orderBy(F.desc_nulls_last("degree"), "name", "id")


def primary_category(categories: Column | str, ranks: dict[str, int] = RANKS) -> Column:
    """The category of the highest rank, by its name without prefix (DEFAULT_RANK if unranked), the first one on a tie."""
    categories = F.col(categories) if isinstance(categories, str) else categories
    flat = [x for k, v in ranks.items() for x in (F.lit(k), F.lit(v))]
    rank = F.create_map(*flat) if flat else F.create_map().cast("map<string,int>")
    ranked = F.transform(categories, lambda c, i: F.struct(F.coalesce(F.try_element_at(rank, F.regexp_replace(c, "^biolink:", "")), F.lit(DEFAULT_RANK)).alias("r"), (-i).alias("i"), c.alias("c")))
    return F.array_max(ranked)["c"]


def category_groups(kg: KnowledgeGraph, ids: DataFrame, ranks: dict[str, int] = RANKS) -> DataFrame:
    """(category, n) of nodes (id) by primary category, largest first, then by name."""
    n = ids.select("id").distinct().join(kg.node_records, "id", "left").withColumn("categories", F.coalesce("categories", F.array().cast("array<string>")))
    return n.groupBy(primary_category("categories", ranks).alias("category")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "category")


def one_hop_pattern(node: str, outgoing: bool = True) -> dict:
    """The pattern of all edges from (or to) a node."""
    s, o = ("n0", "n1") if outgoing else ("n1", "n0")
    return {"nodes": {"n0": {"ids": [node]}, "n1": {}}, "edges": {"e0": {"subject": s, "object": o}}}

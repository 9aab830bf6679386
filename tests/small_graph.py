"""The graph of eleven nodes and twenty edges that FIXTURES.md lists, as raw records.

Its ids, names and statements are fixed values: the answers that tests expect are those known for this graph.
"""

MET, PPARG, INSR, T2D, HYP, GLU, GLM, GCK, TNF, DM, CVD = (
    "CHEBI:6801", "NCBIGene:5468", "NCBIGene:3643", "MONDO:0005148", "HP:0001943", "CHEBI:17234", "GO:0006006", "NCBIGene:2645", "NCBIGene:7124", "MONDO:0005015", "MONDO:0004995",
)

_NODES = [
    (MET, "Metformin", "SmallMolecule Drug", 85.5), (PPARG, "PPARG", "Gene GeneOrGeneProduct", 92.3), (INSR, "INSR", "Gene GeneOrGeneProduct", 88.7), (T2D, "Type 2 Diabetes", "Disease", 78.2),
    (HYP, "Hypoglycemia", "PhenotypicFeature", 65.4), (GLU, "Glucose", "SmallMolecule ChemicalEntity", 70.1), (GLM, "Glucose metabolic process", "BiologicalProcess", 55.8),
    (GCK, "GCK", "Gene GeneOrGeneProduct", 81.2), (TNF, "TNF", "Gene GeneOrGeneProduct", 94.5), (DM, "Diabetes Mellitus", "Disease", 72.0), (CVD, "Cardiovascular Disease", "Disease", 60.0),
]
_EDGES = [
    (MET, "treats", T2D, "drugcentral"), (MET, "affects", PPARG, "ctd", None, None, 0.001, 12), (PPARG, "gene_associated_with_condition", T2D, "disgenet", None, None, 0.002, 15),
    (INSR, "gene_associated_with_condition", T2D, "disgenet", None, None, 0.07, 4), (T2D, "has_phenotype", HYP, "hpo"), (PPARG, "interacts_with", INSR, "intact"),
    (GLU, "participates_in", GLM, "reactome"), (GCK, "participates_in", GLM, "reactome"), (GCK, "gene_associated_with_condition", T2D, "disgenet", None, None, 0.15, 1),
    (MET, "affects", GLU, "ctd"), (MET, "ameliorates_condition", T2D, "clinicaltrials"), (MET, "preventative_for_condition", T2D, "pubmed"),
    (MET, "affects", INSR, "ctd", "activity", "increased", 0.03, 5), (MET, "affects", GCK, "ctd", "activity", "decreased", 0.08, 2), (MET, "affects", TNF, "ctd", "abundance", "increased", 0.0005, 20),
    (T2D, "subclass_of", DM, "mondo"), (DM, "subclass_of", CVD, "mondo"), (MET, "treats", DM, "drugcentral"), (MET, "treats", T2D, "chembl"),
    (MET, "affects", INSR, "hetio", "abundance", "decreased", 0.04, 3),
]


def raw_nodes():
    return [{"id": i, "name": n, "category": ["biolink:" + c for c in cs.split()], "equivalent_identifiers": [i], "information_content": ic} for i, n, cs, ic in _NODES]


def raw_edges():
    out = []
    for k, (s, p, o, src, *rest) in enumerate(_EDGES, 1):
        e = {"id": f"edge{k}", "subject": s, "predicate": "biolink:" + p, "object": o, "category": ["biolink:Association"], "knowledge_level": "knowledge_assertion", "agent_type": "manual_agent"}
        e["sources"] = [{"resource_role": "primary_knowledge_source", "resource_id": f"infores:{src}"}]
        for key, v in zip(("object_aspect_qualifier", "object_direction_qualifier", "p_value", "evidence_count"), rest):
            if v is not None:
                e[key] = v
        out.append(e)
    return out

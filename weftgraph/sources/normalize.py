"""Raw records as graph records: pure functions on one record, used inside Arrow batches."""

from __future__ import annotations

import json
import math
from typing import Any

from weftgraph.operators.constraints import canonical_json, type_name

#: Fields that are no attributes (fixed values).
CORE_EDGE = frozenset("id category subject object predicate sources primary_knowledge_source aggregator_knowledge_source".split())
CORE_NODE = frozenset("id name category".split())
OWN_SOURCE = "infores:weftgraph"
#: Qualifier fields that the result must share with other systems (fixed values).
QUALIFIER_FIELDS = frozenset(
    """anatomical_context_qualifier aspect_qualifier causal_mechanism_qualifier context_qualifier derivative_qualifier direction_qualifier
    disease_context_qualifier form_or_variant_qualifier frequency_qualifier object_aspect_qualifier object_context_qualifier
    object_derivative_qualifier object_direction_qualifier object_form_or_variant_qualifier object_part_qualifier
    object_specialization_qualifier onset_qualifier part_qualifier population_context_qualifier qualified_predicate
    response_context_qualifier response_target_context_qualifier severity_qualifier sex_qualifier specialization_qualifier
    species_context_qualifier stage_qualifier statement_qualifier subject_aspect_qualifier subject_context_qualifier
    subject_derivative_qualifier subject_direction_qualifier subject_form_or_variant_qualifier subject_part_qualifier
    subject_specialization_qualifier temporal_context_qualifier temporal_interval_qualifier""".split()
)


def qualifier_fields(slot_children: dict[str, list[str]] | None = None, root: str = "qualifier") -> frozenset[str]:
    """Fields that are qualifiers: all slots below root in a model (a slot's direct children, names with or without prefix, with blanks or underscores); the fixed ones if the model says nothing."""
    plain = lambda name: name.rpartition(":")[2].replace(" ", "_")
    children: dict[str, list[str]] = {}
    for slot, below in (slot_children or {}).items():
        children.setdefault(plain(slot), []).extend(map(plain, below))
    found: set[str] = set()
    todo = list(children.get(root, []))
    while todo:
        slot = todo.pop()
        if slot not in found and slot != root:
            found.add(slot)
            todo += children.get(slot, [])
    return frozenset(found) or QUALIFIER_FIELDS


class SourceValidationError(ValueError):
    """A record that breaks the contract of a graph source."""


def attribute(type_id: str, value: Any, name: str | None = None, source: str | None = None, value_type: str | None = None) -> dict:
    """An attribute with the typed shadows of its value: as float() and str() have it."""
    try:
        number = float(value)
    except (TypeError, ValueError, OverflowError):
        number = None
    return {
        "attribute_type_id": type_id, "original_attribute_name": name, "attribute_source": source, "value_type_id": value_type,
        "value_json": canonical_json(value), "value_type": type_name(value), "value_num": number if number is None or not math.isnan(number) else float("nan"), "value_text": str(value),
    }


def source_chain(raw: dict, own: str = OWN_SOURCE) -> list[dict]:
    """The sources of an edge with our own aggregator before them, above all that no one else draws from.

    Without sources, the primary one and its aggregators (given nearest last) make a chain.
    """
    make = lambda i, role, up: {"resource_id": i, "resource_role": role, "upstream_resource_ids": up}
    given = raw.get("sources") or []
    if given:
        chain = [make(s["resource_id"], s["resource_role"], list(s.get("upstream_resource_ids") or [])) for s in given]
    else:
        if "primary_knowledge_source" not in raw:
            raise SourceValidationError(f"edge {raw.get('id')!r} has no sources")
        chain = [make(raw["primary_knowledge_source"], "primary_knowledge_source", [])]
        for a in reversed(raw.get("aggregator_knowledge_source") or []):
            chain.append(make(a, "aggregator_knowledge_source", [chain[-1]["resource_id"]]))
    drawn = {u for s in chain for u in s["upstream_resource_ids"]}
    return [make(own, "aggregator_knowledge_source", [s["resource_id"] for s in chain if s["resource_id"] not in drawn]), *chain]


def qualifiers(raw: dict, fields: frozenset[str] = QUALIFIER_FIELDS) -> list[dict]:
    """Qualifier fields by type; values that are no text become JSON, predicates get their prefix."""
    out = []
    for k in sorted(fields & raw.keys()):
        v = raw[k]
        v = v if isinstance(v, str) else json.dumps(v)
        if k == "qualified_predicate":
            v = "biolink:" + v.partition(":")[2] if ":" in v else f"biolink:{v}"
        out.append({"qualifier_type_id": f"biolink:{k}", "qualifier_value": v})
    return out


def edge(raw: dict, fields: frozenset[str] = QUALIFIER_FIELDS) -> dict:
    """An edge record; what is neither core nor qualifier is an attribute, a raw list `qualifiers` is neither."""
    attrs = [attribute(f"biolink:{k}", v, k) for k, v in raw.items() if k not in CORE_EDGE and k not in fields and k != "qualifiers"]
    return {"id": raw.get("id"), "subject": raw.get("subject"), "predicate": raw.get("predicate"), "object": raw.get("object"), "sources": source_chain(raw), "qualifiers": qualifiers(raw, fields), "attributes": attrs}


def node(raw: dict) -> dict:
    attrs = [attribute("biolink:Attribute", v, k) for k, v in raw.items() if k not in CORE_NODE]
    return {"id": raw.get("id"), "name": raw.get("name"), "categories": raw.get("category") or [], "attributes": attrs}


def check_edge(e: dict) -> None:
    """Raises on the first thing that breaks the contract."""
    texts = [("subject", e.get("subject")), ("predicate", e.get("predicate")), ("object", e.get("object"))]
    for part, keys in (("sources", ("resource_id", "resource_role")), ("qualifiers", ("qualifier_type_id", "qualifier_value")), ("attributes", ("attribute_type_id",))):
        if not isinstance(e.get(part), list):
            raise SourceValidationError(f"edge {e.get('id')!r}: {part} must be a list")
        for x in e[part]:
            if not isinstance(x, dict):
                raise SourceValidationError(f"edge {e.get('id')!r}: an element of {part} is no object")
            texts += [(f"{part}.{k}", x.get(k)) for k in keys]
            if part == "sources" and not isinstance(x.get("upstream_resource_ids"), list):
                raise SourceValidationError(f"edge {e.get('id')!r}: upstream_resource_ids must be a list")
    for k, v in texts:
        if not isinstance(v, str) or not v:
            raise SourceValidationError(f"edge {e.get('id')!r}: {k} must be a text, not {v!r}")
    if e.get("id") is not None and not isinstance(e["id"], str):
        raise SourceValidationError(f"edge {e['id']!r}: id must be a text")


def check_node(n: dict) -> None:
    if not isinstance(n.get("id"), str) or not n["id"]:
        raise SourceValidationError(f"node {n.get('id')!r}: id must be a text")
    if n.get("name") is not None and not isinstance(n["name"], str):
        raise SourceValidationError(f"node {n['id']!r}: name must be a text")
    for part in ("categories", "attributes"):
        if not isinstance(n.get(part), list):
            raise SourceValidationError(f"node {n['id']!r}: {part} must be a list")

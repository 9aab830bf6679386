"""Types of the graph's tables."""

from __future__ import annotations

#: An attribute of a node or an edge: the JSON value with typed shadows, so that constraints need no parsing.
ATTRIBUTE = (
    "struct<attribute_type_id:string,original_attribute_name:string,attribute_source:string,value_type_id:string,"
    "value_json:string,value_type:string,value_num:double,value_text:string>"
)
QUALIFIER = "struct<qualifier_type_id:string,qualifier_value:string>"
SOURCE = "struct<resource_id:string,resource_role:string,upstream_resource_ids:array<string>>"

NODES = f"id string, name string, categories array<string>, attributes array<{ATTRIBUTE}>, information_content double"
EDGES = f"edge_idx string, edge_id string, subject string, predicate string, object string, qualifiers array<{QUALIFIER}>, sources array<{SOURCE}>"
EDGE_ATTRIBUTES = f"edge_idx string, attributes array<{ATTRIBUTE}>"

FALLBACK_CATEGORY = "biolink:NamedThing"
SUBCLASS_OF = "biolink:subclass_of"
SUPERCLASS_OF = "biolink:superclass_of"
ANY_PREDICATE = "biolink:related_to"
QUALIFIED_PREDICATE = "biolink:qualified_predicate"

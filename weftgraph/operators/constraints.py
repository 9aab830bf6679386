"""Constraints as column expressions that Catalyst can see."""

from __future__ import annotations

import json
import math
import re
from functools import reduce
from operator import and_, or_
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F


def has_category(categories: Column, wanted: list[str]) -> Column:
    """Any of the wanted categories is listed; null lists and elements match nothing."""
    return F.coalesce(F.exists(categories, lambda c: F.coalesce(c.isin(wanted), F.lit(False))), F.lit(False)) if wanted else F.lit(True)


def qualifiers_match(qualifiers: Column, alternatives: list[list[tuple[str | None, list[str]]]]) -> Column:
    """OR over alternatives, AND within, OR over a qualifier's accepted values; no alternatives accept all."""
    if not alternatives or any(not a for a in alternatives):
        return F.lit(True)

    def one(t: str | None, values: list[str]) -> Column:
        def test(q: Column) -> Column:
            same = q["qualifier_type_id"].eqNullSafe(F.lit(t))
            return same & (q["qualifier_value"].isin([v for v in values if v is not None]) if any(values) else q["qualifier_value"].isNull())

        return F.coalesce(F.exists(qualifiers, test), F.lit(False))

    return reduce(or_, [reduce(and_, [one(t, v) for t, v in a]) for a in alternatives])


def _number(v: Any) -> float | None:
    """float(v) as Python has it; None where that fails, and for what is not a number."""
    try:
        f = float(v)
    except (TypeError, ValueError, OverflowError):
        return None
    return None if math.isnan(f) else f


def type_name(v: Any) -> str:
    return {bool: "bool", int: "int", float: "float", str: "string", list: "list", dict: "dict", type(None): "null"}[type(v)]


def canonical_json(v: Any) -> str:
    return json.dumps(v, sort_keys=True, ensure_ascii=False)


def _equal(a: Column, v: Any) -> Column:
    if isinstance(v, (bool, int, float)):
        n = _number(v)
        return a["value_type"].isin("bool", "int", "float") & (a["value_num"] == F.lit(n)) if n is not None else F.lit(False)
    if isinstance(v, str):
        return (a["value_type"] == "string") & (a["value_text"] == v)
    return (a["value_type"] == type_name(v)) & (a["value_json"] == canonical_json(v))


def _strictly_equal(a: Column, v: Any) -> Column:
    return (a["value_type"] == type_name(v)) & _equal(a, v)


def _compare(a: Column, v: Any, greater: bool) -> Column:
    n = _number(v)
    if n is None or isinstance(v, (list, dict)):
        return F.lit(False)
    ok = ~F.isnan(a["value_num"])
    return ok & (a["value_num"] > n if greater else a["value_num"] < n)


def _java_pattern(p: str) -> str:
    return re.sub(r"\(\?P=(\w+)\)", r"\\k<\1>", p.replace("(?P<", "(?<"))


def _matches(a: Column, v: Any) -> Column:
    try:
        re.compile(str(v))
    except re.error:
        return F.lit(False)
    return a["value_text"].rlike(_java_pattern(str(v)))


_OPERATORS = {"==": _equal, "===": _strictly_equal, ">": lambda a, v: _compare(a, v, True), "<": lambda a, v: _compare(a, v, False), "matches": _matches}


def attribute_matches(attributes: Column, constraint: dict) -> Column:
    """One constraint {id, operator, value, not}: any attribute of that type id or original name passes.

    A list of values passes if one of them does (but for ===). Unknown operators and
    missing attributes do not pass; `not` turns the outcome round in every case.
    """
    op, v = _OPERATORS.get(constraint.get("operator", "")), constraint.get("value")

    def test(a: Column) -> Column:
        if op is None:
            return F.lit(False)
        values = v if isinstance(v, list) and op is not _strictly_equal else [v]
        return reduce(or_, [F.coalesce(op(a, x), F.lit(False)) for x in values], F.lit(False))

    ident = F.lit(constraint.get("id"))
    named = F.filter(attributes, lambda a: a["attribute_type_id"].eqNullSafe(ident) | a["original_attribute_name"].eqNullSafe(ident))
    passes = F.coalesce(F.exists(named, test), F.lit(False))
    return ~passes if constraint.get("not") else passes


def attributes_match(attributes: Column, constraints: list[dict]) -> Column:
    """All constraints hold."""
    return reduce(and_, [attribute_matches(attributes, c) for c in constraints], F.lit(True))

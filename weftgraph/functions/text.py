"""Column functions on text that stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def plain_form(col: Column | str) -> Column:
    """ASCII letters and digits of a text in their order, in lower case.

    Null and texts without any give ''. The class is applied before lower(), so
    that characters whose lower case is ASCII (the Kelvin sign) do not slip in.
    """
    col = F.col(col) if isinstance(col, str) else col
    return F.coalesce(F.lower(F.regexp_replace(col, "[^A-Za-z0-9]+", "")), F.lit(""))


def id_prefix(col: Column | str) -> Column:
    """The part of a compact id before its first ':'."""
    col = F.col(col) if isinstance(col, str) else col
    return F.split(col, ":", 2)[0]

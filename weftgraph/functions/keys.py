"""Text keys as integers, without loss."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Longest run of trailing digits that becomes the integer; the rest stays in the space.
MAX_DIGITS = 18


def integer_key(plain: Column) -> tuple[Column, Column]:
    """(space, number) of a key: equal pairs mean equal keys, and the reverse.

    The number is the key's trailing digits (at most MAX_DIGITS), the space is
    what stands before them with the count of digits, which keeps leading zeros
    apart ('go010' and 'go10' lie in different spaces).
    """
    digits = F.regexp_extract(plain, f"[0-9]{{1,{MAX_DIGITS}}}$", 0)
    n_digits = F.length(digits)
    space = F.concat(F.substring(plain, F.lit(1), F.length(plain) - n_digits), F.lit("#"), n_digits.cast("string"))
    return space, F.coalesce(digits.try_cast("bigint"), F.lit(0).cast("bigint"))

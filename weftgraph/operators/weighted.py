"""Per-key results when a few keys hold most records.

Rows are grouped by key and value first and by key after that. The first
grouping has as many groups as there are different pairs, whatever the share
of one key; the second reads weighted values and is combined on the map side,
so that no task holds the rows of a heavy key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def compress(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, value, weight): each different pair with the number of its rows. Null is a value like any other."""
    return df.groupBy(*keys, F.col(value).alias("value")).agg(F.count(F.lit(1)).alias("weight"))


def counts(weighted: DataFrame, keys: list[str], is_value=None) -> DataFrame:
    """(keys, n_rows, n_distinct) from weighted values. is_value: which values count as different ones; all but null if not given."""
    real = is_value(F.col("value")) if is_value else F.col("value").isNotNull()
    return weighted.groupBy(*keys).agg(F.sum("weight").alias("n_rows"), F.count(F.when(real, F.lit(1))).alias("n_distinct"))


def modes(weighted: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, mode, mode_rows): the most frequent value but null; the smallest one on a tie."""
    best = F.min(F.struct((-F.col("weight")).alias("w"), F.col("value").alias("v")))
    return weighted.filter(F.col("value").isNotNull()).groupBy(*keys).agg(best.alias("b")).select(*keys, F.col("b.v").alias("mode"), (-F.col("b.w")).alias("mode_rows"))


def percentiles(weighted: DataFrame, keys: list[str], q: float, bins: int = 64) -> DataFrame:
    """(keys, percentile): the smallest value that at least the share q of a key's rows do not exceed (null values count for nothing).

    Exact. Split points over all values (at most `bins`, the only thing that is
    collected) cut each key into bins; running weights over a key's bins name the
    one that holds the percentile, and only its different values are then sorted.
    """
    weighted = weighted.filter(F.col("value").isNotNull())
    splits = weighted.agg(F.percentile_approx("value", [i / bins for i in range(1, bins)], 10_000).alias("s")).first()["s"] or []
    splits = sorted(set(splits))

    def bin_of(lo: int, hi: int) -> Column:
        """How many of splits[lo:hi] lie below the value, and lo; by halves."""
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(F.col("value") <= splits[mid], bin_of(lo, mid)).otherwise(bin_of(mid + 1, hi))

    binned = weighted.withColumn("bin", bin_of(0, len(splits)))
    w = Window.partitionBy(*keys).orderBy("bin")
    per_bin = binned.groupBy(*keys, "bin").agg(F.sum("weight").alias("bw"))
    upto = per_bin.withColumns({"upto": F.sum("bw").over(w), "total": F.sum("bw").over(Window.partitionBy(*keys))})
    rank = F.greatest(F.ceil(F.col("total") * q), F.lit(1))
    holds = upto.filter((F.col("upto") >= rank) & (F.col("upto") - F.col("bw") < rank)).select(*keys, "bin", (rank - F.col("upto") + F.col("bw")).alias("need"))
    inside = binned.join(holds, [*keys, "bin"])
    run = F.sum("weight").over(Window.partitionBy(*keys, "bin").orderBy("value").rowsBetween(Window.unboundedPreceding, 0))
    return inside.withColumn("run", run).filter(F.col("run") >= F.col("need")).groupBy(*keys).agg(F.min("value").alias("percentile"))

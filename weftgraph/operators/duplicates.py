"""Records that are the same but for formatting.

Byte-identical rows are collapsed first, with counts; only what is left is
brought to its canonical text; the second grouping is on the whole canonical
text and adds the counts up.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.functions.text import plain_form
from weftgraph.operators.durable import kept


def canonical_value(col: Column) -> Column:
    """Canonical text of a value: its plain form; of a JSON object, the plain forms of its fields and values in the order of the fields.

    Lists keep their order. Null, blank and empty texts, lists and objects have ''.
    A repeated field counts with its last value.
    """
    fields = F.when(F.ltrim(col).startswith("{"), F.from_json(col, "map<string,string>", {"mode": "PERMISSIVE"}))
    pairs = F.transform(F.map_entries(fields), lambda e: F.struct(plain_form(e["key"]).alias("k"), plain_form(e["value"]).alias("v")))
    return F.when(F.size(pairs) > 0, F.array_join(F.transform(F.array_sort(pairs), lambda p: F.concat(p["k"], p["v"])), "")).otherwise(plain_form(col))


def collapse(df: DataFrame, row_id: str, plain_cols: list[str], value_cols: list[str], keep: bool = False) -> tuple[DataFrame, DataFrame]:
    """(statements, raw): each statement once with its copies; each different raw row with its statement.

    statements: c0.. (canonical texts), first_row (smallest row_id), n_copies.
    raw: r0.. (raw columns), c0.., first_raw (smallest row_id), n_raw.
    Rows whose plain_cols do not all have a non-empty plain form are no statements
    and are left out of statements. Both groupings combine on the map side: a third of all rows
    being copies of one costs one row per task. keep writes raw to the shared folder, with
    a digest (k1, k2) in place of its raw columns, for those who read both: rows are collapsed
    and made canonical once.
    """
    cols = [*plain_cols, *value_cols]
    raw_names, canon_names = [f"r{i}" for i in range(len(cols))], [f"c{i}" for i in range(len(cols))]
    raw = df.select(F.col(row_id).alias("row_id"), *[F.col(c).alias(r) for c, r in zip(cols, raw_names)])
    raw = raw.groupBy(*raw_names).agg(F.min("row_id").alias("first_raw"), F.count(F.lit(1)).alias("n_raw"))
    canon = [plain_form(r) if i < len(plain_cols) else canonical_value(F.col(r)) for i, r in enumerate(raw_names)]
    raw = raw.withColumns(dict(zip(canon_names, canon)))
    if keep:
        k1, k2 = _digest(raw_names)
        raw = kept(raw.withColumns({"k1": k1, "k2": k2}).drop(*raw_names))
    statements = raw.groupBy(*canon_names).agg(F.min("first_raw").alias("first_row"), F.sum("n_raw").alias("n_copies"))
    whole = reduce(and_, [F.col(c) != "" for c in canon_names[: len(plain_cols)]])
    # Reads n_copies, so that it is not moved before the groupings and worked out twice.
    statements = statements.filter(F.when(F.col("n_copies") > 0, whole))
    return statements, raw


def _digest(cols: list[str]) -> list[Column]:
    """128 bits of a row of texts, nulls told from empty ones."""
    parts = [x for c in cols for x in (F.col(c).isNull(), F.coalesce(c, F.lit("")))]
    return [F.xxhash64(F.lit(seed), *parts) for seed in (17, 71)]


def copies(df: DataFrame, row_id: str, plain_cols: list[str], value_cols: list[str]) -> DataFrame:
    """(row_a, row_b): every row that is not the first of its statement, with the first.

    Statements are grouped on whole texts; only their members are then looked up, by
    128-bit digests of raw rows. Null-safe in value_cols; ties cannot arise as row_id
    is unique; an empty table gives no rows.
    """
    cols = [*plain_cols, *value_cols]
    raw_names, canon_names = [f"r{i}" for i in range(len(cols))], [f"c{i}" for i in range(len(cols))]
    statements, raw = collapse(df, row_id, plain_cols, value_cols, keep=True)
    d1, d2 = _digest(canon_names)
    repeated = statements.filter(F.col("n_copies") > 1).select(d1.alias("d1"), d2.alias("d2"), "first_row")
    of_raw = dict(zip(("k1", "k2"), _digest(raw_names)))
    # Different raw rows with other rows than the first one of their statement.
    placed = raw.select(d1.alias("d1"), d2.alias("d2"), "k1", "k2", "first_raw", "n_raw").join(repeated, ["d1", "d2"])
    placed = placed.filter((F.col("n_raw") > 1) | (F.col("first_raw") != F.col("first_row"))).select("k1", "k2", F.col("first_row").alias("row_a"))
    rows = df.select(F.col(row_id).alias("row_b"), *[F.col(c).alias(r) for c, r in zip(cols, raw_names)]).select("row_b", *[v.alias(k) for k, v in of_raw.items()])
    # placed has one row for each different raw row: a heavy one is split on the side of the rows only (adaptive skew join).
    return rows.join(placed, ["k1", "k2"]).filter(F.col("row_a") != F.col("row_b")).select("row_a", "row_b")

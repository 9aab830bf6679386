"""References to records that do not exist, are gone or come later.

Parent keys are integers (functions.keys). Consecutive keys are compressed into
runs. Runs, lives of parents and references are sorted together by key and time in
ranges of about equally many rows, whatever the share of one key; a scan of each
range matches every reference as-of to the run that starts before it, and to the
lives of its key that have begun: beyond the run's end the parent is missing,
without a life it is late, beyond the latest end of these lives it is gone.

What a range begins with may go on from the range before. Each range tells how it
ends (one row), and references that depend on that are judged once all have.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.functions.keys import integer_key
from weftgraph.operators.durable import kept

#: Keys are put into runs in blocks of 2 ** BLOCK_BITS integers: as keys are distinct, no task sorts more of them at once.
BLOCK_BITS = 16
EARLIEST, LATEST = -(2**63), 2**63 - 1
_RUN, _LIFE, _REF = 0, 1, 2
_SCANNED = "part int, space string, n bigint, ref_id bigint, field_name string, t bigint, run_hi bigint, life_end bigint, reason string"
_COLUMNS = [c.split()[0] for c in _SCANNED.split(", ")]


def key_runs(keys: DataFrame) -> DataFrame:
    """(space, block, lo, hi): contiguous integer keys of each space, cut at blocks. keys: distinct (space, n)."""
    w = Window.partitionBy("space", "block").orderBy("n")
    numbered = keys.withColumn("block", F.shiftright("n", BLOCK_BITS)).withColumn("g", F.col("n") - F.row_number().over(w))
    return numbered.groupBy("space", "block", "g").agg(F.min("n").alias("lo"), F.max("n").alias("hi")).drop("g")


def _codes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Which rows differ from the row before (the first one does not), and the number of the row's stretch of equal ones."""
    differs = np.zeros(len(texts), bool)
    if len(texts) > 1:
        differs[1:] = pc.not_equal(texts[1:], texts[:-1]).to_numpy(zero_copy_only=False)
    return differs, np.cumsum(differs)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (space, n, t, kind, upto, ref_id, field_name) of one range -> what its references are, by what the range itself has.

    reason '?' needs the end of the range before: run_hi and life_end are then what is
    known here, if anything. The last row has no ref_id: the range's last space, key,
    run and latest end of a life.
    """
    part = TaskContext.get().partitionId()
    space = n_last = run_space = None
    run_hi, life, whole = None, EARLIEST, True  # whole: all rows so far are of the range's first key
    for b in batches:
        if not b.num_rows:
            continue
        spaces, field = b.column(0), b.column(6)
        n, t, kind, upto, ref = (b.column(i).to_numpy(zero_copy_only=False) for i in (1, 2, 3, 4, 5))
        differs, in_space = _codes(spaces)
        first, last = spaces[0].as_py(), spaces[b.num_rows - 1].as_py()
        differs[1:] |= n[1:] != n[:-1]
        key = np.cumsum(differs)
        goes_on = space is None or (first == space and n[0] == n_last)
        # The run that starts before: its row, -1 for what was before the batch.
        at = np.maximum.accumulate(np.where(kind == _RUN, np.arange(len(n)), -1))
        own = (at >= 0) & (in_space[at] == in_space)
        carried = (at < 0) & (in_space == 0) & (run_space == first) if run_hi is not None else np.zeros(len(n), bool)
        covered = np.where(own, upto[at], run_hi if run_hi is not None else EARLIEST)
        known = own | carried
        begun = pd.Series(np.where(kind == _LIFE, upto, EARLIEST)).groupby(key).cummax().to_numpy()
        if goes_on:
            begun = np.where(key == 0, np.maximum(begun, life), begun)
        open_ = ~known & (at < 0) & (in_space == 0) & (run_hi is None) & (space is None or first == space)
        open_ |= (key == 0) & goes_on & whole
        reason = np.where(~known | (covered < n), "missing", np.where(begun == EARLIEST, "late", np.where(begun <= t, "deleted", "")))
        reason[open_] = "?"
        take = (kind == _REF) & (reason != "")
        if take.any():
            rows = pa.array(np.flatnonzero(take))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(rows), part, np.int32)), spaces.take(rows), pa.array(n[take]), pa.array(ref[take].astype(np.int64)), field.take(rows), pa.array(t[take]),
                 pa.array(covered[take], mask=~known[take]), pa.array(begun[take]), pa.array(reason[take].astype(object), pa.string())], names=_COLUMNS)
        whole = whole and goes_on and key[-1] == 0
        life = int(begun[-1])
        if at[-1] >= 0:
            run_hi, run_space = int(upto[at[-1]]), spaces[int(at[-1])].as_py()
        space, n_last = last, int(n[-1])
    if space is not None:
        # field_name holds the space of the last run, reason whether the whole range is of one key.
        yield pa.RecordBatch.from_pylist(
            [dict(zip(_COLUMNS, (part, space, n_last, None, run_space, None, run_hi, life, "one key" if whole else "")))],
            pa.schema([("part", pa.int32()), *[(c, pa.string() if c in ("space", "field_name", "reason") else pa.int64()) for c in _COLUMNS[1:]]]),
        )


def _beginnings(ends: list) -> list[tuple]:
    """(part, space and key that went on into it, their latest end of a life, space and end of the run before) of each range, from the ends of all."""
    out, space, n, life, run_space, run_hi = [], None, None, EARLIEST, None, None
    for e in sorted(ends, key=lambda e: e["part"]):
        out.append((e["part"], space, n, life, run_space, run_hi))
        life = max(life, e["life_end"]) if e["reason"] == "one key" and (e["space"], e["n"]) == (space, n) else e["life_end"]
        space, n = e["space"], e["n"]
        if e["run_hi"] is not None:
            run_space, run_hi = e["field_name"], e["run_hi"]
    return out


def find_orphans(refs: DataFrame, parents: DataFrame) -> DataFrame:
    """References without a living parent: ref_id, field_name, at and reason.

    refs: ref_id BIGINT, field_name STRING, key STRING (plain), at BIGINT (microseconds).
    parents: key STRING, start BIGINT, end BIGINT; a life is start <= at < end.
    reason: 'missing' (no such key), 'late' (all lives start after at), 'deleted' (else).

    Empty and null keys are no references and no parents. A null end is never;
    a parent without start is known but never alive, a reference without at meets
    no life either (both 'deleted'). Repeated parents and references, ties and
    empty tables are allowed: each reference row is judged on its own.
    """
    space, n = integer_key(F.col("key"))
    null = F.lit(None).cast("bigint")
    lives = parents.filter(F.col("key") != "").select(
        space.alias("space"), n.alias("n"), F.coalesce("start", F.lit(EARLIEST + 1)).alias("t"), F.when(F.col("start").isNull(), F.lit(EARLIEST + 1)).otherwise(F.coalesce("end", F.lit(LATEST))).alias("upto")
    )
    runs = key_runs(lives.select("space", "n").distinct())

    def event(df: DataFrame, kind: int, n: Column | str, t: Column | str, upto: Column | str, ref: Column | str = null, field: Column | str = null) -> DataFrame:
        cols = {"space": "space", "n": n, "t": t, "kind": F.lit(kind).cast("tinyint"), "upto": upto, "ref_id": ref, "field_name": field}
        return df.select(*[(F.col(c) if isinstance(c, str) else c).alias(k) for k, c in cols.items()])

    refs = refs.select("ref_id", F.col("field_name").cast("string"), "key", F.coalesce("at", F.lit(LATEST)).alias("t")).filter(F.col("key") != "").withColumns({"space": space, "n": n})
    events = (
        event(runs, _RUN, "lo", F.lit(EARLIEST), "hi", field=F.lit(None).cast("string")).unionByName(event(lives, _LIFE, "n", "t", "upto", field=F.lit(None).cast("string")))
        .unionByName(event(refs, _REF, "n", "t", null, "ref_id", "field_name"))
    )
    # ref_id and field_name split even references of one key and one time.
    by = ["space", "n", "t", "kind", "ref_id", "field_name"]
    events = events.withColumns({"upto": F.coalesce("upto", F.lit(0)), "ref_id": F.coalesce("ref_id", F.lit(0))})
    scanned = kept(events.repartitionByRange(*by).sortWithinPartitions(*by).mapInArrow(_scan, _SCANNED))
    # One row for each range.
    begins = _beginnings(scanned.filter(F.col("ref_id").isNull()).collect())
    before = refs.sparkSession.createDataFrame(begins, "part int, b_space string, b_n bigint, b_life bigint, b_run_space string, b_run_hi bigint")
    open_ = scanned.filter((F.col("reason") == "?") & F.col("ref_id").isNotNull()).join(F.broadcast(before), "part")
    hi = F.coalesce("run_hi", F.when(F.col("b_run_space") == F.col("space"), F.col("b_run_hi")))
    life = F.when((F.col("b_space") == F.col("space")) & (F.col("b_n") == F.col("n")), F.greatest("life_end", "b_life")).otherwise(F.col("life_end"))
    judged = F.when(F.coalesce(hi < F.col("n"), F.lit(True)), "missing").when(life == EARLIEST, "late").when(life <= F.col("t"), "deleted")
    cols = ["ref_id", "field_name", "t", "reason"]
    out = scanned.filter((F.col("reason") != "?") & F.col("ref_id").isNotNull()).select(*cols).unionByName(open_.withColumn("reason", judged).filter(F.col("reason").isNotNull()).select(*cols))
    return out.select("ref_id", "field_name", F.when(F.col("t") != LATEST, F.col("t")).alias("at"), "reason")

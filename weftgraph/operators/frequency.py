"""How often every distinct term occurs, and in how many records.

Pairs of term and record are range-partitioned and sorted by both, so that a
term of any share lies in as many partitions as it needs; a run-length scan of
each partition gives (term, occurrences, records), and what is cut at the
borders of partitions is added up. Equal pairs never lie in two partitions.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RUNS = "field_name string, term string, n_occur bigint, n_records bigint"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (field_name, term, record, times) -> one row per run of equal field and term in each batch.

    Only the last record of the batch before is remembered: a record that goes on
    over a batch's border is not counted again.
    """
    last = None
    for b in batches:
        n = b.num_rows
        if not n:
            continue
        f, t, r, times = (b.column(i) for i in range(4))
        differs = lambda x: pc.fill_null(pc.not_equal(x[1:], x[:-1]), True)
        new_term = pc.or_(differs(f), differs(t)) if n > 1 else pa.array([], pa.bool_())
        new_rec = pc.or_(new_term, differs(r)) if n > 1 else pa.array([], pa.bool_())
        first = (f[0].as_py(), t[0].as_py(), r[0].as_py())
        starts = [0, *(i + 1 for i in pc.indices_nonzero(new_term).to_pylist())]
        is_rec = pc.cast(pa.chunked_array([pa.array([first != last]), new_rec]).combine_chunks(), pa.int64())
        occ_upto, rec_upto = pc.cumulative_sum(times), pc.cumulative_sum(is_rec)
        ends = pa.array([*(s - 1 for s in starts[1:]), n - 1])
        per_run = lambda upto: pc.subtract(upto.take(ends), pa.concat_arrays([pa.array([0], pa.int64()), upto.take(ends[:-1])]))
        at = pa.array(starts)
        yield pa.RecordBatch.from_arrays([f.take(at), t.take(at), per_run(occ_upto), per_run(rec_upto)], ["field_name", "term", "n_occur", "n_records"])
        last = (f[n - 1].as_py(), t[n - 1].as_py(), r[n - 1].as_py())


def term_frequencies(pairs: DataFrame) -> DataFrame:
    """(field_name, term, n_occur, n_records) of pairs (field_name, term, record BIGINT, times BIGINT).

    A pair may come several times: times are added, the record counts once. Null
    and empty terms count for nothing; an empty table gives no rows.
    """
    pairs = pairs.select("field_name", "term", "record", "times").filter(F.col("term") != "")
    by = ["field_name", "term", "record"]
    runs = pairs.repartitionByRange(*by).sortWithinPartitions(*by).mapInArrow(_scan, RUNS)
    return runs.groupBy("field_name", "term").agg(F.sum("n_occur").alias("n_occur"), F.sum("n_records").alias("n_records"))


def with_mark(freq: DataFrame, totals: dict[str, int], rare_below: int = 3, common_above: float = 0.3) -> DataFrame:
    """mark: 'rare' if n_records < rare_below, 'common' if n_records exceeds that share of the field's records, else 'ok'. totals: rows of each field's table."""
    total = F.coalesce(*[F.when(F.col("field_name") == f, F.lit(n)) for f, n in totals.items()])
    mark = F.when(F.col("n_records") < rare_below, "rare").when(F.col("n_records") > F.lit(common_above) * total, "common").otherwise("ok")
    return freq.withColumn("mark", mark)

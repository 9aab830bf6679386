"""Edges that keep arriving as line-delimited JSON, appended to a table by micro-batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from weftgraph.sources.ingest import edges_of_lines


def append_edges(spark: SparkSession, folder: str, table: str, state: str, available_now: bool = True) -> StreamingQuery:
    """Reads new files of a folder once each and appends their edge records to a Parquet table.

    The batch number is a column: a batch that is repeated after a failure replaces itself.
    """

    def write(batch: DataFrame, number: int) -> None:
        edges_of_lines(batch.select("value")).drop("line").write.mode("overwrite").parquet(f"{table}/batch={number}")

    q = spark.readStream.text(folder).writeStream.foreachBatch(lambda b, n: write(b, n)).option("checkpointLocation", state)
    return (q.trigger(availableNow=True) if available_now else q).start()

"""Cutting lineage so that lost executors cost no more than a re-read."""

from __future__ import annotations

import tempfile
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: the session's setting. Where it is unset, one of our own, on one machine only; a cluster must name it."""
    set_by_cluster = spark.conf.get(SETTING, None) or spark.sparkContext.getConf().get(SETTING)
    if set_by_cluster:
        if not spark.sparkContext.getCheckpointDir():
            spark.sparkContext.setCheckpointDir(set_by_cluster)
        return set_by_cluster
    if not spark.sparkContext.getCheckpointDir():
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError(f"{SETTING} must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="weftgraph-"))
    return spark.sparkContext.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint of df (eager)."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def kept(df: DataFrame) -> DataFrame:
    """df as a table written in the shared folder, for what is read again in parts: by columns, compressed."""
    path = f"{shared_dir(df.sparkSession)}/kept-{uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

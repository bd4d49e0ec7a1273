"""Cutting a long plan where its result is read many times."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame


def settle(df: DataFrame) -> DataFrame:
    """``df`` computed once into the cluster's shared checkpoint folder, so that later plans start there.

    Headings, ops and outlines are read by many joins; without the cut each of them would
    carry the whole way from the text again.  A folder of its own is only made on a single
    machine; a cluster has to name one.  What is written are Parquet files, so that a reader
    takes only the columns that it needs.
    """
    context = df.sparkSession.sparkContext
    if not context.getConf().get("spark.checkpoint.dir", None) and not context._jsc.sc().getCheckpointDir().isDefined():
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='vellum-checkpoints-')}")
    path = f"{context.getCheckpointDir() or context.getConf().get('spark.checkpoint.dir')}/settled-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

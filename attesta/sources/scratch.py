"""Lineage cuts and tables in the session's checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def cut(df: DataFrame, batch: int | None = None) -> DataFrame:
    """Checkpoints the rows where spark.checkpoint.dir points; a folder of our own is set only where the session names none, as in tests.

    `batch` is the number of rows that Python tasks get at a time while these rows are made, for rows that are large; the session's own number is set back afterwards.
    """
    context, conf, held = df.sparkSession.sparkContext, df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not context.getCheckpointDir():
        context.setCheckpointDir(conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="attesta-checkpoints-"))
    if batch is None:
        return df.checkpoint()
    before = conf.get(held)
    conf.set(held, batch)
    try:
        return df.checkpoint()
    finally:
        conf.set(held, before)


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that spark.checkpoint.dir names; one of our own only where the session names none, as in tests."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or f"file://{tempfile.mkdtemp(prefix='attesta-shared-')}"
    return f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"

"""Folders that all executors share, for checkpoints and intermediate tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from strandlog.sources.files import Files

#: Intermediate folders of other applications are removed once they are so old, in seconds.
KEPT = 7 * 86_400.0


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or the context's checkpoint folder. In local mode, without either, a temporary folder; an error elsewhere."""
    sc = spark.sparkContext
    known = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if known is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        known = "file://" + tempfile.mkdtemp(prefix="strandlog-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(known)
    return known.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path for an intermediate table. Results may be read lazily, so it is removed not by its maker, but, with all that its
    application left, by the first application that comes KEPT seconds later."""
    root, app = shared_dir(spark), spark.sparkContext.applicationId
    files = Files(spark, root)
    for old in files.names("strandlog-scratch"):
        if old != app and files.age(f"strandlog-scratch/{old}") > KEPT:
            files.delete(f"strandlog-scratch/{old}")
    return f"{root}/strandlog-scratch/{app}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Cuts the lineage with a reliable checkpoint; the files survive lost executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)

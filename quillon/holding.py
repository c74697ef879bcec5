"""Tables that a plan reads several times."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def held(df: DataFrame) -> DataFrame:
    """``df`` computed once: a checkpoint in the session's folder (``spark.checkpoint.dir``), which survives lost executors.

    A local session may do without that folder; on a cluster a missing one is an error, as no other folder is shared.
    """
    spark = df.sparkSession
    if not spark.conf.get("spark.checkpoint.dir", None) and not spark.sparkContext.getCheckpointDir():
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        import tempfile

        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="quillon-"))
    return df.checkpoint()


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that driver and executors share."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        spark.range(1).transform(held)  # names one in a local session, raises on a cluster
        root = spark.sparkContext.getCheckpointDir()
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"

"""Tables that cut lineage, kept where every executor can read them."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

__all__ = ["checkpointed", "ensure_checkpoint_dir"]


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder.

    A cluster names a shared folder in ``spark.checkpoint.dir``. Only where that is unset and Spark runs on
    one machine, as in tests, a temporary folder is made; on a cluster that is an error.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        where = spark.conf.get("spark.checkpoint.dir", None)
        if where is None and not context.master.startswith("local["):
            raise ValueError("name a folder that all executors share in spark.checkpoint.dir")
        context.setCheckpointDir(where or tempfile.mkdtemp(prefix="colloquy-"))
    return context.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` computed now and written to the checkpoint folder; later reads survive lost executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)

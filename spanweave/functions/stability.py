"""Cut the lineage of a frame that many jobs will read."""

from __future__ import annotations

import tempfile

from pyspark import StorageLevel
from pyspark.sql import DataFrame


def settle(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder named by ``spark.checkpoint.dir``.

    Where the setting is absent, a local session gets its own folder; a cluster
    session keeps the lineage and only persists, so lost executors recompute.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    shared = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if context.getCheckpointDir() is None:
        if shared:
            context.setCheckpointDir(shared)
        elif context.master.startswith("local"):
            context.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoint-"))
        else:
            return df.persist(StorageLevel.MEMORY_AND_DISK)
    return df.checkpoint()

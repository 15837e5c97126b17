"""Tables that cut lineage: written to the folder all executors share, and read back."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_CLEAN_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Bytes of a batch of rows for a Python worker.
BATCH = "8m"
_BATCHES, _DEFAULT = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"
_own_folder: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. A local session without the setting gets
    a folder of its own; a cluster session without it is an error, as no other place is
    seen by all executors."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not context.master.startswith("local[") and context.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return _own_folder.setdefault(context.applicationId, "file://" + tempfile.mkdtemp(prefix="shared-"))


def modest_batches(spark: SparkSession) -> None:
    """Have rows sent to Python workers BATCH at a time, where the session has not chosen
    otherwise: by default a batch holds up to 64 MB, several times over in the memory of a task."""
    if spark.conf.get(_BATCHES, _DEFAULT) == _DEFAULT:
        spark.conf.set(_BATCHES, BATCH)


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and return the stored table.

    Unlike persisted partitions the files outlive any executor. The shuffle files of the
    write are released as soon as it has ended; nothing reads them again.
    """
    spark = df.sparkSession
    modest_batches(spark)
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEAN_SHUFFLES, None)
    spark.conf.set(_CLEAN_SHUFFLES, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(_CLEAN_SHUFFLES)
        else:
            spark.conf.set(_CLEAN_SHUFFLES, before)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete the files of settled tables that no later plan reads."""
    for table in tables:
        for folder in {file.rsplit("/", 1)[0] for file in table.inputFiles()}:
            path = table.sparkSession._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    modest_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")

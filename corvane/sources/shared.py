"""The folder that all of a cluster's machines share, for what is computed once and read often."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, or the checkpoint directory set on the context; only a local session without either gets a local folder."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        made = spark.sparkContext._jsc.sc().getCheckpointDir()
        if made.isEmpty():
            if not spark.sparkContext.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="corvane-"))
            made = spark.sparkContext._jsc.sc().getCheckpointDir()
        base = made.get()
    return base.rstrip("/")


#: Bytes of a batch of rows that Python workers get at most.
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Lowers the session's limit on the size of batches for Python, if it is above BATCH_BYTES: texts are long, and workers make arrays several times as large as their batch."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    held = spark._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch()
    if held < 0 or held > BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


#: Removes a job's shuffle files when it ends; else they stay until the driver happens to collect its garbage.
CLEANS = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def no_leftovers(spark: SparkSession) -> Iterator[None]:
    """Jobs that run here leave no shuffle files behind. The session's setting is as before afterwards."""
    try:
        was = spark.conf.get(CLEANS)
    except Exception as e:
        if "SQL_CONF_NOT_FOUND" not in str(e):
            raise
        yield  # a version without it
        return
    spark.conf.set(CLEANS, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANS, was)


def kept(df: DataFrame, compression: str = "zstd") -> DataFrame:
    """df written to the shared folder and read again: computed once, also if executors are lost. The folder stays until someone cleans the shared one, as checkpoints do."""
    path = f"{shared_dir(df.sparkSession)}/corvane-{uuid.uuid4().hex}"
    with no_leftovers(df.sparkSession):
        df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

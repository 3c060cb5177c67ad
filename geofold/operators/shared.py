"""Tables in the folder that the driver and all executors share; they cut plans and survive lost executors.

All tables of an application stand in one folder, ``geofold-<application id>``; ``clear`` deletes it
when nothing built on them is needed any more.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"
#: Spark's setting by which shuffle files go when the execution that wrote them ends.
CLEANUP_CONF = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """From ``spark.checkpoint.dir``; where that is unset, a local folder stands in on ``local`` masters only, as all threads share it there."""
    path = spark.conf.get(CHECKPOINT_CONF, None)
    if not path:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError(f"{CHECKPOINT_CONF} must name a folder that the driver and all executors share; it is unset on {master}")
        path = f"file://{tempfile.mkdtemp(prefix='geofold-checkpoint-')}"
        spark.conf.set(CHECKPOINT_CONF, path)
    return f"{path.rstrip('/')}/geofold-{spark.sparkContext.applicationId}"


#: Spark's setting for the bytes of an Arrow batch that Python workers get.
BATCH_CONF, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20


@contextmanager
def _set(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def bounded_batches(spark: SparkSession):
    """Rows of some MB each don't add up to one batch."""
    return _set(spark, BATCH_CONF, str(BATCH_BYTES))


def stash(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and return the written table."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    with _set(spark, CLEANUP_CONF, "true"):  # once a table is written, the shuffles that made it are never read again
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._geofold_path = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(target, True)


def unstash(df: DataFrame | None) -> None:
    """Delete a table written by ``stash`` that no later step reads."""
    path = getattr(df, "_geofold_path", None)
    if path:
        _delete(df.sparkSession, path)


def clear(spark: SparkSession) -> None:
    """Delete all tables that this application has written."""
    _delete(spark, shared_dir(spark))

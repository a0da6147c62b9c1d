"""Session settings and the shared folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

SQL_SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # The JVM does not compile methods beyond 8000 bytes; let Spark fall back to split-up
    # projections there instead of running one huge generated method uncompiled.
    "spark.sql.codegen.hugeMethodLimit": "8000",
}


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime SQL settings the plans are written for. Partition counts stay the cluster's."""
    for key, value in SQL_SETTINGS.items():
        spark.conf.set(key, value)
    return spark


#: Tasks of a stateful step that few cores get all the same.
LEAST_STATE_TASKS = 8


@contextmanager
def state_tasks(spark: SparkSession) -> Iterator[None]:
    """Streams started inside have a task of a stateful step for each core, or for each shuffle partition of the session if these are fewer.

    In every micro-batch each task opens its state, starts a Python worker and saves the state, which takes seconds whatever its
    rows; more partitions for larger tables would multiply that by the micro-batches. A stream goes on with the number it began with.
    """
    key = "spark.sql.shuffle.partitions"
    partitions = spark.conf.get(key)
    spark.conf.set(key, min(int(partitions), max(LEAST_STATE_TASKS, spark.sparkContext.defaultParallelism)))
    try:
        yield
    finally:
        spark.conf.set(key, partitions)


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir`` (or set on the context).

    Where there is none, a local session gets a temporary folder of its own; on a cluster that is an
    error, since executors do not share a machine's folders.
    """
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if root:
        return root
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors can reach")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    return context.getCheckpointDir()


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A new, unused path below the shared folder."""
    return f"{checkpoint_root(spark).rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def written(df, purpose: str):
    """``df`` written to the shared folder and read back: its lineage is cut, executors may come and go."""
    path = shared_folder(df.sparkSession, purpose)
    df.write.parquet(path)
    made = df.sparkSession.read.schema(df.schema).parquet(path)
    made._written_at = path
    return made


def discard(*tables) -> None:
    """Delete tables of :func:`written`. Only what reads them must be written itself by then."""
    for table in tables:
        context = table.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(table._written_at)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)

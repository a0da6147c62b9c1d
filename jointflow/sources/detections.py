"""Reading detection tables and writing state tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from jointflow.schema import DETECTIONS, EXERCISE_STATE, PERSON, TRACK_KEY, TRACK_ORDER
from jointflow.session import state_tasks
from jointflow.sources.versions import Versions


def scan_detections(
    spark: SparkSession, path: str, fmt: str = "parquet", schema: T.StructType = DETECTIONS
) -> DataFrame:
    """Detections of many videos at once. The schema is given, so nothing is inferred by a pass
    over the data; filters and columns asked for later reach the files."""
    return spark.read.format(fmt).schema(schema).load(path)


def scan_persons(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return scan_detections(spark, path, fmt, PERSON)


def stream_detections(
    spark: SparkSession,
    path: str,
    max_files: int | None = None,
    fmt: str = "parquet",
    schema: T.StructType = DETECTIONS,
) -> DataFrame:
    """The same tables as a stream of files. Run it with ``trigger(availableNow=True)`` to stop at
    the end of the input; ``max_files`` bounds a micro-batch."""
    reader = spark.readStream.format(fmt).schema(schema)
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.load(path)


def write_table(df: DataFrame, path: str, mode: str = "errorifexists") -> str:
    """Write rows with a ``video_id`` as one directory per video.

    The rows are rebalanced by video first: AQE joins small videos into one task and splits a big
    one over many, so neither tiny files nor a single huge writer appear.
    """
    (
        df.hint("rebalance", "video_id")
        .write.mode(mode)
        .partitionBy("video_id")
        .parquet(path)
    )
    return path


write_states = write_table
write_detections = write_table


def read_table(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Read back a table of :func:`write_table`; filters on ``video_id`` prune directories."""
    return spark.read.schema(schema).parquet(path).select(*schema.fieldNames())


def stream_states(
    states: DataFrame, path: str, checkpoint: str, available_now: bool = True, late_path: str | None = None
) -> StreamingQuery:
    """Append a stream of states to parquet files, exactly once per checkpoint.

    With ``late_path`` a stream made ``with_late`` leaves its late rows there, a folder ``batch=<n>`` for each micro-batch
    that a repeated batch overwrites, and its states at ``path`` in the same way.
    """
    if late_path is not None:

        def split(batch: DataFrame, batch_id: int) -> None:
            batch = batch.persist()  # else the stateful step would run twice
            own, late = batch.where("not late").drop("late"), batch.where("late")
            own.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
            late.select("video_id", "frame_idx", "det_idx", "track_id").write.mode("overwrite").parquet(f"{late_path}/batch={batch_id}")
            batch.unpersist()

        parted = states.writeStream.foreachBatch(split).option("checkpointLocation", checkpoint)
        with state_tasks(states.sparkSession):
            return (parted.trigger(availableNow=True) if available_now else parted).start()
    writer = (
        states.writeStream.format("parquet")
        .outputMode("append")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
    )
    with state_tasks(states.sparkSession):
        return (writer.trigger(availableNow=True) if available_now else writer).start()


def stream_latest(states: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Keep the latest state per (video, track, exercise) of a stream in :class:`~jointflow.sources.versions.Versions` under ``path``.

    Each micro-batch writes the states it changed, and every so many all of them; one that is run again after a failure
    overwrites only its own output, and versions no longer needed go.
    """
    from jointflow.operators.exercise import latest_states

    def merge(batch: DataFrame, batch_id: int) -> None:
        _latest_table(path).write(latest_states(batch), batch_id)

    writer = states.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
    with state_tasks(states.sparkSession):
        return writer.trigger(availableNow=True).start()


def read_latest(spark: SparkSession, path: str) -> DataFrame:
    """The latest states written by :func:`stream_latest`."""
    return _latest_table(path).read_newest(spark)


def _latest_table(path: str) -> Versions:
    return Versions(path, (*TRACK_KEY, "exercise"), TRACK_ORDER, EXERCISE_STATE)

"""A feed of snapshot files as a stream: each micro-batch's newest snapshot replaces the state, unless it is empty or older."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.utils import AnalysisException


def previous(spark: SparkSession, path: str) -> DataFrame | None:
    """The state as it is, or None before the first snapshot."""
    try:
        return spark.read.parquet(path)
    except AnalysisException:
        return None


def replace_state(state: str, generated: str) -> Callable[[DataFrame, int], None]:
    """A batch writer: the rows of the batch's newest snapshot become a new version of the state.

    An empty batch, and one whose newest snapshot isn't newer than the state's, change nothing. Versions are written side by
    side under the state's folder, so a reader never sees half a snapshot.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        now = batch.agg(F.max(generated)).first()[0]
        before = current(spark, state, generated)
        if now is None or (before is not None and before.agg(F.max(generated)).first()[0] >= now):
            return
        batch.where(F.col(generated) == now).withColumn("version", F.lit(epoch)).write.mode("append").partitionBy("version").parquet(state)

    return write


def current(spark: SparkSession, state: str, generated: str) -> DataFrame | None:
    """The newest snapshot in the state's folder."""
    every = previous(spark, state)
    if every is None:
        return None
    newest = every.agg(F.max(generated).alias("newest"))
    return every.join(F.broadcast(newest), F.col(generated) == F.col("newest")).drop("newest", "version")  # a row


def run_feed(spark: SparkSession, folder: str, schema: T.StructType, state: str, checkpoint: str, generated: str = "generated_utc") -> StreamingQuery:
    """Takes all snapshot files (JSON lines) that are new in a folder, then stops."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(folder)
    return stream.writeStream.foreachBatch(replace_state(state, generated)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def tumbling_counts(events: DataFrame, time: str, kind: str, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts by kind in windows of event time, batch or stream; an addition to what feeds need."""
    return events.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), kind).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), kind, "n")

"""Streaming input over table files, and a run over everything available."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ashlar.plans.loops import new_folder

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def event_stream(
    spark: SparkSession,
    folder: str,
    schema: StructType,
    time: str = "ts",
    delay: str = "1 hour",
    glob: str = "*.parquet",
    files_per_batch: int | None = None,
) -> DataFrame:
    """Rows of Parquet files as they arrive, with event time and watermark.

    Event time is cast to a timestamp, the only type a watermark accepts.
    """
    reader = spark.readStream.schema(schema).option("pathGlobFilter", glob)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder).withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, delay)


def _settings(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    # Sessions merge before the shuffle, so a busy key sends sessions and not rows.
    spark.conf.set("spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition", "true")


def run_available(stream: DataFrame, root: str | None = None, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Process all available input in append mode into Parquet and read it back.

    With the same ``root`` a later run continues where this one stopped.
    """
    spark = stream.sparkSession
    _settings(spark)
    root = root or new_folder(spark)
    writer = stream.writeStream.format("parquet").option("path", f"{root}/rows")
    writer = writer.option("checkpointLocation", f"{root}/progress").outputMode("append").trigger(availableNow=True)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{root}/rows")


def run_batches(stream: DataFrame, each: Callable[[DataFrame, int], None], root: str, mode: str = "append") -> StreamingQuery:
    """Process all available input, handing each micro-batch and its number to ``each``."""
    _settings(stream.sparkSession)
    writer = stream.writeStream.foreachBatch(each).option("checkpointLocation", f"{root}/progress")
    query = writer.outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def late_rows(query: StreamingQuery) -> int:
    """Rows dropped for arriving after the watermark, from the query's progress."""
    return sum(op.numRowsDroppedByWatermark for p in query.recentProgress for op in p.stateOperators)

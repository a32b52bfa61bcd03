"""Play logs as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from cadenza.sources.table import Table


def play_counts(events: DataFrame, time: str, window: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Plays and value of each window and event type, late rows within the watermark counted."""
    stamped = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    return stamped.groupBy(F.window(time, window), "event_type").agg(F.count(F.lit(1)).alias("plays"), F.sum("value").alias("value"))


def sessions(events: DataFrame, time: str, user: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    stamped = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    return stamped.groupBy(F.session_window(time, gap), user).agg(F.count(F.lit(1)).alias("plays"))


def once(events: DataFrame, keys: list[str], time: str, late: str = "1 hour") -> DataFrame:
    """The first row of each key within the watermark."""
    return events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def merge_into(stream: DataFrame, path: str, keys: list[str], checkpoint: str) -> StreamingQuery:
    """Appends to a log every streamed row whose key it lacks; running a batch again adds nothing.

    Of rows with one key in one batch all stay; :func:`merge_into_table` keeps one, however rows are cut into batches, and reads less.
    """

    def add(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        try:
            old = spark.read.schema(batch.schema).parquet(path).select(*keys).distinct()
            batch = batch.join(old, keys, "left_anti")
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
        batch.write.mode("append").parquet(path)

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def merge_into_table(stream: DataFrame, table: Table, order: str, checkpoint: str) -> StreamingQuery:
    """Adds to a stored log every streamed row whose key it lacks, the first by ``order`` of several of a batch.

    A batch reads and writes the buckets of its own keys only, one key is one row however the rows are cut into batches,
    and running a batch again adds nothing.  The log is made with the first batch.
    """

    def add(batch: DataFrame, _: int) -> None:
        if not table.versions():
            table.create(batch.schema)
        table.insert(batch, order)

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

"""Votes that add up over a stream, and folders that grow."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import StringType, StructField, StructType

#: The state store that keyed state of this kind needs.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
FILES = "path string, modificationTime timestamp, length long, content binary"


class Votes(StatefulProcessor):
    """How often each key voted for each value, for as long as ``ttl_ms`` (0: ever) after its last vote for it."""

    def __init__(self, ttl_ms: int = 0) -> None:
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.counts = handle.getMapState("counts", "value string", "n long", ttlDurationMs=self.ttl_ms or None)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803, ANN001
        for part in rows:
            for value, n in part["value"].value_counts().items():
                old = self.counts.getValue((value,)) if self.counts.containsKey((value,)) else (0,)
                self.counts.updateValue((value,), (old[0] + int(n),))
        totals = {k[0]: v[0] for k, v in self.counts.iterator()}
        if totals:
            best = min(totals, key=lambda v: (-totals[v], v.encode()))
            yield pd.DataFrame({"key": [key[0]], "value": [best], "votes": [totals[best]]})

    def close(self) -> None:
        pass


def winning(votes: DataFrame, key: str, value: str, ttl_ms: int = 0) -> DataFrame:
    """A stream of ``key, value, votes``: after each batch the value with most votes so far of every key that voted in it, the first in UTF-8 order of equals.

    Keyed state is kept by the checkpoint, so a run that begins again goes on counting.  Null values do not vote.  The state of one key is a map of its values.
    """
    votes.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    rows = votes.select(votes[key].cast("string").alias("key"), votes[value].cast("string").alias("value")).where("key is not null and value is not null")
    to = StructType([StructField("key", StringType()), StructField("value", StringType()), *StructType.fromDDL("votes long").fields])
    return rows.groupBy("key").transformWithStateInPandas(Votes(ttl_ms), to, "Update", "ProcessingTime" if ttl_ms else "None")


def growing_folder(spark: SparkSession, path: str, pattern: str = "*", at_a_time: int = 10_000) -> DataFrame:
    """A stream of the files below a folder, ``path, modificationTime, length``, each once; its checkpoint knows those already seen."""
    files = spark.readStream.format("binaryFile").schema(FILES).option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).option("maxFilesPerTrigger", at_a_time)
    return files.load(path).select("path", "modificationTime", "length")


def list_new(files: DataFrame, to: str, checkpoint: str) -> StreamingQuery:
    """Appends the files that came since the last run to a table, and ends."""
    return files.writeStream.format("parquet").option("path", to).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

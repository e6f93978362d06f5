"""Streams of mutations into a table, and windowed counts over them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.table import KVTable

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stream_into(table: KVTable, mutations: DataFrame, checkpoint: str, *order: str, name: str = "log", available_now: bool = True) -> StreamingQuery:
    """Commits each micro-batch once: the commit carries the batch's number, so a batch that is sent again is left out.

    mutations: a streaming frame (key, value, op, expires_at_ms and the ordering
    columns). The latest view is any read of the table; late rows only get later
    sequence numbers within their batch, and a read picks by number.
    """

    def commit(df: DataFrame, batch: int) -> None:
        table.append(df, *order, stream=name, batch=batch)

    w = mutations.writeStream.queryName(name).option("checkpointLocation", checkpoint).foreachBatch(commit)
    return (w.trigger(availableNow=True) if available_now else w).start()


def activity(mutations: DataFrame, time: str, late: str = "10 minutes", size: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Mutations by window and operation, rows later than the watermark left out."""
    window = F.window(time, size, slide) if slide else F.window(time, size)
    return mutations.withWatermark(time, late).groupBy(window.alias("w"), "op").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "op", "n")


def sessions(mutations: DataFrame, time: str, key: str = "key", late: str = "10 minutes", gap: str = "30 minutes") -> DataFrame:
    """Runs of mutations of a key without a gap."""
    return mutations.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("w"), key).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def into_files(counts: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """The whole result of counts over a stream as Parquet files, which each micro-batch writes anew.

    Executors write the rows, and keep their state in RocksDB: neither the driver nor a heap has to hold all groups.
    """

    def write(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(path)

    conf = counts.sparkSession.conf
    before = conf.get(_PROVIDER, None)
    conf.set(_PROVIDER, _ROCKSDB)
    try:  # a stream takes the settings of its start
        return counts.writeStream.outputMode("complete").option("checkpointLocation", checkpoint).foreachBatch(write).trigger(availableNow=True).start()
    finally:
        conf.unset(_PROVIDER) if before is None else conf.set(_PROVIDER, before)

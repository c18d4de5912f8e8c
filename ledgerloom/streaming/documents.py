"""Structured Streaming over event and document tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import statement


def rollup(events: DataFrame, time: str, key: str, value: str, width: str = "1 day", late: str = "1 day") -> DataFrame:
    """(window_start, key, n, total) per window; rows later than ``late`` after the newest are dropped.

    Works on a stream and on a table alike.
    """
    timed = events.withColumn(time, F.col(time).cast("timestamp"))
    w = F.window(F.col(time), width)
    watched = timed.withWatermark(time, late) if events.isStreaming else timed
    got = watched.groupBy(w.alias("w"), F.col(key)).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return got.select(F.col("w.start").alias("window_start"), key, "n", "total")


def watch_statements(spark: SparkSession, folder: str, table: str, checkpoint: str):
    """Append the documents of the statement files that arrive in ``folder`` to the Parquet table ``table``.

    The file source remembers what it has read, and all files of a batch are read
    together into a folder of the batch's number, so a batch that is run again replaces itself.
    """

    def add(batch: DataFrame, number: int) -> None:
        statement.documents_of(batch).write.mode("overwrite").parquet(f"{table}/batch={number}")

    files = statement.raw_files(spark.readStream, folder)
    return files.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

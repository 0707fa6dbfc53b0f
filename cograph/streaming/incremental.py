"""Incremental runs (INC-1..4): new files only, resuming by key, progress."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cograph.sources.slices import slice_key


def new_slice_files(spark: SparkSession, path: str) -> DataFrame:
    """A stream of the slice files of a folder."""
    files = spark.readStream.format("text").option("wholetext", True).option("pathGlobFilter", "*_cfg.txt").schema("value string").load(path)
    return files.select(slice_key(F.col("_metadata.file_name")).alias("sha256"), F.col("value").alias("content"))


def watch(query, report: Callable[[dict], None], every: float = 3.0, rounds: int = 0, sleep: Callable[[float], None] = time.sleep) -> int:
    """Polls a running query and reports what is new: batch, rows and rows a second. Returns the number of reports.

    Ends when the query does, or after `rounds` polls (0: no bound).
    """
    told, last, n = 0, None, 0
    while True:
        active, now = query.isActive, query.lastProgress
        if now is not None and (now["runId"], now["batchId"]) != last:
            last, told = (now["runId"], now["batchId"]), told + 1
            report({"batch": now["batchId"], "rows": now["numInputRows"], "rate": now["processedRowsPerSecond"]})
        n += 1
        if not active or n == rounds:
            return told
        sleep(every)


def run_available(stream: DataFrame, checkpoint: str, write: Callable[[DataFrame, int], None], timeout: float | None = None) -> list[dict]:
    """Processes what is there and stops; the checkpoint remembers it for the next run. Returns the progress reports."""
    query = stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()
    query.awaitTermination(timeout) if timeout else query.awaitTermination()
    return [dict(p) if isinstance(p, dict) else {"numInputRows": p.numInputRows} for p in query.recentProgress]


def resumed_append(out: str, key: str = "sha256") -> Callable[[DataFrame, int], None]:
    """A batch writer that appends the keys that `out` lacks: a batch that is tried again writes nothing twice."""

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(out)
        there = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
        fresh = batch.join(spark.read.parquet(out).select(key), key, "left_anti") if there else batch
        fresh.write.mode("append").parquet(out)

    return write


def progress(done: DataFrame, work: DataFrame, key: str = "sha256") -> DataFrame:
    """done, total and share, at most 1."""
    row = lambda df, d, t: df.select(F.lit(d).alias("d"), F.lit(t).alias("t"))
    both = row(done.select(key).distinct(), 1, 0).unionByName(row(work, 0, 1)).agg(F.coalesce(F.sum("d"), F.lit(0)).alias("done"), F.coalesce(F.sum("t"), F.lit(0)).alias("total"))
    return both.withColumn("share", F.least(F.lit(1.0), F.coalesce(F.try_divide(F.col("done"), F.col("total")), F.lit(0.0))))

"""Prediction records and analysis logs (SRC-9..12)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cograph.functions.responses import log_verdict
from cograph.operators.rows import keep_first, offset_limit

RECORD = "sha256 string, prediction string, ground_truth string, family string, analysis string"


def read_predictions(spark: SparkSession, path: str, strict: bool = True, schema: str = RECORD) -> DataFrame:
    """JSON lines. strict: a malformed line stops the read; else it is dropped, as are records without a key."""
    if strict:
        return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    kept = spark.read.schema(f"{schema}, _bad string").option("columnNameOfCorruptRecord", "_bad").json(path)
    return kept.filter("_bad IS NULL AND sha256 IS NOT NULL").drop("_bad")


def read_logs(spark: SparkSession, *paths: str, offset: int = 0, limit: int = 0) -> DataFrame:
    """sha256 (the file's stem, lower case), content and source; of repeated keys the first path wins.

    offset, limit: a page of the logs in the order of their keys (0: all).
    """
    key = F.lower(F.regexp_replace(F.col("_metadata.file_name"), r"\.log$", ""))

    def one(i: int, path: str) -> DataFrame:
        files = spark.read.option("pathGlobFilter", "*.log").text(path, wholetext=True)
        return files.select(key.alias("sha256"), F.col("value").alias("content"), F.lit(path).alias("source"), F.lit(i).alias("src_prio"), F.col("_metadata.file_name").alias("file"))

    every = keep_first(reduce(DataFrame.unionByName, [one(i, p) for i, p in enumerate(paths)]), ["sha256"], "src_prio", "file")
    return offset_limit(every.drop("src_prio", "file"), "sha256", offset, limit)


def log_records(logs: DataFrame) -> DataFrame:
    return logs.select("sha256", log_verdict(F.col("content")).alias("prediction"), F.length("content").alias("analysis_length"))

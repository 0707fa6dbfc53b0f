"""The knowledge base (SRC-13..16, SNK-8, SNK-10..12): Parquet partitioned by label, upserts by key, statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cograph.functions.vectors import normalise
from cograph.operators.rows import keep_last
from cograph.sources.stores import exists

KEY = ("sha256", "function_name", "suspicious_api")


def kb_id(df: DataFrame) -> DataFrame:
    return df.withColumn("id", F.sha2(F.concat_ws(":", *KEY), 256))


def upsert(base: DataFrame | None, new: DataFrame, order: str = "slice_pos") -> DataFrame:
    """`base` with the rows of `new`: of equal ids, new rows win, and among them the last."""
    new = kb_id(new).withColumn("__age", F.lit(1))
    rows = new if base is None else base.withColumn("__age", F.lit(0)).unionByName(new, allowMissingColumns=True)
    return keep_last(rows, ["id"], "__age", order).drop("__age")


def save(df: DataFrame, path: str, recreate: bool = False) -> None:
    """Writes vectors at length 1, partitioned by label; without `recreate`, what is there stays and nothing is computed."""
    if not recreate and exists(df.sparkSession, path):
        return
    out = df.withColumn("vector", normalise(F.col("vector")))
    out.write.mode("overwrite").partitionBy("ground_truth").parquet(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def statistics(df: DataFrame, target: int | None = None) -> DataFrame:
    """points by label and in all, and the share of a target reached (at most 1)."""
    n = F.count("*")
    out = df.groupBy("ground_truth").agg(n.alias("points"))
    total = F.sum("points").over(W.partitionBy())
    out = out.withColumn("total", total)
    return out.withColumn("progress", F.least(F.lit(1.0), F.col("total") / F.lit(float(target)))) if target else out


def storage(spark: SparkSession, path: str) -> DataFrame:
    """ground_truth, points, files and bytes of what is stored, by partition."""
    rows = spark.read.parquet(path).select("ground_truth", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("size"))
    files = rows.groupBy("ground_truth", "file").agg(F.count("*").alias("points"), F.max("size").alias("size"))
    return files.groupBy("ground_truth").agg(F.sum("points").alias("points"), F.count("*").alias("files"), F.sum("size").alias("bytes"))


def count_where(df: DataFrame, column: str, value) -> int:
    return df.filter(F.col(column) == value).count()

"""Label tables (SRC-1..5): explicit columns, file order kept as `row_pos`."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cograph.functions.text import normal_key, strip, verdict_with_family
from cograph.operators.rows import keep_first, offset_limit

FIELDS = "sha256 string, family string, date string, label double, vt double, vt_scan_date string, vt_year int"


def with_position(files: DataFrame) -> DataFrame:
    """`row_pos` of a file scan: files by name, their parts by place, rows as they stand.

    The number of a row alone would not do: Spark deals parts of files to tasks by size.
    """
    at = F.struct(F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("part"), F.monotonically_increasing_id().alias("row"))
    return files.withColumn("row_pos", at)


def read_labels(spark: SparkSession, path: str, schema: str = FIELDS) -> DataFrame:
    """sha256, family, label and row_pos of a label CSV as it is; blanks before values are kept."""
    return with_position(spark.read.schema(schema).option("header", True).csv(path)).select("sha256", "family", "label", "row_pos")


def write_labels(rows: DataFrame, path: str) -> None:
    """A label CSV (sha256, family, label) with all columns that such files have."""
    names = [f.split()[0] for f in FIELDS.split(", ")]
    rows.select(*[F.col(c) if c in rows.columns else F.lit(None).cast("string").alias(c) for c in names]).write.mode("overwrite").option("header", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def scan_labels(rows: DataFrame, limit: int = 0, offset: int = 0) -> DataFrame:
    """Null keys dropped, keys trimmed and in lower case, the first row of each key, then offset and limit (0: all)."""
    rows = rows.filter("sha256 IS NOT NULL").withColumn("sha256", normal_key(F.col("sha256"))).withColumn("family", strip(F.col("family")))
    return offset_limit(keep_first(rows, ["sha256"], "row_pos"), "row_pos", offset, limit)


def scan_hashes(rows: DataFrame, limit: int = 0) -> DataFrame:
    return scan_labels(rows.withColumn("family", F.lit(None).cast("string")), limit).select("sha256", "row_pos")


def ground_truth(rows: DataFrame) -> DataFrame:
    """sha256 and a verdict that names the family."""
    return scan_labels(rows).select("sha256", verdict_with_family(F.col("label"), F.col("family")).alias("verdict"))


def kb_labels(rows: DataFrame) -> DataFrame:
    """sha256, label and family; of repeated keys the last row wins."""
    rows = rows.filter("sha256 IS NOT NULL").withColumn("sha256", normal_key(F.col("sha256")))
    last = F.max_by(F.struct(F.col("label").cast("int").alias("label"), strip(F.col("family")).alias("family")), "row_pos").alias("last")
    return rows.groupBy("sha256").agg(last).select("sha256", "last.*")


def union_labels(*tables: DataFrame) -> DataFrame:
    """All tables, the first table and row of each key winning."""
    tagged = [t.withColumn("src_prio", F.lit(i)) for i, t in enumerate(tables)]
    rows = reduce(DataFrame.unionByName, tagged).filter("sha256 IS NOT NULL").withColumn("sha256", normal_key(F.col("sha256")))
    return keep_first(rows, ["sha256"], "src_prio", "row_pos")

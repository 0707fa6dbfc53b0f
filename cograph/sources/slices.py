"""Slice files (SRC-6..8, FLT-5, FLT-17): whole-file text rows into one row a function slice, with built-ins only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cograph.functions import constants as C
from cograph.functions.text import freshness, strip


def read_slice_files(spark: SparkSession, path: str) -> DataFrame:
    """sha256 (from the file name), path and content of every *_cfg.txt."""
    files = spark.read.option("pathGlobFilter", "*_cfg.txt").text(path, wholetext=True)
    return files.select(slice_key(F.col("_metadata.file_name")).alias("sha256"), F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))


def slice_key(file_name: Column) -> Column:
    """The key in a slice file's name, decoded and in lower case."""
    return F.lower(F.try_url_decode(F.regexp_extract(file_name, r"^(.*)_cfg\.txt$", 1)))


def worth_parsing(content: Column, least: int = 50) -> Column:
    """Not empty, not the mark of an empty result, and of some length."""
    body = strip(content)
    return (F.length(body) >= least) & ~body.contains(C.NOTHING_FOUND)


def parse_slices(files: DataFrame, content: str = "content") -> DataFrame:
    """The columns of `files` without `content`, and slice_pos, function_name, suspicious_api, nodes, edges, raw_text."""
    text = F.regexp_replace(F.col(content), rf"^{C.VERSION_MARK}[^\n]*(\n|$)", "")
    blocks = F.filter(F.transform(F.split(text, C.BLOCK_MARK), strip), lambda b: b != "")
    blocks = F.when(strip(text) == C.NOTHING_FOUND, F.array().cast("array<string>")).otherwise(blocks)
    rows = files.select(*[c for c in files.columns if c != content], F.posexplode(blocks).alias("slice_pos", "block"))
    lines = F.split("block", "\n")
    name = strip(F.regexp_replace(strip(F.get(lines, F.lit(0))), "=+$", ""))
    below = F.transform(F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0))), strip)
    rows = rows.select("*", name.alias("function_name"), below.alias("below")).drop("block")
    end = F.array_position(F.transform("below", lambda x: x.startswith(C.END_MARK)), True)
    body = F.when(end > 0, F.slice("below", F.lit(1), (end - 1).cast("int"))).otherwise(F.col("below"))
    rows = rows.withColumn("body", body).drop("below")
    starts = lambda *marks: F.filter("body", lambda x: x.startswith(marks[0]) | x.startswith(marks[-1]))
    api = F.coalesce(strip(F.regexp_replace(F.try_element_at(starts("SUSPICIOUS_API:"), F.lit(-1)), r"^[^:]*:", "")), F.lit(""))
    rows = rows.select("*", api.alias("suspicious_api"), starts("NODE ").alias("nodes"), starts("EDGE:").alias("edges"), starts("NODE ", "EDGE:").alias("kept")).drop("body")
    raw = F.concat(F.lit(f"{C.BLOCK_MARK} "), "function_name", F.lit(" ===\nSUSPICIOUS_API: "), "suspicious_api", F.lit("\n"), F.array_join("kept", "\n"), F.lit(f"\n{C.END_MARK} ===\n"))
    return rows.withColumn("raw_text", raw).drop("kept")


def staleness(files: DataFrame) -> DataFrame:
    return files.withColumn("state", freshness(F.col("content"))).select(*[c for c in files.columns if c != "content"], "state.fresh", "state.reason")


def slice_text(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Files (keys, content) from ordered lines (keys, block_pos, line_pos, line): the writer's side of the format."""
    blocks = rows.groupBy(*keys, "block_pos").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_pos", "line"))), lambda x: x["line"]), "\n").alias("block"))
    files = blocks.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block_pos", "block"))), lambda x: x["block"]), "\n\n").alias("blocks"))
    head = f"{C.VERSION_MARK} {C.SLICER_VERSION} ===\n"
    return files.select(*keys, F.concat(F.lit(head), F.when(F.coalesce("blocks", F.lit("")) == "", C.NOTHING_FOUND).otherwise(F.concat("blocks", F.lit("\n\n")))).alias("content"))


def or_nothing(apps: DataFrame, files: DataFrame, key: str = "sha256") -> DataFrame:
    """One file for each app: those without slices say so."""
    empty = f"{C.VERSION_MARK} {C.SLICER_VERSION} ===\n{C.NOTHING_FOUND}"
    return apps.join(files, key, "left").withColumn("content", F.coalesce("content", F.lit(empty)))

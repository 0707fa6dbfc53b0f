"""Instruction records, labelled logs, evaluation of runs (PRJ-5, SRC-12, JOIN-3, entry D)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cograph.functions.responses import log_verdict
from cograph.functions.text import normal_family, strip, verdict
from cograph.operators import evaluation as E
from cograph.operators.joins import fill_by_priority, label_or_default

INSTRUCTION = "Decide from the sliced control-flow graphs of an app whether it is MALWARE or BENIGN, and name the family of malware."


def instruction_records(files: DataFrame, truth: DataFrame) -> DataFrame:
    """instruction, input, output for the non-empty files of labelled apps (truth: sha256, verdict)."""
    rows = files.filter(strip(F.col("content")) != "").join(truth, "sha256")
    return rows.select(F.lit(INSTRUCTION).alias("instruction"), strip(F.col("content")).alias("input"), F.col("verdict").alias("output"))


def labelled_logs(logs: DataFrame, labels: DataFrame) -> DataFrame:
    """sha256, prediction, ground_truth, family, source of analysis logs; what has no label is UNKNOWN."""
    known = labels.select("sha256", verdict(F.col("label")).alias("ground_truth"), strip(F.col("family")).alias("family"))
    rows = logs.select("sha256", log_verdict(F.col("content")).alias("prediction"), "source")
    return label_or_default(rows, known, ground_truth="UNKNOWN", family="unknown").select("sha256", "prediction", "ground_truth", "family", "source")


def evaluate(records: DataFrame, label_tables: list[DataFrame] = ()) -> tuple[DataFrame, DataFrame]:
    """(metrics, family rates) of prediction records; labels that they lack come from the tables, in their order."""
    # Families of equal size come by the first record: by `row_pos` where records have it, else by key.
    if label_tables:
        tables = [t.select("sha256", verdict(F.col("label")).alias("ground_truth"), strip(F.col("family")).alias("family")) for t in label_tables]
        records = fill_by_priority(records, tables, ["ground_truth", "family"])
    known = with_truth(records)
    counts = E.confusion(known)
    return E.metrics(counts), E.group_rates(known, normal_family(F.col("family")), "row_pos" if "row_pos" in known.columns else "sha256")


def with_truth(records: DataFrame) -> DataFrame:
    """The records that an evaluation can use: those with a ground truth."""
    return records.filter("ground_truth IS NOT NULL")


def split_labelled(logs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(labelled, unlabelled) of labelled logs."""
    return logs.filter("ground_truth <> 'UNKNOWN'"), logs.filter("ground_truth = 'UNKNOWN'")

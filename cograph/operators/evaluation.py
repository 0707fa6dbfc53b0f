"""Confusion counts, metrics, rates by group, distributions (AGG-1..6, AGG-13..16, FLT-13)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

POSITIVE, NEGATIVE = "MALWARE", "BENIGN"


def confusion(df: DataFrame, truth: str = "ground_truth", said: str = "prediction", keys: tuple = (), positive=POSITIVE, negative=NEGATIVE) -> DataFrame:
    """total, tp, tn, fp, fn; rows with other values count in the total only."""
    cell = lambda t, p: F.count_if((F.col(truth) == t) & (F.col(said) == p))
    return df.groupBy(*keys).agg(
        F.count("*").alias("total"), cell(positive, positive).alias("tp"), cell(negative, negative).alias("tn"), cell(negative, positive).alias("fp"), cell(positive, negative).alias("fn")
    )


def metrics(counts: DataFrame) -> DataFrame:
    """Accuracy, precision, recall, F1 and error rates from confusion counts; 0 where the denominator is."""
    share = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
    tp, tn, fp, fn = (F.col(c) for c in ("tp", "tn", "fp", "fn"))
    precision, recall = share(tp, tp + fp), share(tp, tp + fn)
    return counts.withColumns(
        {"accuracy": share(tp + tn, F.col("total")), "precision": precision, "recall": recall, "f1": share(2 * precision * recall, precision + recall), "fpr": share(fp, fp + tn), "fnr": share(fn, fn + tp)}
    )


def group_rates(df: DataFrame, group: str | Column, position: str, truth: str = "ground_truth", said: str = "prediction", positive=POSITIVE) -> DataFrame:
    """family, total, detected, missed and rate over the positive rows, the largest first, then the first seen."""
    own = df.filter(F.col(truth) == positive).groupBy((F.col(group) if isinstance(group, str) else group).alias("family"))
    out = own.agg(F.count("*").alias("total"), F.count_if(F.col(said) == positive).alias("detected"), F.min(position).alias("first_seen"))
    out = out.withColumn("missed", F.col("total") - F.col("detected")).withColumn("detection_rate", F.col("detected") / F.col("total"))
    return out.orderBy(F.desc("total"), "first_seen").select("family", "total", "detected", "missed", "detection_rate")


def distribution(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("n"))


def errors(df: DataFrame, kind: str, truth: str = "ground_truth", said: str = "prediction", positive=POSITIVE, negative=NEGATIVE) -> DataFrame:
    """The rows of false positives ("fp") or false negatives ("fn")."""
    a, b = (negative, positive) if kind == "fp" else (positive, negative)
    return df.filter((F.col(truth) == a) & (F.col(said) == b))


def outcome_counts(df: DataFrame, outcome: str = "outcome") -> DataFrame:
    return df.groupBy(outcome).agg(F.count("*").alias("n"))


def fresh_counts(states: DataFrame) -> DataFrame:
    return states.agg(F.count_if("fresh").alias("fresh"), F.count_if(~F.col("fresh")).alias("stale"), F.count_if(F.col("fresh") & F.col("reason").startswith("marker")).alias("rescued"))


def run_summary(df: DataFrame, truth: str = "ground_truth", said: str = "prediction", seconds: str | None = None, keys: tuple = ()) -> DataFrame:
    """Verdict counts, correct rows and their percentage among those with a truth, and the mean seconds of a row."""
    known = F.col(truth).isNotNull()
    out = [F.count("*").alias("total"), F.count_if(F.col(said) == POSITIVE).alias("malware"), F.count_if(F.col(said) == NEGATIVE).alias("benign"), F.count_if(known & (F.col(truth) == F.col(said))).alias("correct"), F.count_if(known).alias("known")]
    out += [F.avg(seconds).alias("mean_seconds")] if seconds else []
    summary = df.groupBy(*keys).agg(*out)
    return summary.withColumn("accuracy_percent", F.coalesce(F.try_divide(F.col("correct") * 100.0, F.col("known")), F.lit(0.0)))


def top_groups(rates: DataFrame, most: int = 15) -> DataFrame:
    """The groups that a report shows: the largest first, then by name."""
    return rates.orderBy(F.desc("total"), "family").limit(most)

"""Sinks (SNK-1..7, SNK-13..17): JSON lines, CSV splits, slice files, dead letters, clean-up, the evaluation report."""

from __future__ import annotations

import re
from pathlib import Path
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cograph.functions import constants as C
from cograph.functions.text import bar
from cograph.sources import stores


def append_predictions(new: DataFrame, path: str, done: DataFrame | None = None, key: str = "sha256") -> None:
    """Appends JSON lines; keys that are in `done` are not written again."""
    rows = new.join(done.select(key), key, "left_anti") if done is not None else new
    rows.write.mode("append").json(path)


def rewrite_predictions(new: DataFrame, path: str, resumed: DataFrame, key: str = "sha256") -> None:
    """The first write of a resumed run: `path` holds the resumed records and the new ones, and nothing else from before.

    Written beside and moved into place, so a run that is lost in between leaves the old records.
    """
    spark, beside = new.sparkSession, f"{path.rstrip('/')}.next"
    fresh = new.join(resumed.select(key), key, "left_anti")
    resumed.unionByName(fresh, allowMissingColumns=True).write.mode("overwrite").json(beside)
    stores.rename(spark, beside, path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_slice_files(files: DataFrame, path: str, key: str = "sha256", content: str = "content", suffix: str = "_cfg.txt") -> int:
    """One file {key}_cfg.txt a row, as `read_slice_files` reads them (or with another suffix); returns their number.

    Tasks write the texts in a folder a key; the driver then only gives the files their names.
    """
    spark, beside = files.sparkSession, f"{path.rstrip('/')}.parts"
    files.select(F.col(key).alias("k"), F.col(content).alias("value")).write.mode("overwrite").partitionBy("k").option("lineSep", "\n").text(beside)
    names = stores.files_below(spark, beside, r"/k=[^/]*/part-")
    for name in names:
        stores.rename(spark, name, f"{path.rstrip('/')}/{unquote(re.search('/k=([^/]*)/part-', name)[1])}{suffix}")
    stores.delete(spark, beside)
    return len(names)


def dead_letters(df: DataFrame, error: str = "error") -> tuple[DataFrame, DataFrame]:
    """(rows without an error, rows with one)."""
    return df.filter(F.col(error).isNull()).drop(error), df.filter(F.col(error).isNotNull())


def write_dead_letters(df: DataFrame, path: str, error: str = "error") -> DataFrame:
    """Writes the rows with an error as JSON lines, a folder for each outcome where there is one; returns the others."""
    good, bad = dead_letters(df, error)
    writer = bad.write.mode("append")
    (writer.partitionBy("outcome") if "outcome" in df.columns else writer).json(path)
    return good


def stale_paths(states: DataFrame) -> DataFrame:
    """What a clean-up would delete."""
    return states.filter(~F.col("fresh")).select("path", "reason")


def delete_stale(states: DataFrame, confirmed: bool = False) -> list[str]:
    """The stale files' paths; they are deleted only if that is `confirmed`. Paths are read one by one, not gathered."""
    spark, out = states.sparkSession, []
    for row in stale_paths(states).orderBy("path").toLocalIterator():
        if not confirmed or stores.delete(spark, row.path):
            out.append(row.path)
    return out


def bars(df: DataFrame, share: str, width: int = 20) -> DataFrame:
    """`df` with `bar`, a picture of a share between 0 and 1, for show()."""
    return df.withColumn("bar", bar(F.col(share), width))


def markdown_report(metrics: DataFrame, families: DataFrame, records: DataFrame, shown: int = 10, compare=C.PUBLISHED) -> str:
    """The evaluation as Markdown. Only aggregates and the first rows shown reach the driver.

    Sections without rows are left out. compare: (name, F1, FPR, FNR) in percent, shown beside this run.
    """
    m = metrics.first().asDict()
    rate = lambda k: f"{m[k] * 100:.2f}%"
    table = lambda head, rows: ["| " + " | ".join(head) + " |", "|" + "---|" * len(head), *("| " + " | ".join(map(str, r)) + " |" for r in rows), ""]
    names = (("Accuracy", "accuracy"), ("Precision", "precision"), ("Recall", "recall"), ("F1", "f1"), ("FPR", "fpr"), ("FNR", "fnr"))
    out = ["# Evaluation", "", *table(("Metric", "Value"), [("Samples", m["total"]), *((name, rate(k)) for name, k in names)])]
    out += table(("", "predicted BENIGN", "predicted MALWARE"), [("BENIGN", m["tn"], m["fp"]), ("MALWARE", m["fn"], m["tp"])])
    rows = families.collect()
    if rows:
        out += ["## Families", "", *table(("Family", "Total", "Detected", "Missed", "Rate"), [(r.family, r.total, r.detected, r.missed, f"{r.detection_rate * 100:.1f}%") for r in rows])]
    for title, truth, said in (("False positives", "BENIGN", "MALWARE"), ("False negatives", "MALWARE", "BENIGN")):
        wrong = records.filter((F.col("ground_truth") == truth) & (F.col("prediction") == said))
        n = wrong.count()
        if n:
            family = F.coalesce("family", F.lit("unknown")) if "family" in records.columns else F.lit("unknown")
            first = wrong.orderBy("sha256").select("sha256", family.alias("family")).limit(shown).collect()
            out += [f"## {title}", "", f"Total: {n}", "", *(f"- `{r.sha256[:32]}`" + (f" (family: {r.family})" if truth == "MALWARE" else "") for r in first)]
            out += [f"- and {n - shown} more"] * (n > shown) + [""]
    if compare:
        out += ["## Comparison", "", *table(("Model", "F1", "FPR", "FNR"), [("**this run**", rate("f1"), rate("fpr"), rate("fnr")), *((name, *(f"{x:.2f}%" for x in rest)) for name, *rest in compare)])]
    return "\n".join(out)


def write_report(text: str, path: str) -> None:
    target = Path(path)
    target.parent.mkdir(parents=True, exist_ok=True)
    target.write_text(text, encoding="utf-8")

"""Label joins, fallbacks and resuming (JOIN-1..6, SET-3)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cograph.operators.rows import keep_first

# Nothing here is broadcast by hint: Spark decides by the size that it knows of a side.


def label_join(files: DataFrame, labels: DataFrame, key: str = "sha256") -> DataFrame:
    return files.join(labels, key)


def label_or_default(rows: DataFrame, labels: DataFrame, key: str = "sha256", **defaults) -> DataFrame:
    """Left join with defaults for the columns of `labels` where nothing was found."""
    out = rows.join(labels, key, "left")
    return out.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in defaults.items()})


def fill_by_priority(rows: DataFrame, tables: list[DataFrame], columns: list[str], key: str = "sha256") -> DataFrame:
    """Missing values of `columns` from the first table that has the key."""
    tagged = [t.select(key, *[F.col(c).alias(f"__{c}") for c in columns]).withColumn("__prio", F.lit(i)) for i, t in enumerate(tables)]
    best = keep_first(reduce(DataFrame.unionByName, tagged), [key], "__prio", *[f"__{c}" for c in columns]).drop("__prio")
    out = rows.join(best, key, "left")
    return out.withColumns({c: F.coalesce(c, f"__{c}") for c in columns}).drop(*[f"__{c}" for c in columns])


def not_done(work: DataFrame, done: DataFrame, key: str = "sha256") -> DataFrame:
    return work.join(done, key, "left_anti")


def with_fallback(work: DataFrame, first: DataFrame, second: DataFrame, value: str, key: str = "sha256") -> DataFrame:
    """`value` from the first table that has the key; null where neither has."""
    return fill_by_priority(work.withColumn(value, F.lit(None).cast(first.schema[value].dataType)), [first, second], [value], key)

"""Order-keeping row operators: keep-first, dedup, offset and limit, top-k (WIN-1..3, WIN-5, WIN-8, WIN-13, WIN-16)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _ranked(df: DataFrame, keys: list, order: list, most: int = 1) -> DataFrame:
    """The first `most` rows of each key; a group limit runs before the shuffle."""
    return df.withColumn("__rank", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter(F.col("__rank") <= most)


def keep_first(df: DataFrame, keys: list, *order) -> DataFrame:
    return _ranked(df, keys, list(order)).drop("__rank")


def keep_last(df: DataFrame, keys: list, *order) -> DataFrame:
    return _ranked(df, keys, [F.desc(o) for o in order]).drop("__rank")


def top_k(df: DataFrame, keys: list, k: int, *order, rank: str = "rank") -> DataFrame:
    return _ranked(df, keys, list(order), k).withColumnRenamed("__rank", rank)


def content_dedup(df: DataFrame, keys: list, text: str, *order) -> DataFrame:
    """The first row of each content (by hash) within `keys`."""
    return keep_first(df, [*keys, F.md5(text)], *order)


def structural_dedup(slices: DataFrame, *order) -> DataFrame:
    """The first slice of each function, API and graph size."""
    return keep_first(slices, ["sha256", "function_name", "suspicious_api", F.size("nodes"), F.size("edges")], *order)


def offset_limit(df: DataFrame, order: str | Column, offset: int = 0, limit: int = 0) -> DataFrame:
    """Rows from `offset` on, at most `limit` (0: all), in the given total order."""
    if not offset and not limit:
        return df
    out = df.orderBy(order)
    out = out.offset(offset) if offset else out
    return out.limit(limit) if limit else out


def dedup_counts(df: DataFrame, keys: list, text: str, keep: Column) -> DataFrame:
    """Rows, distinct contents, and distinct contents that a filter keeps, by key."""
    one = df.groupBy(*keys, F.md5(text).alias("__h")).agg(F.count("*").alias("n"), F.max(keep.cast("int")).alias("k"))
    return one.groupBy(*keys).agg(F.sum("n").alias("n_raw"), F.count("*").alias("n_unique"), F.sum("k").alias("n_kept"))


def balanced_splits(df: DataFrame, label: str, key: str, per_class: int, splits: int, seed: str) -> DataFrame:
    """Disjoint splits with the same number of rows of each class, in a seeded order: `split` from 0."""
    order = F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))
    out = top_k(df.withColumn("__order", order), [label], per_class * splits, "__order", key, rank="__n")
    return out.withColumn("split", F.floor((F.col("__n") - 1) / per_class).cast("int")).drop("__order", "__n")

"""Mixing sources to target weights by capped water-filling, with DataFrame functions only.

Every source has a weight and may be repeated at most `cap` times. The level is found in closed form: with
sources sorted by the level at which each reaches its cap, a source is capped exactly if its own level is not
above the level that the rest would share after all before it are capped. That equals resharing the excess by
weight until none is above its cap.

The words of a source are then taken as whole repetitions of all its documents and one fractional repetition:
documents in the order of a seeded hash until the rest of the target is reached. To find that place without
sorting a hot source in one task, sums are first made by 4,096 hash buckets, then by 4,096 more in the bucket in which
the target falls; only the rows of the last one are sorted.

Defined cases: null text counts as size 0; a null source is a source of its own and comes last; rows with equal
ids are ordered by size and then by their text, so reruns take the same text; rows without an id are ordered by their
text; columns of any name are kept as they are; an empty table gives an empty result; sources without words have target 0.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cograph.llm.common import WORD, table, written

WEIGHTS, SHARE, CAP, SEED = (5, 2, 1), 1.5, 2.0, "mix-1"


def source_targets(sized: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """One row a source: source, source_size, target. The windows run over sources, after all rows are summed."""
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    weighed = totals.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int")))
    everything = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    level = W.orderBy("reach", F.col("source").asc_nulls_last()).rowsBetween(W.unboundedPreceding, -1)
    return (
        weighed.withColumn("most", F.col("source_size") * F.lit(float(cap)))
        .withColumn("reach", F.col("most") / F.col("weight"))
        .withColumn("budget", F.sum("source_size").over(everything) * F.lit(float(share)))
        .withColumn("rest", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(level), F.lit(0.0)))
        .withColumn("capped", F.col("reach") <= (F.col("budget") - F.coalesce(F.sum("most").over(level), F.lit(0.0))) / F.col("rest"))
        .withColumn("used", F.sum(F.when(F.col("capped"), F.col("most")).otherwise(0.0)).over(everything))
        .withColumn("open", F.sum(F.when(F.col("capped"), 0.0).otherwise(F.col("weight"))).over(everything))
        .select("source", "source_size", F.when(F.col("capped"), F.col("most")).otherwise(F.col("weight") * (F.col("budget") - F.col("used")) / F.col("open")).alias("target"))
    )


DIGITS = 3  # hexadecimal digits of the seeded key that name a bucket


def measured(docs: DataFrame, seed: str = SEED, keep: bool = False) -> DataFrame:
    """source, doc_id, size, key (the seeded order) and tie (what orders equal keys); keep: and each row whole, as `row`."""
    text = F.md5(F.coalesce("text", F.lit("")))
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("null:"), text))))
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    whole = [F.struct(*[docs[c] for c in docs.columns]).alias("row")] if keep else []
    return docs.select("source", "doc_id", size.alias("size"), key.alias("key"), F.xxhash64("text").alias("tie"), *whole)


def _same(a, b):
    return F.col(a).eqNullSafe(F.col(b))


def _edges(sized: DataFrame, asked: DataFrame, first: int) -> DataFrame:
    """Where `part` words of a source are reached: asked (source, part, prefix) with the bucket and the words before it.

    The buckets are named by DIGITS digits of the key from `first` on, within the prefix found so far.
    """
    inside = sized.withColumn("prefix", F.substring("key", 1, first - 1)).withColumn("bucket", F.substring("key", 1, first + DIGITS - 1))
    sums = inside.groupBy("source", "prefix", "bucket").agg(F.sum("size").alias("words")).alias("s")
    held = sums.join(asked.alias("a"), _same("s.source", "a.source") & (F.col("s.prefix") == F.col("a.prefix"))).select(F.col("s.source").alias("source"), "bucket", "words", "part", "ahead")
    upto = held.withColumn("upto", F.col("ahead") + F.sum("words").over(W.partitionBy("source").orderBy("bucket")))
    low = F.col("upto") - F.col("words")
    return upto.filter((low < F.col("part")) & (F.col("part") <= F.col("upto"))).select("source", "part", F.col("bucket").alias("prefix"), low.alias("ahead"))


def rulings(sized: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """One row a source: its target, the whole repetitions, and where in the seeded order the fractional one ends."""
    targets, _ = written(source_targets(sized, weights, share, cap), "mix-targets")
    targets = targets.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)).withColumn(
        "part", F.col("target") - F.col("whole") * F.col("source_size")
    )
    start = targets.select("source", "part", F.lit("").alias("prefix"), F.lit(0).cast("long").alias("ahead"))
    edge = _edges(sized, _edges(sized, start, 1), 1 + DIGITS)
    ruled = targets.alias("t").join(edge.alias("e"), _same("t.source", "e.source"), "left")
    return written(ruled.select("t.source", "source_size", "target", "whole", F.col("t.part").alias("part"), F.col("prefix").alias("edge"), F.col("ahead").alias("before")), "mix-rulings")[0]


def repeated(rows: DataFrame, ruled: DataFrame) -> DataFrame:
    """`rows` (measured) with source_size, target and times, how often the mix takes them."""
    bucket = F.substring("key", 1, 2 * DIGITS)
    both = rows.join(ruled.withColumnRenamed("source", "of"), _same("source", "of")).drop("of")
    on_edge = F.coalesce(bucket == F.col("edge"), F.lit(False))
    order = W.partitionBy("source").orderBy("key", "doc_id", "size", "tie").rowsBetween(W.unboundedPreceding, W.currentRow)
    upto = both.filter(on_edge).withColumn("upto", F.col("before") + F.sum("size").over(order))
    edged = upto.withColumn("times", F.col("whole") + (2 * F.col("upto") - F.col("size") <= 2 * F.col("part")).cast("long")).drop("upto")
    clear = both.filter(~on_edge).withColumn("times", F.col("whole") + F.coalesce(bucket < F.col("edge"), F.lit(False)).cast("long"))
    return clear.unionByName(edged)


def _ruled(docs: DataFrame, weights, share: float, cap: float, seed: str) -> tuple[DataFrame, DataFrame]:
    narrow, _ = written(measured(docs, seed), "mix-sizes")
    return narrow, rulings(narrow, weights, share, cap)


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP, seed: str = SEED) -> DataFrame:
    """doc_id, size, source_size, target and taken for every row of `docs` (doc_id, text, source; more are ignored)."""
    narrow, ruled = _ruled(docs, weights, share, cap, seed)
    return repeated(narrow, ruled).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken"))


def mixed_documents(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP, seed: str = SEED) -> DataFrame:
    """The rows of `docs`, each as often as the mix takes it, with all their columns."""
    taken = repeated(measured(docs, seed, keep=True), _ruled(docs, weights, share, cap, seed)[1]).filter("times > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1).cast("long"), "times"))).select("row.*")


def op9_mixing(spark, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


def mixing_sql(docs: str = "documents", seed: str = SEED) -> str:
    return rf"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5('{seed}:' || coalesce(doc_id::VARCHAR, 'null:' || md5(coalesce(text, '')))) AS k FROM {docs}),
totals AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighed AS (SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight FROM totals),
reached AS (SELECT *, source_size * 2.0::DOUBLE AS most, source_size * 2.0::DOUBLE / weight AS reach,
                   (sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE AS budget, sum(weight) OVER () AS all_w FROM weighed),
level AS (SELECT *, reach <= (budget - coalesce(sum(most) OVER w, 0)) / (all_w - coalesce(sum(weight) OVER w, 0)) AS capped FROM reached
          WINDOW w AS (ORDER BY reach, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
target AS (SELECT source, source_size, CASE WHEN capped THEN most ELSE weight * (budget - sum(CASE WHEN capped THEN most ELSE 0 END) OVER ())
                  / sum(CASE WHEN capped THEN 0 ELSE weight END) OVER () END AS target FROM level),
ruled AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole FROM target),
placed AS (SELECT d.doc_id, d.size, r.source_size, r.target, r.whole, r.target - r.whole * r.source_size AS part,
                  sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.doc_id, d.size ROWS UNBOUNDED PRECEDING) AS upto
           FROM sized d JOIN ruled r ON d.source IS NOT DISTINCT FROM r.source)
SELECT doc_id, size, source_size, target,
       (size * (whole + CASE WHEN 2 * upto - size <= 2 * part THEN 1 ELSE 0 END))::BIGINT AS taken FROM placed"""

"""Knowledge-base build and neighbour-vote classification (KB build, VEC-2..8, WIN-7, WIN-8, WIN-11)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cograph.functions import constants as C
from cograph.functions.graph import features, linear_path, with_shape
from cograph.functions.text import query_priority
from cograph.functions.vectors import Embedder, embedding, hybrid
from cograph.operators import neighbours as N
from cograph.operators.rows import structural_dedup, top_k
from cograph.plans.reasoning import cleaned


def with_vectors(slices: DataFrame, embedder: Embedder | None = None, whole: bool = False) -> DataFrame:
    """`slices` with linearized_path and vector (text part and graph part)."""
    graph = features(F.col("nodes"), F.col("edges"), F.col("suspicious_api"), F.col("shape"))
    path = linear_path(F.col("function_name"), F.col("suspicious_api"), F.col("shape"))
    rows = with_shape(slices).withColumn("linearized_path", path).withColumn("graph", graph).drop("shape")
    rows = rows.withColumn("text_part", embedding(F.col("linearized_path"), embedder))
    return rows.withColumn("vector", hybrid(F.col("text_part"), F.col("graph"), whole)).drop("graph", "text_part")


def build_kb(slices: DataFrame, labels: DataFrame, embedder: Embedder | None = None, no_filter: bool = False) -> DataFrame:
    """Rows for the knowledge base from the slices of labelled apps (labels: sha256, label, family)."""
    kept = cleaned(slices.join(labels, "sha256"), no_filter)
    truth = F.when(F.col("label") == 1, "MALWARE").otherwise("BENIGN")
    return with_vectors(kept, embedder).select(
        "sha256", "slice_pos", "function_name", "suspicious_api", truth.alias("ground_truth"), F.coalesce("family", F.lit("unknown")).alias("family"),
        F.substring("raw_text", 1, 500).alias("cfg_preview"), "linearized_path", "vector",
    )


def numbered_kb(kb: DataFrame) -> DataFrame:
    """kb_id (a hash of the key), vector and label, besides the payload."""
    return kb.withColumn("kb_id", F.xxhash64("sha256", "function_name", "suspicious_api", "slice_pos")).withColumn("label", F.col("ground_truth"))


def query_slices(slices: DataFrame, most: int = C.MAX_QUERIES) -> DataFrame:
    """The slices of an app that are asked about: the most telling APIs first, `query_pos` from 1."""
    return top_k(structural_dedup(slices, "slice_pos"), ["sha256"], most, query_priority(F.col("suspicious_api")), "slice_pos", rank="query_pos")


def knn_classify(apps: DataFrame, slices: DataFrame, kb: DataFrame, k: int = C.NEIGHBOURS, threshold: float = C.SIMILARITY, most: int = C.MAX_QUERIES, embedder: Embedder | None = None, exclude_self: bool = False) -> DataFrame:
    """sha256, prediction, confidence, score, votes, top_family, analysis: the neighbours' vote about each app."""
    asked = with_vectors(query_slices(slices, most), embedder, whole=True).withColumn("query_id", F.xxhash64("sha256", "slice_pos"))
    base = numbered_kb(kb)
    hits = N.nearest(asked.select("query_id", "vector"), base.select("kb_id", "vector", "label"), k)
    payload = base.select("kb_id", "family", F.col("sha256").alias("kb_sha"), F.col("function_name").alias("kb_function"))
    full = hits.join(asked.select("query_id", "sha256", "query_pos", "function_name", "suspicious_api"), "query_id").join(payload, "kb_id")
    full = full.filter(F.col("kb_sha") != F.col("sha256")) if exclude_self else full
    voted = N.votes(full, "sha256", threshold)
    family = N.top_group(full.withColumn("place", F.col("query_pos") * 1000 + F.col("rank")), "sha256", "family", threshold, order="place")
    told = top_k(full.filter(F.col("score") >= threshold), ["sha256"], 8, F.desc("score"), "query_pos", "rank", rank="n")
    line = F.concat(F.lit("  - ["), "label", F.lit(" | "), "family", F.lit("] "), F.format_number("score", 3), F.lit(" "), "function_name", F.lit(" ("), "suspicious_api", F.lit(")"))
    told = told.groupBy("sha256").agg(F.array_sort(F.collect_list(F.struct("n", line.alias("line")))).alias("lines"))
    out = apps.select("sha256").join(voted, "sha256", "left").join(family, "sha256", "left").join(told, "sha256", "left")
    with_slices = slices.select("sha256").distinct().withColumn("had", F.lit(True))
    out = out.join(with_slices, "sha256", "left")
    ratio = F.coalesce("score", F.lit(0.0))
    sure = F.when(F.col("had").isNull(), "LOW").otherwise(N.vote_confidence(ratio))
    counted = lambda c: F.coalesce(c, F.lit(0)).cast("int")
    text = F.when(F.col("had").isNull(), "No suspicious API slices found. Classified as BENIGN.").otherwise(
        F.concat(
            F.lit("PREDICTION: "), N.vote_verdict(ratio), F.lit("\nCONFIDENCE: "), sure, F.lit("\nVOTES: "), counted("malware_votes").cast("string"), F.lit(" MALWARE, "), counted("benign_votes").cast("string"),
            F.lit(" BENIGN\nTOP_FAMILY: "), F.coalesce("top_family", F.lit("unknown")), F.lit("\n"), F.coalesce(F.array_join(F.transform("lines", lambda x: x["line"]), "\n"), F.lit("")),
        )
    )
    none = F.when(F.col("had").isNull(), "none").otherwise("unknown")
    return out.select(
        "sha256", N.vote_verdict(ratio).alias("prediction"), sure.alias("confidence"), F.round(ratio, 3).alias("score"),
        counted("malware_votes").alias("malware_votes"), counted("benign_votes").alias("benign_votes"), F.coalesce("top_family", none).alias("top_family"), text.alias("analysis"),
    )


def stratified_hits(slices: DataFrame, kb: DataFrame, per_label: int = 3, sample: int | None = None, most: int = 10, embedder: Embedder | None = None) -> DataFrame:
    """The context hits of each app: per query the best of each label, each stored function claimed once an app.

    sample: look among that many nearest first (as a label-blind index would), and let later hits fill up.
    """
    first = top_k(slices, ["sha256"], most, "slice_pos", rank="query_pos")
    asked = with_vectors(first, embedder, whole=True).withColumn("query_id", F.xxhash64("sha256", "slice_pos"))
    base = numbered_kb(kb)
    names = base.select("kb_id", F.concat_ws(":", "sha256", "function_name").alias("claim"))
    near = N.nearest(asked.select("query_id", "vector"), base.select("kb_id", "vector", "label"), sample or per_label, by_label=sample is None)
    rows = near.join(asked.select("query_id", "sha256", "query_pos", F.col("function_name").alias("query_function")), "query_id").join(names, "kb_id")
    rows = rows.withColumn("label_order", F.when(F.col("label") == "MALWARE", 0).otherwise(1))
    kept = N.claim(rows, "sha256", ["query_pos", "label_order", "rank"], "claim", ["query_pos", "label"], per_label)
    payload = base.drop("vector", "label", "sha256", "slice_pos")
    return kept.join(payload, "kb_id")

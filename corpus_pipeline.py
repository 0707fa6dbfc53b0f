"""From documents to token files in five stages; each stage gets what its predecessor kept.

Languages that the byte network does not recognise go; one document of each group of near
copies (SimHash candidates, five-word Jaccard of 0.8 or more) stays; documents that hold
a benchmark item go; sources are repeated to their target weights; the token ids of what is left are written.
Stages but the last return the columns of their input, extra ones of any name included. The tables in between are Parquet
in the shared folder; each goes when the next one is written.

Defined cases: documents without text or without a letter are in no language and go at the first stage; of repeated
rows and exact copies one stays, by the smallest doc_id (null last), ties by a hash of the row; a null source is a
source of its own; very long texts are judged whole; empty tables pass through all stages as empty tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cograph.llm import contamination, language, mixing, nearcopies, tokens
from cograph.llm.common import remove, table, written


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language.recognised(docs, language.trained(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return nearcopies.one_of_similar(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return contamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return tokens.encode_documents(spark, docs, tokens.default_tokenizer())


STAGES = [
    ("language ID", language_id),
    ("SimHash near-dedup", near_dedup),
    ("benchmark decontamination", decontaminate),
    ("mixing sources to target weights", mix_sources),
    ("token-ID output", token_output),
]

#: The network and the fingerprints can't be said in SQL; the stages are tested against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, path = table(spark, sf_dir, "documents"), None
    for place, (name, stage) in enumerate(STAGES):
        docs, before = stage(spark, docs, sf_dir), path
        if place < len(STAGES) - 1:
            docs, path = written(docs, f"pipeline-{place}")
        remove(spark, *([before] if before else []))
    return docs

"""The tiered and the single-call analyses (LLM-6..13): Spark prepares prompts and reads answers, a model answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cograph.functions import constants as C
from cograph.functions import responses as R
from cograph.functions.text import api_type, cut, numbered, outside_framework
from cograph.operators.calls import grouped_document
from cograph.operators.rows import content_dedup, top_k
from cograph.plans import models as M


def cleaned(slices: DataFrame, no_filter: bool = False) -> DataFrame:
    """First slice of each content in an app; framework code only where it calls something always looked at."""
    rows = content_dedup(slices, ["sha256"], "raw_text", "slice_pos")
    return rows if no_filter else rows.filter(outside_framework(F.col("function_name"), F.col("suspicious_api")))


def fill(template: str, **values: Column) -> Column:
    """A template's fields replaced by columns."""
    out, rest = [], template
    while "{" in rest:
        before, _, tail = rest.partition("{")
        name, _, rest = tail.partition("}")
        out += [F.lit(before), F.coalesce(values[name].cast("string"), F.lit(""))]
    return F.concat(*out, F.lit(rest))


def tier1(slices: DataFrame, model: M.Model, verify: bool = False) -> DataFrame:
    """One answer a slice; with `verify`, what is not sane or not consistent is asked once more and taken as it comes."""
    prompt = fill(M.TIER1[1], function=F.col("function_name"), api=F.col("suspicious_api"), body=cut(F.col("raw_text"), 6000))
    rows = slices.select("sha256", "slice_pos", "function_name", "suspicious_api", "raw_text", prompt.alias("prompt"))
    said = M.ask(rows, model, M.TIER1[0])
    if verify:
        check = fill(M.VERIFY[1], body=cut(F.col("raw_text"), 4000), summary=F.col("summary"))
        sane = R.sanity(F.col("response"), F.col("suspicious_api")) == "OK"
        first = said.filter("error IS NULL").withColumn("sane", sane)
        checked = M.ask(first.filter("sane").withColumnsRenamed({"response": "summary", "error": "e"}).withColumn("prompt2", check), model, M.VERIFY[0], "prompt2")
        good = checked.filter(R.consistency(F.col("response"))["consistent"]).select("sha256", "slice_pos")
        again = M.ask(rows.join(good, ["sha256", "slice_pos"], "left_anti"), model, M.TIER1[0])
        said = said.join(good, ["sha256", "slice_pos"], "left_semi").unionByName(again)
    return said.withColumn("risk_level", R.risk(F.col("response"), 1)).drop("prompt", "raw_text")


def tier2(first: DataFrame, model: M.Model) -> DataFrame:
    """One answer an API of an app, from its functions' answers in order."""
    group = first.filter("response IS NOT NULL").groupBy("sha256", "suspicious_api").agg(F.array_sort(F.collect_list(F.struct("slice_pos", "response"))).alias("s"), F.min("slice_pos").alias("first_seen"))
    text = numbered(F.transform("s", lambda x: x["response"]), "Function ")
    kind = api_type(F.col("suspicious_api"))
    prompt = fill(M.TIER2[1], api=F.col("suspicious_api"), api_type=kind, summaries=text)
    said = M.ask(group.select("sha256", "suspicious_api", "first_seen", kind.alias("api_type"), prompt.alias("prompt")), model, M.TIER2[0])
    return said.withColumn("risk_level", R.risk(F.col("response"), 2)).drop("prompt")


def tier3(second: DataFrame, model: M.Model) -> DataFrame:
    """One verdict an app."""
    line = F.struct("first_seen", F.concat(F.lit("["), "suspicious_api", F.lit(" | "), "api_type", F.lit("]\n"), "response").alias("text"))
    apps = second.filter("response IS NOT NULL").groupBy("sha256").agg(F.array_sort(F.collect_list(line)).alias("s"))
    prompt = fill(M.TIER3[1], summaries=numbered(F.transform("s", lambda x: x["text"]), "API "))
    said = M.ask(apps.select("sha256", prompt.alias("prompt")), model, M.TIER3[0])
    return said.select("sha256", F.when(F.col("error").isNull(), R.final_verdict(F.col("response"))).alias("prediction"), F.col("response").alias("analysis"), "error")


def three_tiers(apps: DataFrame, slices: DataFrame, model: M.Model, verify: bool = False, no_filter: bool = False) -> DataFrame:
    """sha256, prediction, analysis for each app; those without usable slices or answers are benign, with the reason."""
    kept = cleaned(slices, no_filter)
    second = tier2(tier1(kept, model, verify), model)
    said = tier3(second, model)
    had = slices.select("sha256").distinct().withColumn("had", F.lit(True))
    out = apps.select("sha256").join(said, "sha256", "left").join(had, "sha256", "left")
    why = F.when(F.col("had").isNull(), "No suspicious APIs found.").otherwise("No function could be analysed.")
    return out.filter("error IS NULL").select("sha256", F.coalesce("prediction", F.lit("BENIGN")).alias("prediction"), F.coalesce("analysis", why).alias("analysis"))


def retrieval_context(hits: DataFrame, most: int = 6) -> DataFrame:
    """sha256, context: the best hits of an app's functions (score, ground_truth, family, function_name, ...)."""
    best = top_k(hits, ["sha256"], most, F.desc("score"), "kb_id", rank="n")
    line = F.concat(
        F.lit("Match "), F.col("n").cast("string"), F.lit(" (similarity "), F.format_number("score", 3), F.lit(") for "), "query_function", F.lit("\n  "),
        "ground_truth", F.lit(" | "), F.coalesce("family", F.lit("unknown")), F.lit(" | "), "function_name", F.lit(" | "), "suspicious_api", F.lit("\n  "), F.coalesce("linearized_path", F.lit("")),
        F.lit("\n  "), F.substring(F.coalesce("cfg_preview", F.lit("")), 1, 300),
    )
    told = best.groupBy("sha256").agg(
        F.array_sort(F.collect_list(F.struct("n", line.alias("line")))).alias("s"), F.count_if(F.col("ground_truth") == "MALWARE").alias("bad"), F.count_if(F.col("ground_truth") == "BENIGN").alias("good")
    )
    head = F.concat(F.lit("["), F.col("bad").cast("string"), F.lit(" MALWARE, "), F.col("good").cast("string"), F.lit(" BENIGN]\n\n"))
    return told.select("sha256", F.concat(head, F.array_join(F.transform("s", lambda x: x["line"]), "\n\n")).alias("context"))


def retrieved(slices: DataFrame, kb: DataFrame, **options) -> DataFrame:
    """sha256, context: what the knowledge base holds that is like an app's functions (options: of `stratified_hits`)."""
    from cograph.plans.retrieval import stratified_hits  # the retrieval plans use the cleaning above

    return retrieval_context(stratified_hits(slices, kb, **options))


def single_call(apps: DataFrame, slices: DataFrame, model: M.Model, context: DataFrame | None = None, no_filter: bool = False, kb: DataFrame | None = None) -> DataFrame:
    """sha256, prediction, confidence, analysis, error: all packed functions of an app in one prompt.

    context: sha256 and what is told about similar functions; kb: a knowledge base to find them in instead.
    """
    kept = cleaned(slices, no_filter)
    context = retrieved(kept, kb) if kb is not None and context is None else context
    budget = max(C.LEAST_BUDGET, model.budget - C.PROMPT_OVERHEAD)
    docs = grouped_document(kept, budget)
    docs = docs.join(context, "sha256", "left") if context is not None else docs.withColumn("context", F.lit(None).cast("string"))
    prompt = fill(M.SINGLE[1], context=F.coalesce("context", F.lit("none found")), count=F.col("n_functions"), apis=F.array_join("apis", ", "), document=F.col("document"))
    said = M.ask(docs.select("sha256", prompt.alias("prompt")), model, M.SINGLE[0])
    verdict = F.when(F.col("error").isNull(), R.final_verdict(F.col("response")))
    answered = said.select("sha256", verdict.alias("prediction"), F.when(F.col("error").isNull(), R.confidence(F.col("response"), verdict)).alias("confidence"), F.col("response").alias("analysis"), "error")
    return _with_defaults(apps, slices, kept, answered)


def _with_defaults(apps: DataFrame, slices: DataFrame, kept: DataFrame, answered: DataFrame) -> DataFrame:
    had = slices.select("sha256").distinct().withColumn("had", F.lit(True))
    out = apps.select("sha256").join(answered, "sha256", "left").join(had, "sha256", "left")
    why = F.when(F.col("had").isNull(), "No suspicious APIs found.").otherwise("All functions were framework code.")
    plain = F.col("error").isNull()
    return out.select(
        "sha256",
        F.when(plain, F.coalesce("prediction", F.lit("BENIGN"))).alias("prediction"),
        F.when(plain, F.coalesce("confidence", F.lit("UNKNOWN"))).alias("confidence"),
        F.when(plain, F.coalesce("analysis", why)).alias("analysis"),
        "error",
    )


def direct(files: DataFrame, model: M.Model, first: int = 1500) -> DataFrame:
    """sha256, prediction, analysis from the first characters of a slice file."""
    said = M.ask(files.select("sha256", fill(M.DIRECT[1], document=cut(F.col("content"), first)).alias("prompt")), model, M.DIRECT[0])
    return said.filter("error IS NULL").select("sha256", R.final_verdict(F.col("response")).alias("prediction"), F.col("response").alias("analysis"))

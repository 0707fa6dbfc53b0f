"""Call graph between slices, API groups and budget packing (JOIN-7, GRF-7/8, WIN-9, WIN-12, WIN-15, AGG-7)."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cograph.functions import constants as C
from cograph.functions.text import class_of, cut, high_risk, simple_name, strip, token_estimate


def invocations(slices: DataFrame) -> DataFrame:
    """sha256, caller, callee_class, method and signature of every call in the slices' statements."""
    node = slices.select("sha256", F.col("function_name").alias("caller"), F.explode("nodes").alias("node"))
    part = lambda i: F.transform(F.regexp_extract_all("node", F.lit(C.CALL), F.lit(i)), strip)
    pairs = node.filter(F.col("node").contains("invoke")).select("sha256", "caller", F.explode(F.arrays_zip(part(1).alias("callee_class"), part(3).alias("method"))).alias("c"))
    return pairs.select("sha256", "caller", "c.callee_class", "c.method", F.concat_ws(".", "c.callee_class", "c.method").alias("signature")).distinct()


def call_edges(slices: DataFrame) -> DataFrame:
    """Distinct (sha256, caller, callee): a call of a slice's full name, else of its class and simple name."""
    calls = invocations(slices)
    names = slices.select("sha256", F.col("function_name").alias("callee")).distinct()
    exact = calls.join(names.withColumn("signature", F.col("callee")), ["sha256", "signature"]).select("sha256", "caller", "callee")
    rest = calls.join(names.withColumnRenamed("callee", "signature"), ["sha256", "signature"], "left_anti")
    by_class = names.withColumn("callee_class", class_of(F.col("callee"))).withColumn("last", simple_name(F.col("callee")))
    near = rest.withColumn("last", simple_name(F.col("method"))).join(by_class, ["sha256", "callee_class", "last"])
    near = near.filter(F.col("callee").endswith(F.concat(F.lit("."), F.col("method"))))
    return exact.unionByName(near.select("sha256", "caller", "callee")).distinct()


def neighbours(edges: DataFrame) -> DataFrame:
    """sha256, function_name, callers, callees: both directions in one aggregation."""
    both = edges.select("sha256", F.col("callee").alias("function_name"), F.col("caller").alias("by"), F.lit(None).cast("string").alias("to")).unionByName(
        edges.select("sha256", F.col("caller").alias("function_name"), F.lit(None).cast("string").alias("by"), F.col("callee").alias("to"))
    )
    return both.groupBy("sha256", "function_name").agg(F.array_sort(F.collect_set("by")).alias("callers"), F.array_sort(F.collect_set("to")).alias("callees"))


def group_order(rows: DataFrame, app: str, group: str, position: str, risky: Column) -> DataFrame:
    """app, group, size, group_rank: risky groups first, then larger ones, then the first seen."""
    sized = rows.groupBy(app, group).agg(F.count("*").alias("size"), F.min(position).alias("first_seen"))
    order = W.partitionBy(app).orderBy(F.desc(risky.cast("int")), F.desc("size"), "first_seen")
    return sized.withColumn("group_rank", F.row_number().over(order)).select(app, group, "size", "group_rank")


def pack(rows: DataFrame, app: str, group_rank: str, position: str, name: str, cost: str, budget: int | str) -> DataFrame:
    """The rows that fit an app's budget: names packed before are passed over, the first row that does not fit ends its
    group, and a full budget ends the app.

    Sequential by nature: sorted partitions are streamed; the names of one app in memory are bounded by its budget.
    """
    bound = budget if isinstance(budget, str) else None
    columns = rows.columns
    at = {c: columns.index(c) for c in (app, group_rank, name, cost, *([bound] if bound else []))}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, group, shut, used, names = None, None, False, 0, set()
        for batch in batches:
            got = {c: batch.column(i).to_pylist() for c, i in at.items()}
            stay = []
            for r in range(batch.num_rows):
                if got[app][r] != now:
                    now, group, used, names = got[app][r], None, 0, set()
                most = got[bound][r] if bound else budget
                if got[group_rank][r] != group:
                    group, shut = got[group_rank][r], used >= most
                if shut or got[name][r] in names:
                    continue
                if used + got[cost][r] > most:
                    shut = True
                    continue
                used += got[cost][r]
                names.add(got[name][r])
                stay.append(r)
            if stay:
                yield batch.take(pa.array(stay))

    return rows.repartition(app).sortWithinPartitions(app, group_rank, position).mapInArrow(run, rows.schema)


def function_block(slices: DataFrame) -> DataFrame:
    """`slices` with callers and callees, `block` (how a function is shown) and `cost` (its tokens)."""
    around = neighbours(call_edges(slices))
    rows = slices.join(around, ["sha256", "function_name"], "left")
    listed = lambda label, c: F.when(F.size(F.coalesce(c, F.array().cast("array<string>"))) > 0, F.concat(F.lit(label), F.array_join(c, ", "), F.lit("\n"))).otherwise("")
    body = cut(F.array_join(F.concat("nodes", "edges"), "\n"), 8000)
    block = F.concat(
        F.lit("--- FUNCTION: "), "function_name", F.lit(" ---\nSUSPICIOUS_API: "), "suspicious_api", F.lit("\n"),
        listed("CALLED_BY: ", F.col("callers")), listed("CALLS: ", F.col("callees")), body, F.lit("\n--- END FUNCTION ---\n"),
    )
    return rows.withColumn("block", block).withColumn("cost", token_estimate(F.col("block")))


def chains(rows: DataFrame, most: int = 10) -> DataFrame:
    """sha256, suspicious_api, chains: the first `most` distinct call chains of a group, sorted."""
    empty = F.array().cast("array<string>")
    here = F.concat("function_name", F.lit(" (invokes "), "suspicious_api", F.lit(")"))
    inward = F.transform(F.coalesce("callers", empty), lambda c: F.concat(F.lit("  [CALL CHAIN] "), c, F.lit(" --> "), here))
    outward = F.transform(F.coalesce("callees", empty), lambda c: F.concat(F.lit("  [CALL CHAIN] "), here, F.lit(" --> "), c))
    lines = rows.select("sha256", "suspicious_api", F.explode(F.concat(inward, outward)).alias("line")).distinct()
    first = lines.withColumn("n", F.row_number().over(W.partitionBy("sha256", "suspicious_api").orderBy("line"))).filter(F.col("n") <= most)
    return first.groupBy("sha256", "suspicious_api").agg(F.array_sort(F.collect_list("line")).alias("chains"))


def grouped_document(slices: DataFrame, budget: int | str) -> DataFrame:
    """sha256, document, n_functions, apis: the packed functions by API group, with the groups' call chains."""
    rows = function_block(slices)
    ranked = rows.join(group_order(slices, "sha256", "suspicious_api", "slice_pos", high_risk(F.col("suspicious_api"))), ["sha256", "suspicious_api"])
    kept = pack(ranked, "sha256", "group_rank", "slice_pos", "function_name", "cost", budget)
    bodies = kept.groupBy("sha256", "suspicious_api", "group_rank", "size").agg(F.array_sort(F.collect_list(F.struct("slice_pos", "block"))).alias("b"))
    headed = bodies.join(chains(rows), ["sha256", "suspicious_api"], "left")
    header = F.concat(
        F.lit("=== API GROUP "), F.col("group_rank").cast("string"), F.lit(": "), "suspicious_api", F.lit(" ("), F.col("size").cast("string"), F.lit(" function(s)) ===\n"),
        F.coalesce(F.array_join("chains", "\n"), F.lit("  (no calls between these functions)")), F.lit("\n"),
    )
    text = headed.withColumn("text", F.concat(header, F.array_join(F.transform("b", lambda x: x["block"]), "\n")))
    ordered = text.groupBy("sha256").agg(F.array_sort(F.collect_list(F.struct("group_rank", "text", "suspicious_api"))).alias("g"), F.sum(F.size("b")).alias("n_functions"))
    return ordered.select("sha256", F.array_join(F.transform("g", lambda x: x["text"]), "\n").alias("document"), "n_functions", F.transform("g", lambda x: x["suspicious_api"]).alias("apis"))

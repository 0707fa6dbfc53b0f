"""Instruction tables (SRC-20, JOIN-10): what a bytecode front end leaves for slicing, as JSON lines, one a method.

A front end (any tool that turns an app's bytecode into statements) writes a file an app with a line a method:
`{"class": ..., "name": ..., "concrete": true, "units": [{"text": ..., "kind": ..., "defines": "$r0", "uses": [...],
"next": [...], "callee_class": ..., "callee_name": ..., "arguments": [...], "base": ...}, ...]}`; `next` are the places
of the units that may follow, handlers included. Files of the same app (several code archives) are one app; methods
of framework packages and methods that a file before already had are passed over. Definitions that reach a use are
computed here.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cograph.functions import constants as C
from cograph.functions.text import either
from cograph.operators.rows import keep_first

UNIT = "struct<text:string,kind:string,defines:string,uses:array<string>,next:array<bigint>,callee_class:string,callee_name:string,arguments:array<string>,base:string>"
METHOD = f"class string, name string, concrete boolean, units array<{UNIT}>"


def read_methods(spark: SparkSession, path: str, no_filter: bool = False) -> DataFrame:
    """sha256, method_id, class, name, concrete and units of all apps' methods; the app's key is what stands before the file name's first dot."""
    files = spark.read.schema(METHOD).option("mode", "DROPMALFORMED").json(path)
    rows = files.select(F.lower(F.substring_index(F.col("_metadata.file_name"), ".", 1)).alias("sha256"), F.col("_metadata.file_name").alias("file"), "*").filter("class IS NOT NULL AND name IS NOT NULL")
    own = rows if no_filter else rows.filter(~F.col("class").rlike("^" + either(C.FRAMEWORK_PREFIXES)))
    signature = F.xxhash64("sha256", "class", "name", F.transform("units", lambda u: u["text"]))
    return keep_first(own.withColumn("method_id", signature), ["method_id"], "file").drop("file")



def tables(methods: DataFrame) -> dict[str, DataFrame]:
    """The tables that `operators.slicing` takes: methods, units, uses, reaching_defs and cfg_edges, with ordinals."""
    each = methods.select("method_id", F.posexplode("units").alias("unit_id", "u"))
    units = each.select("method_id", F.col("unit_id").cast("long").alias("unit_id"), F.col("unit_id").alias("pos"), "u.kind", "u.text", "u.callee_class", "u.callee_name", F.col("u.arguments").alias("arg_locals"), F.col("u.base").alias("base_local"))
    uses = each.select("method_id", F.col("unit_id").cast("long").alias("unit_id"), F.posexplode("u.uses").alias("ordinal", "local"))
    edges = each.select("method_id", F.col("unit_id").cast("long").alias("src"), F.explode("u.next").alias("dst"))
    edges = edges.withColumn("ordinal", F.col("src"))
    return {"methods": methods.select("method_id", "class", "name", "concrete", "sha256"), "units": units, "uses": uses, "reaching_defs": reaching(methods), "cfg_edges": edges}


def reaching_of(defines: list[str | None], following: list[list[int]], uses: list[list[str]]) -> list[tuple[int, str, int]]:
    """(unit, local, unit that defines it) of every definition that reaches a use, by sets of definitions as bits."""
    n = len(defines)
    kill: dict[str, int] = {}
    for i, local in enumerate(defines):
        if local is not None:
            kill[local] = kill.get(local, 0) | 1 << i
    into, todo, queued = [0] * n, list(range(n - 1, -1, -1)), [True] * n
    while todo:
        i = todo.pop()
        queued[i] = False
        out = into[i] & ~kill[defines[i]] | 1 << i if defines[i] is not None else into[i]
        for j in following[i]:
            if 0 <= j < n and into[j] | out != into[j]:
                into[j] |= out
                if not queued[j]:
                    queued[j] = True
                    todo.append(j)
    found = []
    for i, names in enumerate(uses):
        for local in dict.fromkeys(names):
            reach, at = into[i] & kill.get(local, 0), 0
            while reach:
                at = (reach & -reach).bit_length() - 1
                found.append((i, local, at))
                reach &= reach - 1
    return found


def reaching(methods: DataFrame) -> DataFrame:
    """method_id, unit_id, local, def_unit_id, ordinal: a row a use and definition that reaches it. One method at a time is in memory."""

    def run(batches):
        for batch in batches:
            rows = []
            for method, units in zip(batch["method_id"], batch["units"]):
                units = list(units) if units is not None else []
                listed = lambda x: [] if x is None else list(np.asarray(x).tolist())
                found = reaching_of([u["defines"] for u in units], [listed(u["next"]) for u in units], [listed(u["uses"]) for u in units])
                rows += [(method, i, local, d, d) for i, local, d in found]
            yield pd.DataFrame(rows, columns=["method_id", "unit_id", "local", "def_unit_id", "ordinal"])

    return methods.select("method_id", "units").mapInPandas(run, "method_id long, unit_id long, local string, def_unit_id long, ordinal long")

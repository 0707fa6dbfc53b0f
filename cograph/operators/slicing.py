"""Backward slicing over instruction tables (SLC-1..8, JOIN-10/11, FLT-15/16).

methods(method_id, class, name, concrete) · units(method_id, unit_id, pos, kind, text, callee_class, callee_name,
arg_locals, base_local) · uses(method_id, unit_id, local) · reaching_defs(method_id, unit_id, local, def_unit_id) ·
cfg_edges(method_id, src, dst)

Which units a slice holds depends on the order of a unit's uses, of a use's definitions and of a unit's predecessors.
The last three tables may have an `ordinal` column that gives it; without one, names and numbers do.
"""

from __future__ import annotations

from collections import defaultdict, deque

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cograph.functions.text import is_seed
from cograph.sources.slices import slice_text


def criteria(methods: DataFrame, units: DataFrame) -> DataFrame:
    """criterion_id, method_id, unit_id, callee_name, locals: each sensitive call in a concrete method, and what it uses."""
    calls = units.filter(F.col("callee_name").isNotNull() & F.col("callee_class").isNotNull()).filter(is_seed(F.col("callee_class"), F.col("callee_name")))
    found = calls.join(methods.filter("concrete").select("method_id"), "method_id", "left_semi")
    base = F.when(F.col("base_local").isNotNull(), F.array("base_local")).otherwise(F.array().cast("array<string>"))
    used = F.array_union(F.coalesce("arg_locals", F.array().cast("array<string>")), base)
    return found.select(F.concat_ws(":", F.col("method_id").cast("string"), F.col("unit_id").cast("string")).alias("criterion_id"), "method_id", "unit_id", "callee_name", used.alias("locals"))


def backward(seed: int, seed_locals, uses: dict, defs: dict, branches: dict) -> list[int]:
    """Units of one slice in the order found.

    A queue in order of discovery: a unit's uses are taken one by one, and the definitions of those that matter by
    then are followed. What a new definition uses matters from then on for the whole slice, the rest of the same
    unit's uses included; each unit is expanded once.
    """
    matter, seen, queue = set(seed_locals), {seed: None}, deque([seed])

    def reach(unit: int) -> bool:
        fresh = unit not in seen
        if fresh:
            seen[unit] = None
            queue.append(unit)
        return fresh

    while queue:
        unit = queue.popleft()
        for local in uses.get(unit, ()):
            for d in defs.get((unit, local), ()) if local in matter else ():
                if reach(d):
                    matter.update(uses.get(d, ()))
        for p in branches.get(unit, ()):
            reach(p)
    return list(seen)


def slice_units(criteria_: DataFrame, units: DataFrame, uses: DataFrame, reaching_defs: DataFrame, cfg_edges: DataFrame) -> DataFrame:
    """criterion_id, unit_id, error: one task holds one method's tables, which are small; a failure stays with its slice."""
    jumps = units.filter(F.col("kind").isin("if", "goto")).select("method_id", F.col("unit_id").alias("src"))

    def fact(table: DataFrame, kind: str, a: str, local: str | None, b: str | None) -> DataFrame:
        order = F.col("ordinal").cast("long") if "ordinal" in table.columns else F.lit(0).cast("long")
        name = F.col(local) if local else F.lit(None).cast("string")
        to = F.col(b).cast("long") if b else F.lit(None).cast("long")
        return table.select("method_id", F.lit(kind).alias("fact"), F.col(a).alias("a"), order.alias("ordinal"), name.alias("local"), to.alias("b"))

    facts = (
        fact(uses, "use", "unit_id", "local", None)
        .unionByName(fact(reaching_defs, "def", "unit_id", "local", "def_unit_id"))
        .unionByName(fact(cfg_edges.join(jumps, ["method_id", "src"], "left_semi"), "branch", "dst", None, "src"))
    )
    facts = facts.join(criteria_.select("method_id").distinct(), "method_id", "left_semi").withColumnRenamed("method_id", "of_method")

    def run(key, seeds: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        use, defs, branches = defaultdict(list), defaultdict(list), defaultdict(list)
        for kind, a, _, local, b in rows.sort_values(["fact", "a", "ordinal", "local", "b"])[["fact", "a", "ordinal", "local", "b"]].itertuples(index=False, name=None):
            if kind == "use":
                use[a].append(local)
            elif kind == "def":
                defs[a, local].append(int(b))
            else:
                branches[a].append(int(b))
        out = []
        for s in seeds.itertuples(index=False):
            try:
                out += [(s.criterion_id, s.method_id, int(u), None) for u in backward(int(s.unit_id), list(s.locals), use, defs, branches)]
            except Exception as error:  # one slice's fault is its own
                out.append((s.criterion_id, s.method_id, None, str(error)))
        return pd.DataFrame(out, columns=["criterion_id", "method_id", "unit_id", "error"])

    return criteria_.groupBy("method_id").cogroup(facts.groupBy("of_method")).applyInPandas(run, "criterion_id string, method_id long, unit_id long, error string")


def numbered(sliced: DataFrame, units: DataFrame) -> DataFrame:
    """criterion_id, unit_id, node (from 1, in program order) and text."""
    rows = sliced.filter("error IS NULL").join(units.select("method_id", "unit_id", "pos", "text"), ["method_id", "unit_id"])
    return rows.withColumn("node", F.row_number().over(W.partitionBy("criterion_id").orderBy("pos"))).select("criterion_id", "method_id", "unit_id", "node", "text")


def induced_edges(nodes: DataFrame, edges: DataFrame, group: str = "criterion_id", keys: tuple = ("method_id",)) -> DataFrame:
    """(group, src node, dst node) of the edges with both ends among a group's nodes."""
    a = nodes.select(group, *keys, F.col("unit_id").alias("src"), F.col("node").alias("src_node"))
    b = nodes.select(group, *keys, F.col("unit_id").alias("dst"), F.col("node").alias("dst_node"))
    return edges.join(a, [*keys, "src"]).join(b, [group, *keys, "dst"]).select(group, "src_node", "dst_node")


def serialise(criteria_: DataFrame, methods: DataFrame, nodes: DataFrame, edges: DataFrame, app: str = "sha256") -> DataFrame:
    """Slice files (app, content) of all criteria; `methods` has the app's key."""
    named = criteria_.join(methods.select("method_id", app, F.concat_ws(".", "class", "name").alias("function")), "method_id")
    order = W.partitionBy(app).orderBy("method_id", "unit_id")
    head = named.withColumn("block_pos", F.row_number().over(order)).select("criterion_id", app, "block_pos", "function", "callee_name")
    line = lambda df, group, text, *more: df.select(app, "block_pos", F.struct(F.lit(group).alias("g"), *[F.col(c).cast("long").alias(f"o{i}") for i, c in enumerate(more)]).alias("line_pos"), text.alias("line"))
    flat = head.withColumns({"z": F.lit(0), "y": F.lit(0)})
    n = head.join(nodes, "criterion_id").withColumn("y", F.lit(0))
    lines = (
        line(flat, 0, F.concat(F.lit("=== FUNCTION: "), "function", F.lit(" ===")), "z", "y")
        .unionByName(line(flat, 1, F.concat(F.lit("SUSPICIOUS_API: "), "callee_name"), "z", "y"))
        .unionByName(line(n, 2, F.concat(F.lit("NODE "), F.col("node").cast("string"), F.lit(": "), "text"), "node", "y"))
        .unionByName(line(head.join(edges, "criterion_id"), 3, F.concat(F.lit("EDGE: "), F.col("src_node").cast("string"), F.lit(" -> "), F.col("dst_node").cast("string")), "src_node", "dst_node"))
        .unionByName(line(flat, 4, F.lit("=== END FUNCTION ==="), "z", "y"))
    )
    return slice_text(lines, [app])

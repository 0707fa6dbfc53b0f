"""Features of a slice's control-flow graph and its linear path (GRF-1..6, AGG-9/10)."""

from __future__ import annotations

import re
from collections import deque
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cograph.functions import constants as C
from cograph.functions.text import category, log_norm
from cograph.functions.vectors import one_hot

EDGE, NODE = r"EDGE:\s*(\d+)\s*->\s*(\d+)", r"^NODE\s+(\d+):"
TYPES = (*C.STATEMENT_TYPES, "other")
DEEPEST = 30  # the path feature saturates there


def edges_of(lines: Column) -> Column:
    """array<struct<src, dst>> of the edge lines that can be read; duplicates stay."""
    read = F.filter(lines, lambda e: e.rlike(EDGE))
    return F.transform(read, lambda e: F.struct(F.regexp_extract(e, EDGE, 1).cast("long").alias("src"), F.regexp_extract(e, EDGE, 2).cast("long").alias("dst")))


def node_ids(lines: Column) -> Column:
    return F.array_distinct(F.transform(F.filter(lines, lambda n: n.rlike(NODE)), lambda n: F.regexp_extract(n, NODE, 1).cast("long")))


def statement_type(line: Column, strict: bool = False) -> Column:
    """The first pattern found in the line; `strict` looks for branches before assignments."""
    order = list(C.STATEMENT_TYPES.items())
    if strict:
        order = [("if_branch", C.STRICT_BRANCH), *(x for x in order if x[0] != "if_branch")]
    out = F.lit("other")
    for name, pattern in reversed(order):
        out = F.when(line.rlike(f"(?iU){pattern}"), name).otherwise(out)
    return out


def histogram(values: Column, order=TYPES) -> Column:
    """The share of each of `order` among the values; zeros if there are none."""
    n = F.greatest(F.size(values), F.lit(1)).cast("double")
    return F.transform(F.array(*map(F.lit, order)), lambda t: F.size(F.filter(values, lambda v: v == t)) / n)


def edge_density(n_nodes: Column, n_edges: Column) -> Column:
    most = F.when(n_nodes > 1, n_nodes.cast("double") * (n_nodes - 1)).otherwise(F.lit(1.0))
    return F.least(F.lit(1.0), n_edges.cast("double") / most)


def max_out_degree(ids: Column, edges: Column) -> Column:
    """The most edges that leave one of `ids` (0 without any)."""
    row = lambda value, mark: F.struct(value.alias("at"), F.lit(mark).alias("mark"))
    # Ids before the sources equal to them, in one sorted array: one fold counts the sources behind each id.
    both = F.array_sort(F.concat(F.transform(ids, lambda i: row(i, 0)), F.transform(edges, lambda e: row(e["src"], 1))))
    start = F.struct(F.lit(None).cast("long").alias("now"), F.lit(0).alias("run"), F.lit(0).alias("best"))

    def step(s: Column, x: Column) -> Column:
        new = x["mark"] == 0
        run = F.when(new, F.lit(0)).otherwise(s["run"] + F.coalesce((x["at"] == s["now"]).cast("int"), F.lit(0)))
        return F.struct(F.when(new, x["at"]).otherwise(s["now"]).alias("now"), run.alias("run"), F.greatest(s["best"], run).alias("best"))

    return F.aggregate(both, start, step, lambda s: s["best"])


def _adjacency(edges) -> dict[int, list[int]]:
    out: dict[int, list[int]] = {}
    for e in edges:
        out.setdefault(e["src"], []).append(e["dst"])
    return out


def _reached(ids, adjacency: dict[int, list[int]]) -> dict[int, None]:
    reach, todo = dict.fromkeys(ids), list(ids)
    while todo:
        for v in adjacency.get(todo.pop(), ()):
            if v not in reach:
                reach[v] = None
                todo.append(v)
    return reach


def components_of(ids, adjacency: dict[int, list[int]]) -> list[list[int]]:
    """Strongly connected components of what can be reached from `ids`; each comes after all that it leads to."""
    number: dict[int, int] = {}
    low: dict[int, int] = {}
    held: list[int] = []
    done: set[int] = set()
    out: list[list[int]] = []
    for root in _reached(ids, adjacency):
        if root in number:
            continue
        number[root] = low[root] = len(number)
        held.append(root)
        trail = [(root, iter(adjacency.get(root, ())))]
        while trail:
            u, rest = trail[-1]
            for v in rest:
                if v not in number:
                    number[v] = low[v] = len(number)
                    held.append(v)
                    trail.append((v, iter(adjacency.get(v, ()))))
                    break
                if v not in done:
                    low[u] = min(low[u], number[v])
            else:
                trail.pop()
                if trail:
                    low[trail[-1][0]] = min(low[trail[-1][0]], low[u])
                if low[u] == number[u]:
                    part = [held.pop()]
                    while part[-1] != u:
                        part.append(held.pop())
                    done.update(part)
                    out.append(part)
    return out


def has_cycle(ids, adjacency: dict[int, list[int]]) -> bool:
    """Whether a cycle can be reached from `ids`."""
    return any(len(c) > 1 or c[0] in adjacency.get(c[0], ()) for c in components_of(ids, adjacency))


def longest_path(ids, adjacency: dict[int, list[int]], most: int = DEEPEST) -> int:
    """Nodes on the longest simple path from one of `ids`, at most `most`.

    A path never comes back to a strongly connected component that it left, so components are solved one after
    another, those that they lead to first. Within one, a state is where a path stands and which nodes it has used, each looked
    at once; the search ends at `most` nodes, or when all nodes are used and the deepest way out is taken. So the work
    is linear without cycles, and can only be large for a component that is large, cyclic and without such a path.
    """
    ids = list(ids)
    depth: dict[int, int] = {}
    for part in components_of(ids, adjacency):
        inside = set(part)
        out = {u: max((depth[v] for v in adjacency.get(u, ()) if v not in inside), default=0) for u in part}
        if len(part) == 1:
            depth[part[0]] = min(most, 1 + out[part[0]])
            continue
        bit = {u: 1 << i for i, u in enumerate(part)}
        # Nodes with few ways on come first: long paths are found early.
        near = {u: sorted({v for v in adjacency[u] if v in inside and v != u}, key=lambda v: (len(adjacency[v]), v)) for u in part}
        top = min(most, len(part) + max(out.values()))
        found = {u: _deepest(u, near, bit, out, top) for u in part}
        depth.update(found)
    return max((depth[u] for u in ids), default=0)


def _deepest(root: int, near: dict[int, list[int]], bit: dict[int, int], out: dict[int, int], top: int) -> int:
    best, seen, stack = 0, set(), [(root, bit[root], 1)]
    while stack and best < top:
        u, used, n = stack.pop()
        best = max(best, min(top, n + out[u]))
        for v in reversed(near[u]):
            if not used & bit[v] and (v, used | bit[v]) not in seen:
                seen.add((v, used | bit[v]))
                stack.append((v, used | bit[v], n + 1))
    return best


def visiting_order(ids, adjacency: dict[int, list[int]]) -> list[int]:
    """Breadth first from the nodes without predecessors (else the lowest id), then what was not reached, by id."""
    ids = sorted(ids)
    if not adjacency or not ids:
        return ids
    targets = {v for vs in adjacency.values() for v in vs}
    queue = deque([i for i in ids if i not in targets] or ids[:1])
    seen: dict[int, None] = {}
    while queue:
        u = queue.popleft()
        if u not in seen:
            seen[u] = None
            queue.extend(v for v in adjacency.get(u, ()) if v not in seen)
    have = set(ids)
    return [u for u in seen if u in have] + [i for i in ids if i not in seen]


_SHAPE = T.StructType([T.StructField("cycle", T.DoubleType()), T.StructField("longest", T.LongType()), T.StructField("degree", T.LongType()), T.StructField("types", T.ArrayType(T.DoubleType())), T.StructField("path", T.ArrayType(T.StringType()))])


def path_of(ids, tokens, adjacency: dict[int, list[int]]) -> list[str]:
    """Tokens in visiting order without repeats side by side; of equal ids the last token counts."""
    token = dict(zip(ids, tokens))
    out: list[str] = []
    for i in visiting_order(token, adjacency):
        if not out or out[-1] != token[i]:
            out.append(token[i])
    return out


_KINDS = tuple((name, re.compile(pattern, re.I)) for name, pattern in C.STATEMENT_TYPES.items())
_PARAMETER, _INVOKE, _CAST, _IF, _RETURN = (re.compile(x) for x in (C.PATH_PARAMETER, C.PATH_INVOKE, C.PATH_CAST, r"\bif\b", r"\breturn\b"))
_NODE = re.compile(NODE)
_EDGE = re.compile(EDGE)


@lru_cache(1 << 16)
def read_statement(line: str) -> tuple[int, str]:
    """The place of a statement's type in TYPES, and its token on the path: `statement_type` and `path_token` for one line."""
    kind = next((i for i, (_, pattern) in enumerate(_KINDS) if pattern.search(line)), len(_KINDS))
    if m := _PARAMETER.search(line):
        return kind, f"param({m[2].rsplit('.', 1)[-1]})"
    if m := _INVOKE.search(line):
        return kind, m[1]
    if m := _CAST.search(line):
        return kind, f"cast({m[1].rsplit('.', 1)[-1]})"
    return kind, "branch" if _IF.search(line) else "return" if _RETURN.search(line) else "assign"


def shape_of(nodes, edges) -> tuple[float, int, int, list[float], list[str]]:
    """Cycle, longest path, degree, shares of statement types, and path of one slice's node and edge lines."""
    ids, tokens, types = [], [], [0] * len(TYPES)
    for line in nodes:
        number = _NODE.match(line)
        kind, token = read_statement(line[number.end() :].strip() if number else line)
        types[kind] += 1
        if number:
            ids.append(int(number[1]))
            tokens.append(token)
    pairs = [{"src": int(m[1]), "dst": int(m[2])} for m in map(_EDGE.search, edges) if m]
    adjacency, own = _adjacency(pairs), dict.fromkeys(ids)
    degree = max((len(adjacency.get(i, ())) for i in own), default=0)
    shares = [n / max(1, len(nodes)) for n in types]
    return float(has_cycle(own, adjacency)), longest_path(own, adjacency), degree, shares, path_of(ids, tokens, adjacency)


@F.pandas_udf(_SHAPE)
def shape(nodes: pd.Series, edges: pd.Series) -> pd.DataFrame:
    """What column expressions cannot say of a graph, or only node by node and uncompiled: one pass over its lines."""
    return pd.DataFrame([shape_of(n, e) for n, e in zip(nodes, edges)], columns=["cycle", "longest", "degree", "types", "path"])


def with_shape(slices: DataFrame) -> DataFrame:
    """`slices` with `shape`."""
    return slices.withColumn("shape", shape("nodes", "edges"))


def features(nodes: Column, edges: Column, api: Column, walk: Column) -> Column:
    """The 25 features: 7 of topology, 8 of statement types, 10 of the API's category."""
    n, m, degree = F.size(nodes), F.size(edges), walk["degree"]
    topology = F.array(
        log_norm(n, 50),
        log_norm(m, 100),
        edge_density(n, m),
        log_norm(degree, 10),
        F.when(degree > 1, 1.0).otherwise(0.0),
        walk["cycle"],
        log_norm(walk["longest"], 30),
    )
    return F.concat(topology, walk["types"], one_hot(category(api), C.API_CATEGORIES))


def path_token(statement: Column) -> Column:
    """What a statement is called on the path."""
    last = lambda c: F.substring_index(c, ".", -1)
    wrap = lambda kind, c: F.concat(F.lit(kind + "("), c, F.lit(")"))
    parameter, invoke, cast = f"(?U){C.PATH_PARAMETER}", f"(?U){C.PATH_INVOKE}", f"(?U){C.PATH_CAST}"
    return (
        F.when(statement.rlike(parameter), wrap("param", last(F.regexp_extract(statement, parameter, 2))))
        .when(statement.rlike(invoke), F.regexp_extract(statement, invoke, 1))
        .when(statement.rlike(cast), wrap("cast", last(F.regexp_extract(statement, cast, 1))))
        .when(statement.rlike(r"(?U)\bif\b"), "branch")
        .when(statement.rlike(r"(?U)\breturn\b"), "return")
        .otherwise("assign")
    )


def collapse(items: Column) -> Column:
    """Without items that repeat the one before, in one fold."""
    start = F.struct(F.lit(None).cast("string").alias("last"), F.array().cast("array<string>").alias("out"))
    step = lambda s, x: F.struct(x.alias("last"), F.when(x.eqNullSafe(s["last"]), s["out"]).otherwise(F.array_append(s["out"], x)).alias("out"))
    return F.aggregate(items, start, step, lambda s: s["out"])


def linear_path(function: Column, api: Column, walk: Column) -> Column:
    """One line for a slice: its function, its API, and the tokens along the graph."""
    path = F.array_join(walk["path"], " -> ")
    return F.concat(F.lit("FUNC: "), function, F.lit(" | API: "), api, F.lit(" | PATH: "), F.when(path == "", "unknown").otherwise(path))

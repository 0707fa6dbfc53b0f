"""Secret scans with an incremental blob ledger, in DataFrame functions only.

Every version of every path is addressed by the SHA-256 of its content (its blob). The ledger is a Parquet table
of (blob, rules, findings): which rule versions a blob has been scanned with, and what each version found. A scan
takes one copy of each blob that lacks some rule version, runs only the missing rules, appends to the ledger, and joins
the findings of the versions asked for back to all paths, so copies and unchanged files cost a hash and a join.
Findings of other versions stay in the ledger and are not returned; what two scans of one version added counts once.

Spans are in code points with an exclusive end. A rule's matches are leftmost and non-overlapping; those whose
judged part is too short are dropped after matching, so they still use up their text.

Defined cases: null text is an empty blob without findings; an empty table gives no rows; repeated rows are each
returned; a null id stays null.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cograph.llm.common import fresh_path, path_exists, table


class Rule(NamedTuple):
    kind: str
    version: int
    pattern: str
    group: int
    least: int
    base: bool


#: The first three are fixed by the contract, in its order; the rest are this operator's own.
RULES = (
    Rule("assign", 1, r"""((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, True),
    Rule("access", 1, r"AKIA[A-Z0-9]+", 0, 20, True),
    Rule("hex", 1, r"[0-9a-f]{24,}", 0, 24, True),
    Rule("pem", 1, r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1, False),
    Rule("forge", 1, r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 40, False),
    Rule("jwt", 1, r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 30, False),
)

FINDINGS = "array<struct<start:bigint,end:bigint,kind:string,rule:string>>"


def rule_name(rule: Rule) -> str:
    return f"{rule.kind}@{rule.version}"


def spans_of(text: Column, rule: Rule) -> Column:
    """The spans of one rule: the pieces between matches and the matches themselves add up to positions."""
    whole = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    judged = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group))
    pieces = F.split(text, rule.pattern, -1)
    found = F.arrays_zip(F.transform(pieces, F.length).alias("gap"), F.transform(whole, F.length).alias("long"), F.transform(judged, F.length).alias("part"))
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast(FINDINGS).alias("spans"))

    def step(state: Column, x: Column) -> Column:
        at = state["at"] + F.coalesce(x["gap"], F.lit(0))
        end = at + F.coalesce(x["long"], F.lit(0))
        span = F.struct(at.alias("start"), end.alias("end"), F.lit(rule.kind).alias("kind"), F.lit(rule_name(rule)).alias("rule"))
        return F.struct(end.alias("at"), F.when(x["part"] >= rule.least, F.concat(state["spans"], F.array(span))).otherwise(state["spans"]).alias("spans"))

    return F.when(text.rlike(rule.pattern), F.aggregate(found, start, step, lambda s: s["spans"])).otherwise(F.array().cast(FINDINGS))


def read_ledger(spark: SparkSession, ledger: str) -> DataFrame:
    schema = f"blob string, rules array<string>, findings {FINDINGS}"
    if not path_exists(spark, ledger):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(ledger)


def scan_incremental(versions: DataFrame, ledger: str, text: str = "text", rules=RULES) -> tuple[DataFrame, DataFrame]:
    """Scans what the ledger lacks and appends it. Returns (versions with `blob`, without the text; findings of each blob)."""
    spark = versions.sparkSession
    content = F.coalesce(F.col(text), F.lit(""))
    names = [rule_name(r) for r in rules]
    seen = read_ledger(spark, ledger).groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("rules"))).alias("seen"))
    # One copy of a blob: the first of each task, then of all tasks. Ordered sorts spill; nothing is gathered.
    blobs = versions.select(F.sha2(content, 256).alias("blob"), content.alias("body"))
    if path_exists(spark, ledger):
        blobs = blobs.join(seen, "blob", "left").filter(~F.coalesce(F.size(F.array_intersect("seen", F.array(*map(F.lit, names)))) == len(names), F.lit(False)))
    else:
        blobs = blobs.withColumn("seen", F.array().cast("array<string>"))
    one = blobs.groupBy("blob").agg(F.first("body").alias("body"), F.first("seen").alias("seen"))
    todo = F.array_except(F.array(*map(F.lit, names)), F.coalesce("seen", F.array().cast("array<string>")))
    found = [F.when(F.array_contains(todo, n), spans_of(F.col("body"), r)).otherwise(F.array().cast(FINDINGS)) for n, r in zip(names, rules, strict=True)]
    one.select("blob", todo.alias("rules"), F.concat(*found).alias("findings")).write.mode("append").parquet(ledger)
    # Of the versions asked for, by start and then in the order of the rules.
    place = F.create_map(*[F.lit(x) for i, n in enumerate(names) for x in (n, i)])
    asked = F.filter("findings", lambda x: F.array_contains(F.array(*map(F.lit, names)), x["rule"]))
    placed = F.transform(asked, lambda x: F.struct(x["start"].alias("start"), place[x["rule"]].alias("place"), x["end"].alias("end"), x["kind"].alias("kind")))
    by_blob = read_ledger(spark, ledger).select("blob", placed.alias("findings")).filter(F.size("findings") > 0)
    by_blob = by_blob.groupBy("blob").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("findings")))).alias("findings"))
    return versions.withColumn("blob", F.sha2(content, 256)).drop(text), by_blob


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def secrets(docs: DataFrame, ledger: str) -> DataFrame:
    """The digest that op4 returns for each row of `docs` (doc_id, text)."""
    paths, findings = scan_incremental(docs.select("doc_id", "text"), ledger)
    base = F.array(*[F.lit(r.kind) for r in RULES if r.base])
    spans = F.coalesce("findings", F.array().cast("array<struct<start:bigint,place:int,end:bigint,kind:string>>"))
    count = lambda kind: F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return paths.join(findings, "blob", "left").select(
        "doc_id",
        *[count(r.kind) for r in RULES if r.base],
        F.sha2(joined(F.filter(spans, lambda s: F.array_contains(base, s["kind"]))), 256).alias("base_sha256"),
        joined(spans).alias("spans"),
    )


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets(table(spark, sf_dir, "documents"), fresh_path(spark, "ledger"))


def secrets_sql(docs: str = "documents") -> str:
    found = []
    for place, r in enumerate(RULES):
        p = r.pattern.replace("'", "''")
        found.append(f"""
  SELECT row, '{r.kind}' AS kind, {place} AS place, {str(r.base).lower()} AS base, pos + gap - long AS first, pos + gap AS last FROM (
    SELECT row, part, long, gap + long AS gap, coalesce(sum(gap + long) OVER (PARTITION BY row ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos FROM (
      SELECT row, unnest(range(len(m))) AS i, unnest([length(x) for x in m]) AS long, unnest([length(x) for x in g]) AS part, unnest([length(x) for x in s[1:len(m)]]) AS gap
      FROM (SELECT row, regexp_extract_all(body, '{p}', 0) AS m, regexp_extract_all(body, '{p}', {r.group}) AS g, regexp_split_to_array(body, '{p}') AS s FROM d)
    )) WHERE part >= {r.least}""")
    return f"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS body FROM {docs}),
f AS ({" UNION ALL ".join(found)}),
a AS (SELECT row, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
       string_agg(kind || ':' || first || ':' || last, ',' ORDER BY first, place) FILTER (base) AS b,
       string_agg(kind || ':' || first || ':' || last, ',' ORDER BY first, place) AS s FROM f GROUP BY row)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(b, '')) AS base_sha256, coalesce(s, '') AS spans FROM d LEFT JOIN a USING (row)"""

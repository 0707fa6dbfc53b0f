"""The library's operators on the driver's tables, each with the SQL that says the same.

`documents` stands for slice files, `labels` for truth (toxic) and prediction (quality), `embeddings` for the knowledge
base, `events` for statements of a function (a user) in order, `conversations` for model answers, `pages` for calls.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cograph.functions import constants as C
from cograph.functions import graph as G
from cograph.functions import responses as R
from cograph.functions import text as X
from cograph.functions import vectors as V
from cograph.operators import calls, evaluation, joins, neighbours, rows, slicing
from cograph.plans import curation, models, reasoning, retrieval
from cograph.sources import slices as S

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# ---- cleaning: WIN-1..3, WIN-13, AGG-17, FLT-3, PRJ-1, PRJ-11..13 ----


@query("SELECT doc_id, source FROM (SELECT *, row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) AS n FROM documents) WHERE n = 1")
def content_dedup(spark, d):
    """WIN-2: the first document of each content."""
    return rows.content_dedup(read(spark, d, "documents"), [], "text", "doc_id").select("doc_id", "source")


@query("SELECT source, lang, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY source, lang ORDER BY doc_id) AS n FROM documents) WHERE n = 1")
def keep_first(spark, d):
    """WIN-1."""
    return rows.keep_first(read(spark, d, "documents"), ["source", "lang"], "doc_id").select("source", "lang", "doc_id")


@query("SELECT doc_id FROM (SELECT *, row_number() OVER (PARTITION BY source, lang, len(string_split(text, ' ')), len(string_split(text, chr(10))) ORDER BY doc_id) AS n FROM documents) WHERE n = 1")
def structural_dedup(spark, d):
    """WIN-3: the first of each shape."""
    docs = read(spark, d, "documents").select("doc_id", F.col("source").alias("sha256"), F.col("lang").alias("function_name"), F.lit("").alias("suspicious_api"), F.split("text", " ").alias("nodes"), F.split("text", "\n").alias("edges"))
    return rows.structural_dedup(docs, "doc_id").select("doc_id")


@query("""SELECT source, sum(n)::BIGINT AS n_raw, count(*) AS n_unique, sum(k)::BIGINT AS n_kept FROM
(SELECT source, md5(text) AS h, count(*) AS n, max(CASE WHEN contains(text, 'License') THEN 1 ELSE 0 END) AS k FROM documents GROUP BY ALL) GROUP BY source""")
def dedup_counts(spark, d):
    """AGG-17."""
    return rows.dedup_counts(read(spark, d, "documents"), ["source"], "text", F.col("text").contains("License"))


_HOSTS = ("http://blog.", "https://blog.", "http://m.", "https://m.")


@query("SELECT page_id, url FROM pages WHERE NOT regexp_matches(url, '^(http://blog\\.|https://blog\\.|http://m\\.|https://m\\.)') OR regexp_matches(lower(url), '(/en/|/fr/)')")
def prefix_allow_filter(spark, d):
    """FLT-3: the framework filter's shape: prefixes go unless an always-kept fragment stands in the other column."""
    return read(spark, d, "pages").filter(X.outside_framework(F.col("url"), F.col("url"), _HOSTS, ("/en/", "/fr/"))).select("page_id", "url")


@query("SELECT doc_id FROM documents ORDER BY doc_id LIMIT 50 OFFSET 10")
def offset_limit(spark, d):
    """WIN-13: a page of rows is the feature."""
    return rows.offset_limit(read(spark, d, "documents").select("doc_id"), "doc_id", 10, 50)


@query("SELECT doc_id, lower(trim('  ' || upper(source) || ' ')) AS key, CASE WHEN lang = 'en' THEN 'MALWARE' ELSE 'BENIGN' END AS verdict, regexp_replace('com.' || source || '.run', '\\.[^.]*$', '') AS cls FROM documents")
def key_normalise(spark, d):
    """PRJ-1, PRJ-2, PRJ-11."""
    label = F.when(F.col("lang") == "en", 1.0).when(F.col("lang") == "de", 0.0).otherwise(float("nan"))
    key = X.normal_key(F.concat(F.lit("  "), F.upper("source"), F.lit(" ")))
    return read(spark, d, "documents").select("doc_id", key.alias("key"), X.verdict(label).alias("verdict"), X.class_of(F.concat(F.lit("com."), "source", F.lit(".run"))).alias("cls"))


@query("SELECT doc_id, md5(CASE WHEN length(text) > 1500 THEN substr(text, 1, 1500) || chr(10) || '... [truncated] ...' ELSE text END) AS h, CASE WHEN length(text) > 42 THEN left(text, 20) || '...' || right(text, 19) ELSE text END AS short FROM documents")
def truncate_marker(spark, d):
    """PRJ-12, PRJ-19."""
    return read(spark, d, "documents").select("doc_id", F.md5(X.cut(F.col("text"), 1500)).alias("h"), X.elide(F.col("text")).alias("short"))


@query("SELECT source, sum(length(text) // 3)::BIGINT AS tokens, max(length(text))::INT AS longest FROM documents GROUP BY source")
def token_estimate(spark, d):
    """PRJ-13, PRJ-20."""
    return read(spark, d, "documents").groupBy("source").agg(F.sum(X.token_estimate(F.col("text"))).alias("tokens"), F.max(F.length("text")).alias("longest"))


# ---- joins and evaluation: JOIN-1..6, AGG-1..6, WIN-14, WIN-16, PRJ-4..6, SET-1..3 ----


def _judged(spark, d) -> DataFrame:
    docs, labels = read(spark, d, "documents").select("doc_id", "source", "lang"), read(spark, d, "labels")
    said = lambda c: X.verdict(F.col(c))
    return joins.label_join(docs, labels, "doc_id").select("doc_id", "source", "lang", said("toxic").alias("ground_truth"), said("quality").alias("prediction"))


_JUDGED = "(SELECT d.doc_id, source, lang, CASE WHEN toxic = 1 THEN 'MALWARE' ELSE 'BENIGN' END AS ground_truth, CASE WHEN quality = 1 THEN 'MALWARE' ELSE 'BENIGN' END AS prediction FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"


@query(f"SELECT * FROM {_JUDGED}")
def label_join(spark, d):
    """JOIN-1, FLT-6."""
    return _judged(spark, d)


@query("SELECT d.doc_id, coalesce(quality, -1)::INT AS quality, coalesce(toxic, -1)::INT AS toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def label_left_default(spark, d):
    """JOIN-3."""
    return joins.label_or_default(read(spark, d, "documents").select("doc_id"), read(spark, d, "labels"), "doc_id", quality=-1, toxic=-1)


@query("""WITH t AS (SELECT doc_id, 'quality' AS f, quality AS v, 0 AS p FROM labels WHERE quality = 1 UNION ALL SELECT doc_id, 'toxic', toxic, 1 FROM labels),
r AS (SELECT doc_id, f, v FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY p, f, v) AS n FROM t) WHERE n = 1)
SELECT d.doc_id, r.f AS found_in, r.v AS value FROM documents d LEFT JOIN r ON d.doc_id = r.doc_id""")
def priority_label_fill(spark, d):
    """JOIN-2, JOIN-5, Q20."""
    labels = read(spark, d, "labels")
    first = labels.filter("quality = 1").select("doc_id", F.lit("quality").alias("found_in"), F.col("quality").alias("value"))
    second = labels.select("doc_id", F.lit("toxic").alias("found_in"), F.col("toxic").alias("value"))
    work = read(spark, d, "documents").select("doc_id", F.lit(None).cast("string").alias("found_in"), F.lit(None).cast("int").alias("value"))
    return joins.fill_by_priority(work, [first, second], ["found_in", "value"], "doc_id")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def resume_anti(spark, d):
    """JOIN-4, FLT-10, SET-3."""
    return joins.not_done(read(spark, d, "documents").select("doc_id"), read(spark, d, "labels"), "doc_id")


_CELLS = "count(*) AS total, count(*) FILTER (ground_truth = 'MALWARE' AND prediction = 'MALWARE') AS tp, count(*) FILTER (ground_truth = 'BENIGN' AND prediction = 'BENIGN') AS tn, count(*) FILTER (ground_truth = 'BENIGN' AND prediction = 'MALWARE') AS fp, count(*) FILTER (ground_truth = 'MALWARE' AND prediction = 'BENIGN') AS fn"


@query(f"SELECT source, {_CELLS} FROM {_JUDGED} GROUP BY source")
def confusion(spark, d):
    """AGG-1."""
    return evaluation.confusion(_judged(spark, d), keys=("source",))


_RATES = """total, tp, tn, fp, fn, coalesce((tp + tn)::DOUBLE / nullif(total, 0), 0) AS accuracy, coalesce(tp::DOUBLE / nullif(tp + fp, 0), 0) AS precision,
coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0) AS recall, coalesce(2.0 * (tp::DOUBLE / nullif(tp + fp, 0)) * (tp::DOUBLE / nullif(tp + fn, 0)) / nullif((tp::DOUBLE / nullif(tp + fp, 0)) + (tp::DOUBLE / nullif(tp + fn, 0)), 0), 0) AS f1,
coalesce(fp::DOUBLE / nullif(fp + tn, 0), 0) AS fpr, coalesce(fn::DOUBLE / nullif(fn + tp, 0), 0) AS fnr"""
_ROUND = [f"round({c}, 6) AS {c}" for c in ("accuracy", "precision", "recall", "f1", "fpr", "fnr")]


@query(f"SELECT lang, total, tp, tn, fp, fn, {', '.join(_ROUND)} FROM (SELECT lang, {_RATES} FROM (SELECT lang, {_CELLS} FROM {_JUDGED} GROUP BY lang))")
def metrics(spark, d):
    """AGG-2."""
    out = evaluation.metrics(evaluation.confusion(_judged(spark, d), keys=("lang",)))
    return out.withColumns({c: F.round(c, 6) for c in ("accuracy", "precision", "recall", "f1", "fpr", "fnr")})


@query(f"SELECT source AS family, count(*) AS total, count(*) FILTER (prediction = 'MALWARE') AS detected, count(*) FILTER (prediction <> 'MALWARE') AS missed, round(count(*) FILTER (prediction = 'MALWARE') / count(*), 6) AS detection_rate FROM {_JUDGED} WHERE ground_truth = 'MALWARE' GROUP BY source")
def family_rates(spark, d):
    """AGG-3, PRJ-6."""
    out = evaluation.group_rates(_judged(spark, d), X.normal_family(F.col("source")), "doc_id")
    return out.withColumn("detection_rate", F.round("detection_rate", 6))


@query("SELECT lang, count(*) AS n FROM documents GROUP BY lang")
def distribution(spark, d):
    """AGG-4, AGG-13."""
    return evaluation.distribution(read(spark, d, "documents"), "lang")


@query(f"""SELECT source, count(*) AS total, count(*) FILTER (prediction = 'MALWARE') AS malware, count(*) FILTER (prediction = 'BENIGN') AS benign, count(*) FILTER (prediction = ground_truth) AS correct, count(*) AS known,
round(count(*) FILTER (prediction = ground_truth) * 100.0 / count(*), 6)::DOUBLE AS accuracy_percent FROM {_JUDGED} GROUP BY source""")
def run_summary(spark, d):
    """AGG-5, AGG-6, AGG-14, WIN-18."""
    return evaluation.run_summary(_judged(spark, d), keys=("source",)).withColumn("accuracy_percent", F.round("accuracy_percent", 6))


@query("""SELECT doc_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', (strpos('0123456789abcdef', substr(h, 17, 1)) - 1)::INT % 4 + 1, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS id, md5(text) AS h
FROM (SELECT doc_id, text, sha1(unhex('6ba7b8109dad11d180b400c04fd430c8') || encode(concat_ws(':', source, lang, doc_id::VARCHAR))) AS h FROM documents)""")
def uuid5_key(spark, d):
    """STR-10, STR-9."""
    return read(spark, d, "documents").select("doc_id", X.uuid5(F.concat_ws(":", "source", "lang", F.col("doc_id").cast("string"))).alias("id"), F.md5("text").alias("h"))


@query(f"SELECT 'fp' AS kind, doc_id FROM (SELECT doc_id FROM {_JUDGED} WHERE ground_truth = 'BENIGN' AND prediction = 'MALWARE' ORDER BY doc_id LIMIT 10) UNION ALL SELECT 'fn', doc_id FROM (SELECT doc_id FROM {_JUDGED} WHERE ground_truth = 'MALWARE' AND prediction = 'BENIGN' ORDER BY doc_id LIMIT 10)")
def fp_fn_top10(spark, d):
    """WIN-14, FLT-13: a report of the first ten."""
    judged = _judged(spark, d)
    part = lambda k: evaluation.errors(judged, k).orderBy("doc_id").limit(10).select(F.lit(k).alias("kind"), "doc_id")
    return part("fp").unionByName(part("fn"))


@query("SELECT d.doc_id, trim(text, ' ' || chr(10) || chr(9) || chr(13)) AS input, CASE WHEN toxic = 1 THEN 'MALWARE (family: ' || trim(source) || ')' ELSE 'BENIGN' END AS output FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE trim(text) <> ''")
def instruction_set(spark, d):
    """PRJ-4, PRJ-5, FLT-5."""
    files = read(spark, d, "documents").select(F.col("doc_id").alias("sha256"), F.col("text").alias("content"), "source")
    truth = files.drop("content").join(read(spark, d, "labels").withColumnRenamed("doc_id", "sha256"), "sha256").select("sha256", X.verdict_with_family(F.col("toxic"), F.col("source")).alias("verdict"))
    rows_ = files.filter(X.strip(F.col("content")) != "").join(truth, "sha256")
    return rows_.select(F.col("sha256").alias("doc_id"), X.strip(F.col("content")).alias("input"), F.col("verdict").alias("output"))


@query("SELECT toxic, doc_id, ((n - 1) // 5)::INT AS split FROM (SELECT *, row_number() OVER (PARTITION BY toxic ORDER BY md5('s1:' || doc_id), doc_id) AS n FROM labels) WHERE n <= 10")
def balanced_split(spark, d):
    """WIN-16, AGG-15: a sample is the feature."""
    return rows.balanced_splits(read(spark, d, "labels"), "toxic", "doc_id", 5, 2, "s1").select("toxic", "doc_id", "split")


@query("""WITH u AS (SELECT doc_id, source, 0 AS p FROM documents WHERE lang <> 'en' UNION ALL SELECT doc_id + 1, source, 1 FROM documents)
SELECT doc_id, source, p FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY p, source) AS n FROM u) WHERE n = 1""")
def union_keep_first(spark, d):
    """SET-1, SET-2, SRC-5."""
    docs = read(spark, d, "documents").select("doc_id", "source", "lang")
    both = docs.filter("lang <> 'en'").select("doc_id", "source", F.lit(0).alias("p")).unionByName(docs.select((F.col("doc_id") + 1).alias("doc_id"), "source", F.lit(1).alias("p")))
    return rows.keep_first(both, ["doc_id"], "p", "source")


# ---- parsing and graphs: SRC-8, STR-*, AGG-9/10, GRF-*, WIN-4, ARR-4 ----


def _files(spark, d) -> DataFrame:
    """Slice files out of events: an app is an event type, a function a user, a statement an event."""
    e = read(spark, d, "events").select(F.col("event_type").alias("sha256"), "user_id", "event_id", "value", F.row_number().over(W.partitionBy("event_type", "user_id").orderBy("event_id")).alias("n"))
    kind = F.pmod("event_id", F.lit(4))
    statement = (
        F.when(kind == 0, F.concat(F.lit("$r1 = virtualinvoke $r0.<com.u"), F.pmod(F.col("user_id") + 1, F.lit(50)).cast("string"), F.lit(".A: void go(int)>(1)")))
        .when(kind == 1, "if $r1 != null goto return").when(kind == 2, "$r2 := @parameter0: android.content.Context").otherwise("x = (java.lang.String) $r1")
    )
    node = F.concat(F.lit("NODE "), F.col("n").cast("string"), F.lit(": "), statement)
    last = F.max("n").over(W.partitionBy("sha256", "user_id"))
    back = F.when(F.pmod("event_id", F.lit(7)) == 0, F.lit(1)).otherwise(F.col("n") + 1)
    edge = F.when(F.col("n") < last, F.concat(F.lit("EDGE: "), F.col("n").cast("string"), F.lit(" -> "), back.cast("string")))
    lines = e.select("*", node.alias("node"), edge.alias("edge"))
    body = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col(c).isNotNull(), F.struct("n", c)))), lambda x: x[c]), "\n")
    user = lines.groupBy("sha256", "user_id").agg(body("node").alias("nodes"), body("edge").alias("edges"))
    api = F.element_at(F.array(*map(F.lit, ("getDeviceId", "exec", "forName", "sendTextMessage", "query"))), (F.pmod("user_id", F.lit(5)) + 1).cast("int"))
    block = F.concat(F.lit("=== FUNCTION: com.u"), F.pmod("user_id", F.lit(50)).cast("string"), F.lit(".A."), F.when(F.col("user_id") < 50, "go").otherwise(F.concat(F.lit("m"), F.col("user_id").cast("string"))), F.lit(" ===\nSUSPICIOUS_API: "), api, F.lit("\n"), "nodes", F.lit("\n"), "edges", F.lit("\n=== END FUNCTION ===\n\n"))
    blocks = user.select("sha256", "user_id", block.alias("block"))
    joined = blocks.groupBy("sha256").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("user_id", "block"))), lambda x: x["block"]), "").alias("content"))
    return joined.select("sha256", F.concat(F.lit("=== SLICER_VERSION: 2 ===\n"), "content").alias("content"))


def _slices(spark, d) -> DataFrame:
    return S.parse_slices(_files(spark, d))


_N = "SELECT event_type AS sha256, user_id, event_id, row_number() OVER (PARTITION BY event_type, user_id ORDER BY event_id) AS n, count(*) OVER (PARTITION BY event_type, user_id) AS m FROM events"


@query(f"""SELECT sha256, (row_number() OVER (PARTITION BY sha256 ORDER BY user_id) - 1)::INT AS slice_pos, 'com.u' || (user_id % 50) || '.A.' || CASE WHEN user_id < 50 THEN 'go' ELSE 'm' || user_id END AS function_name,
['getDeviceId', 'exec', 'forName', 'sendTextMessage', 'query'][(user_id % 5)::INT + 1] AS suspicious_api, count(*)::INT AS n_nodes, (count(*) - 1)::INT AS n_edges FROM ({_N}) GROUP BY sha256, user_id""")
def block_parse(spark, d):
    """SRC-8, STR-1, STR-2, STR-11."""
    return _slices(spark, d).select("sha256", "slice_pos", "function_name", "suspicious_api", F.size("nodes").alias("n_nodes"), F.size("edges").alias("n_edges"))


@query("""SELECT page_id, len(regexp_extract_all(html, 'href="([^"]*)"', 1))::INT AS n, array_to_string(regexp_extract_all(html, 'href="([^"]*)"', 1), '|') AS links FROM pages""")
def regex_extract_all(spark, d):
    """STR-8, STR-4."""
    found = F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))
    return read(spark, d, "pages").select("page_id", F.size(found).alias("n"), F.array_join(found, "|").alias("links"))


_TYPES = """CASE WHEN regexp_matches(s, '(?i)(virtual|static|special|interface)invoke') THEN 'invoke' WHEN regexp_matches(s, '(?i):=\\s*@(this|parameter|caughtexception)') THEN 'identity'
WHEN regexp_matches(s, '(?i)\\bif\\b\\s+\\$') THEN 'if_branch' WHEN regexp_matches(s, '(?i)\\breturn\\b') THEN 'return' WHEN regexp_matches(s, '(?i)\\(\\s*[a-zA-Z][\\w.]*\\)\\s*\\$') THEN 'cast' ELSE 'other' END"""
_STATEMENT = """CASE event_id % 4 WHEN 0 THEN '$r1 = virtualinvoke $r0.<com.u' || ((user_id + 1) % 50) || '.A: void go(int)>(1)' WHEN 1 THEN 'if $r1 != null goto return'
WHEN 2 THEN '$r2 := @parameter0: android.content.Context' ELSE 'x = (java.lang.String) $r1' END"""


@query(f"SELECT sha256, kind, count(*) AS n FROM (SELECT sha256, {_TYPES} AS kind FROM (SELECT sha256, {_STATEMENT} AS s FROM ({_N}))) GROUP BY ALL")
def first_match_type(spark, d):
    """STR-6 (no generated statement is an assignment of its own, so the look-ahead is not needed in SQL)."""
    node = _slices(spark, d).select("sha256", F.explode("nodes").alias("node"))
    return node.select("sha256", G.statement_type(F.col("node")).alias("kind")).groupBy("sha256", "kind").agg(F.count("*").alias("n"))


@query("""SELECT user_id, round(count(*) FILTER (event_type = 'click') / count(*), 6) AS click, round(count(*) FILTER (event_type = 'view') / count(*), 6) AS view,
round(count(*) FILTER (event_type NOT IN ('click', 'view')) / count(*), 6) AS other FROM events GROUP BY user_id""")
def type_histogram(spark, d):
    """AGG-9."""
    kind = F.when(F.col("event_type").isin("click", "view"), F.col("event_type")).otherwise("other")
    types = read(spark, d, "events").groupBy("user_id").agg(F.collect_list(kind).alias("t"))
    h = G.histogram(F.col("t"), ("click", "view", "other"))
    return types.select("user_id", *[F.round(h[i], 6).alias(c) for i, c in enumerate(("click", "view", "other"))])


@query("""SELECT user_id, event_type, round(least(1.0, ln(1 + count(*)) / ln(51.0)), 6) AS size, CASE WHEN event_type = 'click' THEN 1.0 ELSE 0.0 END::DOUBLE AS is_click FROM events GROUP BY ALL""")
def one_hot_log_norm(spark, d):
    """ARR-4, PRJ-14, MTH-1."""
    n = read(spark, d, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    return n.select("user_id", "event_type", F.round(X.log_norm(F.col("n"), 50), 6).alias("size"), V.one_hot(F.col("event_type"), ["click", "view"])[0].alias("is_click"))


@query("""SELECT user_id, string_agg(event_type, '>' ORDER BY ts, event_id) AS path FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events) WHERE p IS NULL OR p <> event_type GROUP BY user_id""")
def adjacent_collapse(spark, d):
    """WIN-4."""
    e = read(spark, d, "events").groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id", "event_type"))), lambda x: x["event_type"]).alias("t"))
    return e.select("user_id", F.array_join(G.collapse(F.col("t")), ">").alias("path"))


_EDGES = f"SELECT sha256, user_id, n AS src, CASE WHEN event_id % 7 = 0 THEN 1 ELSE n + 1 END AS dst FROM ({_N}) WHERE n < m"


@query(f"""SELECT sha256, user_id % 50 AS u, max(deg)::INT AS degree, round(max(m) / max(greatest(nn * (nn - 1), 1)), 9) AS density FROM
(SELECT e.*, nn, nn - 1 AS m FROM (SELECT sha256, user_id, src, count(*) AS deg FROM ({_EDGES}) GROUP BY ALL) e JOIN (SELECT event_type AS s2, user_id AS u2, count(*) AS nn FROM events GROUP BY ALL) ON s2 = sha256 AND u2 = user_id WHERE user_id < 50) GROUP BY sha256, user_id""")
def graph_degree(spark, d):
    """AGG-10, GRF-1, GRF-5."""
    s = _slices(spark, d).filter("function_name LIKE '%.go' AND size(edges) > 0")
    degree = G.max_out_degree(G.node_ids(F.col("nodes")), G.edges_of(F.col("edges")))
    return s.select("sha256", F.regexp_extract("function_name", r"com\.u(\d+)", 1).cast("long").alias("u"), degree.alias("degree"), F.round(G.edge_density(F.size("nodes"), F.size("edges")), 9).alias("density"))


#: The generated graphs: a chain in which node n leads to n + 1, or back to 1 where its event's number is divisible by 7.
_CHAIN = f"(SELECT *, n < m AND event_id % 7 = 0 AS back, min(CASE WHEN n < m AND event_id % 7 = 0 THEN n END) OVER (PARTITION BY sha256, user_id) AS f1, min(CASE WHEN n < m AND event_id % 7 = 0 THEN n END) OVER (PARTITION BY sha256, user_id ORDER BY n ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS j FROM ({_N}))"
#: The longest simple path from n: to the end, or to the next way back j and on from 1 to what was there before.
_WALK = "CASE WHEN j IS NULL THEN m - n + 1 WHEN f1 < n THEN j - n + 1 + f1 ELSE j END"
_LOG = lambda x, scale: f"least(1.0, ln(1 + {x}) / ln({scale + 1}.0))"
_HOT = [f"CASE WHEN user_id % 5 = {k} THEN 1.0 ELSE 0.0 END" for k in range(5)]
_FEATURES = (
    _LOG("m", 50), _LOG("(m - 1)", 100), "least(1.0, (m - 1)::DOUBLE / greatest(1, m * (m - 1)))", _LOG("least(1, m - 1)", 10), "0.0", "CASE WHEN f1 IS NULL THEN 0.0 ELSE 1.0 END", _LOG("least(30, walk)", 30),
    "t0 / m", "0.0", "t2 / m", "t1 / m", "0.0", "t3 / m", "0.0", "0.0",
    _HOT[2], _HOT[0], "0.0", _HOT[3], "0.0", "0.0", "0.0", _HOT[1], _HOT[4], "0.0",
)


@query(f"""SELECT sha256, (row_number() OVER (PARTITION BY sha256 ORDER BY user_id) - 1)::INT AS slice_pos, {', '.join(f"round(({x})::DOUBLE, 6) AS f{i}" for i, x in enumerate(_FEATURES))}
FROM (SELECT sha256, user_id, m, f1, max({_WALK}) AS walk, {', '.join(f"count(*) FILTER (event_id % 4 = {k})::DOUBLE AS t{k}" for k in range(4))} FROM {_CHAIN} GROUP BY ALL)""")
def graph_features(spark, d):
    """GRF-2..5."""
    f = G.features(F.col("nodes"), F.col("edges"), F.col("suspicious_api"), F.col("shape"))
    made = G.with_shape(_slices(spark, d)).select("sha256", "slice_pos", f.alias("f"))
    return made.select("sha256", "slice_pos", *[F.round(F.col("f")[i], 6).alias(f"f{i}") for i in range(len(_FEATURES))])


#: Breadth first: what comes behind a way back starts a chain of its own; the first chain that goes back brings 1 and its chain.
_VISITED = f"""WITH c AS (SELECT *, coalesce(sum(back::INT) OVER (PARTITION BY sha256, user_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seg FROM {_CHAIN}),
s AS (SELECT sha256, user_id, seg, min(n) AS low, count(*) AS len, max(back::INT) AS goes FROM c GROUP BY ALL),
e AS (SELECT sha256, user_id, min(len) AS len, arg_min(seg, len * 1000000 + seg) AS seg FROM s WHERE seg > 0 AND goes = 1 GROUP BY ALL),
o AS (SELECT c.*, CASE WHEN c.seg > 0 OR c.f1 IS NULL THEN c.n - s.low WHEN e.len IS NULL THEN 1000000000 + c.n ELSE e.len + c.n - 1 END AS level, CASE WHEN c.seg > 0 OR e.seg IS NULL THEN c.seg ELSE e.seg END AS turn
FROM c JOIN s ON c.sha256 = s.sha256 AND c.user_id = s.user_id AND c.seg = s.seg LEFT JOIN e ON c.sha256 = e.sha256 AND c.user_id = e.user_id),
t AS (SELECT *, ['go', 'branch', 'param(Context)', 'cast(String)'][(event_id % 4)::INT + 1] AS token FROM o)"""


@query(f"""{_VISITED}, k AS (SELECT *, lag(token) OVER (PARTITION BY sha256, user_id ORDER BY level, turn) AS p FROM t)
SELECT sha256, (row_number() OVER (PARTITION BY sha256 ORDER BY user_id) - 1)::INT AS slice_pos, 'FUNC: com.u' || (user_id % 50) || '.A.' || CASE WHEN user_id < 50 THEN 'go' ELSE 'm' || user_id END || ' | API: '
|| ['getDeviceId', 'exec', 'forName', 'sendTextMessage', 'query'][(user_id % 5)::INT + 1] || ' | PATH: ' || string_agg(token, ' -> ' ORDER BY level, turn) FILTER (p IS NULL OR p <> token) AS path FROM k GROUP BY sha256, user_id""")
def linearize(spark, d):
    """GRF-6, STR-7."""
    return G.with_shape(_slices(spark, d)).select("sha256", "slice_pos", G.linear_path(F.col("function_name"), F.col("suspicious_api"), F.col("shape")).alias("path"))


@query("SELECT event_id, (props ->> '$.k')::BIGINT AS k, to_json({'id': event_id, 'type': event_type})::VARCHAR AS record FROM events")
def json_prop(spark, d):
    """STR-12."""
    return read(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"), F.to_json(F.struct(F.col("event_id").alias("id"), F.col("event_type").alias("type"))).alias("record"))


# ---- vectors: ARR-1..3, VEC-4..8, AGG-8, WIN-5..7 ----

_COS = "list_dot_product(a, b) / (sqrt(list_dot_product(a, a)) * sqrt(list_dot_product(b, b)))"


@query("SELECT vec_id, round(sqrt(list_dot_product(e, e)), 4) AS norm, round(e[1] / sqrt(list_dot_product(e, e)), 4) AS first FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings)")
def l2_normalise(spark, d):
    """ARR-1."""
    e = read(spark, d, "embeddings")
    return e.select("vec_id", F.round(V.norm(F.col("embedding")), 4).alias("norm"), F.round(V.normalise(F.col("embedding"))[0], 4).alias("first"))


@query(f"SELECT vec_id, other, round({_COS}, 4) AS cosine FROM (SELECT x.vec_id, y.vec_id AS other, x.embedding::DOUBLE[] AS a, y.embedding::DOUBLE[] AS b FROM embeddings x JOIN embeddings y ON y.vec_id = x.vec_id + 1)")
def cosine_pairs(spark, d):
    """ARR-3: each vector with the next."""
    e = read(spark, d, "embeddings").select("vec_id", "embedding")
    nxt = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("vec_id").alias("other"), F.col("embedding").alias("b"))
    return e.join(nxt, "vec_id").select("vec_id", "other", F.round(V.cosine(F.col("embedding"), F.col("b")), 4).alias("cosine"))


def _base(spark, d) -> tuple[DataFrame, DataFrame]:
    """Queries: every row whose id is divisible by 100; base: all rows, in two classes."""
    e = read(spark, d, "embeddings")
    label = X.verdict(F.pmod("label", F.lit(2)).cast("double"))
    return e.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector")), e.select(F.col("vec_id").alias("kb_id"), F.col("embedding").alias("vector"), label.alias("label"))


_HITS = f"""SELECT query_id, kb_id, label, round({_COS}, 6) AS s FROM (SELECT q.vec_id AS query_id, k.vec_id AS kb_id, CASE WHEN k.label % 2 = 1 THEN 'MALWARE' ELSE 'BENIGN' END AS label,
q.embedding::DOUBLE[] AS a, k.embedding::DOUBLE[] AS b FROM embeddings q, embeddings k WHERE q.vec_id % 100 = 0)"""


def _top(k: int, keys: str) -> str:
    return f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY s DESC, kb_id) AS n FROM ({_HITS})) WHERE n <= {k}"


@query(f"SELECT query_id, kb_id, label, n::INT AS rank, round(s, 4) AS score FROM ({_top(5, 'query_id')})")
def knn_topk(spark, d):
    """VEC-5, JOIN-8, WIN-6, VEC-4."""
    return neighbours.nearest(*_base(spark, d), 5).select("query_id", "kb_id", "label", "rank", F.round("score", 4).alias("score"))


@query(f"SELECT query_id, kb_id, label, n::INT AS rank, round(s, 4) AS score FROM ({_top(3, 'query_id, label')})")
def stratified_knn(spark, d):
    """VEC-6b, WIN-5, FLT-8."""
    return neighbours.nearest(*_base(spark, d), 3, by_label=True).select("query_id", "kb_id", "label", "rank", F.round("score", 4).alias("score"))


@query(f"SELECT query_id, kb_id, label, n2::INT AS rank, round(s, 4) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id, label ORDER BY s DESC, kb_id) AS n2 FROM ({_top(100, 'query_id')})) WHERE n2 <= 3")
def stratified_oversample(spark, d):
    """VEC-6a."""
    return neighbours.oversampled(*_base(spark, d)).select("query_id", "kb_id", "label", "rank", F.round("score", 4).alias("score"))


def _voted(spark, d) -> DataFrame:
    return neighbours.votes(neighbours.nearest(*_base(spark, d), 5), "query_id", 0.2)


_VOTED = f"""SELECT query_id, coalesce(wy / nullif(wy + wn, 0), 0) AS r, vy, vn FROM (SELECT query_id, sum(CASE WHEN s >= 0.2 AND label = 'MALWARE' THEN s * s ELSE 0 END) AS wy,
sum(CASE WHEN s >= 0.2 AND label <> 'MALWARE' THEN s * s ELSE 0 END) AS wn, count(*) FILTER (s >= 0.2 AND label = 'MALWARE') AS vy, count(*) FILTER (s >= 0.2 AND label <> 'MALWARE') AS vn FROM ({_top(5, 'query_id')}) GROUP BY query_id)"""


@query(f"SELECT query_id, CASE WHEN r >= 0.5 THEN 'MALWARE' ELSE 'BENIGN' END AS prediction, CASE WHEN r >= 0.7 OR r <= 0.3 THEN 'HIGH' ELSE 'MEDIUM' END AS confidence, round(r, 4) AS score, vy AS malware_votes, vn AS benign_votes FROM ({_VOTED})")
def knn_vote(spark, d):
    """VEC-8, AGG-11, FLT-7."""
    return _voted(spark, d).select("query_id", "prediction", "confidence", F.round("score", 4).alias("score"), "malware_votes", "benign_votes")


@query(f"""SELECT total, tp, tn, fp, fn, {', '.join(_ROUND)} FROM (SELECT {_RATES} FROM (SELECT {_CELLS} FROM (SELECT CASE WHEN r >= 0.5 THEN 'MALWARE' ELSE 'BENIGN' END AS prediction,
CASE WHEN label % 2 = 1 THEN 'MALWARE' ELSE 'BENIGN' END AS ground_truth FROM ({_VOTED}) JOIN embeddings ON vec_id = query_id)))""")
def knn_evaluation(spark, d):
    """Entry C and D together: neighbour votes, judged against the truth."""
    truth = read(spark, d, "embeddings").select(F.col("vec_id").alias("query_id"), X.verdict(F.pmod("label", F.lit(2)).cast("double")).alias("ground_truth"))
    out = evaluation.metrics(evaluation.confusion(_voted(spark, d).join(truth, "query_id")))
    return out.withColumns({c: F.round(c, 6) for c in ("accuracy", "precision", "recall", "f1", "fpr", "fnr")})


@query(f"""SELECT query_id, family AS top_family FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY w DESC, seen) AS r FROM
(SELECT query_id, e.label::VARCHAR AS family, round(sum(s * s), 9) AS w, min(kb_id) AS seen FROM ({_top(5, 'query_id')}) t JOIN embeddings e ON e.vec_id = kb_id WHERE s >= 0.2 AND t.label = 'MALWARE' GROUP BY ALL)) WHERE r = 1""")
def top_family(spark, d):
    """AGG-12."""
    hits = neighbours.nearest(*_base(spark, d), 5).join(read(spark, d, "embeddings").select(F.col("vec_id").alias("kb_id"), F.col("label").cast("string").alias("family")), "kb_id")
    return neighbours.top_group(hits, "query_id", "family", 0.2)


@query(f"""WITH RECURSIVE h AS (SELECT query_id, kb_id, label, n AS rank, query_id // 1000 AS app, label || ':' || (kb_id % 97) AS claim, row_number() OVER (PARTITION BY query_id // 1000 ORDER BY query_id, label, n) AS i FROM ({_top(20, 'query_id')})),
r AS (SELECT app, 0::BIGINT AS i, -1::BIGINT AS query_id, '' AS label, 0::BIGINT AS kb_id, 0 AS held, []::VARCHAR[] AS claimed, false AS kept FROM (SELECT DISTINCT app FROM h)
UNION ALL SELECT app, i, query_id, label, kb_id, had + ok::INT, CASE WHEN ok THEN list_append(claimed, claim) ELSE claimed END, ok FROM (SELECT *, had < 3 AND NOT list_contains(claimed, claim) AS ok FROM
(SELECT h.*, r.claimed, CASE WHEN r.query_id = h.query_id AND r.label = h.label THEN r.held ELSE 0 END AS had FROM r JOIN h ON h.app = r.app AND h.i = r.i + 1)))
SELECT query_id, kb_id, label FROM r WHERE kept""")
def claim_dedup(spark, d):
    """WIN-7."""
    hits = neighbours.nearest(*_base(spark, d), 20).withColumn("app", F.floor(F.col("query_id") / 1000)).withColumn("claim", F.concat_ws(":", "label", F.pmod("kb_id", F.lit(97)).cast("string")))
    return neighbours.claim(hits, "app", ["query_id", "label", "rank"], "claim", ["query_id", "label"], 3).select("query_id", "kb_id", "label")


@query("SELECT CASE WHEN label % 2 = 1 THEN 'MALWARE' ELSE 'BENIGN' END AS ground_truth, count(*) AS points FROM embeddings GROUP BY 1")
def kb_label_counts(spark, d):
    """AGG-8, SRC-15, SRC-16."""
    return _base(spark, d)[1].groupBy(F.col("label").alias("ground_truth")).agg(F.count("*").alias("points"))


# ---- call graph, groups, budgets, slicing: JOIN-7, AGG-7, WIN-8..12, WIN-15, FLT-15, SLC-*, JOIN-11 ----


@query("""SELECT user_id, event_type, size, row_number() OVER (PARTITION BY user_id ORDER BY CASE WHEN contains(event_type, 'click') THEN 1 ELSE 0 END DESC, size DESC, first_seen)::INT AS group_rank
FROM (SELECT user_id, event_type, count(*) AS size, min(event_id) AS first_seen FROM events GROUP BY ALL)""")
def group_priority(spark, d):
    """WIN-9, AGG-7, PRJ-10."""
    return calls.group_order(read(spark, d, "events"), "user_id", "event_type", "event_id", X.high_risk(F.col("event_type"), ["click"]))


@query("""WITH RECURSIVE d AS (SELECT source, lang, doc_id, md5(text) AS name, length(text) // 3 AS cost FROM documents),
g AS (SELECT source, lang, row_number() OVER (PARTITION BY source ORDER BY CASE WHEN lang = 'de' THEN 1 ELSE 0 END DESC, count(*) DESC, min(doc_id)) AS gr FROM d GROUP BY source, lang),
h AS (SELECT d.*, gr, row_number() OVER (PARTITION BY d.source ORDER BY gr, doc_id) AS i FROM d JOIN g ON d.source = g.source AND d.lang = g.lang),
r AS (SELECT source, '' AS lang, 0::BIGINT AS doc_id, 0::BIGINT AS cost, 0::BIGINT AS i, 0::BIGINT AS gr, false AS shut, 0::BIGINT AS used, []::VARCHAR[] AS names, false AS kept FROM (SELECT DISTINCT source FROM h)
UNION ALL SELECT source, lang, doc_id, cost, i, gr, shut OR (free AND used + cost > 14000), CASE WHEN free AND used + cost <= 14000 THEN used + cost ELSE used END, CASE WHEN free AND used + cost <= 14000 THEN list_append(names, name) ELSE names END, free AND used + cost <= 14000
FROM (SELECT *, NOT shut AND NOT list_contains(names, name) AS free FROM (SELECT h.*, CASE WHEN h.gr = r.gr THEN r.shut ELSE r.used >= 14000 END AS shut, r.used, r.names FROM r JOIN h ON r.source = h.source AND h.i = r.i + 1)))
SELECT source, lang, doc_id, cost FROM r WHERE kept""")
def budget_pack(spark, d):
    """WIN-12."""
    docs = read(spark, d, "documents").select("source", "lang", "doc_id", F.md5("text").alias("name"), X.token_estimate(F.col("text")).alias("cost"))
    ranked = docs.join(calls.group_order(docs, "source", "lang", "doc_id", F.col("lang") == "de"), ["source", "lang"])
    return calls.pack(ranked, "source", "group_rank", "doc_id", "name", "cost", 14_000).select("source", "lang", "doc_id", "cost")


@query(f"""WITH f AS (SELECT DISTINCT sha256, user_id, 'com.u' || (user_id % 50) || '.A.' || CASE WHEN user_id < 50 THEN 'go' ELSE 'm' || user_id END AS fn FROM ({_N})),
c AS (SELECT DISTINCT e.sha256, f.fn AS caller, 'com.u' || ((e.user_id + 1) % 50) || '.A.go' AS callee FROM ({_N}) e JOIN f ON e.sha256 = f.sha256 AND e.user_id = f.user_id WHERE event_id % 4 = 0)
SELECT DISTINCT c.sha256, caller, callee FROM c JOIN f ON c.sha256 = f.sha256 AND c.callee = f.fn""")
def call_edges(spark, d):
    """JOIN-7, GRF-7, STR-8."""
    return calls.call_edges(_slices(spark, d))


@query()
def grouped_document(spark, d):
    """GRF-8, WIN-15, LLM-11's content."""
    return calls.grouped_document(_slices(spark, d), 12_500).select("sha256", "n_functions", "apis", F.md5("document").alias("h"))


@query("""WITH n AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS node FROM events WHERE value > 50),
e AS (SELECT user_id, event_id AS src, lead(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS dst FROM events)
SELECT a.user_id, a.node AS src_node, b.node AS dst_node FROM e JOIN n a ON a.user_id = e.user_id AND a.event_id = src JOIN n b ON b.user_id = e.user_id AND b.event_id = dst""")
def induced_subgraph(spark, d):
    """JOIN-11, SLC-6."""
    e = read(spark, d, "events").select("user_id", "event_id", "value")
    order = W.partitionBy("user_id").orderBy("event_id")
    nodes = e.filter("value > 50").select("user_id", F.col("event_id").alias("unit_id"), F.row_number().over(order).cast("long").alias("node"))
    edges = e.select(F.col("event_id").alias("src"), F.lead("event_id").over(order).alias("dst"))
    return slicing.induced_edges(nodes, edges, "user_id", ())


_CALLEES = (*C.SEED_NAMES, *C.CONTEXT_NAMES, *C.LOADER_NAMES, *C.SOCKET_NAMES, "toString")
_CLASSES = ("android.telephony.TelephonyManager", "java.net.Socket", "dalvik.system.DexClassLoader", "com.ex.MyDao", "java.net.URL", "android.content.ContentResolver", "RuntimeRemoteException")
_QUOTED = lambda names: "[" + ", ".join(f"'{n}'" for n in names) + "]"


@query(f"""SELECT p_partkey, cls, callee, (list_contains({_QUOTED(C.SEED_NAMES)}, callee) OR (list_contains({_QUOTED(C.CONTEXT_NAMES)}, callee) AND regexp_matches(cls, '{"|".join(C.CONTEXT_FRAGMENTS)}'))
OR (list_contains({_QUOTED(C.LOADER_NAMES)}, callee) AND contains(cls, 'ClassLoader')) OR (list_contains({_QUOTED(C.SOCKET_NAMES)}, callee) AND regexp_matches(cls, 'URL|Socket'))) AS seed
FROM (SELECT p_partkey, {_QUOTED(_CLASSES)}[(p_partkey % {len(_CLASSES)})::INT + 1] AS cls, {_QUOTED(_CALLEES)}[(p_partkey % {len(_CALLEES)})::INT + 1] AS callee FROM part)""")
def seed_match(spark, d):
    """FLT-15, SLC-1."""
    pick = lambda names: F.element_at(F.array(*map(F.lit, names)), (F.pmod("p_partkey", F.lit(len(names))) + 1).cast("int"))
    p = read(spark, d, "part").select("p_partkey", pick(_CLASSES).alias("cls"), pick(_CALLEES).alias("callee"))
    return p.withColumn("seed", X.is_seed(F.col("cls"), F.col("callee")))


@query(f"""SELECT name, api_type, category, priority, risky FROM (SELECT unnest({_QUOTED(_CALLEES)}) AS name) JOIN (SELECT 1) ON true,
LATERAL (SELECT CASE WHEN list_contains({_QUOTED(C.TRANSFER_APIS)}, name) THEN 'transfer' ELSE 'access' END AS api_type,
CASE {" ".join(f"WHEN list_contains({_QUOTED(v)}, lower(name)) THEN '{k}'" for k, v in C.API_CATEGORIES.items())} ELSE 'other' END AS category,
CASE WHEN regexp_matches(lower(name), '{"|".join(C.FIRST_PRIORITY)}') THEN 0 WHEN regexp_matches(lower(name), '{"|".join(C.SECOND_PRIORITY)}') THEN 1 ELSE 2 END::INT AS priority,
regexp_matches(name, '{"|".join(x.replace(".", "[.]") for x in C.HIGH_RISK_APIS)}') AS risky)""")
def api_tables(spark, d):
    """PRJ-7..10."""
    names = spark.createDataFrame([(n,) for n in _CALLEES], "name string")
    n = F.col("name")
    return names.select("name", X.api_type(n).alias("api_type"), X.category(n).alias("category"), X.query_priority(n).alias("priority"), X.high_risk(n).alias("risky"))


@query()
def backward_slice(spark, d):
    """SLC-1..8: methods out of events, each event a unit; files as the writer makes them, by length."""
    e = read(spark, d, "events").select(F.col("user_id").alias("method_id"), F.col("event_id").alias("unit_id"), "event_type", "value")
    order = W.partitionBy("method_id").orderBy("unit_id")
    e = e.withColumn("pos", F.row_number().over(order)).withColumn("local", F.concat(F.lit("$r"), F.pmod("unit_id", F.lit(5)).cast("string")))
    units = e.select(
        "method_id", "unit_id", "pos", F.when(F.pmod("unit_id", F.lit(6)) == 0, "if").otherwise("other").alias("kind"), F.concat("local", F.lit(" = "), "event_type").alias("text"),
        F.when(F.col("pos") % 40 == 0, "java.lang.Runtime").alias("callee_class"), F.when(F.col("pos") % 40 == 0, "exec").alias("callee_name"), F.array("local").alias("arg_locals"), F.lit(None).cast("string").alias("base_local"),
    )
    last = F.max("unit_id").over(W.partitionBy("method_id", "local").orderBy("unit_id").rowsBetween(W.unboundedPreceding, -1))
    uses = e.select("method_id", "unit_id", "local").unionByName(e.select("method_id", "unit_id", F.concat(F.lit("$r"), F.pmod(F.col("unit_id") + 1, F.lit(5)).cast("string")).alias("local")).filter("unit_id % 3 = 0"))
    defs = e.select("method_id", "unit_id", "local", last.alias("def_unit_id")).filter("def_unit_id IS NOT NULL")
    edges = e.select("method_id", "unit_id", F.lead("unit_id").over(order).alias("dst")).filter("dst IS NOT NULL").withColumnRenamed("unit_id", "src")
    methods = e.select("method_id").distinct().select("method_id", F.concat(F.lit("com.u"), F.col("method_id").cast("string")).alias("class"), F.lit("go").alias("name"), F.lit(True).alias("concrete"), F.pmod("method_id", F.lit(10)).cast("string").alias("sha256"))
    crit = slicing.criteria(methods, units)
    nodes = slicing.numbered(slicing.slice_units(crit, units, uses, defs, edges), units)
    files = slicing.serialise(crit, methods, nodes, slicing.induced_edges(nodes, edges))
    return S.parse_slices(S.or_nothing(methods.select("sha256").distinct(), files)).select("sha256", "slice_pos", "function_name", F.size("nodes").alias("n_nodes"), F.size("edges").alias("n_edges"))


# ---- responses and tiers: STR-13..17, FLT-17/18, AGG-19, LLM-6..11 ----

_ENDS = ("PREDICTION: BENIGN", "**Final Prediction:** MALWARE", "My final verdict: benign", "I would classify this as malware", "shows spyware and trojan traits", "RISK: critical", "CONFIDENCE: high", "RISK_LEVEL: LOW")


def _answers(spark, d) -> DataFrame:
    end = F.element_at(F.array(*map(F.lit, _ENDS)), (F.pmod(F.col("conv_id") + F.col("turn"), F.lit(len(_ENDS))) + 1).cast("int"))
    return read(spark, d, "conversations").select("conv_id", "turn", F.concat("text", F.lit("\n"), end).alias("text"))


_ANSWERS = f"SELECT conv_id, turn, text || chr(10) || {_QUOTED(_ENDS)}[((conv_id + turn) % {len(_ENDS)})::INT + 1] AS text FROM conversations"
_SIGNALS = " + ".join(f"contains(upper(text), '{s}')::INT" for s in C.SIGNALS)


@query(f"""WITH l AS (SELECT conv_id, turn, text, list_transform(string_split(text, chr(10)), lambda x: upper(trim(trim(trim(x), '*')))) AS lines FROM ({_ANSWERS})),
m AS (SELECT *, list_filter(list_transform(lines, lambda x: CASE WHEN regexp_matches(x, '^(FINAL )?PREDICTION.*:.*MALWARE') THEN 'MALWARE' WHEN regexp_matches(x, '^(FINAL )?PREDICTION.*:.*BENIGN') THEN 'BENIGN' END), lambda x: x IS NOT NULL) AS a,
list_filter(list_transform(lines, lambda x: CASE WHEN contains(x, 'MALWARE') AND regexp_matches(x, 'PREDICTION|FINAL|VERDICT') THEN 'MALWARE' WHEN contains(x, 'BENIGN') AND regexp_matches(x, 'PREDICTION|FINAL|VERDICT') THEN 'BENIGN'
WHEN starts_with(x, 'MALWARE') THEN 'MALWARE' WHEN starts_with(x, 'BENIGN') THEN 'BENIGN' END), lambda x: x IS NOT NULL) AS b FROM l)
SELECT conv_id, turn, coalesce(a[1], b[1], CASE WHEN regexp_matches(upper(text), '({"|".join(C.SAYINGS)}) BENIGN') THEN 'BENIGN' WHEN regexp_matches(upper(text), '({"|".join(C.SAYINGS)}) MALWARE') THEN 'MALWARE' END,
CASE WHEN {_SIGNALS} >= 2 THEN 'MALWARE' ELSE 'BENIGN' END) AS verdict, ({_SIGNALS})::INT AS signals FROM m""")
def verdict_parse(spark, d):
    """STR-14, AGG-19."""
    return _answers(spark, d).select("conv_id", "turn", R.final_verdict(F.col("text")).alias("verdict"), R.signal_count(F.col("text")).alias("signals"))


def _risk_sql(mark: str, high: str, critical: str = "") -> str:
    line = f"list_filter(list_transform(string_split(text, chr(10)), lambda x: upper(x)), lambda x: contains(x, '{mark}') OR contains(x, 'RISK:'))[1]"
    return f"CASE {critical.format(line)} WHEN regexp_matches({line}, '{high}') THEN 'HIGH' WHEN contains({line}, 'MEDIUM') THEN 'MEDIUM' WHEN contains({line}, 'LOW') THEN 'LOW' ELSE 'UNKNOWN' END"


@query(f"SELECT conv_id, turn, {_risk_sql('RISK_ASSESSMENT:', 'HIGH|CRITICAL')} AS tier1, {_risk_sql('RISK_LEVEL:', 'HIGH', chr(87) + 'HEN contains({0}, ' + chr(39) + 'CRITICAL' + chr(39) + ') THEN ' + chr(39) + 'CRITICAL' + chr(39))} AS tier2 FROM ({_ANSWERS})")
def risk_parse(spark, d):
    """STR-13."""
    return _answers(spark, d).select("conv_id", "turn", R.risk(F.col("text"), 1).alias("tier1"), R.risk(F.col("text"), 2).alias("tier2"))


@query(f"""SELECT conv_id, turn, coalesce(upper(trim(regexp_replace(list_filter(string_split(text, chr(10)), lambda x: starts_with(upper(trim(x)), 'CONFIDENCE:'))[1], '^[^:]*:', ''))), 'UNKNOWN') AS confidence,
CASE WHEN len(list_filter(string_split(text, chr(10)), lambda x: (contains(upper(x), 'MALWARE') AND regexp_matches(upper(x), 'PREDICTION|FINAL')) OR starts_with(trim(upper(x), ' *'), 'MALWARE'))) > 0 THEN 'MALWARE' ELSE 'BENIGN' END AS log_verdict FROM ({_ANSWERS})""")
def confidence_and_log(spark, d):
    """STR-15, STR-16."""
    return _answers(spark, d).select("conv_id", "turn", R.confidence(F.col("text"), F.lit("BENIGN")).alias("confidence"), R.log_verdict(F.col("text")).alias("log_verdict"))


@query(f"""SELECT conv_id, turn, CASE WHEN length(trim(text)) < 100 THEN 'too short' WHEN NOT contains(lower(text), 'the') THEN 'API not mentioned'
WHEN NOT regexp_matches(lower(text), 'risk|behavior|behaviour|data_flow') THEN 'no risk or behaviour' ELSE 'OK' END AS sanity FROM ({_ANSWERS})""")
def sanity_check(spark, d):
    """FLT-18."""
    return _answers(spark, d).select("conv_id", "turn", R.sanity(F.col("text"), F.lit("a.b.The")).alias("sanity"))


@query("""WITH f AS (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN '=== SLICER_VERSION: 2 ===' || chr(10) || text WHEN 1 THEN '=== SLICER_VERSION: 1 ===' || chr(10) || text WHEN 2 THEN '=== SLICER_VERSION: x ===' || chr(10) || text
WHEN 3 THEN text || chr(10) || 'SUSPICIOUS_API: openConnection' ELSE text || chr(10) || 'SUSPICIOUS_API: forName' END AS c FROM documents)
SELECT doc_id, doc_id % 5 IN (0, 3) AS fresh, ['version 2', 'version 1 < 2', 'malformed version header', 'marker openConnection', 'no header, no marker'][(doc_id % 5)::INT + 1] AS reason FROM f""")
def staleness(spark, d):
    """FLT-17, AGG-16, STR-3."""
    m, t = F.pmod("doc_id", F.lit(5)), F.col("text")
    head = lambda x: F.concat(F.lit(f"=== SLICER_VERSION: {x} ===\n"), t)
    tail = lambda x: F.concat(t, F.lit(f"\nSUSPICIOUS_API: {x}"))
    content = F.when(m == 0, head("2")).when(m == 1, head("1")).when(m == 2, head("x")).when(m == 3, tail("openConnection")).otherwise(tail("forName"))
    return S.staleness(read(spark, d, "documents").select("doc_id", content.alias("content")))


#: What the offline model notices of an app's calls: more than one of its signs is HIGH.
_NOTICED = "count(DISTINCT CASE user_id % 5 WHEN 0 THEN 'getDeviceId' WHEN 1 THEN 'exec' WHEN 3 THEN 'sendTextMessage' END)"
_OFFLINE = f"SELECT event_type AS sha256, CASE WHEN {_NOTICED} > 1 THEN 'MALWARE' ELSE 'BENIGN' END AS prediction"


@query(f"{_OFFLINE} FROM events GROUP BY 1")
def tier_rollup(spark, d):
    """LLM-6..10 with the offline model."""
    s = _slices(spark, d)
    return reasoning.three_tiers(s.select("sha256").distinct(), s, models.RuleModel(), verify=True).select("sha256", "prediction")


@query(f"{_OFFLINE}, CASE {_NOTICED} WHEN 0 THEN 'LOW' WHEN 1 THEN 'MEDIUM' ELSE 'HIGH' END AS confidence FROM events GROUP BY 1")
def single_call(spark, d):
    """LLM-11 with the offline model."""
    s = _slices(spark, d)
    return reasoning.single_call(s.select("sha256").distinct(), s, models.RuleModel()).select("sha256", "prediction", "confidence")


@query()
def knn_classify(spark, d):
    """VEC-1..3, VEC-8, WIN-8, WIN-11: a knowledge base of all slices, and every app asked about."""
    s = _slices(spark, d)
    labels = s.select("sha256").distinct().select("sha256", F.pmod(F.length("sha256"), F.lit(2)).alias("label"), F.col("sha256").alias("family"))
    return retrieval.knn_classify(labels, s, retrieval.build_kb(s, labels)).drop("analysis")


@query("SELECT doc_id, md5(trim(text, ' ' || chr(10))) AS h FROM documents JOIN labels USING (doc_id)")
def instruction_records(spark, d):
    """PRJ-5 through the plan."""
    files = read(spark, d, "documents").select(F.col("doc_id").alias("sha256"), F.col("text").alias("content"))
    truth = read(spark, d, "labels").select(F.col("doc_id").alias("sha256"), F.col("doc_id").cast("string").alias("verdict"))
    return curation.instruction_records(files, truth).select(F.col("output").cast("long").alias("doc_id"), F.md5("input").alias("h"))

"""Queries of the sources, sinks and plans: what is written is read again by the library's own readers, and has its SQL.

Files go to a folder of their own in the shared one, and are dropped with the application.
"""

from __future__ import annotations

import io

import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cograph.functions import constants as C
from cograph.functions import responses as R
from cograph.functions import text as X
from cograph.functions import vectors as V
from cograph.operators import evaluation, joins, rows
from cograph.plans import curation, extraction, models, reasoning
from cograph.queries import _CELLS, _JUDGED, _N, _QUOTED, _RATES, _ROUND, _ANSWERS, SQL, _answers, _files, _judged, _slices, query, read
from cograph.sources import archives, ir, knowledge, labels, predictions, sinks, stores
from cograph.sources import slices as S
from cograph.streaming import incremental


def _in_order(df: DataFrame, *order: str) -> DataFrame:
    """Dealt so that the files' names and the rows in them follow the order."""
    return df.repartitionByRange(4, *order).sortWithinPartitions(*order)


# ---- labels: SRC-1..5, FLT-1, WIN-17, SNK-6 ----


def _label_rows(spark: SparkSession, d: str) -> DataFrame:
    """Keys in two cases, null keys, families with a blank before them, and labels that are missing."""
    docs, truth = read(spark, d, "documents").select("doc_id", "source", "lang"), read(spark, d, "labels").select("doc_id", "toxic")
    key = F.when(F.pmod("doc_id", F.lit(11)) != 0, F.concat(F.lit("K"), (F.col("doc_id") - F.pmod("doc_id", F.lit(3))).cast("string")))
    both = docs.join(truth, "doc_id", "left")
    return both.select("doc_id", F.when(F.pmod("doc_id", F.lit(2)) == 0, F.lower(key)).otherwise(key).alias("sha256"), F.concat(F.lit(" "), "source").alias("family"), F.col("toxic").cast("double").alias("label"))


def _label_file(spark: SparkSession, d: str) -> DataFrame:
    path = stores.scratch(spark, "labels")
    labels.write_labels(_in_order(_label_rows(spark, d), "doc_id"), path)
    return labels.read_labels(spark, path)


_LABELS = "(SELECT d.doc_id, CASE WHEN d.doc_id % 11 <> 0 THEN 'k' || (d.doc_id - d.doc_id % 3) END AS sha256, source AS family, toxic::DOUBLE AS label FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"
_FIRST = f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sha256 ORDER BY doc_id) AS n FROM {_LABELS} WHERE sha256 IS NOT NULL) WHERE n = 1)"


@query(f"SELECT sha256, family, label FROM {_FIRST} ORDER BY doc_id LIMIT 60 OFFSET 5")
def label_scan(spark, d):
    """SRC-1, FLT-1, WIN-17, WIN-13: a page of a label file in file order."""
    return labels.scan_labels(_label_file(spark, d), limit=60, offset=5).select("sha256", "family", "label")


@query(f"SELECT sha256 FROM {_FIRST}")
def hash_scan(spark, d):
    """SRC-2."""
    return labels.scan_hashes(_label_file(spark, d)).select("sha256")


@query(f"SELECT sha256, CASE WHEN label = 1 THEN 'MALWARE (family: ' || family || ')' ELSE 'BENIGN' END AS verdict FROM {_FIRST}")
def truth_scan(spark, d):
    """SRC-3, PRJ-4."""
    return labels.ground_truth(_label_file(spark, d))


@query(f"SELECT sha256, label::INT AS label, family FROM (SELECT *, row_number() OVER (PARTITION BY sha256 ORDER BY doc_id DESC) AS n FROM {_LABELS} WHERE sha256 IS NOT NULL) WHERE n = 1")
def kb_label_scan(spark, d):
    """SRC-4: the last row of a key wins."""
    return labels.kb_labels(_label_file(spark, d))


@query(f"""WITH u AS (SELECT sha256, label, 0 AS p, doc_id FROM {_LABELS} WHERE doc_id % 5 = 0 UNION ALL SELECT sha256, label, 1, doc_id FROM {_LABELS})
SELECT sha256, label, p AS src_prio FROM (SELECT *, row_number() OVER (PARTITION BY sha256 ORDER BY p, doc_id) AS n FROM u WHERE sha256 IS NOT NULL) WHERE n = 1""")
def label_union(spark, d):
    """SRC-5, SET-1, SET-2: two label tables, the first winning."""
    rows_ = _label_rows(spark, d).withColumnRenamed("doc_id", "row_pos")
    return labels.union_labels(rows_.filter("row_pos % 5 = 0"), rows_).select("sha256", "label", "src_prio")


@query("SELECT toxic, (n - 1) // 5 AS split, count(*) AS n_rows FROM (SELECT *, row_number() OVER (PARTITION BY toxic ORDER BY md5('s2:' || doc_id), doc_id) AS n FROM labels) WHERE n <= 15 GROUP BY ALL")
def split_files(spark, d):
    """SNK-6, WIN-16, AGG-15: balanced splits as CSV files, read back and counted."""
    path = stores.scratch(spark, "splits")
    sinks.write_csv(rows.balanced_splits(read(spark, d, "labels"), "toxic", "doc_id", 5, 3, "s2"), path)
    back = spark.read.option("header", True).schema("doc_id long, quality int, toxic int, split long").csv(path)
    return back.groupBy("toxic", "split").agg(F.count("*").alias("n_rows"))


# ---- slice files: SRC-6, SRC-7, SNK-13, FLT-4, FLT-5, AGG-16, SNK-16, INC-1..4 ----


@query(f"SELECT sha256, count(DISTINCT user_id) AS n_slices, count(*) AS n_nodes FROM ({_N}) GROUP BY sha256")
def slice_file_scan(spark, d):
    """SRC-6, SRC-7, SNK-13: slice files under their own names, read back and parsed."""
    path = stores.scratch(spark, "slices")
    sinks.write_slice_files(_files(spark, d).withColumn("sha256", F.upper("sha256")), path)
    parsed = S.parse_slices(S.read_slice_files(spark, path).select("sha256", "content"))
    return parsed.groupBy("sha256").agg(F.count("*").alias("n_slices"), F.sum(F.size("nodes")).alias("n_nodes"))


@query(f"SELECT sha256, count(DISTINCT user_id) AS kept FROM ({_N}) GROUP BY sha256")
def no_filter(spark, d):
    """FLT-4: without the framework filter only repeated contents go."""
    two = _slices(spark, d).unionByName(_slices(spark, d).withColumn("slice_pos", F.col("slice_pos") + 1000))
    named = two.withColumn("function_name", F.concat(F.lit("android."), "function_name"))
    return reasoning.cleaned(named, no_filter=True).groupBy("sha256").agg(F.count("*").alias("kept"))


@query(f"SELECT doc_id FROM (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN substr(text, 1, 55) WHEN 1 THEN text || '{C.NOTHING_FOUND}' ELSE text END AS c FROM documents) WHERE length(trim(c, ' ' || chr(10) || chr(9) || chr(13))) >= 50 AND NOT contains(c, '{C.NOTHING_FOUND}')")
def worth_parsing(spark, d):
    """FLT-5: the rule itself."""
    m = F.pmod("doc_id", F.lit(3))
    content = F.when(m == 0, F.substring("text", 1, 55)).when(m == 1, F.concat("text", F.lit(C.NOTHING_FOUND))).otherwise(F.col("text"))
    return read(spark, d, "documents").select("doc_id", content.alias("c")).filter(S.worth_parsing(F.col("c"))).select("doc_id")


def _states(spark, d) -> DataFrame:
    m = F.pmod("doc_id", F.lit(5))
    content = F.when(m == 0, f"{C.VERSION_MARK} 2 ===\nx").when(m == 1, f"{C.VERSION_MARK} 1 ===\nx").when(m == 2, "x").when(m == 3, "SUSPICIOUS_API: openConnection").otherwise("SUSPICIOUS_API: exec")
    return S.staleness(read(spark, d, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("path"), content.alias("content")))


@query("SELECT count(*) FILTER (doc_id % 5 IN (0, 3)) AS fresh, count(*) FILTER (doc_id % 5 NOT IN (0, 3)) AS stale, count(*) FILTER (doc_id % 5 = 3) AS rescued FROM documents")
def fresh_counts(spark, d):
    """AGG-16, FLT-17."""
    return evaluation.fresh_counts(_states(spark, d))


@query("SELECT 'd' || doc_id AS path, CASE doc_id % 5 WHEN 1 THEN 'version 1 < 2' ELSE 'no header, no marker' END AS reason FROM documents WHERE doc_id % 5 IN (1, 2, 4)")
def stale_files(spark, d):
    """SNK-16: what a clean-up would delete; without a confirmation nothing is."""
    return sinks.stale_paths(_states(spark, d))


@query(f"SELECT sha256, count(DISTINCT user_id) AS n_slices FROM ({_N}) GROUP BY sha256")
def streamed_files(spark, d):
    """INC-1, INC-2: a stream over a folder of slice files, run three times; the last run finds nothing new."""
    path, out, seen = stores.scratch(spark, "stream"), stores.scratch(spark, "streamed"), stores.scratch(spark, "checkpoint")
    files = _files(spark, d)
    first = F.pmod(F.length("sha256"), F.lit(2)) == 0
    for part in (first, ~first, None):
        if part is not None:
            for name in stores.files_below(spark, _slice_folder(spark, files.filter(part)), r"_cfg\.txt$"):
                stores.rename(spark, name, f"{path}/{name.rsplit('/', 1)[-1]}")
        incremental.run_available(incremental.new_slice_files(spark, path), seen, incremental.resumed_append(out))
    return S.parse_slices(spark.read.parquet(out)).groupBy("sha256").agg(F.count("*").alias("n_slices"))


def _slice_folder(spark: SparkSession, files: DataFrame) -> str:
    path = stores.scratch(spark, "part")
    sinks.write_slice_files(files, path)
    return path


@query("SELECT (SELECT count(DISTINCT doc_id) FROM labels) AS done, (SELECT count(*) FROM documents) AS total, round(least(1.0, (SELECT count(DISTINCT doc_id) FROM labels) / (SELECT count(*) FROM documents)), 6) AS share")
def progress(spark, d):
    """INC-4, AGG-20: the share done, at most 1."""
    out = incremental.progress(read(spark, d, "labels"), read(spark, d, "documents"), "doc_id")
    return out.withColumn("share", F.round("share", 6))


# ---- predictions, logs, evaluation: SRC-9..12, SNK-1..5, SNK-15, FLT-11, FLT-14, AGG-13..15, WIN-18, LLM-13 ----


def _records(spark, d) -> DataFrame:
    return _judged(spark, d).select(F.col("doc_id").cast("string").alias("sha256"), "prediction", "ground_truth", F.col("source").alias("family"), F.col("lang").alias("analysis"))


_RECORDS = f"(SELECT doc_id::VARCHAR AS sha256, prediction, ground_truth, source AS family, lang AS analysis, doc_id FROM {_JUDGED})"


@query(f"SELECT sha256, prediction, ground_truth, family, analysis FROM {_RECORDS}")
def prediction_log(spark, d):
    """SRC-9, SNK-1, SNK-2, SET-3: a run stopped and resumed: the first write keeps what was done, later ones append what is new."""
    path, every = stores.scratch(spark, "predictions"), _records(spark, d)
    part = lambda k: every.filter(F.pmod(F.col("sha256").cast("long"), F.lit(3)) == k)
    sinks.append_predictions(part(0), path)
    done = predictions.read_predictions(spark, path)
    sinks.rewrite_predictions(part(0).unionByName(part(1)), path, done)
    sinks.append_predictions(every, path, predictions.read_predictions(spark, path))
    return predictions.read_predictions(spark, path)


@query(f"SELECT sha256, prediction FROM {_RECORDS} WHERE doc_id % 4 = 0")
def lenient_log(spark, d):
    """SRC-10: blank and broken lines, and records without a key, are passed over."""
    path, m = stores.scratch(spark, "lenient"), F.pmod(F.col("sha256").cast("long"), F.lit(4))
    line = F.when(m == 0, F.to_json(F.struct("sha256", "prediction"))).when(m == 1, "").when(m == 2, '{"sha256": broken').otherwise(F.to_json(F.struct("prediction")))
    _records(spark, d).select(line.alias("value")).write.text(path)
    return predictions.read_predictions(spark, path, strict=False).select("sha256", "prediction")


def _log_files(spark, d) -> tuple[str, str]:
    """Two folders of logs: all keys in the first but every third, all in the second, where they say something else."""
    text = _answers(spark, d).groupBy(F.pmod("conv_id", F.lit(30)).alias("k")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("conv_id", "turn", "text"))), lambda x: x["text"]), "\n").alias("content"))
    key = F.concat(F.lit("LOG"), F.col("k").cast("string")).alias("sha256")
    out = stores.scratch(spark, "logs-a"), stores.scratch(spark, "logs-b")
    sinks.write_slice_files(text.filter("k % 3 <> 0").select(key, "content"), out[0], suffix=".log")
    sinks.write_slice_files(text.select(key, F.lit("Final prediction: MALWARE").alias("content")), out[1], suffix=".log")
    return out


_TALKS = f"(SELECT (conv_id % 30) AS k, string_agg(text, chr(10) ORDER BY conv_id, turn) AS content FROM ({_ANSWERS}) GROUP BY 1)"
_SAYS = "len(list_filter(string_split(content, chr(10)), lambda x: (contains(upper(x), 'MALWARE') AND regexp_matches(upper(x), 'PREDICTION|FINAL')) OR starts_with(trim(upper(x), ' *'), 'MALWARE'))) > 0"
_LOGS = f"(SELECT 'log' || k AS sha256, k % 3 = 0 OR {_SAYS} AS bad, k FROM {_TALKS})"


@query(f"SELECT sha256, CASE WHEN bad THEN 'MALWARE' ELSE 'BENIGN' END AS prediction FROM {_LOGS} ORDER BY sha256 LIMIT 15 OFFSET 4")
def log_scan(spark, d):
    """SRC-11, SRC-12, LLM-13, PRJ-20: a page of the logs of two folders, the first winning."""
    return predictions.log_records(predictions.read_logs(spark, *_log_files(spark, d), offset=4, limit=15)).select("sha256", "prediction")


@query(f"SELECT CASE WHEN k % 2 = 0 THEN 'labelled' ELSE 'unlabelled' END AS part, sha256, CASE WHEN bad THEN 'MALWARE' ELSE 'BENIGN' END AS prediction, CASE WHEN k % 2 = 0 THEN 'BENIGN' ELSE 'UNKNOWN' END AS ground_truth FROM {_LOGS}")
def labelled_log_file(spark, d):
    """SNK-5, FLT-14, JOIN-3: labelled logs as JSON lines, read back and parted by whether a label was found."""
    path = stores.scratch(spark, "labelled")
    logs = predictions.read_logs(spark, *_log_files(spark, d))
    known = spark.range(0, 30, 2).select(F.concat(F.lit("log"), F.col("id").cast("string")).alias("sha256"), F.lit(0.0).alias("label"), F.lit(" x").alias("family"))
    sinks.write_json(curation.labelled_logs(logs, known), path)
    parts = zip(("labelled", "unlabelled"), curation.split_labelled(predictions.read_predictions(spark, path)))
    one, two = (p.select(F.lit(name).alias("part"), "sha256", "prediction", "ground_truth") for name, p in parts)
    return one.unionByName(two)


@query("SELECT doc_id::VARCHAR AS output, md5(trim(text, ' ' || chr(10))) AS h FROM documents JOIN labels USING (doc_id)")
def instruction_file(spark, d):
    """SNK-4: instruction records as JSON lines; a second run adds nothing."""
    path, schema = stores.scratch(spark, "instructions"), "instruction string, input string, output string"
    files = read(spark, d, "documents").select(F.col("doc_id").alias("sha256"), F.col("text").alias("content"))
    truth = read(spark, d, "labels").select(F.col("doc_id").alias("sha256"), F.col("doc_id").cast("string").alias("verdict"))
    records = curation.instruction_records(files, truth)
    for done in (None, True):
        sinks.append_predictions(records, path, done and spark.read.schema(schema).json(path), "output")
    return spark.read.schema(schema).json(path).select("output", F.md5("input").alias("h"))


@query(f"SELECT total, tp, tn, fp, fn, {', '.join(_ROUND)} FROM (SELECT {_RATES} FROM (SELECT {_CELLS} FROM {_JUDGED} WHERE doc_id % 3 <> 0))")
def evaluated(spark, d):
    """FLT-11, AGG-2 through the plan: records without a truth do not count."""
    records = _records(spark, d).withColumn("ground_truth", F.when(F.col("sha256").cast("long") % 3 != 0, F.col("ground_truth")))
    return curation.evaluate(records)[0].withColumns({c: F.round(c, 6) for c in ("accuracy", "precision", "recall", "f1", "fpr", "fnr")})


@query(f"SELECT coalesce(a.family, b.family) AS found, r.sha256 FROM {_RECORDS} r LEFT JOIN (SELECT sha256, family FROM {_RECORDS} WHERE doc_id % 3 = 0) a USING (sha256) LEFT JOIN (SELECT sha256, analysis AS family FROM {_RECORDS} WHERE doc_id % 3 = 1) b USING (sha256)")
def fallback_labels(spark, d):
    """JOIN-5: a value from the first table that has the key, else from the second."""
    every, m = _records(spark, d), F.pmod(F.col("sha256").cast("long"), F.lit(3))
    first, second = every.filter(m == 0).select("sha256", F.col("family").alias("found")), every.filter(m == 1).select("sha256", F.col("analysis").alias("found"))
    return joins.with_fallback(every.select("sha256"), first, second, "found")


@query(f"SELECT count(*) AS total, count(*) FILTER (prediction = ground_truth) AS correct, round(avg(doc_id % 50), 6) AS mean_seconds FROM {_JUDGED}")
def mean_seconds(spark, d):
    """AGG-14."""
    timed = _judged(spark, d).withColumn("seconds", F.pmod("doc_id", F.lit(50)).cast("double"))
    return evaluation.run_summary(timed, seconds="seconds").select("total", "correct", F.round("mean_seconds", 6).alias("mean_seconds"))


@query(f"SELECT source || '-' || lang AS family, count(*) AS total, count(*) FILTER (prediction = 'MALWARE') AS detected FROM {_JUDGED} WHERE ground_truth = 'MALWARE' GROUP BY 1 ORDER BY total DESC, family LIMIT 15")
def top_groups(spark, d):
    """WIN-18: the fifteen groups that a report shows."""
    rates = evaluation.group_rates(_judged(spark, d), X.normal_family(F.concat_ws("-", "source", "lang")), "doc_id")
    return evaluation.top_groups(rates).select("family", "total", "detected")


# ---- projections: PRJ-3, PRJ-17, PRJ-18, SNK-17, STR-17, STR-12 ----


@query("SELECT doc_id, CASE doc_id % 3 WHEN 1 THEN 'MALWARE' WHEN 0 THEN 'BENIGN' END AS verdict FROM documents")
def tri_state(spark, d):
    """PRJ-3."""
    label = F.when(F.pmod("doc_id", F.lit(3)) < 2, F.pmod("doc_id", F.lit(3)).cast("double"))
    return read(spark, d, "documents").select("doc_id", X.verdict_or_null(label).alias("verdict"))


@query("""SELECT doc_id, CASE WHEN p >= 80 THEN 'green' WHEN p >= 50 THEN 'yellow' ELSE 'red' END AS accuracy, CASE WHEN p <= 5 THEN 'green' WHEN p <= 20 THEN 'yellow' ELSE 'red' END AS error,
printf('%.2f%%', p::DOUBLE) AS shown, rpad(repeat('#', p // 5), 20, '.') AS bar FROM (SELECT doc_id, (doc_id % 21 * 5)::INT AS p FROM documents)""")
def bands(spark, d):
    """PRJ-17, PRJ-18, SNK-17."""
    p = (F.pmod("doc_id", F.lit(21)) * 5).cast("int")
    shares = read(spark, d, "documents").select("doc_id", X.accuracy_band(p).alias("accuracy"), X.error_band(p).alias("error"), X.percentage(p / 100).alias("shown"), (p / 100).alias("share"))
    return sinks.bars(shares, "share").drop("share")


@query(f"""SELECT conv_id, turn, NOT contains(upper(t), 'INCONSISTENT') AS consistent, CASE WHEN contains(upper(t), 'INCONSISTENT') THEN CASE WHEN conv_id % 2 = 0 THEN 'not in the code' ELSE 'Consistency check failed' END ELSE 'OK' END AS reason
FROM (SELECT conv_id, turn, replace(replace(text, 'REASON:', ''), 'reason:', '') || chr(10) || 'VERDICT: ' || CASE WHEN turn % 2 = 0 THEN 'CONSISTENT' ELSE 'inconsistent' END || chr(10) || CASE WHEN conv_id % 2 = 0 THEN ' Reason:  not in the code ' ELSE '' END AS t FROM ({_ANSWERS}))""")
def consistency(spark, d):
    """STR-17."""
    bare = F.replace(F.replace("text", F.lit("REASON:"), F.lit("")), F.lit("reason:"), F.lit(""))
    end = F.concat(F.lit("\nVERDICT: "), F.when(F.pmod("turn", F.lit(2)) == 0, "CONSISTENT").otherwise("inconsistent"), F.lit("\n"), F.when(F.pmod("conv_id", F.lit(2)) == 0, " Reason:  not in the code ").otherwise(""))
    return _answers(spark, d).select("conv_id", "turn", R.consistency(F.concat(bare, end)).alias("c")).select("conv_id", "turn", "c.consistent", "c.reason")


@query("SELECT event_id, (props ->> '$.k')::BIGINT AS k FROM events")
def json_file(spark, d):
    """STR-12, SNK-3: records written as JSON lines, over what was there, and read back."""
    path = stores.scratch(spark, "json")
    record = read(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))
    for _ in range(2):
        sinks.write_json(record, path)
    return spark.read.schema("event_id long, k long").json(path)


# ---- knowledge base: SRC-13..16, SNK-8, SNK-10..12, INC-3, AGG-8, ARR-2, VEC-1..3 ----


def _kb_path(spark, d) -> str:
    """A store made of two loads: ids of the second that the first has win; a save on what is there does nothing."""
    path = stores.scratch(spark, "kb")
    e = read(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("sha256"), F.lit("f").alias("function_name"), F.lit("a").alias("suspicious_api"), F.lit(0).alias("slice_pos"), X.verdict(F.pmod("label", F.lit(2)).cast("double")).alias("ground_truth"), F.col("embedding").alias("vector"))
    first = knowledge.upsert(None, e.filter("sha256 % 3 <> 0").withColumn("ground_truth", F.lit("BENIGN")))
    knowledge.save(knowledge.upsert(first, e.filter("sha256 % 3 <> 1")), path)
    knowledge.save(first, path)
    return path


_KB = "(SELECT vec_id, CASE WHEN vec_id % 3 = 1 OR label % 2 <> 1 THEN 'BENIGN' ELSE 'MALWARE' END AS ground_truth, embedding::DOUBLE[] AS e FROM embeddings)"


@query(f"SELECT vec_id::VARCHAR AS sha256, ground_truth, round(e[1] / sqrt(list_dot_product(e, e)), 4) AS first FROM {_KB}")
def kb_store(spark, d):
    """SRC-13, SRC-14, SNK-8, SNK-10..12, INC-3."""
    return knowledge.load(spark, _kb_path(spark, d)).select("sha256", "ground_truth", F.round(F.col("vector")[0], 4).alias("first"))


@query(f"SELECT ground_truth, count(*) AS points, (SELECT count(*) FROM embeddings) AS total, round(least(1.0, (SELECT count(*) FROM embeddings) / 100000.0), 6) AS progress, true AS stored FROM {_KB} GROUP BY 1")
def kb_statistics(spark, d):
    """SRC-15, AGG-8: points and share of a target, and what the partitions hold on disk."""
    path = _kb_path(spark, d)
    stats, disk = knowledge.statistics(knowledge.load(spark, path), 100_000), knowledge.storage(spark, path)
    both = stats.join(disk.withColumnRenamed("points", "held"), "ground_truth")
    return both.select("ground_truth", "points", F.col("total").cast("long").alias("total"), F.round("progress", 6).alias("progress"), ((F.col("held") == F.col("points")) & (F.col("files") > 0) & (F.col("bytes") > 0)).alias("stored"))


@query(f"SELECT count(*) AS n FROM {_KB} WHERE ground_truth = 'MALWARE'")
def kb_count(spark, d):
    """SRC-16."""
    return spark.createDataFrame([(knowledge.count_where(knowledge.load(spark, _kb_path(spark, d)), "ground_truth", "MALWARE"),)], "n long")


@query("""SELECT vec_id, len(e)::INT + 2 AS dim, round(g / sqrt(g * g + 1), 4) AS tail, round(sqrt(list_dot_product(e, e) + 1), 4) AS norm
FROM (SELECT vec_id, embedding::DOUBLE[] AS e, (label % 3 + 1)::DOUBLE AS g FROM embeddings)""")
def hybrid_vector(spark, d):
    """ARR-2, VEC-3: a text part and a graph part of length 1, one after another."""
    graph = F.array((F.pmod("label", F.lit(3)) + 1).cast("double"), F.lit(1.0))
    v = read(spark, d, "embeddings").select("vec_id", V.hybrid(F.col("embedding"), graph).alias("v"))
    return v.select("vec_id", F.size("v").alias("dim"), F.round(F.element_at("v", -2), 4).alias("tail"), F.round(V.norm(F.col("v")), 4).alias("norm"))


@query("SELECT doc_id, 384 AS dim, CASE WHEN len(regexp_extract_all(text, '[^\\s]+')) > 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS norm FROM documents")
def text_embedding(spark, d):
    """VEC-1, VEC-2: the offline embedder's vectors have their dimension and length 1."""
    e = read(spark, d, "documents").select("doc_id", V.embedding(F.col("text")).alias("e"))
    return e.select("doc_id", F.size("e").alias("dim"), F.round(V.norm(F.col("e")), 4).alias("norm"))


# ---- extraction: SRC-17..20, JOIN-6, JOIN-10, JOIN-12, FLT-16, SNK-15, AGG-13, SLC-1..5 ----

_INSIDE = ("AndroidManifest.xml", "classes.dex", "lib/x/libjiagu.so", "a/libshell.so")


def _archive(kind: int) -> bytes:
    """0: complete; 1: packed; 2: no code; 3: no manifest; 4: cut short."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for at, name in enumerate(_INSIDE):
            if (at == 0 and kind != 3) or (at == 1 and kind not in (1, 2)) or (at > 1 and kind == 1):
                z.writestr(name, "x" * 50)
    return out.getvalue()[: 60 if kind == 4 else None]


def _archives(spark, d) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        made = [_archive(k) for k in range(5)]
        for batch in batches:
            content = [made[i % 5] for i in batch["doc_id"]]
            yield pd.DataFrame({"path": [f"{i}.apk" for i in batch["doc_id"]], "length": [len(c) for c in content], "content": content})

    return read(spark, d, "documents").select("doc_id").mapInPandas(run, "path string, length long, content binary")


@query(f"SELECT doc_id || '.apk' AS path, doc_id % 5 IN (0, 1, 2) AS valid, CASE doc_id % 5 WHEN 1 THEN 'Qihoo 360 / Jiagu' WHEN 2 THEN '{C.MISSING_DEX}' END AS packer FROM documents")
def archive_states(spark, d):
    """SRC-17, SRC-18, JOIN-12."""
    return archives.inspect(_archives(spark, d)).select("path", "valid", "packer")


class _Shelf:
    """A fetcher without a network: every seventh key is gone."""

    def fetch(self, key: str) -> bytes:
        if int(key) % 7 == 0:
            raise OSError("gone")
        return _archive(int(key) % 5)


class _Slicer:
    def slices(self, key: str, data: bytes) -> str:
        if int(key) % 11 == 0:
            raise TimeoutError("too long")
        return f"slices of {key}"


_OUTCOME = "CASE WHEN doc_id % 7 = 0 THEN 'download' WHEN doc_id % 5 IN (3, 4) THEN 'invalid' WHEN doc_id % 5 IN (1, 2) THEN 'packed' WHEN doc_id % 11 = 0 THEN 'slicer' ELSE 'ok' END"


def _extracted(spark, d) -> tuple[DataFrame, DataFrame]:
    work = read(spark, d, "documents").select(F.col("doc_id").cast("string").alias("sha256"))
    have = read(spark, d, "labels").select(F.col("doc_id").cast("string").alias("sha256"), F.lit("there").alias("content"))
    return extraction.or_extracted(work, have, _Shelf(), _Slicer(), tries=1)


@query(f"SELECT doc_id::VARCHAR AS sha256, CASE WHEN l.doc_id IS NOT NULL THEN 'there' ELSE 'slices of ' || doc_id END AS content FROM documents d LEFT JOIN labels l USING (doc_id) WHERE l.doc_id IS NOT NULL OR {_OUTCOME} = 'ok'")
def extracted(spark, d):
    """JOIN-6, SRC-19: the files that are there, and on demand what can be fetched, checked and sliced."""
    return _extracted(spark, d)[0]


@query(f"SELECT {_OUTCOME} AS outcome, count(*) AS n FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) AND {_OUTCOME} <> 'ok' GROUP BY 1")
def dead_letters(spark, d):
    """SNK-15, AGG-13: what failed, written by outcome and counted when read back."""
    path = stores.scratch(spark, "dead")
    sinks.write_dead_letters(_extracted(spark, d)[1], path, "detail")
    return evaluation.outcome_counts(spark.read.schema("sha256 string, outcome string, detail string").json(path))


def _methods(spark, d) -> DataFrame:
    """IR files, one an event type, a method a user: straight code in which unit n defines $r(n % 4) and uses two others."""
    e = read(spark, d, "events").select("event_type", "user_id", "event_id", (F.row_number().over(W.partitionBy("event_type", "user_id").orderBy("event_id")) - 1).alias("n"))
    local = lambda k: F.concat(F.lit("$r"), F.pmod(F.col("n") + k, F.lit(4)).cast("string"))
    seed = F.pmod("event_id", F.lit(9)) == 0
    unit = F.struct(
        F.col("n"), F.concat(local(0), F.lit(" = "), F.col("event_id").cast("string")).alias("text"), F.when(F.pmod("event_id", F.lit(6)) == 0, "if").otherwise("assign").alias("kind"), F.when(F.pmod("event_id", F.lit(5)) != 0, local(0)).alias("defines"),
        F.array(local(1), local(2)).alias("uses"), F.array(F.col("n") + 1).alias("next"), F.when(seed, "java.lang.Runtime").alias("callee_class"), F.when(seed, "exec").alias("callee_name"), F.array(local(1)).alias("arguments"), F.lit(None).cast("string").alias("base"),
    )
    methods = e.groupBy("event_type", "user_id").agg(F.array_sort(F.collect_list(unit)).alias("units"))
    line = F.to_json(F.struct(F.when(F.pmod("user_id", F.lit(10)) == 0, F.concat(F.lit("android.u"), F.col("user_id").cast("string"))).otherwise(F.concat(F.lit("com.u"), F.col("user_id").cast("string"))).alias("class"), F.lit("go").alias("name"), F.lit(True).alias("concrete"), "units"))
    files = methods.select("event_type", "user_id", line.alias("line")).groupBy("event_type").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("user_id", "line"))), lambda x: x["line"]), "\n").alias("content"))
    path = stores.scratch(spark, "ir")
    sinks.write_slice_files(files.withColumnRenamed("event_type", "sha256"), path, suffix=".jsonl")
    return ir.read_methods(spark, path)


_UNITS = "(SELECT event_type, user_id, event_id, row_number() OVER (PARTITION BY event_type, user_id ORDER BY event_id) - 1 AS n FROM events WHERE user_id % 10 <> 0)"


@query(f"""WITH u AS {_UNITS}, s AS (SELECT event_type, user_id, n, unnest([(n + 1) % 4, (n + 2) % 4]) AS r FROM u),
f AS (SELECT event_type, user_id, n, n % 4 AS r FROM u WHERE event_id % 5 <> 0),
h AS (SELECT s.event_type, s.user_id, s.n, s.r, max(f.n) AS def FROM s JOIN f ON s.event_type = f.event_type AND s.user_id = f.user_id AND s.r = f.r AND f.n < s.n GROUP BY ALL)
SELECT event_type AS sha256, 'com.u' || user_id AS class, n AS unit_id, '$r' || r AS local, def AS def_unit_id FROM h""")
def reaching_defs(spark, d):
    """SRC-20, JOIN-10: instruction files read back, and the definitions that reach each use."""
    methods = _methods(spark, d)
    return ir.reaching(methods).join(methods.select("method_id", "sha256", "class"), "method_id").select("sha256", "class", "unit_id", "local", "def_unit_id")


# ---- retrieval and models: WIN-10, AGG-18, VEC-7, LLM-12 ----


@query("""WITH h AS (SELECT user_id::VARCHAR AS sha256, event_id AS kb_id, (event_id * 7919 % 97) / 100.0 AS score, CASE WHEN event_type = 'click' THEN 'MALWARE' ELSE 'BENIGN' END AS truth, event_type FROM events),
b AS (SELECT *, row_number() OVER (PARTITION BY sha256 ORDER BY score DESC, kb_id) AS n FROM h),
t AS (SELECT sha256, n, truth, 'Match ' || n || ' (similarity ' || printf('%.3f', score::DOUBLE) || ') for q' || sha256 || chr(10) || '  ' || truth || ' | ' || event_type || ' | f' || kb_id || ' | a' || chr(10) || '  p' || kb_id || chr(10) || '  c' AS line FROM b WHERE n <= 6)
SELECT sha256, '[' || count(*) FILTER (truth = 'MALWARE') || ' MALWARE, ' || count(*) FILTER (truth = 'BENIGN') || ' BENIGN]' || chr(10) || chr(10) || string_agg(line, chr(10) || chr(10) ORDER BY n) AS context FROM t GROUP BY sha256""")
def retrieval_context(spark, d):
    """VEC-7, WIN-10, AGG-18: the six best hits of an app as text, with the mix of their labels."""
    e, name = read(spark, d, "events"), lambda mark, c: F.concat(F.lit(mark), F.col(c).cast("string"))
    hits = e.select(
        F.col("user_id").cast("string").alias("sha256"), F.col("event_id").alias("kb_id"), (F.pmod(F.col("event_id") * 7919, F.lit(97)) / 100).alias("score"), name("q", "user_id").alias("query_function"),
        F.when(F.col("event_type") == "click", "MALWARE").otherwise("BENIGN").alias("ground_truth"), F.col("event_type").alias("family"), name("f", "event_id").alias("function_name"), F.lit("a").alias("suspicious_api"),
        name("p", "event_id").alias("linearized_path"), F.lit("c").alias("cfg_preview"),
    )
    return reasoning.retrieval_context(hits)


_CALLED = ("exec ", "sendTextMessage", "getDeviceId", "nothing")
_SIGNS = r"sendTextMessage|getDeviceId|getSubscriberId|DexClassLoader|loadClass|exec\b|openConnection|RISK_LEVEL: HIGH"


@query(f"""SELECT doc_id AS sha256, CASE WHEN len(list_distinct(regexp_extract_all(c, '{_SIGNS}'))) > 1 THEN 'MALWARE' ELSE 'BENIGN' END AS prediction FROM
(SELECT doc_id, CASE WHEN length(t) > 1500 THEN substr(t, 1, 1500) || chr(10) || '... [truncated] ...' ELSE t END AS c FROM (SELECT doc_id, {_QUOTED(_CALLED)}[(doc_id % 4)::INT + 1] || ' ' || text || ' getDeviceId sendTextMessage' AS t FROM documents))""")
def direct_mode(spark, d):
    """LLM-12, LLM-1: a verdict on the first 1,500 characters, by the offline model."""
    called = F.element_at(F.array(*map(F.lit, _CALLED)), (F.pmod("doc_id", F.lit(4)) + 1).cast("int"))
    files = read(spark, d, "documents").select(F.col("doc_id").alias("sha256"), F.concat_ws(" ", called, "text", F.lit("getDeviceId sendTextMessage")).alias("content"))
    return reasoning.direct(files, models.RuleModel()).select("sha256", "prediction")


@query(SQL["single_call"])
def single_call_with_context(spark, d):
    """LLM-11 with retrieval: similar functions from a knowledge base of all slices go into the prompt."""
    from cograph.plans import retrieval

    s = _slices(spark, d)
    labelled = s.select("sha256").distinct().select("sha256", F.pmod(F.length("sha256"), F.lit(2)).alias("label"), F.col("sha256").alias("family"))
    path = stores.scratch(spark, "context-kb")
    knowledge.save(retrieval.build_kb(s, labelled), path)
    return reasoning.single_call(s.select("sha256").distinct(), s, models.RuleModel(), kb=knowledge.load(spark, path)).select("sha256", "prediction", "confidence")

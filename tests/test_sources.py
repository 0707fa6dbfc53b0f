import zipfile

import pytest
from pyspark.sql import functions as F

from cograph.operators import joins, rows
from cograph.plans import curation
from cograph.sources import archives, knowledge, labels, predictions, sinks
from cograph.streaming import incremental


def test_labels(spark, tmp_path):
    (tmp_path / "l.csv").write_text("sha256,family,date,label,vt,vt_scan_date,vt_year\nAB, kuguo,,1.0,,,\nab, late,,0.0,,,\n,x,,1.0,,,\ncd, benign,,,,,\n")
    raw = labels.read_labels(spark, str(tmp_path / "l.csv"))
    got = [(r.sha256, r.family, r.label) for r in labels.scan_labels(raw).orderBy("row_pos").collect()]
    assert got == [("ab", "kuguo", 1.0), ("cd", "benign", None)]
    assert [r.sha256 for r in labels.scan_labels(raw, limit=1, offset=1).collect()] == ["cd"]
    assert {r.sha256: r.label for r in labels.kb_labels(raw).collect()} == {"ab": 0, "cd": None}
    assert {r.sha256: r.verdict for r in labels.ground_truth(raw).collect()} == {"ab": "MALWARE (family: kuguo)", "cd": "BENIGN"}
    assert labels.scan_hashes(raw).count() == 2 and labels.union_labels(raw, raw).count() == 2


def test_predictions(spark, tmp_path):
    (tmp_path / "p.jsonl").write_text('{"sha256": "a", "prediction": "MALWARE"}\n\nnot json\n{"prediction": "BENIGN"}\n')
    assert [r.sha256 for r in predictions.read_predictions(spark, str(tmp_path / "p.jsonl"), strict=False).collect()] == ["a"]
    with pytest.raises(Exception):
        predictions.read_predictions(spark, str(tmp_path / "p.jsonl")).collect()
    for d, text in (("one", "Final prediction: MALWARE"), ("two", "nothing")):
        (tmp_path / d).mkdir()
        (tmp_path / d / "AA.log").write_text(text)
    (tmp_path / "two" / "bb.log").write_text("fine")
    logs = predictions.read_logs(spark, str(tmp_path / "one"), str(tmp_path / "two"))
    assert {(r.sha256, r.prediction) for r in predictions.log_records(logs).collect()} == {("aa", "MALWARE"), ("bb", "BENIGN")}
    known = spark.createDataFrame([("aa", 1.0, " kuguo")], "sha256 string, label double, family string")
    assert {(r.sha256, r.ground_truth, r.family) for r in curation.labelled_logs(logs, known).collect()} == {("aa", "MALWARE", "kuguo"), ("bb", "UNKNOWN", "unknown")}


def test_archives(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.apk", "w") as z:
        z.writestr("AndroidManifest.xml", "x")
        z.writestr("lib/x/libjiagu.so", "x")
    (tmp_path / "b.apk").write_bytes(b"broken")
    got = {r.path[-5]: (r.valid, r.packer) for r in archives.inspect(archives.read_archives(spark, str(tmp_path))).collect()}
    assert got == {"a": (True, "Qihoo 360 / Jiagu"), "b": (False, None)}


def test_knowledge(spark, tmp_path):
    row = lambda v, pos, t="BENIGN": ("s", "f", "a", pos, t, [float(v), 0.0])
    schema = "sha256 string, function_name string, suspicious_api string, slice_pos int, ground_truth string, vector array<double>"
    base = knowledge.upsert(None, spark.createDataFrame([row(3, 0), row(4, 1)], schema))
    assert [r.slice_pos for r in base.collect()] == [1]
    after = knowledge.upsert(base, spark.createDataFrame([row(5, 0, "MALWARE")], schema))
    knowledge.save(after, str(tmp_path / "kb"))
    knowledge.save(base, str(tmp_path / "kb"))
    got = knowledge.load(spark, str(tmp_path / "kb"))
    assert [(r.ground_truth, r.vector) for r in got.collect()] == [("MALWARE", [1.0, 0.0])]
    assert knowledge.statistics(got, 4).first().progress == 0.25 and knowledge.count_where(got, "ground_truth", "MALWARE") == 1


def test_joins_and_splits(spark):
    work = spark.createDataFrame([("a", None), ("b", None), ("c", "own")], "sha256 string, v string")
    one, two = (spark.createDataFrame(x, "sha256 string, v string") for x in ([("a", "1")], [("a", "2"), ("b", "2"), ("c", "2")]))
    assert {(r.sha256, r.v) for r in joins.fill_by_priority(work, [one, two], ["v"]).collect()} == {("a", "1"), ("b", "2"), ("c", "own")}
    assert {(r.sha256, r.v) for r in joins.with_fallback(work.drop("v"), one, two, "v").collect()} == {("a", "1"), ("b", "2"), ("c", "2")}
    df = spark.range(100).select(F.col("id").alias("key"), (F.col("id") % 2).alias("label"))
    split = rows.balanced_splits(df, "label", "key", 10, 2, "s").groupBy("split", "label").count().collect()
    assert {(r.split, r.label): r["count"] for r in split} == {(s, c): 10 for s in (0, 1) for c in (0, 1)}


def test_report(spark, tmp_path):
    records = spark.createDataFrame([("a" * 64, "MALWARE", None, None), ("b" * 64, "MALWARE", "BENIGN", "x")], "sha256 string, prediction string, ground_truth string, family string")
    table = spark.createDataFrame([("a" * 64, 1.0, " kuguo")], "sha256 string, label double, family string")
    metrics, families = curation.evaluate(records, [table])
    text = sinks.markdown_report(metrics, families, records)
    assert "| kuguo | 1 | 1 | 0 | 100.0% |" in text and "## False positives" in text
    sinks.write_report(text, str(tmp_path / "r" / "report.md"))
    good, bad = sinks.dead_letters(spark.createDataFrame([(1, None), (2, "x")], "a int, error string"))
    assert good.count() == bad.count() == 1


def test_incremental(spark, tmp_path):
    (tmp_path / "in").mkdir()
    out, seen = str(tmp_path / "out"), []
    for name in ("a", "b", None):
        if name:
            (tmp_path / "in" / f"{name}_cfg.txt").write_text(name)
        incremental.run_available(incremental.new_slice_files(spark, str(tmp_path / "in")), str(tmp_path / "cp"), incremental.resumed_append(out))
        seen.append(spark.read.parquet(out).count())
    assert seen == [1, 2, 2]
    assert {r.sha256 for r in spark.read.parquet(out).collect()} == {"a", "b"}
    assert incremental.progress(spark.read.parquet(out), spark.range(4)).first().share == 0.5


def test_uuid(spark):
    import uuid

    from cograph.functions.text import uuid5

    names = ["a:b:c", "", "é:x", *(f"n{i}" for i in range(50))]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert all(r.u == str(uuid.uuid5(uuid.NAMESPACE_DNS, r.n)) for r in df.select("n", uuid5(F.col("n")).alias("u")).collect())


def test_extraction(spark, tmp_path):
    import io

    from cograph.plans import extraction

    def archive(good):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            z.writestr("AndroidManifest.xml" if good else "x", "x")
            z.writestr("classes.dex", "x")
        return out.getvalue()

    class Store:
        def fetch(self, key):
            if key == "gone":
                raise OSError("404")
            return archive(key != "bad")

    class Decoder:
        def slices(self, key, data):
            if key == "slow":
                raise TimeoutError("300 s")
            return f"text of {key}"

    work = spark.createDataFrame([(k,) for k in ("ok", "gone", "bad", "slow", "done")], "sha256 string")
    done = spark.createDataFrame([("done",)], "sha256 string")
    got = {r.sha256: (r.outcome, r.content) for r in extraction.extract(work, done, Store(), Decoder()).collect()}
    assert got == {"ok": ("ok", "text of ok"), "gone": ("download", None), "bad": ("invalid", None), "slow": ("slicer", None)}

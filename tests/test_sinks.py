"""Sinks, stores and what reads them; order of label files; polling."""

from pyspark.sql import functions as F

from cograph.functions.text import tokenizer_count
from cograph.plans import curation
from cograph.sources import labels, predictions, sinks, stores
from cograph.sources import slices as S
from cograph.streaming import incremental


def test_label_order(spark, tmp_path):
    """Files by name whatever their sizes, and the parts of a file by place."""
    head = "sha256,family,date,label,vt,vt_scan_date,vt_year\n"
    (tmp_path / "a.csv").write_text(head + "k0,f,,1.0,,,\n")
    (tmp_path / "b.csv").write_text(head + "".join(f"k{i},f,,0.0,,,\n" for i in range(3000)))
    (tmp_path / "c.csv").write_text(head + "k0,f,,0.0,,,\nlast,f,,,,,\n")
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "8000")
        spark.conf.set("spark.sql.files.openCostInBytes", "100")
        rows = labels.scan_labels(labels.read_labels(spark, str(tmp_path)))
        got = [(r.sha256, r.label) for r in rows.orderBy("row_pos").collect()]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == [("k0", 1.0), *((f"k{i}", 0.0) for i in range(1, 3000)), ("last", None)]


def test_label_file(spark, tmp_path):
    rows = spark.createDataFrame([("AB", " x", 1.0), (None, "y", None)], "sha256 string, family string, label double")
    labels.write_labels(rows.coalesce(1), str(tmp_path / "l"))
    assert [(r.sha256, r.family, r.label) for r in labels.read_labels(spark, str(tmp_path / "l")).orderBy("row_pos").collect()] == [("AB", " x", 1.0), (None, "y", None)]


def test_slice_files(spark, tmp_path):
    text = "=== SLICER_VERSION: 2 ===\n=== FUNCTION: a.b ===\nSUSPICIOUS_API: exec\nNODE 1: x\n=== END FUNCTION ===\n"
    keys = ["AA", "bb", "c%2Fd", "e=f g"]
    files = spark.createDataFrame([(k, text) for k in keys], "sha256 string, content string")
    assert sinks.write_slice_files(files, str(tmp_path / "s")) == 4
    back = S.read_slice_files(spark, str(tmp_path / "s"))
    assert {r.sha256 for r in back.collect()} >= {"aa", "bb", "e=f g"} and back.count() == 4
    assert S.parse_slices(back.select("sha256", "content")).count() == 4


def test_prediction_files(spark, tmp_path):
    out, rec = str(tmp_path / "p"), lambda *keys: spark.createDataFrame([(k, "BENIGN") for k in keys], "sha256 string, prediction string")
    read = lambda: sorted(r.sha256 for r in predictions.read_predictions(spark, out).collect())
    sinks.append_predictions(rec("a", "old"), out)
    resumed = spark.createDataFrame([("a", "MALWARE")], "sha256 string, prediction string")
    sinks.rewrite_predictions(rec("a", "b"), out, resumed)
    assert read() == ["a", "b"] and predictions.read_predictions(spark, out).filter("prediction = 'MALWARE'").count() == 1
    sinks.append_predictions(rec("b", "c"), out, predictions.read_predictions(spark, out))
    sinks.append_predictions(rec("c"), out)
    assert read() == ["a", "b", "c", "c"]


def test_report_sections(spark):
    rows = [(f"{i:064d}", "MALWARE", "BENIGN", None) for i in range(12)] + [("f" * 64, "BENIGN", "MALWARE", "kuguo"), ("e" * 64, "BENIGN", "MALWARE", None)]
    records = spark.createDataFrame(rows, "sha256 string, prediction string, ground_truth string, family string")
    text = sinks.markdown_report(*curation.evaluate(records), records)
    assert "- and 2 more" in text and f"- `{'f' * 32}` (family: kuguo)" in text and f"- `{'e' * 32}` (family: unknown)" in text
    assert "## Comparison" in text and "| Drebin | 81.33% | 0.40% | 24.21% |" in text and "| **this run** |" in text
    clean = records.limit(0)
    assert "## False" not in sinks.markdown_report(curation.evaluate(records)[0], curation.evaluate(clean)[1], clean, compare=())


def test_clean_up(spark, tmp_path):
    for name in ("x", "y", "z"):
        (tmp_path / name).write_text(name)
    states = spark.createDataFrame([(str(tmp_path / "x"), False, "old"), (str(tmp_path / "y"), True, "new"), (str(tmp_path / "z"), False, "old")], "path string, fresh boolean, reason string")
    stale = [str(tmp_path / "x"), str(tmp_path / "z")]
    assert sinks.delete_stale(states) == stale and (tmp_path / "x").exists()
    assert sinks.delete_stale(states, confirmed=True) == stale and sorted(p.name for p in tmp_path.iterdir()) == ["y"]


def test_dead_letters(spark, tmp_path):
    rows = spark.createDataFrame([(1, "slicer", "late"), (2, "download", "gone"), (3, "ok", None)], "a int, outcome string, error string")
    assert [r.a for r in sinks.write_dead_letters(rows, str(tmp_path / "d")).collect()] == [3]
    assert {(r.a, r.outcome) for r in spark.read.json(str(tmp_path / "d")).collect()} == {(1, "slicer"), (2, "download")}
    assert sinks.bars(spark.createDataFrame([(0.5,)], "share double"), "share", 4).first().bar == "##.."


def test_stores(spark, tmp_path):
    path = stores.scratch(spark, "t")
    assert not stores.exists(spark, path) and stores.files_below(spark, path) == []
    spark.range(3).write.parquet(path)
    assert stores.exists(spark, path) and stores.files_below(spark, path, r"\.parquet$")
    stores.rename(spark, path, f"{path}-b")
    assert spark.read.parquet(f"{path}-b").count() == 3 and stores.delete(spark, f"{path}-b") and not stores.exists(spark, f"{path}-b")


def test_watch():
    class Query:
        reports = [None, {"runId": 1, "batchId": 0, "numInputRows": 5, "processedRowsPerSecond": 2.0}] * 2 + [{"runId": 1, "batchId": 1, "numInputRows": 1, "processedRowsPerSecond": 1.0}]
        at = 0

        @property
        def isActive(self):
            return self.at < len(self.reports) - 1

        @property
        def lastProgress(self):
            self.at += 1
            return self.reports[self.at - 1]

    told = []
    assert incremental.watch(Query(), told.append, sleep=lambda s: None) == 2
    assert [r["batch"] for r in told] == [0, 1] and incremental.watch(Query(), told.append, rounds=1, sleep=lambda s: None) == 0


def test_tokenizer(spark):
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    df = spark.createDataFrame([("hello world",), ("",), (None,)], "t string")
    assert [r.n for r in df.select(tokenizer_count(F.col("t"), path).alias("n")).collect()] == [2, 0, 0]

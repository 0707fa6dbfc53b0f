import random

import corpus_pipeline
from pyspark.sql import functions as F

from cograph.llm import contamination, language, simhash
from conftest import COLUMNS, row
from test_learned import SYLLABLES, speech


def test_stages(spark, tmp_path):
    rng = random.Random(8)
    bench = [(i, speech(rng, "en", 40)) for i in range(5)]
    rows = [row(i, speech(rng, lang := rng.choice(list(SYLLABLES)), rng.randint(30, 90)), lang, f"s{i % 4}") for i in range(200)]
    rows += [row(300 + i, rows[i][1]) for i in range(20)] + [row(400 + i, f"{speech(rng, 'fr', 20)} {t}") for i, t in bench] + [row(500, None), row(501, "123"), rows[7]]
    docs = spark.createDataFrame(rows, COLUMNS)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    counts, now = [], docs
    for name, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, str(tmp_path))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert now.columns == docs.columns
        out = str(tmp_path / f"stage-{len(counts)}")
        now.write.parquet(out)
        now = spark.read.parquet(out)
        counts.append(now.count())
    assert counts[:3] == [len(rows) - 2, 205, 200] and counts[3] == counts[4]
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, now.collect()))
    last = got.orderBy("start").collect()
    assert all(a.start + a.n_tokens == b.start for a, b in zip(last, last[1:]))


def test_one_of_each(odd, empty):
    kept = simhash.one_of_each(odd)
    groups = simhash.clusters(odd).select("root").distinct().count()
    assert kept.columns == odd.columns and kept.count() == groups and simhash.one_of_each(empty).count() == 0


def test_empty_stages(spark, empty, tmp_path):
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0

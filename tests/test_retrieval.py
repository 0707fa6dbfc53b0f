import numpy as np
import pytest

from cograph.operators import evaluation, neighbours


@pytest.mark.parametrize(
    ("hits", "ratio", "verdict", "confidence"),
    [([(0.90, "MALWARE"), (0.80, "MALWARE"), (0.75, "BENIGN")], 0.720497, "MALWARE", "HIGH"), ([(0.80, "MALWARE"), (0.80, "BENIGN")], 0.5, "MALWARE", "MEDIUM"), ([(0.69, "MALWARE")], 0, "BENIGN", "HIGH")],
)
def test_votes(spark, hits, ratio, verdict, confidence):
    df = spark.createDataFrame([(1, s, c) for s, c in hits], "q int, score double, label string")
    got = neighbours.votes(df, "q").first()
    assert got.score == pytest.approx(ratio, abs=1e-6) and (got.prediction, got.confidence) == (verdict, confidence)


def test_nearest(spark):
    rng = np.random.default_rng(1)
    base, asked = rng.normal(size=(300, 8)), rng.normal(size=(40, 8))
    base[5] = base[4]
    kb = spark.createDataFrame([(i, v.tolist(), "AB"[i % 3 == 0]) for i, v in enumerate(base)], "kb_id long, vector array<double>, label string").repartition(5)
    q = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(asked)], "query_id long, vector array<double>")
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    score = np.round(unit(asked) @ unit(base).T, 6)
    want = {(i, int(j)) for i in range(40) for j in np.lexsort((np.arange(300), -score[i]))[:5]}
    for query_rows in (4096, 7):
        assert {(r.query_id, r.kb_id) for r in neighbours.nearest(q, kb, 5, query_rows=query_rows).collect()} == want
    strata = neighbours.nearest(q, kb, 3, by_label=True).collect()
    assert len(strata) == 40 * 6
    every = {(r.query_id, r.kb_id): r.rank for r in neighbours.nearest(q, kb, 300).collect()}
    assert all((r.query_id, r.kb_id) in every for r in strata)
    assert neighbours.nearest(q.limit(0), kb).count() == 0


def test_claim(spark):
    rows = [("a", 1, "B", 1, "x"), ("a", 1, "B", 2, "y"), ("a", 1, "B", 3, "z"), ("a", 2, "B", 1, "x"), ("a", 2, "B", 2, "w"), ("b", 1, "B", 1, "x")]
    df = spark.createDataFrame(rows, "app string, q int, label string, rank int, claim string").repartition(3)
    got = sorted((r.app, r.q, r.claim) for r in neighbours.claim(df, "app", ["q", "label", "rank"], "claim", ["q", "label"], 2).collect())
    assert got == [("a", 1, "x"), ("a", 1, "y"), ("a", 2, "w"), ("b", 1, "x")]


@pytest.mark.parametrize(("tp", "tn", "fp", "fn", "want"), [(5, 7, 0, 3, (80.00, 100.00, 62.50, 76.92, 0.00, 37.50)), (6, 8, 0, 4, (77.78, 100.00, 60.00, 75.00, 0.00, 40.00)), (0, 0, 5, 0, (0, 0, 0, 0, 100, 0))])
def test_metrics(spark, tp, tn, fp, fn, want):
    rows = [("MALWARE", "MALWARE")] * tp + [("BENIGN", "BENIGN")] * tn + [("BENIGN", "MALWARE")] * fp + [("MALWARE", "BENIGN")] * fn
    got = evaluation.metrics(evaluation.confusion(spark.createDataFrame(rows, "ground_truth string, prediction string"))).first()
    assert [round(got[c] * 100, 2) for c in ("accuracy", "precision", "recall", "f1", "fpr", "fnr")] == pytest.approx(want)


def test_model_embedder(spark, monkeypatch):
    """A library's model takes the stand-in's place; one of another dimension is an error."""
    import sys
    import types

    from cograph.functions import vectors

    class Model:
        def __init__(self, model_name):
            self.name = model_name

        def embed(self, texts, batch_size):
            return (np.array([len(t), 4.0]) for t in texts)

    module = types.ModuleType("fastembed")
    module.TextEmbedding = Model
    monkeypatch.setitem(sys.modules, "fastembed", module)
    assert np.allclose(vectors.ModelEmbedder("m", dim=2).embed(["abc", None]), [[0.6, 0.8], [0, 1]])
    with pytest.raises(ValueError):
        vectors.ModelEmbedder("m").embed(["abc"])


def test_normalise(spark):
    from pyspark.sql import functions as F

    from cograph.functions import vectors

    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],), ([],), (None,)], "v array<double>")
    assert [r.n for r in df.select(vectors.normalise(F.col("v")).alias("n")).collect()] == [[0.6, 0.8], [0.0, 0.0], [], None]

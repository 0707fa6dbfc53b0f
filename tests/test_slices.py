import pytest
from pyspark.sql import functions as F

from cograph.functions import graph as G
from cograph.functions import text as X
from cograph.operators import rows
from cograph.plans import retrieval
from cograph.plans.reasoning import cleaned
from cograph.sources import slices as S

CHAIN = """=== SLICER_VERSION: 2 ===
=== FUNCTION: com.ex.A.go ===
SUSPICIOUS_API: getDeviceId
NODE 1: $r0 := @this: com.ex.A
NODE 2: $r1 := @parameter0: android.content.Context
NODE 3: if $r1 == null goto return null
NODE 4: $r2 = virtualinvoke $r1.<android.content.Context: java.lang.Object getSystemService(java.lang.String)>("phone")
NODE 5: $r3 = (android.telephony.TelephonyManager) $r2
NODE 6: $r4 = virtualinvoke $r3.<android.telephony.TelephonyManager: java.lang.String getDeviceId()>()
EDGE: 1 -> 2
EDGE: 2 -> 3
EDGE: 3 -> 4
EDGE: 4 -> 5
EDGE: 5 -> 6
=== END FUNCTION ===
"""


def block(function="com.ex.B.f", api="exec", nodes=("a", "b"), edges=(), end=True):
    lines = [f"=== FUNCTION: {function} ===", *([f"SUSPICIOUS_API: {api}"] if api else [])]
    lines += [f"NODE {i}: {n}" for i, n in enumerate(nodes, 1)] + [f"EDGE: {a} -> {b}" for a, b in edges]
    return "\n".join(lines + ["=== END FUNCTION ==="] * end) + "\n\n"


def parsed(spark, *texts):
    return S.parse_slices(spark.createDataFrame([(f"s{i}", t) for i, t in enumerate(texts)], "sha256 string, content string"))


def features(spark, text):
    out = G.with_shape(parsed(spark, text))
    return out.select(G.features(F.col("nodes"), F.col("edges"), F.col("suspicious_api"), F.col("shape")).alias("f"), G.linear_path(F.col("function_name"), F.col("suspicious_api"), F.col("shape")).alias("p")).first()


def test_chain(spark):
    row = features(spark, CHAIN)
    assert row.f[:7] == pytest.approx([0.494913, 0.388237, 0.166667, 0.289065, 0, 0, 0.566662], abs=1e-6)
    assert row.f[7:15] == pytest.approx([2 / 6, 2 / 6, 2 / 6, 0, 0, 0, 0, 0])
    assert row.f[15:] == [0.0, 1.0] + [0.0] * 8
    assert row.p == "FUNC: com.ex.A.go | API: getDeviceId | PATH: param(A) -> param(Context) -> branch -> getSystemService -> cast(TelephonyManager) -> getDeviceId"


def test_loop(spark):
    row = features(spark, block(nodes="abcd", edges=[(1, 2), (2, 3), (3, 2), (3, 4)]))
    assert row.f[:7] == pytest.approx([0.409336, 0.348732, 0.333333, 0.458157, 1, 1, 0.468679], abs=1e-6)


def test_edge_cases(spark):
    sentinel = "NO_SUSPICIOUS_APIS_FOUND"
    assert parsed(spark, sentinel, f"=== SLICER_VERSION: 2 ===\n{sentinel}\n", "", "   ").count() == 0
    assert [r.function_name for r in parsed(spark, "stray\n" + block()).orderBy("slice_pos").collect()] == ["stray", "com.ex.B.f"]
    assert parsed(spark, block(end=False)).count() == 1
    assert parsed(spark, block(api=None)).first().suspicious_api == ""
    none = features(spark, block(nodes=(), edges=[(1, 2)]))
    assert none.p.endswith("PATH: unknown") and none.f[7:15] == [0] * 8 and none.f[2] == 1
    bad = parsed(spark, block(edges=[("x", "y"), (1, 2)])).select(F.size("edges").alias("n"), F.size(G.edges_of(F.col("edges"))).alias("m")).first()
    assert (bad.n, bad.m) == (2, 1)
    outside = features(spark, block(nodes="a", edges=[(1, 9), (9, 10), (9, 11)]))
    assert outside.f[3] == pytest.approx(0.289065, abs=1e-6) and outside.f[6] == pytest.approx(0.403694, abs=1e-4)
    assert features(spark, block(nodes="a", edges=[(1, 1)])).f[5] == 1
    long = [(i, i + 1) for i in range(1, 5000)]
    assert features(spark, block(nodes=["x"] * 5000, edges=long)).f[5:7] == [0, 1]


def test_order_and_dedup(spark):
    same = block() + block() + block(nodes=("c", "d"))
    kept = cleaned(parsed(spark, same)).orderBy("slice_pos").collect()
    assert [r.slice_pos for r in kept] == [0, 2]
    assert [r.slice_pos for r in rows.structural_dedup(parsed(spark, same), "slice_pos").collect()] == [0]


@pytest.mark.parametrize(("function", "api", "kept"), [("com.facebook.X", "forName", False), ("com.facebook.X", "loadClass", True), ("com.facebook.X", "getActiveNetworkInfo", False), ("com.facebookish.X", "forName", True)])
def test_framework_filter(spark, function, api, kept):
    assert cleaned(parsed(spark, block(function, api))).count() == kept
    assert cleaned(parsed(spark, block(function, api)), no_filter=True).count() == 1


@pytest.mark.parametrize(
    ("text", "fresh"),
    [("=== SLICER_VERSION: 2 ===", True), ("=== SLICER_VERSION: 3 ===", True), ("=== SLICER_VERSION: 1 ===", False), ("=== SLICER_VERSION: ===", False), ("SUSPICIOUS_API: openConnection", True), ("SUSPICIOUS_API: forName", False), ("", False)],
)
def test_freshness(spark, text, fresh):
    df = spark.createDataFrame([(text,)], "content string")
    assert df.select(X.freshness(F.col("content")).alias("s")).first().s.fresh == fresh


def test_seeds(spark):
    cases = [("X", "exec", True), ("a.ContentResolver", "query", True), ("MyDao", "query", False), ("dalvik.system.DexClassLoader", "<init>", True), ("RuntimeRemoteException", "<init>", False), ("java.net.Socket", "connect", True), ("Foo", "connect", False), ("java.lang.Class", "getMethod", False), (None, None, False)]
    df = spark.createDataFrame(cases, "c string, n string, e boolean")
    assert df.filter(X.is_seed(F.col("c"), F.col("n")) != F.col("e")).count() == 0


def test_files(spark, tmp_path):
    (tmp_path / "ABC_cfg.txt").write_text(CHAIN)
    (tmp_path / "other.txt").write_text("x")
    files = S.read_slice_files(spark, str(tmp_path))
    assert [r.sha256 for r in files.collect()] == ["abc"]
    assert S.parse_slices(files.drop("path")).first().raw_text.count("NODE") == 6


def test_classify(spark):
    slices = parsed(spark, CHAIN, block("com.ex.C.f", "forName", ("$a = x", "return"), [(1, 2)]), "")
    apps = spark.createDataFrame([("s0",), ("s1",), ("s2",)], "sha256 string")
    labels = spark.createDataFrame([("s0", 1, "kuguo"), ("s1", 0, None)], "sha256 string, label int, family string")
    got = {r.sha256: r for r in retrieval.knn_classify(apps, slices, retrieval.build_kb(slices, labels)).collect()}
    assert (got["s0"].prediction, got["s0"].confidence, got["s0"].top_family) == ("MALWARE", "HIGH", "kuguo")
    assert (got["s1"].prediction, got["s1"].confidence) == ("BENIGN", "HIGH")
    assert (got["s2"].confidence, got["s2"].top_family, got["s2"].score) == ("LOW", "none", 0)
    assert got["s0"].analysis.startswith("PREDICTION: MALWARE")

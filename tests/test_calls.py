import random

from pyspark.sql import functions as F

from cograph.operators import calls, slicing
from cograph.plans import models, reasoning
from cograph.sources import slices as S
from test_slices import CHAIN, block, parsed


def test_call_edges(spark):
    call = "virtualinvoke $r0.<com.ex.B: void f(int)>(1)"
    near = "staticinvoke <com.ex.B: void g()>()"
    slices = parsed(spark, block("com.ex.A.go", "exec", (call, near)) + block("com.ex.B.f") + block("com.ex.B.h.g"))
    assert {(r.caller, r.callee) for r in calls.call_edges(slices).collect()} == {("com.ex.A.go", "com.ex.B.f")}
    doc = calls.grouped_document(slices, 10_000).first()
    assert doc.n_functions == 3 and "com.ex.A.go --> com.ex.B.f (invokes exec)" in doc.document and "CALLED_BY: com.ex.A.go" in doc.document


def plain_pack(rows, budget):
    kept, used, names, now, shut = [], 0, set(), None, False
    for group, pos, name, cost in sorted(rows):
        if group != now:
            now, shut = group, used >= budget
        if shut or name in names:
            continue
        if used + cost > budget:
            shut = True
            continue
        used += cost
        names.add(name)
        kept.append(pos)
    return kept


def test_pack(spark):
    rng = random.Random(2)
    rows = [(f"app{a}", rng.randint(1, 4), i, f"n{rng.randint(0, 30)}", rng.randint(1, 40)) for a in range(5) for i in range(60)]
    df = spark.createDataFrame(rows, "app string, g int, pos int, name string, cost int").repartition(4)
    got = {}
    for r in calls.pack(df, "app", "g", "pos", "name", "cost", 300).collect():
        got.setdefault(r.app, []).append(r.pos)
    for a in range(5):
        assert sorted(got[f"app{a}"]) == sorted(plain_pack([r[1:] for r in rows if r[0] == f"app{a}"], 300))


def test_backward_slice(spark):
    # 1: a = p; 2: if a; 3: b = a; 4: c = 1; 5: exec(b); a branch before 5 is kept, 4 is not.
    units = spark.createDataFrame(
        [(7, i, i, k, t, cc, cn, al, None) for i, k, t, cc, cn, al in [(1, "assign", "a = p", None, None, []), (2, "if", "if a", None, None, []), (3, "assign", "b = a", None, None, []), (4, "assign", "c = 1", None, None, []), (5, "invoke", "exec(b)", "java.lang.Runtime", "exec", ["b"])]],
        "method_id long, unit_id long, pos int, kind string, text string, callee_class string, callee_name string, arg_locals array<string>, base_local string",
    )
    methods = spark.createDataFrame([(7, "com.ex.A", "go", True, "app")], "method_id long, class string, name string, concrete boolean, sha256 string")
    uses = spark.createDataFrame([(7, 2, "a"), (7, 3, "a"), (7, 5, "b")], "method_id long, unit_id long, local string")
    defs = spark.createDataFrame([(7, 2, "a", 1), (7, 3, "a", 1), (7, 5, "b", 3)], "method_id long, unit_id long, local string, def_unit_id long")
    edges = spark.createDataFrame([(7, 1, 2), (7, 2, 3), (7, 3, 4), (7, 4, 5), (7, 2, 5)], "method_id long, src long, dst long")
    crit = slicing.criteria(methods, units)
    nodes = slicing.numbered(slicing.slice_units(crit, units, uses, defs, edges), units)
    assert sorted((r.unit_id, r.node) for r in nodes.collect()) == [(1, 1), (2, 2), (3, 3), (5, 4)]
    files = slicing.serialise(crit, methods, nodes, slicing.induced_edges(nodes, edges))
    text = files.first().content
    assert text.splitlines()[:3] == ["=== SLICER_VERSION: 2 ===", "=== FUNCTION: com.ex.A.go ===", "SUSPICIOUS_API: exec"] and "EDGE: 2 -> 4" in text
    both = S.or_nothing(spark.createDataFrame([("app",), ("none",)], "sha256 string"), files)
    assert [r.function_name for r in S.parse_slices(both).collect()] == ["com.ex.A.go"]


def test_slice_order():
    """What a definition uses matters for the rest of the unit's uses; a use that came before is not taken back."""
    uses, defs = {0: ["a", "b"], 1: ["b"]}, {(0, "a"): [1], (0, "b"): [2]}
    assert slicing.backward(0, ["a"], uses, defs, {}) == [0, 1, 2]
    assert slicing.backward(0, ["a"], {**uses, 0: ["b", "a"]}, defs, {}) == [0, 1]


def plain_slice(seed, locals_, uses, defs, jumps):
    """A queue, unit by unit, as the definition says it."""
    relevant, found, queue = set(locals_), [seed], [seed]
    for unit in queue:
        for local in uses.get(unit, []):
            if local in relevant:
                for d in defs.get((unit, local), []):
                    if d not in found:
                        found.append(d)
                        queue.append(d)
                        relevant |= set(uses.get(d, []))
        for p in jumps.get(unit, []):
            if p not in found:
                found.append(p)
                queue.append(p)
    return found


def test_slices_of_tables(spark):
    """Tables with ordinals, many methods at once, against the plain queue."""
    rng, names = random.Random(3), "abcdef"
    units, uses, defs, edges, want = [], [], [], [], {}
    for m in range(12):
        n = rng.randint(4, 25)
        kinds = [rng.choice(("if", "goto", "assign", "assign")) for _ in range(n)]
        u = {i: rng.sample(names, rng.randint(0, 3)) for i in range(n)}
        d = {(i, x): rng.sample(range(n), rng.randint(0, 3)) for i in range(n) for x in u[i]}
        pre = {i: rng.sample(range(n), rng.randint(0, 3)) for i in range(n)}
        args = rng.sample(names, 2)
        units += [(m, i, i, kinds[i], f"{i}", "java.lang.Runtime" if i == n - 1 else None, "exec" if i == n - 1 else None, args if i == n - 1 else [], None) for i in range(n)]
        uses += [(m, i, x, k) for i, xs in u.items() for k, x in enumerate(xs)]
        defs += [(m, i, x, to, k) for (i, x), ds in d.items() for k, to in enumerate(ds)]
        edges += [(m, p, i, k) for i, ps in pre.items() for k, p in enumerate(ps)]
        jumps = {i: [p for p in ps if kinds[p] in ("if", "goto")] for i, ps in pre.items()}
        want[m] = sorted(plain_slice(n - 1, args, u, d, jumps))
    table = lambda rows, schema: spark.createDataFrame(rows, schema).repartition(3)
    units = table(units, "method_id long, unit_id long, pos int, kind string, text string, callee_class string, callee_name string, arg_locals array<string>, base_local string")
    methods = table([(m, "com.ex.A", "go", True, "app") for m in range(12)], "method_id long, class string, name string, concrete boolean, sha256 string")
    crit = slicing.criteria(methods, units)
    made = slicing.slice_units(
        crit, units, table(uses, "method_id long, unit_id long, local string, ordinal int"), table(defs, "method_id long, unit_id long, local string, def_unit_id long, ordinal int"), table(edges, "method_id long, src long, dst long, ordinal int")
    )
    got = {}
    for r in made.collect():
        assert r.error is None
        got.setdefault(r.method_id, []).append(r.unit_id)
    assert {m: sorted(v) for m, v in got.items()} == want


def plain_reaching(defines, following, uses):
    """By walking back from each use, one step at a time."""
    before = {i: [j for j, ks in enumerate(following) if i in ks] for i in range(len(defines))}
    out = set()
    for i, names in enumerate(uses):
        for local in names:
            seen, todo = set(), list(before[i])
            while todo:
                j = todo.pop()
                if j in seen:
                    continue
                seen.add(j)
                if defines[j] == local:
                    out.add((i, local, j))
                else:
                    todo += before[j]
    return out


def test_reaching():
    from cograph.sources import ir

    rng = random.Random(4)
    for _ in range(100):
        n = rng.randint(0, 12)
        defines = [rng.choice(("a", "b", "c", None)) for _ in range(n)]
        following = [rng.sample(range(n), min(n, rng.randint(0, 3))) for _ in range(n)]
        uses = [rng.sample("abc", rng.randint(0, 2)) for _ in range(n)]
        got = ir.reaching_of(defines, following, uses)
        assert len(got) == len(set(got)) and set(got) == plain_reaching(defines, following, uses)


def test_instruction_files(spark, tmp_path):
    """Two archives of one app, framework classes, a broken line; sliced from what was read."""
    import json

    from cograph.sources import ir

    unit = lambda text, defines=None, uses=(), nxt=(), kind="assign", **more: {"text": text, "defines": defines, "uses": list(uses), "next": list(nxt), "kind": kind, **more}
    body = [unit("a = p", "a", [], [1]), unit("if a", None, ["a"], [2, 4], "if"), unit("b = a", "b", ["a"], [3]), unit("c = 1", "c", [], [4]), unit("exec(b)", None, ["b"], [], "invoke", callee_class="java.lang.Runtime", callee_name="exec", arguments=["b"])]
    method = lambda cls: json.dumps({"class": cls, "name": "go", "concrete": True, "units": body})
    (tmp_path / "AA.classes.jsonl").write_text("\n".join([method("com.ex.A"), "not json", method("android.app.X")]))
    (tmp_path / "AA.classes2.jsonl").write_text("\n".join([method("com.ex.A"), method("com.ex.B")]))
    methods = ir.read_methods(spark, str(tmp_path))
    assert sorted((r.sha256, r["class"]) for r in methods.collect()) == [("aa", "com.ex.A"), ("aa", "com.ex.B")] and ir.read_methods(spark, str(tmp_path), no_filter=True).count() == 3
    t = ir.tables(methods)
    crit = slicing.criteria(t["methods"], t["units"])
    nodes = slicing.numbered(slicing.slice_units(crit, t["units"], t["uses"], t["reaching_defs"], t["cfg_edges"]), t["units"])
    assert sorted((r.unit_id, r.node) for r in nodes.collect()) == sorted([(0, 1), (1, 2), (2, 3), (4, 4)] * 2)


def test_retrieval_in_single_call(spark):
    """What the knowledge base holds reaches the prompt."""
    from cograph.plans import retrieval

    class Reader:
        budget = 20_000

        def chat(self, system, user, temperature=0.1):
            return f"PREDICTION: {'MALWARE' if 'Match 1 (similarity' in user and '[1 MALWARE, 0 BENIGN]' in user else 'BENIGN'}\nCONFIDENCE: LOW"

    slices = parsed(spark, CHAIN)
    apps = slices.select("sha256").distinct()
    kb = retrieval.build_kb(slices, apps.select("sha256", F.lit(1).alias("label"), F.lit("fam").alias("family")))
    assert [(r.prediction, r.confidence) for r in reasoning.single_call(apps, slices, Reader(), kb=kb).collect()] == [("MALWARE", "LOW")]
    assert [r.prediction for r in reasoning.single_call(apps, slices, Reader()).collect()] == ["BENIGN"]


def test_models(spark):
    asked = []

    class Flaky:
        budget = 10

        def __init__(self, key):
            self.key = key

        def chat(self, system, user, temperature=0.1):
            asked.append(self.key)
            if self.key != "c":
                raise models.ModelError(401 if self.key == "a" else 429)
            return "ok"

    assert models.Retrying(Flaky, ["a", "b", "c"], sleep=lambda s: None).chat("", "") == "ok"
    assert asked == ["a", "b", "c"]
    assert models.create("stub").budget == 14_000
    slices = parsed(spark, CHAIN, "NO_SUSPICIOUS_APIS_FOUND", block("com.facebook.X", "forName"))
    apps = spark.createDataFrame([("s0",), ("s1",), ("s2",)], "sha256 string")
    for run in (reasoning.three_tiers, reasoning.single_call):
        got = {r.sha256: r for r in run(apps, slices, models.RuleModel()).collect()}
        assert len(got) == 3 and got["s1"].prediction == "BENIGN" and got["s1"].analysis == "No suspicious APIs found."
    bad = type("Bad", (), {"budget": 9000, "chat": lambda self, *a, **k: 1 / 0})()
    assert reasoning.single_call(apps, slices, bad).filter(F.col("error").isNotNull()).count() == 1

"""The pipeline's near-copy stage against all pairs of a plain exact Jaccard."""

import random

from cograph.llm import nearcopies
from conftest import COLUMNS, prose, row


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def plain_kept(rows, least=0.8):
    sets, parent = [shingles(r[1]) for r in rows], list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a == sets[j] or len(a & sets[j]) >= least * len(a | sets[j]):
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    groups = {}
    for i, r in enumerate(rows):
        groups.setdefault(root(i), []).append((r[0] is None, r[0]))
    return sorted(min(g) for g in groups.values())


def changed(rng, text, n):
    words = text.split()
    for at in rng.sample(range(len(words)), n):
        words[at] = f"new{rng.random()}"
    return " ".join(words)


def check(spark, rows):
    import corpus_pipeline

    docs = spark.createDataFrame(rows, COLUMNS).repartition(3)
    kept = dict(corpus_pipeline.STAGES)["SimHash near-dedup"](spark, docs, "").collect()
    assert sorted((r.doc_id is None, r.doc_id) for r in kept) == plain_kept(rows)


def test_planted_near_copies(spark):
    rng = random.Random(5)
    rows = [row(i, prose(rng, rng.randint(60, 400), 3000)) for i in range(120)]
    rows += [row(1000 + i, changed(rng, rows[i][1], n)) for i in range(120) for n in [max(1, round(len(rows[i][1].split()) * rng.choice((0.005, 0.01, 0.015, 0.02, 0.03))))]]
    near = [len(shingles(rows[i][1]) & (b := shingles(rows[120 + i][1]))) / len(shingles(rows[i][1]) | b) for i in range(120)]
    assert sum(0.8 <= j <= 0.95 for j in near) > 50 and sum(j < 0.8 for j in near) > 10
    check(spark, rows)


def test_odd_rows(spark, odd_rows):
    check(spark, [r for r in odd_rows if r[0] is not None])


def test_large_group(spark, monkeypatch):
    """Bands of more nodes than SMALL and than a tile; chains across tiles."""
    monkeypatch.setattr(nearcopies, "SMALL", 4)
    monkeypatch.setattr(nearcopies.linked, "__defaults__", (16,))
    rng = random.Random(6)
    rows = []
    for g in range(2):
        text = prose(rng, 300, 3000)
        for i in range(60):
            rows.append(row(1000 * g + i, changed(rng, text, rng.randint(1, 8))))
    rows += [row(5000 + i, prose(rng, 200, 3000) + " " + rows[0][1][:200]) for i in range(20)]
    check(spark, rows)

"""Operators with models, indexes and searches."""

import math
import random
import re
import zlib
from itertools import combinations

import numpy as np
from pyspark.sql import functions as F

from cograph.llm import contamination, language, neighbours, urls
from conftest import COLUMNS, prose, row

SYLLABLES = {"en": "the and ing tion er wh", "de": "der und ung sch ß ü", "fr": "le eau é è oux que"}


def speech(rng, lang, n):
    return " ".join("".join(rng.choice(SYLLABLES[lang].split()) for _ in range(rng.randint(1, 4))) for _ in range(n))


def test_language(spark, odd, empty):
    rng = random.Random(1)
    rows = [row(i, speech(rng, lang := rng.choice(list(SYLLABLES)), rng.randint(3, 90)), lang) for i in range(500)]
    rows += [row(900, None), row(901, ""), row(902, "12 -- 34"), row(None, speech(rng, "fr", 20), None), row(904, speech(rng, "de", 5000), None)]
    docs = spark.createDataFrame(rows, COLUMNS)
    model = language.trained(docs)
    bare = docs.select("doc_id", "text")
    got = {r.doc_id: r for r in language.identify(bare, model).collect()}
    held = [r for r in rows[:500] if zlib.crc32(str(r[0]).encode()) % 4 == 2]
    assert len(held) > 60 and sum(got[r[0]].lang_pred == r[2] for r in held) / len(held) >= 0.97
    assert [got[i].lang_pred for i in (900, 901, 902)] == ["und"] * 3 and got[904].lang_pred == "de" and got[None].lang_pred == "fr"
    assert all(0 <= r.score <= 1 for r in got.values())
    kept = language.recognised(docs, model)
    assert kept.columns == docs.columns and kept.count() == len(rows) - 3
    assert language.trained(empty) is None
    assert language.identify(bare, None).filter("lang_pred <> 'und'").count() == 0 and language.recognised(empty, None).count() == 0
    again = {r.doc_id: tuple(r) for r in language.identify(bare.repartition(5), language.trained(docs.repartition(7))).collect()}
    assert again == {k: tuple(v) for k, v in got.items()}


def test_language_networks_are_apart():
    """Two networks with the same filters are two networks."""
    import pyarrow as pa

    rng = np.random.default_rng(1)
    windows = rng.integers(97, 122, (40, language.WINDOW)).astype(np.uint8)
    params = language.train(windows, np.arange(40) % 2, 2, steps=3)
    flipped = (params[0], params[1], params[2][:, ::-1].copy(), params[3][::-1].copy())
    say = lambda names, p: language.Network.of(names, p).predict(pa.array(["abc def"]))[0][0]
    first = say(["x", "y"], params)
    assert say(["x", "y"], flipped) != first and say(["de", "en"], params) in ("de", "en") and say(["x", "y"], params) == first


def test_language_columns_and_labels(spark):
    """Columns of the result's names are replaced; every label is learned, however many there are."""
    rng = random.Random(2)
    rows = [row(i, f"{chr(97 + i % 26)}{chr(97 + i // 26 % 26)} " * rng.randint(20, 40), f"l{i % 70:03d}") for i in range(600)]
    docs = spark.createDataFrame(rows, COLUMNS)
    model = language.trained(docs)
    assert len(model[0]) == 70
    got = language.identify(docs, model)
    assert got.columns == [*[c for c in docs.columns if c not in ("lang_pred", "score")], "lang_pred", "score"] and got.filter("score is null").count() == 0


def test_language_windows():
    raw = np.frombuffer(b"a" * 300 + b"b" * 10, dtype=np.uint8)
    windows, first = language.windows_of(raw, np.array([0, 300, 300, 310]))
    assert first.tolist() == [0, 2, 2, 3] and (windows == 97).sum() == 300 and (windows == 98).sum() == 10


def items(rng, n):
    return [(i, f"{prose(rng, rng.randint(12, 50), 3000)}. What is it? {prose(rng, rng.randint(1, 12), 3000)}.") for i in range(n)]


def test_contamination(spark, odd, empty):
    rng = random.Random(6)
    bench = items(rng, 30)
    clean = [row(i, prose(rng, rng.randint(5, 400), 3000)) for i in range(150)]
    bad = [row(1000 + i, f"{prose(rng, rng.randint(0, 300), 3000)} {text.upper() if i % 5 == 0 else text} {prose(rng, 50, 3000)}") for i, text in bench]
    docs = spark.createDataFrame(clean + bad + [row(1, None), row(2, ""), row(None, bench[3][1]), bad[0]], COLUMNS)
    table = spark.createDataFrame(bench + [(99, None), (98, ""), (97, "?!"), bench[0]], "item_id long, text string")
    got = contamination.contaminated(docs, table)
    pairs = sorted((r.doc_id if r.doc_id is not None else -1, r.item_id) for r in got.collect())
    assert pairs == sorted([(1000 + i, i) for i, _ in bench] + [(-1, 3), (1000, 0)])
    kept = contamination.decontaminate(docs, table)
    assert kept.columns == docs.columns and kept.count() == len(clean) + 2
    assert contamination.contaminated(docs, table.limit(0)).count() == 0 and contamination.contaminated(empty, table).count() == 0
    assert contamination.decontaminate(docs, table.limit(0)).count() == docs.count()
    chunks = [x.value for x in contamination.indexes(table, chunk_words=200)]
    assert len(chunks) > 3 and sum(len(x.ids) for x in chunks) == len(bench)


def plain_scores(bench, texts):
    """BM25 of every item for every passage, from the texts alone: the best passage of each (text, item), as a share of the item's own score."""
    lists = {i: re.findall(r"[0-9A-Za-z]+", t.lower()) for i, t in bench}
    n, mean = len(lists), sum(map(len, lists.values())) / len(lists)
    df = {w: sum(w in set(x) for x in lists.values()) for x in lists.values() for w in x}
    weight = lambda w, x: math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * x.count(w) * 2.2 / (x.count(w) + 1.2 * (0.25 + 0.75 * len(x) / mean))
    weights = {i: {w: weight(w, x) for w in set(x)} for i, x in lists.items()}
    out = {}
    for r, text in enumerate(texts):
        words = re.findall(r"[0-9A-Za-z]+", text.lower())
        for low in range(0, len(words), 64):
            have = set(words[low : low + 128])
            for i, own in weights.items():
                out[r, i] = max(out.get((r, i), 0), sum(v for w, v in own.items() if w in have) / sum(own.values()))
    return out


def test_retrieval_is_complete(spark):
    """Every passage and item above the threshold by a plain BM25 is found, and nothing else; whole blocks are skipped."""
    import pyarrow as pa

    rng = random.Random(9)
    bench = items(rng, 60)
    texts = [" ".join(rng.sample(t.split(), rng.randint(3, len(t.split())))) + " " + prose(rng, rng.randint(0, 200), 3000) for _, t in bench for _ in range(4)]
    index = next(contamination.indexes(spark.createDataFrame(bench, "item_id long, text string"))).value
    before, contamination.OVERLAP = contamination.OVERLAP, 0
    try:
        got = {(r, j): s for r, j, s, *_ in index.search(*contamination.words_of(pa.array(texts)))}
    finally:
        contamination.OVERLAP = before
    want = {k: s for k, s in plain_scores(bench, texts).items() if s >= contamination.THRESHOLD}
    assert got.keys() == want.keys() and len(want) > 60 and all(abs(got[k] - want[k]) < 1e-9 for k in got)
    assert 0 < index.opened < index.met / 2


def test_contamination_chunks(spark, odd, odd_rows, monkeypatch):
    """Several chunks give what one gives, on rows of every odd kind, a very long text among them."""
    rng = random.Random(10)
    bench = items(rng, 12) + [(51, " ".join(next(r[1] for r in odd_rows if r[0] == 303).split()[29_000:29_060]))]
    table = spark.createDataFrame(bench, "item_id long, text string")
    docs = odd.unionByName(spark.createDataFrame([row(800 + i, t) for i, t in bench[:4]], COLUMNS))
    once = sorted(map(str, contamination.contaminated(docs, table).collect()))
    stay = sorted(map(str, contamination.decontaminate(docs, table).collect()))
    monkeypatch.setattr(contamination, "CHUNK_WORDS", 150)
    assert len(list(contamination.indexes(table))) > 2
    assert sorted(map(str, contamination.contaminated(docs, table).collect())) == once and "doc_id=303, item_id=51" in " ".join(once)
    assert sorted(map(str, contamination.decontaminate(docs, table).collect())) == stay and len(stay) < docs.count()


def test_long_items(spark):
    """Items of more words than a passage, copied whole, in part, and not at all."""
    rng = random.Random(12)
    spoken = lambda n: " ".join(f"u{rng.randint(0, 1 << 30)}" for _ in range(n))
    bench = [(i, f"{spoken(n - 20)}. What is it? {spoken(17)}.") for i, n in enumerate((140, 300, 500, 2000))]
    whole = [row(i, f"{prose(rng, 37 * i, 3000)} {text} {prose(rng, 50, 3000)}") for i, text in bench]
    part = [row(100 + i, f"{prose(rng, 90, 3000)} {' '.join(text.split()[70:140])} {prose(rng, 90, 3000)}") for i, text in bench]
    clean = [row(200 + i, spoken(900)) for i in range(5)]
    docs = spark.createDataFrame(whole + part + clean, COLUMNS)
    table = spark.createDataFrame(bench, "item_id long, text string")
    got = contamination.contaminated(docs, table).collect()
    assert sorted((r.doc_id, r.item_id) for r in got) == [(i, i) for i, _ in bench] + [(100 + i, i) for i, _ in bench]
    assert all(r.question_overlap > 0.99 and r.answer_overlap > 0.99 for r in got if r.doc_id < 100)
    assert all(r.question_overlap < 0.6 for r in got if r.doc_id >= 100)
    assert sorted(r.doc_id for r in contamination.decontaminate(docs, table).collect()) == [200 + i for i in range(5)]


def test_neighbours(spark):
    rng = np.random.default_rng(2)
    vectors = rng.normal(size=(400, 16)).astype(np.float32).tolist()
    rows = [(i, v) for i, v in enumerate(vectors)]
    rows += [(500 + i, vectors[0]) for i in range(20)] + [(600, None), (601, []), (602, [0.0] * 16), (603, [float("nan")] + [1.0] * 15), (604, [float("inf")] * 16), (605, [1.0, None] * 8), (None, vectors[1]), (650, [1.0, 2.0]), (651, [2.0, 4.0]), (700, [1e30] * 16), (0, vectors[0])]
    df = spark.createDataFrame([(i, v, 0, "x") for i, v in rows], "vec_id long, embedding array<float>, label int, score string").repartition(4)
    data = neighbours.valid_vectors(df)
    good = {(i, tuple(np.array(v, dtype=np.float32).tolist())) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and any(v)}
    asked = data.filter("id % 50 = 0")
    want = set()
    for q, a in ((i, v) for i, v in good if i % 50 == 0):
        near = []
        for i, b in good:
            if i != q and len(a) == len(b):
                x, y = np.array(a, dtype=np.float64), np.array(b, dtype=np.float64)
                near.append((-neighbours.exact_cosines(x[None], y[None])[0], i))
        want |= {(q, n, i, -s) for n, (s, i) in enumerate(sorted(near)[:5], 1)}
    for size in (neighbours.QUERY_BYTES, 3 * 8 * 16):
        assert {tuple(r) for r in neighbours.nearest(asked, data, query_bytes=size).collect()} == want
    assert neighbours.nearest(asked.limit(0), data).count() == 0 and neighbours.nearest(asked, data.limit(0)).count() == 0


def test_neighbour_tiles():
    """Tiles of very long vectors are exact, and their bounds hold."""
    rng = np.random.default_rng(4)
    v = rng.normal(size=(12, 3000))
    v[5] = v[6] * (1 + 1e-12)
    small, scale, residual = neighbours.quantise(v)
    product = neighbours._product(small, small)
    assert (product == small.astype(np.int64) @ small.astype(np.int64).T).all()
    true = np.array([[neighbours.exact_cosines(a[None], b[None])[0] for b in v] for a in v])
    assert (np.abs(product * scale[:, None] * scale[None] - true) <= residual[:, None] + (1 + residual[:, None]) * residual[None] + 1e-9).all()


def test_neighbour_blocks():
    """Of equal vectors in a block the smallest ids travel, whatever their order; others all do."""
    import pyarrow as pa

    ids = [9, 3, 7, 1, 5, 8, 2]
    vectors = [[1.0, 2.0]] * 5 + [[2.0, 1.0], [2.0, 1.0]]
    batch = pa.RecordBatch.from_arrays([pa.array(ids), pa.array(vectors, pa.list_(pa.float32()))], names=["id", "v"])
    (out,) = neighbours._pack(100, 3)([batch])
    assert sorted(np.frombuffer(out.column("ids")[0].as_py(), "<i8").tolist()) == [1, 2, 3, 5, 8] and out.column("width")[0].as_py() == 4


def plain_url(url):
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    end = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end])
    path = rest[end:].split("?")[0].split("#")[0] if rest[end : end + 1] == "/" else ""
    fits = [r for r in urls.BASE if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return host, path, max(fits, key=lambda r: len(r.name), default=None)


URLS = ["http://a.net/x", "http://NET/", "https://example.net/en/1", "https://b.example.net/en", "http://example.com/de/?q=1", "http://example.com/de", "ftp://x.org/fr/#a", "http://org?x=/fr/", "x.net/", "", None, "a://b://c.net/", "http://a.net", "http://É.net/\n", "http://u@h.net:80/", "http://x.com/a?b=1&c=2#d", "://net/"]


LONG = "https://a.b.c.d.casino.e.f.g.example.com/1/two/3/four/five/six.html?a=1&b=2&c=3&d=4&e=5&f=6#x"


def plain_tokens(url):
    """The tokens of a URL, cut nowhere."""
    if url is None or "://" not in url:
        return []
    host, path, _ = plain_url(url)
    labels = host.split(".")
    out = ["s:" + url.split("://")[0], *("h:" + ".".join(labels[-k:]) for k in range(1, len(labels) + 1)), *("w:" + w for w in re.findall("[a-z]+", host))]
    out += [f"p{i}:" + re.sub("[0-9]+", "0", x) for i, x in enumerate(x for x in path.split("/") if x)]
    out += ["a:" + x for x in re.findall("[?&]([^=&]+)=", url.split("#")[0])] + (["fragment"] if "#" in url else [])
    return list(dict.fromkeys(out))


def plain_rules(rows, least, confidence):
    """All itemsets of at least `least` rows, the sure rules among them, without those that a part of theirs says."""
    counts, agree = {}, {}
    for tokens, label in rows:
        for k in range(1, len(tokens) + 1):
            for items in combinations(sorted(tokens), k):
                counts[items] = counts.get(items, 0) + 1
                agree[items, label] = agree.get((items, label), 0) + 1
    sure = {key: n / counts[key[0]] for key, n in agree.items() if n >= least and n / counts[key[0]] >= confidence}
    return {key: c for key, c in sure.items() if not any(set(o) < set(key[0]) and v == key[1] and d >= c for (o, v), d in sure.items())}


def test_url_mining(spark):
    """Mined rules and the verdicts of the query's labels against all itemsets; URLs of any length."""
    rng = random.Random(7)
    rows = []
    for _ in range(200):
        tokens = [t for t in "abcdefg" if rng.random() < 0.45]
        tokens = [t for t in tokens if t != "f" or not {"b", "g"} <= set(tokens)]
        sure = "allow" if {"b", "g"} <= set(tokens) else "block" if "f" in tokens and rng.random() < 0.97 else None
        rows.append((tokens, sure or rng.choice(["allow", "block"])))
    rules = urls.mine(spark.createDataFrame(rows, "tokens array<string>, label string"), support=0.05)
    got = {(r.tokens, r.verdict): round(r.confidence, 9) for r in rules}
    assert got == {k: round(c, 9) for k, c in plain_rules(rows, 10, urls.CONFIDENCE).items()} and len({v for _, v in got}) == 2
    index = urls.RuleIndex(rules)
    for tokens, _ in rows:
        fits = [r for r in rules if set(r.tokens) <= set(tokens)]
        assert index.best(tokens) == min(fits, key=lambda r: (-r.confidence, -r.support, r.tokens, r.verdict), default=None)
    df = spark.createDataFrame([(u,) for u in [*URLS, LONG]], "url string")
    tokens = df.select("url", urls.tokens_of(F.col("url"), urls.host_of(F.col("url")), urls.path_of(F.col("url"))).alias("t")).collect()
    assert all(r.t == plain_tokens(r.url) for r in tokens) and "a:f" in plain_tokens(LONG) and "p5:six.html" in plain_tokens(LONG)


def test_url_weak_labels(spark):
    """The query's lexicon can block: hosts with an unwanted word go, what only looks like one stays; nulls are allowed."""
    known = [f"https://{h}.example.com/{p}/{i}" for h in ("www.casino-win", "m.free-bets", "blog.alphabet", "casinova") for p in ("en", "es") for i in range(30)]
    rows = list(enumerate([*known, None, "", "no scheme", LONG]))
    pages = spark.createDataFrame(rows, "page_id long, url string")
    got = {r.page_id: r for r in urls.filter_urls(pages, urls.lexicon_labels(pages)).collect()}
    for i, u in rows:
        assert got[i].verdict == ("block" if u and ("casino-win" in u or "free-bets" in u or u == LONG) else "allow"), u
    assert got[0].mined_rule and got[0].confidence >= urls.CONFIDENCE and got[len(known)].mined_rule is None


def test_urls(spark):
    rng = random.Random(3)
    many = [f"http{rng.choice(('', 's'))}://{rng.choice(('m', 'blog', 'w'))}.example.{rng.choice(('com', 'net', 'org'))}/{rng.choice(('en', 'de', 'fr'))}/{rng.randint(0, 99)}" for _ in range(300)]
    rows = list(enumerate(URLS + many)) + [(0, URLS[0]), (None, URLS[1])]
    df = spark.createDataFrame([(i, u, None, "x", None) for i, u in rows], "page_id long, url string, html string, tokens string, host string")
    found = urls.filter_urls(df, urls.lexicon_labels(df))
    got = {(r.page_id, r.host, r.path, r.rule): r.verdict for r in found.collect()}
    for i, u in rows:
        host, path, rule = plain_url(u)
        verdict = got[i, host, path, rule.name if rule else None]
        assert verdict == (rule.verdict if rule else "allow")
    assert urls.filter_urls(df.limit(0), urls.lexicon_labels(df.limit(0))).count() == 0


def test_url_labels(spark):
    """Unruled pages are judged by the labels given; labelled pages that a fixed rule fits never train."""
    pages = spark.createDataFrame([(i, f"https://{h}.example.com/en/{i}") for i in range(40) for h in ("casino", "news")], "page_id long, url string")
    given = [(f"https://casino.example.com/es/{i}", "block") for i in range(20)] + [(f"https://news.example.com/es/{i}", "allow") for i in range(20)]
    label = lambda rows: spark.createDataFrame(rows, "url string, label string")
    got = urls.filter_urls(pages, label([*given, (None, "block"), ("https://x.com/", None), ("https://x.com/", "else")])).collect()
    assert len(got) == 80 and all(r.verdict == ("block" if r.host.startswith("casino") else "allow") and r.mined_rule for r in got)
    ruled = urls.filter_urls(pages, label([(f"https://casino.example.com/de/{i}", "block") for i in range(20)]))
    assert ruled.filter("mined_rule is not null or verdict <> 'allow'").count() == 0


def test_url_rules(spark):
    """Tokens of the same rows are one item, named by the smallest; too few rows give no rule."""
    rows = [(["a", "b"], "block")] * 20 + [(["a", "c", "d"], "allow")] * 20 + [(["c", "d"], "allow")] * 5
    rules = urls.mine(spark.createDataFrame(rows, "tokens array<string>, label string"))
    assert {(r.tokens, r.verdict) for r in rules} == {(("b",), "block"), (("c",), "allow")}
    index = urls.RuleIndex(rules)
    assert index.best(["b", "a"]).verdict == "block" and index.best(["a"]) is None
    assert urls.mine(spark.createDataFrame(rows[:4], "tokens array<string>, label string")) == []
    assert urls.mine(spark.createDataFrame([], "tokens array<string>, label string")) == []


def test_url_rules_of_long_rows(spark):
    """No token of a row is left out: a rule of tokens that tell least is found beside more than ten that tell more."""
    rng, rows = random.Random(11), []
    for _ in range(240):
        label = rng.choice(["allow", "block"])
        tokens = [t for t in "abcdefghijkl" if rng.random() < (0.95 if label == "block" else 0.8)]
        tokens += ["y", "z"] if label == "allow" and rng.random() < 0.5 else rng.choice([["y"], ["z"]])
        rows.append((tokens, label))
    rules = urls.mine(spark.createDataFrame(rows, "tokens array<string>, label string"), support=0.05)
    got = {(r.tokens, r.verdict): round(r.confidence, 9) for r in rules}
    assert got == {k: round(c, 9) for k, c in plain_rules(rows, 12, urls.CONFIDENCE).items()}
    assert got[("y", "z"), "allow"] == 1 and max(len(t) for t, _ in rows) > 12


def test_url_rules_of_chains(spark):
    """Rows of 60 frequent tokens, each a part of the one before: 2 ** 60 itemsets, of which few can be rules."""
    rows = [([f"t{j:02}" for j in range(i % 60 + 1)], "block" if i % 60 >= 30 else "allow") for i in range(1200)]
    rules = urls.mine(spark.createDataFrame(rows, "tokens array<string>, label string"))
    got = {r.tokens: (r.verdict, r.confidence) for r in rules}
    assert got == {(f"t{j:02}",): ("block", min(30, 60 - j) / (60 - j)) for j in range(27, 60)}

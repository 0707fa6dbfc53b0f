"""The queries themselves, whole tables with production parameters, against plain versions."""

import hashlib
import re

import brute
import pytest
from oracle import DATA, connect
from test_exact import plain_licence
from test_learned import plain_url

from cograph.llm import licences, queries, tokens, urls


@pytest.fixture(scope="module")
def docs():
    return connect().execute("SELECT doc_id, text, lang FROM documents ORDER BY doc_id").fetchall()


def run(spark, name):
    return queries.queries()[name](spark, DATA).collect()


def test_op1(spark, docs):
    """Held-out accuracy on the table's own labels."""
    lang = {d: x for d, _, x in docs}
    got = run(spark, "op1_language")
    assert sorted(r.doc_id for r in got) == sorted(lang)
    held = [(r.lang_pred, lang[r.doc_id]) for r in got if r.held_out and lang[r.doc_id]]
    assert len(held) > 20 and sum(a == b for a, b in held) / len(held) >= 0.9


def test_op2(spark, docs):
    want = {(d, n, gone, hashlib.sha256(kept.encode()).hexdigest()) for d, n, gone, kept in brute.substrings([r[:2] for r in docs])}
    assert {(r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in run(spark, "op2_substrings")} == want and any(x[2] for x in want)


def test_op3(spark, docs):
    """Everything but what windows add to labels and score."""
    want = {d: plain_licence(t) for d, t, _ in docs}
    got = run(spark, "op3_licences")
    assert len(got) == len(want) and any(r.base_labels for r in got) and any(r.labels != r.base_labels for r in got)
    for r in got:
        *base, labels, score = want[r.doc_id]
        assert [r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels] == base
        assert set(filter(None, labels.split(","))) <= set(filter(None, r.labels.split(","))) and r.score >= score


def test_op3_windows(spark, docs):
    """A label beyond those of phrases and lines has a window of its template's words behind it."""
    for r in run(spark, "op3_licences"):
        text = next(t for d, t, _ in docs if d == r.doc_id) or ""
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
        held = set(r.base_labels.split(",")) | {""}
        for label, t in licences.TEMPLATES:
            parts = re.findall("[a-z0-9]+", t)
            want, span = set(parts), -(-len(parts) * 3 // 2)
            if any(len(want & set(words[i : i + span])) >= licences.CONTAINMENT * len(want) - 1e-9 for i in range(len(words)) if words[i] in want):
                held.add(label)
        assert set(r.labels.split(",")) <= held


def test_op5(spark, docs):
    from tokenizers import Tokenizer

    want = brute.tokens([r[:2] for r in docs], Tokenizer.from_file(tokens.default_tokenizer()))
    assert sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in run(spark, "op5_tokens")) == sorted(want)


def test_op6(spark, docs):
    assert sorted((r.doc_id, r.fingerprint, r.component_id) for r in run(spark, "op6_simhash")) == brute.simhash([r[:2] for r in docs])


def test_op7(spark):
    """Hosts, paths and rules; what no rule fits goes exactly if a frequent unwanted word is in its host."""
    pages = connect().execute("SELECT page_id, url FROM pages").fetchall()
    got = {r.page_id: r for r in run(spark, "op7_urls")}
    assert len(got) == len(pages)
    for i, u in pages:
        host, path, rule = plain_url(u)
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule.name if rule else None)
        if rule:
            assert got[i].verdict == rule.verdict
        elif got[i].verdict == "block":
            assert got[i].mined_rule and got[i].confidence >= urls.CONFIDENCE
        else:
            assert got[i].verdict == "allow"


def test_op8(spark, docs):
    """Every item that stands in a document word for word is found."""
    words = lambda t: f" {' '.join(re.findall(r'[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+', re.sub('[A-Z]', lambda m: m[0].lower(), t or '')))} "
    bench = [(i, words(t)) for i, t in connect().execute("SELECT item_id, text FROM benchmark").fetchall()]
    whole = {(d, i) for d, t, _ in docs for text in [words(t)] for i, item in bench if item in text}
    got = {(r.doc_id, r.item_id) for r in run(spark, "op8_contamination")}
    assert whole <= got and len(got) <= 2 * len(whole) + 5

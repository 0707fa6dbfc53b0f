"""License scans: phrases, and an exact set-similarity join of text blocks with license templates.

A block is a line of a document, or a window of SPREAD times a template's number of words, from any word on and across
line ends, so that a notice is found wherever its lines break. A block meets a template if it holds at least `CONTAINMENT` of the template's
distinct words. The words of all templates are counted over all documents and numbered from the rarest on; the words
of templates and of blocks (those that stand in some template) are put in that one order. A block can meet a template
of n words, o of which it must hold, only if it holds one of the template's n - o + 1 rarest (prefix filter), has at
least o words (length filter), and if from the first such word on, which is place i of the template and place j of the
block, both still have o words (positional filter: what is rarer than that word is not shared). What passes is counted
in full, so the join is exact. For windows, a whole document is joined like a block first: a window can only meet a
template that its document meets.

Words are runs of ASCII letters and digits and of non-ASCII characters, with A-Z in lower case.

Defined cases: null text has no words; empty texts likewise; repeated rows stay; null ids stay null; an empty table
gives no rows. `score` is the largest share of a template that a block holds among those met, 1 where a fixed phrase
stands, else 0.
"""

from __future__ import annotations

from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cograph.llm.common import NOT_WORD, mapped, table, text_bytes, word_hashes, word_spans, words_of

CONTAINMENT, SPREAD, ROWS = 0.9, 1.5, 1024

#: Fixed by the contract: phrases and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Templates of this operator's own: a label and the words of a notice.
NOTICES = (
    ("apache-2.0", "licensed under the apache license version 2.0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("cc-by-nc", "licensed under cc by nc 4.0"),
    ("cc-by-sa", "licensed under cc by sa 4.0"),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3"),
    ("lgpl", "licensed under the gnu lesser general public license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2.0"),
    ("no-copy", "no part of this publication may be reproduced distributed or transmitted in any form without prior written permission"),
)

#: What the short grant lines name ("Released under the MIT License").
NAMES = (
    ("apache-2.0", "the apache license version 2.0"),
    ("bsd", "the bsd license"),
    ("cc-by-nc", "cc by nc 4.0"),
    ("cc-by-sa", "cc by sa 4.0"),
    ("gpl-3.0", "the gnu general public license version 3"),
    ("lgpl", "the gnu lesser general public license"),
    ("mit", "the mit license"),
    ("mpl-2.0", "the mozilla public license version 2.0"),
)
TEMPLATES = tuple(dict.fromkeys((*NOTICES, *((label, f"{verb} under {name}") for label, name in NAMES for verb in ("licensed", "released", "distributed")))))


def _hash(text: str) -> np.ndarray:
    return words_of(pa.array([text], pa.string()))[0]


class Matcher:
    """Templates against blocks; `counts`: how often each template word stands in the corpus, by its hash."""

    def __init__(self, templates, counts: dict[int, int], containment: float = CONTAINMENT):
        self.labels = [t[0] for t in templates]
        sets = [set(_hash(t[1]).tolist()) for t in templates]
        # Terms in the order of the search (by hash), and the place of each in the one order of all words (rarest first).
        self.terms = np.unique(np.array([h for s in sets for h in s], dtype=np.uint64))
        ordered = sorted(self.terms.tolist(), key=lambda h: (counts.get(h, 0), h))
        number = {h: i for i, h in enumerate(ordered)}
        self.number = np.array([number[h] for h in self.terms.tolist()], dtype=np.int64)
        self.size = np.array([len(s) for s in sets])
        self.need = np.array([ceil(containment * len(s) - 1e-9) for s in sets])
        prefix: list[list[tuple[int, int]]] = [[] for _ in self.terms]
        member: list[list[int]] = [[] for _ in self.terms]
        for t, s in enumerate(sets):
            for place, n in enumerate(sorted(number[h] for h in s)):
                member[n].append(t)
                if place <= self.size[t] - self.need[t]:
                    prefix[n].append((t, place))
        self.member_at, self.member = _ragged(member)
        self.prefix_at, flat = _ragged([[t for t, _ in x] for x in prefix])
        self.prefix = flat
        self.place = np.array([p for x in prefix for _, p in x], dtype=np.int64)
        self.sets = [np.array(sorted(s), dtype=np.uint64) for s in sets]
        self.span = [ceil(SPREAD * len(_hash(t[1]))) for t in templates]

    def windows(self, words: np.ndarray, first: np.ndarray) -> list[tuple[int, int, float]]:
        """(row, template, largest share of a window) of every pair that meets the threshold."""
        out = []
        rows = np.repeat(np.arange(len(first) - 1), np.diff(first))
        for r, t, _ in zip(*(x.tolist() for x in self.match(words, rows))):
            mine, want, span = words[first[r] : first[r + 1]], self.sets[t], self.span[t]
            at = np.minimum(np.searchsorted(want, mine), len(want) - 1)
            hits = np.flatnonzero(want[at] == mine)
            term, hits = at[hits].tolist(), hits.tolist()
            inside, low, distinct, most = [0] * len(want), 0, 0, 0
            for x, place in zip(term, hits):
                distinct += not inside[x]
                inside[x] += 1
                while place - hits[low] >= span:
                    inside[term[low]] -= 1
                    distinct -= not inside[term[low]]
                    low += 1
                most = max(most, distinct)
            if most >= self.need[t]:
                out.append((r, t, most / len(want)))
        return out

    def match(self, words: np.ndarray, block: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(block, template, share) of every pair that meets the threshold; `block` is sorted."""
        nothing = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        if not len(words) or not len(self.terms):
            return nothing
        at = np.minimum(np.searchsorted(self.terms, words), len(self.terms) - 1)
        hit = np.flatnonzero(self.terms[at] == words)
        if not len(hit):
            return nothing
        n, many = len(self.labels), len(self.terms)
        # The distinct words of each block that stand in templates, in the one order; what each block has from there on.
        once = np.unique(block[hit] * many + self.number[at[hit]])
        mine, term = once // many, once % many
        rest = np.searchsorted(mine, mine, side="right") - np.arange(len(mine))
        length = np.bincount(block, minlength=int(block[-1]) + 1)
        which, entry = _expand(self.prefix_at, term)
        pair, place, left = mine[which] * n + self.prefix[entry], self.place[entry], rest[which]
        # Of each pair, the first shared word of the prefix decides: pairs are in the block's order of words.
        pair, first = np.unique(pair, return_index=True)
        t, place, left = pair % n, place[first], left[first]
        pair = pair[(length[pair // n] >= self.need[t]) & (np.minimum(self.size[t] - place, left) >= self.need[t])]
        self.passed = len(pair)
        if not len(pair):
            return nothing
        inside = np.isin(mine, np.unique(pair // n))
        which, entry = _expand(self.member_at, term[inside])
        got, held = np.unique(mine[inside][which] * n + self.member[entry], return_counts=True)
        good = (held >= self.need[got % n]) & np.isin(got, pair)
        got, held = got[good], held[good]
        return got // n, got % n, held / self.size[got % n]


def _ragged(lists) -> tuple[np.ndarray, np.ndarray]:
    return np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int64), np.array([y for x in lists for y in x], dtype=np.int64)


def _expand(at: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each of `rows`, its entries in a ragged array: (index into rows, entry)."""
    many = at[rows + 1] - at[rows]
    which = np.repeat(np.arange(len(rows)), many)
    begin = np.concatenate([[0], np.cumsum(many)[:-1]]) if len(many) else many
    return which, np.arange(len(which)) - begin[which] + at[rows][which]


def _scan(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes, words before each text, and the block (line) of each word, numbered through all texts."""
    raw, at = text_bytes(texts)
    raw = raw | (((raw >= 65) & (raw <= 90)).astype(np.uint8) << 5)
    starts, ends, first = word_spans(raw, at, NOT_WORD)
    lines = np.searchsorted(np.flatnonzero(raw == 10), starts)
    rows = np.repeat(np.arange(len(at) - 1), np.diff(first))
    return word_hashes(raw, starts, ends), first, lines + rows


def _counter(terms: np.ndarray):
    def run(batches):
        total = np.zeros(len(terms), dtype=np.int64)
        for batch in batches:
            for i in range(0, batch.num_rows, ROWS):
                words = words_of(batch.column("text").slice(i, ROWS))[0]
                if len(words):
                    at = np.minimum(np.searchsorted(terms, words), len(terms) - 1)
                    total += np.bincount(at[terms[at] == words], minlength=len(terms))
        yield pa.RecordBatch.from_arrays([pa.array(terms.astype(np.int64)), pa.array(total)], names=["term", "n"])

    return run


def word_counts(docs: DataFrame, templates=TEMPLATES) -> dict[int, int]:
    """How often each word of the templates stands in all documents: one row a template word."""
    terms = np.unique(np.concatenate([_hash(t[1]) for t in templates]))
    counted = docs.select("text").transform(mapped(_counter(terms), "term long, n long")).groupBy("term").agg(F.sum("n").alias("n"))
    return {r.term & 0xFFFFFFFFFFFFFFFF: r.n for r in counted.collect()}


SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
_ARROW = pa.schema([("doc_id", pa.int64()), *[(c, pa.int64()) for c in ("n_words", "n_base", "first_word", "last_word")], ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64())])


def phrase_places(words: np.ndarray, first: np.ndarray, phrases=PHRASES) -> list[tuple[int, int, str]]:
    """(row, word, label) of every place of a phrase."""
    out = []
    for phrase, label in phrases.items():
        want = _hash(phrase)
        if len(words) < len(want):
            continue
        same = words[: len(words) - len(want) + 1] == want[0]
        at = np.flatnonzero(same)
        for k in range(1, len(want)):
            at = at[words[at + k] == want[k]]
        row = np.searchsorted(first, at, side="right") - 1
        whole = at + len(want) <= first[row + 1]
        out += [(r, w, label) for r, w in zip(row[whole].tolist(), (at - first[row])[whole].tolist())]
    return out


def _judge(templates, counts: dict[int, int], containment: float):
    def run(batches):
        matcher = Matcher(templates, counts, containment)
        for batch in batches:
            for i in range(0, batch.num_rows, ROWS):
                part = batch.slice(i, ROWS)
                words, first, block = _scan(part.column("text"))
                n = part.num_rows
                places, base, labels, score = [[] for _ in range(n)], [set() for _ in range(n)], [set() for _ in range(n)], [0.0] * n
                for r, w, label in phrase_places(words, first):
                    places[r].append(w)
                    base[r].add(label)
                    labels[r].add(label)
                    score[r] = 1.0
                blocks, which, share = matcher.match(words, block)
                if len(blocks):
                    row = np.searchsorted(first, np.searchsorted(block, blocks), side="right") - 1
                    for r, t, s in zip(row.tolist(), which.tolist(), share.tolist()):
                        labels[r].add(matcher.labels[t])
                        score[r] = max(score[r], s)
                for r, t, s in matcher.windows(words, first):
                    labels[r].add(matcher.labels[t])
                    score[r] = max(score[r], s)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id").cast(pa.int64()),
                        pa.array(np.diff(first).astype(np.int64)),
                        pa.array([len(p) for p in places], pa.int64()),
                        pa.array([min(p, default=None) for p in places], pa.int64()),
                        pa.array([max(p, default=None) for p in places], pa.int64()),
                        pa.array([",".join(sorted(x)) for x in base]),
                        pa.array([",".join(sorted(x)) for x in labels]),
                        pa.array(score),
                    ],
                    schema=_ARROW,
                )

    return run


def scan_licences(docs: DataFrame, templates=TEMPLATES, containment: float = CONTAINMENT) -> DataFrame:
    return docs.select("doc_id", "text").transform(mapped(_judge(templates, word_counts(docs, templates), containment), SCHEMA))


def op3_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licences(table(spark, sf_dir, "documents"))

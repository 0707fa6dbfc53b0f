"""Benchmark decontamination: a BM25 inverted index of the test items, searched with every passage of every document.

A passage is a window of two neighbouring halves of 64 words, so every run of up to 64 words lies whole in one. The
score of an item is its BM25 score for the passage's distinct words, divided by its score for its own words; all
items of at least `THRESHOLD` are retrieved. The search is block-max WAND, for all passages of a batch at once. A word's
postings are cut into blocks of `BLOCK` neighbouring items, each with its largest impact. An item's weakest words, which
together cannot lift it over the threshold, have no postings (as in WAND, no item is met by them alone); a block's
largest left-out sum bounds what they could add. First only the blocks' maxima are added up: a block of items whose
maxima and left-out sum stay below the threshold is skipped with all its postings. The postings of the others are
added up, and items whose sum plus their own left-out words reaches the threshold are scored in full. So nothing above
the threshold is missed. What is retrieved is verified by the
shares of the question's and of the answer's five-word runs that the passage holds (the answer is an item's last
sentence, the question what stands before it; a single sentence is both).

An item longer than a passage (128 words) is searched as a whole and in overlapping pieces of 64 words, each scored and
verified like an item of its own; a passage that holds a piece holds the item. Its score is then the best piece's, its
overlaps are the shares of the whole item's runs that the matching passages hold together.

Items are dealt into chunks of a bounded number of words; each chunk's index is sent to the tasks and the documents
are read once a chunk. With several chunks, each one's result is written and its index dropped before the next one is
built, so one index at a time is held. Document frequencies are counted over all items.

Words are runs of ASCII letters and digits and of non-ASCII characters, with A-Z in lower case.

Defined cases: null and empty texts match nothing, as do null, empty and word-less items; repeated items count once;
repeated documents are each judged; a null doc_id is kept; empty tables give no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from math import ceil, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cograph.llm.common import WORD_SQL, ascii_lower, mapped, remove, table, words_of, written

THRESHOLD, OVERLAP, HALF, RUN, K1, B, SPARE, CHUNK_WORDS, BLOCK = 0.4, 0.3, 64, 5, 1.2, 0.75, 0.15, 2_000_000, 4


def pieces_of(n: int) -> list[tuple[int, int]]:
    """The whole item of n words, and for one longer than a passage its pieces of HALF words, every half of that."""
    if n <= 2 * HALF:
        return [(0, n)]
    return [(0, n), *[(at, at + HALF) for at in range(0, n - HALF, HALF // 2)], (n - HALF, n)]


def runs_of(words: np.ndarray, n: int = RUN) -> np.ndarray:
    """Hashes of the runs of n words (of all words, if they are fewer)."""
    n = min(n, len(words))
    if not n:
        return words
    out = np.zeros(len(words) - n + 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(n):
            out += words[k : k + len(out)] * np.uint64((2 * k + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    return out


def held(some: np.ndarray, sorted_: np.ndarray) -> np.ndarray:
    """Which of `some` are in `sorted_`."""
    if not len(sorted_):
        return np.zeros(len(some), dtype=bool)
    return sorted_[np.minimum(np.searchsorted(sorted_, some), len(sorted_) - 1)] == some


def _spread(begin: np.ndarray, many: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For ranges of `many` places from `begin` on: (number of the range, place) of each place."""
    of = np.repeat(np.arange(len(begin)), many)
    return of, np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many) + begin[of]


class Index:
    """Postings of a chunk of items in arrays: each word's blocks from its place on, each block's items and impacts."""

    def __init__(self, items: list[tuple[int, str]], df: dict[str, int], n_items: int, mean_words: float, threshold: float = THRESHOLD):
        self.ids, self.words, self.impacts, self.runs, self.rest, self.whole = [], [], [], [], [], []
        #: Of each item, by the number of its first entry: the runs of question and answer, and the words of a run.
        self.question, self.answer, self.lengths = {}, {}, {}
        self.threshold = threshold
        #: Postings of the blocks that passages met, and of those that were not skipped.
        self.met = self.opened = 0
        entries: list[tuple[int, int, float]] = []
        for item, text in items:
            parts = [p for p in re.split(r"(?<=[.?!])\s+|\n+", text) if re.search(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]", p)]
            hashes, first = words_of(pa.array([text, " ".join(parts[:-1] or parts), parts[-1]], pa.string()))
            plain = re.findall(WORD_SQL, re.sub("[A-Z]", lambda m: m[0].lower(), text))
            names = dict(zip(plain, hashes[: first[1]].tolist(), strict=True))
            whole = len(self.ids)
            self.question[whole] = runs_of(hashes[first[1] : first[2]])
            self.answer[whole] = runs_of(hashes[first[2] : first[3]])
            self.lengths[whole] = (min(RUN, first[2] - first[1]), min(RUN, first[3] - first[2]))
            for low, high in pieces_of(len(plain)):
                j = len(self.ids)
                counts = Counter(plain[low:high])
                norm = K1 * (1 - B + B * (high - low) / mean_words)
                weigh = {w: log(1 + (n_items - df[w] + 0.5) / (df[w] + 0.5)) * c * (K1 + 1) / (c + norm) for w, c in counts.items()}
                own = sum(weigh.values())
                order = sorted(weigh, key=lambda w: (weigh[w], w))
                left, spare = 0.0, min(SPARE, threshold / 2)
                for w in order:
                    impact = weigh[w] / own
                    if left + impact < spare:
                        left += impact
                    else:
                        entries.append((names[w], j, impact))
                self.ids.append(item)
                self.words.append(np.array([names[w] for w in order], dtype=np.uint64))
                self.impacts.append(np.array([weigh[w] / own for w in order]))
                self.runs.append(runs_of(hashes[low:high]))
                self.rest.append(left)
                self.whole.append(whole)
        self.rest = np.array(self.rest)
        entries.sort()
        hashes = np.array([e[0] for e in entries], dtype=np.uint64)
        self.items = np.array([e[1] for e in entries], dtype=np.int64)
        self.impact = np.array([e[2] for e in entries])
        # Postings are in the order of (word, item): a block is a run of one word and one block of items.
        block = self.items // BLOCK
        edge = np.flatnonzero(np.concatenate([[True], (hashes[1:] != hashes[:-1]) | (block[1:] != block[:-1])])) if len(entries) else np.zeros(0, np.int64)
        self.block_at, self.block_many, self.block = edge, np.diff(np.concatenate([edge, [len(entries)]])), block[edge]
        self.block_max = np.maximum.reduceat(self.impact, edge) if len(entries) else self.impact
        self.terms, self.begin, self.many = np.unique(hashes[edge], return_index=True, return_counts=True)
        self.blocks = -(-len(self.ids) // BLOCK)
        self.block_rest = np.maximum.reduceat(self.rest, np.arange(0, len(self.ids), BLOCK)) if len(self.ids) else self.rest
        size = 1 << max(12, int(len(self.terms) * 8).bit_length())
        self.mask = np.uint64(size - 1)
        self.slots = np.full(size, -1, dtype=np.int32)
        self.more: dict[int, list[int]] = {}
        for t, slot in enumerate((self.terms & self.mask).tolist()):
            if self.slots[slot] < 0:
                self.slots[slot] = t
            else:
                self.more.setdefault(slot, []).append(t)
        self.crowded = np.array(sorted(self.more), dtype=np.int64)

    def terms_of(self, words: np.ndarray) -> np.ndarray:
        """The number of each word's term, -1 without postings."""
        slot = (words & self.mask).astype(np.int64)
        term = self.slots[slot]
        known = term >= 0
        term = np.where(known & (self.terms[np.maximum(term, 0)] == words), term, -1) if len(self.terms) else term
        if len(self.crowded):
            open_ = np.flatnonzero(known & (term < 0))
            at = np.minimum(np.searchsorted(self.terms, words[open_]), len(self.terms) - 1)
            term[open_] = np.where(self.terms[at] == words[open_], at, -1)
        return term

    def search(self, words: np.ndarray, first: np.ndarray) -> list[tuple[int, int, float, float, float]]:
        """(row, item, score, question overlap, answer overlap) of all verified matches; the best passage of each."""
        counts = np.diff(first)
        halves = np.concatenate([[0], np.cumsum(-(-counts // HALF))])
        term = self.terms_of(words)
        hit = np.flatnonzero(term >= 0)
        if not len(hit):
            return []
        row = np.searchsorted(first, hit, side="right") - 1
        half = halves[row] + (hit - first[row]) // HALF
        key = np.unique(half * len(self.terms) + term[hit])
        half, term = key // len(self.terms), key % len(self.terms)
        begins = np.zeros(halves[-1] + 1, dtype=bool)
        begins[halves[:-1][counts > 0]] = True
        # Blocks of every passage (its first half, and the half behind it), and the sums of their maxima.
        of, place = _spread(self.begin[term], self.many[term])
        half = half[of]
        back = np.flatnonzero(~begins[half])
        place = np.concatenate([place, place[back]])
        key, which = np.unique(np.concatenate([half, half[back] - 1]) * self.blocks + self.block[place], return_inverse=True)
        bound = np.bincount(which, weights=self.block_max[place], minlength=len(key)) + self.block_rest[key % self.blocks]
        open_ = bound >= self.threshold - 1e-9
        keep = np.flatnonzero(open_[which])
        self.met, self.opened = self.met + int(self.block_many[place].sum()), self.opened + int(self.block_many[place[keep]].sum())
        # The postings of the blocks that are left.
        of, posting = _spread(self.block_at[place[keep]], self.block_many[place[keep]])
        key, which = np.unique(key[which[keep]][of] // self.blocks * len(self.ids) + self.items[posting], return_inverse=True)
        total = np.bincount(which, weights=self.impact[posting], minlength=len(key))
        good = np.flatnonzero(total + self.rest[key % len(self.ids)] >= self.threshold - 1e-9)
        out: dict[tuple[int, int], tuple[float, float, float]] = {}
        seen: dict[tuple[int, int], list[np.ndarray]] = {}
        for k in good.tolist():
            half, j = divmod(int(key[k]), len(self.ids))
            r = int(np.searchsorted(halves, half, side="right")) - 1
            low = int(first[r]) + (half - int(halves[r])) * HALF
            mine = words[low : min(low + 2 * HALF, int(first[r + 1]))]
            score = float(self.impacts[j] @ held(self.words[j], np.sort(mine)))
            if score < self.threshold:
                continue
            whole = self.whole[j]
            asked, told = (held(x, np.sort(runs_of(mine, n))) for x, n in zip((self.question[whole], self.answer[whole]), self.lengths[whole]))
            if j == whole:
                both = (asked.sum() + told.sum()) / (len(asked) + len(told))
            else:
                both = held(self.runs[j], np.sort(runs_of(mine))).mean()
            if both < OVERLAP:
                continue
            if len(self.ids) > whole + 1 and self.whole[whole + 1] == whole:  # a long item is gathered from all its passages
                had = seen.setdefault((r, whole), [np.zeros_like(asked), np.zeros_like(told)])
                had[0] |= asked
                had[1] |= told
                out[r, whole] = (max(score, out.get((r, whole), (0,))[0]), float(had[0].mean()), float(had[1].mean()))
            elif score > out.get((r, whole), (0,))[0]:
                out[r, whole] = (score, float(asked.mean()), float(told.mean()))
        return [(r, self.ids[j], *x) for (r, j), x in sorted(out.items())]


def indexes(items: DataFrame, threshold: float = THRESHOLD, chunk_words: int | None = None):
    """The index of each chunk of `items` (item_id, text)."""
    chunk_words, spark = chunk_words or CHUNK_WORDS, items.sparkSession
    words = F.regexp_extract_all(ascii_lower("text"), F.lit(WORD_SQL), F.lit(0))
    items = items.select("item_id", "text").distinct().withColumn("words", words).filter(F.size("words") > 0)
    n, total = items.agg(F.count("*"), F.sum(F.size("words"))).first()
    chunks = ceil((total or 0) / chunk_words)
    df = items.select(F.explode(F.array_distinct("words")).alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    for c in range(chunks):
        mine = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(chunks)) == c)
        rows = sorted((tuple(r) for r in mine.select("item_id", "text").collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
        own = mine.select(F.explode("words").alias("w")).distinct()
        counts = {r.w: r.n for r in df.join(own, "w").collect()}
        if rows:
            yield spark.sparkContext.broadcast(Index(rows, counts, n, total / n, threshold))


ROWS = 512


def _matches(shared):
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("score", pa.float64()), ("question_overlap", pa.float64()), ("answer_overlap", pa.float64())])

    def run(batches):
        index = shared.value
        for batch in batches:
            for i in range(0, batch.num_rows, ROWS):
                part = batch.slice(i, ROWS)
                found = index.search(*words_of(part.column("text")))
                if found:
                    ids = part.column("doc_id").to_pylist()
                    yield pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*[(ids[r], *rest) for r, *rest in found]), schema)], schema=schema)

    return run


def _clean(shared):
    def run(batches):
        index = shared.value
        for batch in batches:
            for i in range(0, batch.num_rows, ROWS):
                part = batch.slice(i, ROWS)
                bad = {r for r, *_ in index.search(*words_of(part.column("text")))}
                yield part.take(pa.array([r for r in range(part.num_rows) if r not in bad], pa.int64())) if bad else part

    return run


def _chunked(start: DataFrame, step, items: DataFrame, threshold: float) -> DataFrame:
    """step(frame so far, index) for each chunk's index; but for the last, the result is written and the index dropped."""
    out, before, path = start, None, None
    for shared in indexes(items, threshold):
        if before is not None:
            out, new = written(step(out, before), "bench-chunk")
            before.destroy()
            remove(start.sparkSession, *([path] if path else []))
            path = new
        before = shared
    return out if before is None else step(out, before)


MATCH = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double"


def contaminated(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, item_id, score, question_overlap, answer_overlap of every verified match."""
    texts = docs.select(F.col("doc_id").cast("long"), "text")
    none = docs.sparkSession.createDataFrame([], MATCH)
    return _chunked(none, lambda found, shared: found.unionByName(texts.transform(mapped(_matches(shared), MATCH))), items, threshold)


def decontaminate(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of `docs` that hold no test item, with all their columns."""
    return _chunked(docs, lambda rows, shared: rows.transform(mapped(_clean(shared), docs.schema)), items, threshold)


def op8_contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))

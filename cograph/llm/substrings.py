"""Substring dedup by recompression: words covered by a window that starts in an earlier document are removed.

Every document is parsed by recompression: runs of one word become one symbol, then, round after round, pairs of
neighbouring symbols of which the first is of the left and the second of the right class become one. Whether two
symbols merge depends on their names alone, so equal substrings get the same symbols in their interior.

Names are global, and one to one over all documents: a Spark job over all of them gathers the distinct pairs of every
round (for the first one the runs too) under the names that hashing proposes, in buckets by their first bits. Where two different ones meet in a name,
all but one of the lowest such round get another, and the rounds from there on are gathered again with these names, until
no two meet. Words are the terminals.

With each symbol goes its zone: the words that decide that it is there. Wherever the zone's words stand, the symbol
stands too, so equal windows hold the same symbols, save those whose zones reach out of the window. Every window of
`WINDOW` words points at one symbol of a zone of `LEAST_ZONE` words or more that lies in it (the one of the least hash;
it is the same for equal windows) or, if there is none, at itself.

1. Shared symbols reveal repeats: the zones pointed at (about one for four words) are grouped; those in one document
   only cannot be in a repeat.
2. Stretches of windows that point at a zone of several documents are cut at places that their words choose, and each
   piece is spelled by symbols: from the words up, what may merge with a symbol outside is taken off at both ends, and
   the rest goes up a round. Equal stretches, and no others, are spelled alike. A piece that an earlier document has
   too is settled, with all its windows.
3. The windows of the other pieces are spelled alike, and the smallest document of each spelling is found.
4. What is in a smaller document is sent back to its document, and its words go.

A spelling is kept as 64 bits over the names of its symbols, verified by 32 bits of other hashes of the words
themselves. Keys are pre-aggregated before they are shuffled; the joins that send answers back have one small row a
key on the other side, so a key that stands in a third of all rows is split by adaptive execution. Between the steps
tables are written to the shared folder and dropped when they have been used. Rows are known by doc_id and a 32-bit
hash of the text; if different texts of one id share it, another hash is taken.

Defined cases: null and empty texts have no words; a null doc_id is neither smaller nor larger than another, so such
rows neither remove nor lose words; repeated rows and rows with equal ids never remove each other's words, and each
keeps its own text; texts shorter than a window lose nothing; an empty table gives no rows. Errors, as no result would
be right: a text of 2 ** 28 words or more; so many different texts under one id that no 32-bit hash parts them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cograph.llm.common import mapped, remove, splitmix, table, text_bytes, word_hashes, word_spans, written

WINDOW, ROUNDS, LEAST_ZONE, PIECE, LONGEST, BATCH_WORDS, FLUSH, BUCKET_BITS = 13, 3, 6, 16, 64, 150_000, 1_000_000, 12
#: Names are hashes without their last three bits, which hold the round: names of two rounds never meet.
KEEP = 0xFFFFFFFFFFFFFFF8
_FAR = 1 << 20
_NONE, _ALL = np.uint64(0xFFFFFFFFFFFFFFFF), 0xFFFFFFFFFFFFFFFF


class Names:
    """The names of runs (round 0) and pairs (rounds from 1 on): hashes, and others where the Spark rounds found two alike."""

    def __init__(self, others: dict[int, dict[tuple[int, int], int]] | None = None, keep: int = KEEP):
        self.others, self.keep = others or {}, np.uint64(keep)
        self.taken = {r: np.array(sorted({self.proposed(*x, r) for x in found}), dtype=np.uint64) for r, found in self.others.items() if found}

    def proposed(self, left: int, right: int, r: int, salt: int = 0) -> int:
        return int(self.hashed(np.array([left], np.uint64), np.array([right], np.uint64), r, salt)[0])

    def hashed(self, left: np.ndarray, right: np.ndarray, r: int, salt: int = 0) -> np.ndarray:
        mixed = splitmix(left * np.uint64(0x9FB21C651E98DF25) + splitmix(right + np.uint64(0xA24BAED4963EE407 * (salt + 1) & int(_NONE))))
        return splitmix(mixed + np.uint64(r)) & self.keep | np.uint64(r)

    def of(self, left: np.ndarray, right: np.ndarray, r: int) -> np.ndarray:
        """Names of the pairs (left, right), or of the runs of `right` times `left`."""
        out = self.hashed(left, right, r)
        if r in self.taken:
            for i in np.flatnonzero(np.isin(out, self.taken[r])).tolist():
                out[i] = self.others[r].get((int(left[i]), int(right[i])), int(out[i]))
        return out


def parse(words: np.ndarray, row: np.ndarray, names: Names, rounds: int = ROUNDS):
    """The symbols after each round of recompression, from the runs on.

    Yields (name, right class, first word, last word, zone's first, zone's last, new, left, right): `new` are the
    places of the symbols that the round made, `left` and `right` what they were made of.
    """
    if not len(words):
        return
    edge = np.concatenate([[True], row[1:] != row[:-1], [True]])
    begin = np.flatnonzero(edge[:-1] | np.concatenate([[True], words[1:] != words[:-1]]))
    lo, hi = begin, np.concatenate([begin[1:], [len(words)]]) - 1
    name = words[begin]
    new = np.flatnonzero(hi > lo)
    left, right = name[new], (hi - lo + 1)[new].astype(np.uint64)
    name[new] = names.of(left, right, 0)
    # A run ends where another word stands: its zone has both neighbours, and none if the document ends there.
    zlo, zhi = np.where(edge[lo], lo - _FAR, lo - 1), np.where(edge[hi + 1], hi + _FAR, hi + 1)
    for r in range(1, rounds + 2):
        second_class = (splitmix(name ^ np.uint64(0xC0FFEE + 7919 * r)) >> np.uint64(63)).astype(bool)
        yield name, second_class, lo, hi, zlo, zhi, new, left, right
        if r > rounds:
            return
        mine = row[lo]
        near = mine[1:] == mine[:-1]
        pair = np.flatnonzero(~second_class[:-1] & second_class[1:] & near)
        second = np.zeros(len(name), dtype=bool)
        second[pair + 1] = True
        alone = ~second
        alone[pair] = False
        name, hi, zlo, zhi = name.copy(), hi.copy(), zlo.copy(), zhi.copy()
        # What stays single depends on the neighbour that it could have merged with.
        a = np.flatnonzero(alone & ~second_class)
        z = zhi[np.minimum(a + 1, len(name) - 1)]
        has = np.concatenate([near, [False]])[a]
        b = np.flatnonzero(alone & second_class)
        y = zlo[np.maximum(b - 1, 0)]
        had = np.concatenate([[False], near])[b]
        new_hi, new_lo = np.where(has, np.maximum(zhi[a], z), zhi[a] + _FAR), np.where(had, np.minimum(zlo[b], y), zlo[b] - _FAR)
        left, right = name[pair], name[pair + 1]
        name[pair] = names.of(left, right, r)
        hi[pair] = hi[pair + 1]
        low, high = np.minimum(zlo[pair], zlo[pair + 1]), np.maximum(zhi[pair], zhi[pair + 1])
        zhi[a], zlo[b], zlo[pair], zhi[pair] = new_hi, new_lo, low, high
        keep = ~second
        new = (np.cumsum(keep) - 1)[pair]
        name, lo, hi, zlo, zhi = name[keep], lo[keep], hi[keep], zlo[keep], zhi[keep]


def spelled(words: np.ndarray, levels: list, begin: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """64 bits over the spelling of each word range [begin, stop), none empty, by the symbols of all rounds.

    levels: what `parse` yields. Runs at the ends are taken with the words that they have inside. In each round a symbol of the right class at the
    left end might be merged with one outside, as one of the left class at the right end: they are taken off. What is
    left are whole symbols of the next round; those of the last round end the spelling.
    """
    out = splitmix(np.full(len(begin), 0x51ED, dtype=np.uint64))

    def take(which, name, mark):
        out[which] = splitmix((out[which] ^ name) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(mark))

    p = q = None
    for r, (name, second_class, lo, hi, *_) in enumerate(levels):
        at = np.repeat(np.arange(len(lo)), hi - lo + 1)  # the symbol of each word
        if not r:
            p, q = at[begin], at[stop - 1]  # the runs at the ends
            take(slice(None), words[begin], 1)
            take(slice(None), (np.minimum(hi[p] + 1, stop) - begin).astype(np.uint64), 2)
            both = np.flatnonzero(q > p)
            take(both, words[stop[both] - 1], 3)
            take(both, (stop[both] - lo[q[both]]).astype(np.uint64), 4)
            p = p + 1  # whole runs [p, q)
        else:
            some = q > p
            p, q = np.where(some, at[np.where(some, low, 0)], 0), np.where(some, at[np.where(some, high, 0)] + 1, 0)
        if r == ROUNDS:
            live = np.flatnonzero(q > p)
            place = p[live]
            while len(live):
                take(live, name[place], 9)
                place = place + 1
                stay = place < q[live]
                live, place = live[stay], place[stay]
            return out
        some = np.flatnonzero(q > p)
        off = some[second_class[p[some]]]
        take(off, name[p[off]], 5)
        p[off] += 1
        some = np.flatnonzero(q > p)
        off = some[~second_class[q[some] - 1]]
        take(off, name[q[off] - 1], 6)
        q[off] -= 1
        take(slice(None), (q > p).astype(np.uint64), 7)
        some = q > p
        low, high = np.where(some, lo[np.where(some, p, 0)], 0), np.where(some, hi[np.where(some, q - 1, 0)], 0)
    return out


def anchors(words: np.ndarray, first: np.ndarray, names: Names, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, zone's first word, zone's last word) of all zones that some window names."""
    n = len(words)
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    starts = np.flatnonzero(np.arange(n) + window <= first[row + 1]) if n else np.zeros(0, np.int64)
    empty = np.zeros(0, np.int64)
    if not len(starts):
        return empty.astype(np.uint64), empty, empty
    at, length, score = [], [], []
    levels = list(parse(words, row, names))
    for name, _, _, _, zlo, zhi, *_ in levels[1:]:
        size = zhi - zlo + 1
        fits = np.flatnonzero((size >= LEAST_ZONE) & (size <= window))
        at.append(zlo[fits])
        length.append(size[fits])
        score.append(splitmix(name[fits] ^ np.uint64(0x5DEECE66D)) >> np.uint64(1))
    at, length, score = np.concatenate(at), np.concatenate(length), np.concatenate(score)
    best = np.full(n, _NONE)
    by_length = []
    for size in range(LEAST_ZONE, window + 1):
        mine = length == size
        p, s = at[mine], score[mine]
        line = np.full(n + window, _NONE)
        np.minimum.at(line, p, s)
        by_length.append((size, p, s))
        for o in range(window - size + 1):
            np.minimum(best, line[o : o + n], out=best)
    whole = np.zeros(n, dtype=bool)
    whole[starts] = True
    chosen_at, chosen_size = [], []
    for size, p, s in by_length:
        hit = np.zeros(len(p), dtype=bool)
        for o in range(window - size + 1):
            q = p - o
            ok = q >= 0
            q = np.maximum(q, 0)
            hit |= ok & whole[q] & (best[q] == s)
        p = np.unique(p[hit])
        chosen_at.append(p)
        chosen_size.append(size)
    bare = starts[best[starts] == _NONE]
    chosen_at.append(bare)
    chosen_size.append(window)
    lo = np.concatenate(chosen_at)
    hi = np.concatenate([p + size - 1 for p, size in zip(chosen_at, chosen_size)])
    return spelled(words, levels, lo, hi + 1), lo, hi


def _parts(batch: pa.RecordBatch, rows: int = 1024, seed: int = 0):
    """Pieces of a batch of a bounded number of words (a single text may have more): rows, words, words before each row.

    With a seed, other hashes of the words too.
    """
    for i in range(0, batch.num_rows, rows):
        part = batch.slice(i, rows)
        raw, at = text_bytes(part.column("text"))
        starts, ends, first = word_spans(raw, at)
        low = 0
        while low < part.num_rows:
            high = max(low + 1, int(np.searchsorted(first, first[low] + BATCH_WORDS, side="right")) - 1)
            a, b = first[low], first[high]
            if b - a >= 1 << 28:
                raise OverflowError("a text has 2 ** 28 words or more")
            out = part.slice(low, high - low), word_hashes(raw, starts[a:b], ends[a:b]), first[low : high + 1] - a
            yield (*out, word_hashes(raw, starts[a:b], ends[a:b], seed)) if seed else out
            low = high


def _row_of(first: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def _new_symbols(batches, names: Names, low: int, high: int):
    """(round, name, left, right) of the pairs that rounds low to high make of a task's texts (round 1: the runs too), some words at a time."""
    for batch in batches:
        for _, words, first in _parts(batch):
            for at, (name, *_, new, left, right) in enumerate(parse(words, _row_of(first), names, high)):
                if len(new) and at >= (low if low > 1 else 0):
                    yield at, name[new], left, right


def _made(names: Names, low: int, high: int):
    """(bucket, made): the distinct names that rounds low to high make of a task's texts, by their first bits.

    A row has some names of a bucket, eight bytes each, and then for each 32 bits of what it is made of.
    """

    def distinct(held):
        name, part = (np.concatenate(x) for x in zip(*held))
        order = np.argsort(name)
        name, part = name[order], part[order]
        fresh = np.concatenate([[True], (name[1:] != name[:-1]) | (part[1:] != part[:-1])])
        name, part = name[fresh].astype("<u8"), part[fresh].astype("<u4")
        bucket = (name >> np.uint64(64 - BUCKET_BITS)).astype(np.int32)
        begin = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
        edges = np.append(begin, len(name)).tolist()
        made = [name[i:j].tobytes() + part[i:j].tobytes() for i, j in zip(edges, edges[1:])]
        return pa.RecordBatch.from_arrays([pa.array(bucket[begin]), pa.array(made, pa.binary())], names=["bucket", "made"])

    def run(batches):
        held, many = [[] for _ in range(high + 1)], [0] * (high + 1)
        for at, name, left, right in _new_symbols(batches, names, low, high):
            held[at].append((name, (splitmix(splitmix(left ^ np.uint64(0x2545F4914F6CDD1D)) + right) >> np.uint64(32)).astype(np.uint32)))
            many[at] += len(name)
            if many[at] > FLUSH:
                yield distinct(held[at])
                held[at], many[at] = [], 0
        for some in held:
            if some:
                yield distinct(some)

    return run


def _met(batches):
    """The names in which different parts meet, from the rows of `_made` in the order of their buckets; whole buckets at a time."""

    def double(held):
        name = np.concatenate([np.frombuffer(x, "<u8", len(x) // 12) for x in held])
        part = np.concatenate([np.frombuffer(x, "<u4", len(x) // 12, len(x) // 12 * 8) for x in held])
        order = np.argsort(name)
        name, part = name[order], part[order]
        begin = np.flatnonzero(np.concatenate([[True], name[1:] != name[:-1]]))
        met = np.minimum.reduceat(part, begin) != np.maximum.reduceat(part, begin)
        return pa.RecordBatch.from_arrays([pa.array(name[begin[met]].astype(np.uint64).view(np.int64))], names=["name"])

    held, many, last = [], 0, None
    for batch in batches:
        for bucket, made in zip(batch.column("bucket").to_pylist(), batch.column("made").to_pylist()):
            if bucket != last and many > FLUSH:
                yield double(held)
                held, many = [], 0
            held.append(made)
            many, last = many + len(made) // 12, bucket
    if held:
        yield double(held)


def _meant(names: Names, r: int, wanted: list[int] | None = None):
    """(name, l, r): what the wanted names (None: all) are made of."""

    def run(batches):
        for _, name, left, right in _new_symbols(batches, names, r, r):
            some = slice(None) if wanted is None else np.isin(name, np.array(wanted, dtype=np.int64).view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(x[some].view(np.int64)) for x in (name, left, right)], names=["name", "l", "r"])

    return run


def _doubled(texts: DataFrame, names: Names, low: int, high: int) -> list[int]:
    """The names of rounds low to high in which different parts meet."""
    made = texts.transform(mapped(_made(names, low, high), "bucket int, made binary"))
    return [x.name for x in made.repartition("bucket").sortWithinPartitions("bucket").transform(mapped(_met, "name long")).collect()]


def named_globally(texts: DataFrame, rounds: int = ROUNDS, keep: int | None = None) -> Names:
    """The Spark rounds: names of all runs and pairs of `texts` (text), one to one over all documents.

    A job gathers the names proposed for the pairs of all rounds (with the first one's for the runs too). Where two parts
    meet in a name, all but one of those of the lowest such round get another, and the job is run again from that round
    on, as the rounds above it parse with its names. Names that meet are rare (about n ** 2 / 2 ** 62 of n symbols), so
    they fit the driver and one job does, as a rule, for all rounds.
    """
    keep = keep or KEEP
    others: dict[int, dict[tuple[int, int], int]] = {r: {} for r in range(rounds + 1)}
    r, salt = 1, 0
    while True:
        names = Names(others, keep)
        double = _doubled(texts, names, r, rounds)
        remove(texts.sparkSession)  # nothing here holds the job's frames any more, so its shuffle goes
        if not double:
            return names
        lowest = min(x & 7 for x in double)
        r = max(lowest, 1)
        double = [x for x in double if x & 7 == lowest]
        salt += 1
        clash = texts.transform(mapped(_meant(names, r, double), "name long, l long, r long")).distinct().collect()
        known, first = others[lowest], set()
        for x in sorted(clash, key=lambda x: ((x.l & _ALL, x.r & _ALL) in known, x.l & _ALL, x.r & _ALL)):
            if x.name in first:
                known[x.l & _ALL, x.r & _ALL] = names.proposed(x.l & _ALL, x.r & _ALL, lowest, salt)
            first.add(x.name)


def _anchor_rows(names: Names):
    def run(batches):
        for batch in batches:
            for part, words, first in _parts(batch):
                key, lo, hi = anchors(words, first, names)
                if not len(key):
                    continue
                row = np.searchsorted(first, lo, side="right") - 1
                order = np.argsort(row, kind="stable")
                row, key, lo, hi = row[order], key[order], lo[order], hi[order]
                ids, tags = part.column("doc_id").to_numpy()[row], part.column("tag").to_numpy()[row]
                # One number for the text's hash, the zone's place (28 bits) and its length (4 bits).
                where = (tags.astype(np.int64) << 32) | ((lo - first[row]) << 4) | (hi - lo + 1)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(ids), pa.array(where)], names=["key", "doc_id", "place"])

    return run


def _marked(part: pa.RecordBatch, column: str, words: np.ndarray, first: np.ndarray):
    """For each entry of a list column of structs: its row, and its fields as arrays."""
    lists = part.column(column)
    many = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    flat = lists.flatten()
    return np.repeat(np.arange(part.num_rows), many), [flat.field(i).to_numpy(zero_copy_only=False) for i in range(flat.type.num_fields)]


def _cover(n: int, begin: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Which of n places lie in one of the ranges [begin, stop)."""
    marks = np.zeros(n + 1, dtype=np.int32)
    np.add.at(marks, begin, 1)
    np.add.at(marks, stop, -1)
    return np.cumsum(marks[:-1]) > 0


def _checked(others: np.ndarray, begin: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """32 bits over the other hashes of the words of each range, one after another."""
    out, live = splitmix((stop - begin).astype(np.uint64)), np.arange(len(begin))
    place = begin.copy()
    while len(live):
        out[live] = splitmix((out[live] ^ others[place[live]]) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(1))
        place[live] += 1
        live = live[place[live] < stop[live]]
    return (out >> np.uint64(32)).astype(np.uint32).view(np.int32)


def _piece_rows(names: Names):
    def run(batches):
        for batch in batches:
            for part, words, first, others in _parts(batch, seed=77):
                ids, tags, n = part.column("doc_id").to_numpy(), part.column("tag").to_numpy(), len(words)
                row, (place, least) = _marked(part, "zones", words, first)
                lo = (place >> 4) & 0xFFFFFFF
                hi = lo + (place & 15) - 1
                counts = np.diff(first)[row]
                begin, stop = np.maximum(hi - WINDOW + 1, 0), np.minimum(lo, counts - WINDOW) + 1
                ok = stop > begin
                begin, stop = first[row] + begin, first[row] + stop
                hold, need = _cover(n, begin[ok], stop[ok]), _cover(n, begin[ok & (least < ids[row])], stop[ok & (least < ids[row])])
                at = np.flatnonzero(hold)
                if not len(at):
                    continue
                mine = np.searchsorted(first, at, side="right") - 1
                cut = splitmix(words[at] * np.uint64(3) + words[at + 1]) % np.uint64(PIECE) == 0
                fresh = np.concatenate([[True], (at[1:] != at[:-1] + 1) | (mine[1:] != mine[:-1]) | cut[1:]])
                # Where the words choose no place for long, pieces end after LONGEST windows.
                inside = np.arange(len(at)) - np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))
                edge = np.flatnonzero(inside % LONGEST == 0)
                last = np.concatenate([edge[1:], [len(at)]]) - 1
                begin, end, mine = at[edge], at[last] + WINDOW, mine[edge]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(spelled(words, list(parse(words, _row_of(first), names)), begin, end).view(np.int64)), pa.array(_checked(others, begin, end)), pa.array(ids[mine]), pa.array(tags[mine]),
                        pa.array((begin - first[mine]).astype(np.int32)), pa.array((last - edge + 1).astype(np.int32)), pa.array(np.logical_or.reduceat(need[at], edge)),
                    ],
                    names=["h", "c", "doc_id", "tag", "at", "n", "need"],
                )

    return run


def _window_rows(names: Names):
    def run(batches):
        for batch in batches:
            for part, words, first, others in _parts(batch, seed=77):
                ids, tags = part.column("doc_id").to_numpy(), part.column("tag").to_numpy()
                row, (place, many, need) = _marked(part, "pieces", words, first)
                which = np.repeat(np.arange(len(row)), many)
                if not len(which):
                    continue
                inside = np.arange(len(which)) - np.repeat(np.cumsum(many) - many, many)
                at, mine = first[row][which] + place[which] + inside, row[which]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(spelled(words, list(parse(words, _row_of(first), names)), at, at + WINDOW).view(np.int64)), pa.array(_checked(others, at, at + WINDOW)), pa.array(ids[mine]), pa.array(tags[mine]), pa.array((at - first[mine]).astype(np.int32)), pa.array(need[which].astype(bool))],
                    names=["h", "c", "doc_id", "tag", "at", "need"],
                )

    return run


def _kept_rows(batches):
    for batch in batches:
        n_words, n_removed, digests = [], [], []
        for text, places in zip(batch.column("text"), batch.column("places")):
            text, places = text.as_py(), places.as_py()
            words = text.encode().split() if text else []
            gone = 0
            if places:
                out = np.zeros(len(words) + 1, dtype=np.int32)
                begin, many = (np.array([p[k] for p in places]) for k in ("at", "n"))
                np.add.at(out, begin, 1)
                np.add.at(out, begin + many - 1 + WINDOW, -1)
                stay = np.cumsum(out[:-1]) == 0
                gone = len(words) - int(stay.sum())
                kept = [words[i] for i in np.flatnonzero(stay)]
            else:
                kept = words
            n_words.append(len(words))
            n_removed.append(gone)
            digests.append(b" ".join(kept))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array([d.decode() for d in digests], pa.string())], names=["doc_id", "n_words", "n_removed", "kept"])


def _least(rows: DataFrame, *name: str) -> tuple[DataFrame, str]:
    """The smallest document of each name that more than one has.

    Written first: the shuffle behind it can go, and a join with it has two plain shuffles, which Spark splits where
    one name has too many rows.
    """
    several = rows.groupBy(*name).agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).filter("least < most")
    found = written(several.select(*name, "least"), "sub-least")
    remove(rows.sparkSession)
    return found


def repeated_windows(docs: DataFrame) -> DataFrame:
    """(doc_id, tag, places): for each row the ranges (first, number) of its windows that also start in a smaller document."""
    spark, row = docs.sparkSession, ["doc_id", "tag"]
    known = docs.filter("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", "tag", "text")
    names = named_globally(known.select("text"))

    zones, zones_path = written(known.transform(mapped(_anchor_rows(names), "key long, doc_id long, place long")), "sub-zones")
    shared, shared_path = _least(zones, "key")
    back = zones.join(shared.hint("shuffle_hash"), "key").select("doc_id", F.shiftright("place", 32).cast("int").alias("tag"), F.struct("place", "least").alias("zone"))
    by_row, by_row_path = written(back.groupBy(*row).agg(F.collect_list("zone").alias("zones")), "sub-rows")
    del back
    remove(spark, zones_path, shared_path)

    pieces, pieces_path = written(known.join(by_row, row).transform(mapped(_piece_rows(names), "h long, c int, doc_id long, tag int, at int, n int, need boolean")), "sub-pieces")
    remove(spark, by_row_path)
    least, least_path = _least(pieces, "h", "c")
    judged = pieces.join(least.hint("shuffle_hash"), ["h", "c"], "left").withColumn("settled", F.coalesce(F.col("least") < F.col("doc_id"), F.lit(False)))
    judged, judged_path = written(judged.select(*row, "at", "n", "need", "settled"), "sub-judged")
    remove(spark, pieces_path, least_path)

    unsettled = judged.filter("NOT settled").groupBy(*row).agg(F.collect_list(F.struct("at", "n", "need")).alias("pieces"))
    windows, windows_path = written(known.join(unsettled, row).transform(mapped(_window_rows(names), "h long, c int, doc_id long, tag int, at int, need boolean")), "sub-windows")
    least, least_path = _least(windows, "h", "c")
    found = windows.filter("need").join(least.hint("shuffle_hash"), ["h", "c"]).filter("least < doc_id").select(*row, "at", F.lit(1).alias("n"))
    gone = found.unionByName(judged.filter("settled").select(*row, "at", "n"))
    places, _ = written(gone.groupBy(*row).agg(F.collect_list(F.struct("at", "n")).alias("places")), "sub-places")
    remove(spark, windows_path, judged_path, least_path)
    return places


def tagged(docs: DataFrame, tries: int = 8) -> DataFrame:
    """doc_id, text and tag of each row: a hash of the text that parts the different texts of one id."""
    for seed in range(tries):
        whole = F.xxhash64("text")
        rows = docs.select("doc_id", "text", F.hash(F.lit(seed), "text", whole).alias("tag"))
        alike = rows.filter("doc_id IS NOT NULL").groupBy("doc_id", "tag").agg(F.min(whole).alias("a"), F.max(whole).alias("b")).filter("a <> b")
        if alike.isEmpty():
            return rows
    raise ValueError("one id has too many different texts")


def deduplicate(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed and kept (the words that stay, joined by spaces) for each row of `docs`."""
    rows = tagged(docs)
    joined = rows.join(repeated_windows(rows), ["doc_id", "tag"], "left").select("doc_id", "text", "places")
    return joined.transform(mapped(_kept_rows, "doc_id long, n_words long, n_removed long, kept string"))


def op2_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = deduplicate(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))

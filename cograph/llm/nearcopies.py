"""Near copies: SimHash candidates over five-word shingles, verified by the exact Jaccard similarity of the shingles.

Documents with the same set of shingles are one node, so exact copies never meet as pairs. Two SimHash fingerprints
at similarity 0.8 differ in about 10 of 64 bits, and a radius that holds nearly all such pairs (RADIUS) leaves no
selective parts for the pigeonhole keys of `simhash`. So nodes meet by MinHash bands: a pair at exactly 0.8 shares
none of the BANDS bands once in (1 - 0.8 ** DEPTH) ** BANDS, 1 in 38,000. Of those that meet, pairs within the SimHash
radius and of sizes that allow the similarity are candidates. Their shingle sets are compared in full; only pairs
of SIMILARITY or more are links, and components are those of `simhash`.

In a band with at most SMALL nodes the fingerprints are compared bit-sliced, as in `simhash`. In a larger one the sets themselves go to the tasks, which
count what each node shares with all others through postings of the shingles, and only a spanning forest of the links
leaves a task: a group of n copies gives at most n - 1 rows a band. Bands of very many nodes are cut into tiles, and
every pair of tiles is a task of its own.

Defined cases: words are split at ASCII white space, A-Z in lower case; a text of fewer than five words is one shingle;
null and empty texts are copies of each other; repeated rows stay one; a null doc_id comes last.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cograph.llm.common import mapped, splitmix, text_bytes, word_hashes, word_spans, written
from cograph.llm.contamination import runs_of
from cograph.llm.simhash import _bit_counts, components, kept_rows, near_pairs

SHINGLE, SIMILARITY, RADIUS, BANDS, DEPTH, SMALL, TILE = 5, 0.8, 24, 20, 4, 32, 1024
_ODD = splitmix(np.arange(1, 2 * BANDS * DEPTH + 1, dtype=np.uint64)) | np.uint64(1)
_TIMES, _MARK = _ODD[: BANDS * DEPTH], _ODD[BANDS * DEPTH :]


def shingle_sets(texts: pa.Array) -> list[np.ndarray]:
    """The sorted distinct hashes of each text's five-word shingles."""
    raw, at = text_bytes(texts)
    raw = raw | (((raw >= 65) & (raw <= 90)).astype(np.uint8) << 5)
    starts, ends, first = word_spans(raw, at)
    words = word_hashes(raw, starts, ends)
    return [np.unique(splitmix(runs_of(words[a:b], SHINGLE))) for a, b in zip(first, first[1:])]


def name_of(found: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(found.tobytes()) if len(found) else 0


def fingerprint(found: np.ndarray) -> int:
    counts = np.zeros(64, dtype=np.int64)
    for i in range(0, len(found), 1 << 14):
        counts += _bit_counts(found[i : i + (1 << 14)].view(np.uint8).reshape(-1, 8))
    return int.from_bytes(np.packbits(counts * 2 > len(found)).tobytes(), "big")


def bands_of(found: np.ndarray) -> np.ndarray:
    """One key a band, equal where all of the band's MinHashes are."""
    low = np.full(BANDS * DEPTH, 0xFFFFFFFFFFFFFFFF, dtype=np.uint64)
    for i in range(0, len(found), 2048):
        low = np.minimum(low, ((found[i : i + 2048, None] ^ _MARK) * _TIMES).min(axis=0))
    return splitmix((low * _MARK).reshape(BANDS, DEPTH).sum(axis=1, dtype=np.uint64))


def _sketches(batches):
    for batch in batches:
        found = shingle_sets(batch.column("text"))
        signed = lambda x: pa.array(np.array(x, dtype=np.uint64).view(np.int64))
        bands = pa.array([bands_of(s).view(np.int64) if len(s) else [] for s in found], pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("ref"), signed([name_of(s) for s in found]), signed([fingerprint(s) for s in found]), pa.array([len(s) for s in found], pa.int64()), bands], names=["doc_id", "ref", "node", "fp", "size", "bands"])


def _sets(batches):
    for batch in batches:
        found = shingle_sets(batch.column("text"))
        yield pa.RecordBatch.from_arrays([pa.array(np.array([name_of(s) for s in found], dtype=np.uint64).view(np.int64)), pa.array([s.tobytes() for s in found], pa.binary())], names=["node", "set"])


def jaccard(a: bytes, b: bytes) -> float:
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / (len(x) + len(y) - both)


def _alike(batches):
    for batch in batches:
        good = [jaccard(x.as_py(), y.as_py()) >= SIMILARITY - 1e-12 for x, y in zip(batch.column("x"), batch.column("y"))]
        yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(good, pa.bool_())) for c in ("a", "b")], names=["a", "b"])


def _runs(batches, keys, columns):
    """The batches as whole groups: (numbers by column, sets, edges of the groups); rows are sorted by `keys`."""

    def cut(rows, sets):
        edges = np.concatenate([[0], np.flatnonzero((rows[:keys, 1:] != rows[:keys, :-1]).any(axis=0)) + 1, [rows.shape[1]]])
        return rows, sets, edges

    rows, sets = np.zeros((len(columns), 0), dtype=np.int64), []
    for batch in batches:
        rows = np.concatenate([rows, np.stack([batch.column(c).to_numpy().astype(np.int64) for c in columns])], axis=1)
        if "set" in batch.schema.names:
            sets += batch.column("set").to_pylist()
        edges = cut(rows, sets)[2]
        if len(edges) > 2:
            at = edges[-2]
            yield rows[:, :at], sets[:at], edges[:-1]
            rows, sets = rows[:, at:], sets[at:]
    if rows.shape[1]:
        yield cut(rows, sets)


def _pairs(a, b) -> pa.RecordBatch:
    both = np.unique(np.sort(np.stack([a, b]), axis=0), axis=1)
    return pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1])], names=["a", "b"])


def _candidates(batches):
    """Over rows sorted by (key, node), small groups: all pairs that may be similar."""
    for rows, _, edges in _runs(batches, 1, ("key", "node", "fp", "size")):
        node, size = rows[1], rows[3]
        for i, j in near_pairs(np.ascontiguousarray(rows[2]).view(np.uint64), np.repeat(edges[:-1], np.diff(edges)), None, RADIUS):
            some = np.minimum(size[i], size[j]) >= SIMILARITY * np.maximum(size[i], size[j]) - 1e-9
            if some.any():
                yield _pairs(node[i[some]], node[j[some]])


def forest(sets: list[np.ndarray], sides: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the similar pairs across the sides (bit 0: first tile, bit 1: second)."""
    left, right = np.flatnonzero(sides & 1), np.flatnonzero(sides & 2)
    sizes, parent, out = np.array([len(s) for s in sets]), list(range(len(sets))), []

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    terms = np.concatenate([sets[i] for i in right]) if len(right) else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(len(right)), sizes[right])
    order = np.argsort(terms, kind="stable")
    terms, owner = terms[order], owner[order]
    for i in left.tolist():
        low, high = np.searchsorted(terms, sets[i]), np.searchsorted(terms, sets[i], side="right")
        many = high - low
        at = np.arange(many.sum()) + np.repeat(low - np.concatenate([[0], np.cumsum(many)[:-1]]), many)
        both = np.bincount(owner[at], minlength=len(right))
        for j in right[both >= SIMILARITY * (sizes[i] + sizes[right] - both) - 1e-9].tolist():
            x, y = root(i), root(j)
            if x != y:
                parent[max(x, y)] = min(x, y)
                out.append((i, j))
    return out


def _forests(batches):
    """Over rows sorted by (key, pair, node), large groups with their sets: the links."""
    for rows, sets, edges in _runs(batches, 2, ("key", "pair", "side", "node")):
        for a, b in zip(edges, edges[1:]):
            found = forest([np.frombuffer(x, np.uint64) for x in sets[a:b]], rows[2, a:b])
            if found:
                yield _pairs(*(rows[3, a:b][list(x)] for x in zip(*found)))


def large(keyed: DataFrame, hot: DataFrame, sets: DataFrame) -> DataFrame:
    """Links of the nodes that share a large band; keyed: key, node; hot: key, tiles; sets: node, set."""
    tiled = keyed.select("key", "node").join(hot, "key").withColumn("mine", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int"))
    placed = tiled.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).select(
        "key",
        (F.least("mine", "other") * F.col("tiles").cast("long") + F.greatest("mine", "other")).alias("pair"),
        F.when(F.col("mine") == F.col("other"), 3).when(F.col("mine") < F.col("other"), 1).otherwise(2).alias("side"),
        "node",
    )
    grouped = placed.join(sets, "node").repartition("key", "pair").sortWithinPartitions("key", "pair", "node")
    return grouped.transform(mapped(_forests, "a long, b long")).distinct()


def sets_of(asked: DataFrame, nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """node, set of each of `asked` (node); texts: ref, text."""
    refs = nodes.join(asked.distinct(), "node", "left_semi").select(F.col("best.ref").alias("ref"))
    return written(texts.join(refs, "ref", "left_semi").select("text").transform(mapped(_sets, "node long, set binary")).dropDuplicates(["node"]), "near-sets")[0]


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs whose shingle sets are similar enough."""
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("set").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("set").alias("y")), "b")
    return both.select("a", "b", "x", "y").transform(mapped(_alike, "a long, b long"))


def linked(docs: DataFrame, tile: int = TILE) -> DataFrame:
    """root and best (last, doc_id, ref) of each distinct shingle set of `docs` (doc_id, text)."""
    texts = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("ref"), "text")
    schema = "doc_id long, ref long, node long, fp long, size long, bands array<long>"
    rows = texts.withColumn("doc_id", F.col("doc_id").cast("long")).transform(mapped(_sketches, schema))
    best = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "ref")).alias("best")
    nodes, _ = written(rows.groupBy("node").agg(best, *[F.first(c).alias(c) for c in ("fp", "size", "bands")]), "near-nodes")
    keyed = nodes.select("node", "fp", "size", F.explode("bands").alias("key"))
    hot = keyed.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > SMALL).select("key", F.ceil(F.col("n") / tile).cast("int").alias("tiles"))
    hot, _ = written(hot, "near-hot")
    few = keyed.join(hot, "key", "left_anti").repartition("key").sortWithinPartitions("key", "node")
    pairs, _ = written(few.transform(mapped(_candidates, "a long, b long")).distinct(), "near-pairs")
    asked = pairs.select(F.explode(F.array("a", "b")).alias("node")).union(keyed.join(hot, "key", "left_semi").select("node"))
    sets = sets_of(asked, nodes, texts.select("ref", "text"))
    roots, _ = components(verified(pairs, sets).union(large(keyed, hot, sets)))
    return nodes.join(roots, "node", "left").select(F.coalesce("root", "node").alias("root"), "best")


def one_of_similar(docs: DataFrame) -> DataFrame:
    """The rows of `docs` with the smallest doc_id of their group of near copies, one a group, with all their columns."""
    stay = linked(docs).groupBy("root").agg(F.min("best").alias("best"))
    return kept_rows(docs, stay)

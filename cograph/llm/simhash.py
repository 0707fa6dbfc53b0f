"""SimHash near-duplicates with bit-sliced comparison.

Fingerprints come from all word shingles of the whole text. Equal fingerprints are one node from then on, so exact
copies never meet as pairs. Candidates are found by the pigeonhole principle: a fingerprint is cut into k + r parts
(r: the radius), of which at least k must agree between any two linked fingerprints, so every choice of k parts is
a key and no link is missed; k grows with the number of distinct fingerprints, so keys stay selective.

Within the rows of one key, the fingerprints are held as 64 vertical bit planes, groups side by side, however small or
large they are. A block of 64 candidates is one machine word of each plane; a row is compared with the blocks of its
group up to its own. Differing bits are added into carry-save counters for all 64 at once, and a block is given up as
soon as every candidate in it exceeds the radius. Keys with very many fingerprints are cut into tiles, and every pair
of tiles is a task of its own, so no group has to fit one task. Only a spanning forest of each tile pair leaves it, so
the links of a group of n copies are at most n - 1 rows a key. Components are then found by alternating large-star and
small-star rounds on the edges, each written to the shared folder, until only stars are left.

Defined cases: null and empty texts have fingerprint zero and are linked like any other; texts with fewer words than
a shingle are one shingle; repeated rows stay; a null doc_id stays null and never names a component unless all
of its rows have none; an empty table gives no rows.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cograph.llm.common import mapped, remove, table, written

SHINGLE, RADIUS, SEED, TILE = 4, 4, 42, 2048
ONES = np.uint64(0xFFFFFFFFFFFFFFFF)


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The 64-bit fingerprint: a bit is 1 if it is set in over half of the shingles' hashes."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else ()
    if not words:
        return 0
    body = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(body, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate([[0], ends[:-shingle]]).tolist()
    stops = (ends[shingle - 1 :] - 1).tolist()
    digest = xxhash.xxh64_digest
    hashes = np.frombuffer(b"".join([digest(body[a:b], SEED) for a, b in zip(starts, stops)]), dtype=np.uint8).reshape(-1, 8)
    counts = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), 1 << 14):
        counts += _bit_counts(hashes[i : i + (1 << 14)])
    return int.from_bytes(np.packbits(counts * 2 > len(hashes)).tobytes(), "big")


def _bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How often each of the 64 bits is set in at most 2 ** 14 hashes of 8 bytes."""
    bits = np.unpackbits(hashes, axis=1)
    short = len(bits) % 255
    whole = bits[: len(bits) - short].reshape(-1, 255, 64).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
    return whole + bits[len(bits) - short :].sum(axis=0, dtype=np.int64)


def _fingerprints(batches):
    for batch in batches:
        found = [fingerprint(t.as_py()) for t in batch.column("text")]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("ref"), pa.array(np.array(found, dtype=np.uint64).view(np.int64))], names=["doc_id", "ref", "fp"])


def parts_of(n: int, radius: int = RADIUS) -> tuple[int, list[tuple[int, ...]]]:
    """Number of parts and the choices that serve as keys: enough bits in a key for about n fingerprints."""
    k = 1
    while k < 4 and 64 * k / (k + radius) < np.log2(max(n, 2)) + 2:
        k += 1
    return k + radius, list(combinations(range(k + radius), k))


def masks_of(parts: int, choices) -> list[int]:
    cuts = [round(i * 64 / parts) for i in range(parts + 1)]
    return [sum(((1 << cuts[p + 1]) - (1 << cuts[p])) for p in c) for c in choices]


def planes_of(values: np.ndarray) -> np.ndarray:
    """64 bit planes of the values, 64 values a word: planes[b, w] bit j is bit b of value 64 w + j."""
    padded = np.zeros(-(-len(values) // 64) * 64, dtype=np.uint64)
    padded[: len(values)] = values
    bits = np.unpackbits(padded.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.packbits(bits.T.copy(), axis=1, bitorder="little").view(np.uint64)


def near_pairs(values: np.ndarray, starts: np.ndarray, sides: np.ndarray | None = None, radius: int = RADIUS, chunk: int = 1 << 17):
    """Yields arrays (row, earlier row of its group) of the pairs of at most `radius` differing bits.

    starts: the first row of each row's group. sides: bit 0 for rows of a tile pair's first tile, bit 1 for its second;
    rows of one tile alone are compared with rows of the other only. Carry-save counters over vertical planes; the
    counters have as many bits as the radius, and what they carry out stays in `over`.
    """
    n = len(values)
    planes = planes_of(values)
    second = planes_of_bits(sides & 2) if sides is not None else None
    first = planes_of_bits(sides & 1) if sides is not None else None
    own = np.arange(n)
    low, blocks = starts // 64, own // 64 - starts // 64 + 1
    blocks[own == starts] = 0  # the first row of a group has no earlier one
    upto = np.concatenate([[0], np.cumsum(blocks)])
    depth, at = max(1, int(radius).bit_length()), 0
    while at < n:
        stop = max(at + 1, int(np.searchsorted(upto, upto[at] + chunk, side="right")) - 1)
        rows = np.repeat(own[at:stop], blocks[at:stop])
        cols = np.arange(len(rows)) - np.repeat(upto[at:stop] - upto[at], blocks[at:stop]) + low[rows]
        at = stop
        # Candidates outside the group, and from the row itself on, are over the radius from the start.
        over = ~(_ones_from(starts[rows] - cols * 64) & ~_ones_from(rows - cols * 64))
        if sides is not None:
            mine = sides[rows]
            over |= np.where(mine == 3, np.uint64(0), ~np.where(mine == 1, second[cols], first[cols]))
        count = np.zeros((depth, len(rows)), dtype=np.uint64)
        for bit in range(64):
            carry = planes[bit][cols] ^ (np.uint64(0) - ((values[rows] >> np.uint64(bit)) & np.uint64(1)))
            for level in range(depth):
                count[level], carry = count[level] ^ carry, count[level] & carry
            over |= carry
            if bit % 4 == 3:  # give up blocks in which every value exceeds the radius
                live = np.flatnonzero((over | _above(count, radius)) != ONES)
                if len(live) < len(rows):
                    rows, cols, over, count = rows[live], cols[live], over[live], count[:, live]
                if not len(live):
                    break
        if len(rows):
            hit = ~(over | _above(count, radius))
            which, j = np.nonzero(np.unpackbits(hit.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
            yield rows[which], cols[which] * 64 + j


def _ones_from(place: np.ndarray) -> np.ndarray:
    """Words whose bits are set from `place` on (all below 1, none from 64 on)."""
    shifted = ONES << np.clip(place, 0, 63).astype(np.uint64)
    return np.where(place >= 64, np.uint64(0), shifted)


def planes_of_bits(flags: np.ndarray) -> np.ndarray:
    """One plane: bit j of word w is set where flag 64 w + j is."""
    padded = np.zeros(-(-len(flags) // 64) * 64, dtype=bool)
    padded[: len(flags)] = flags != 0
    return np.packbits(padded, bitorder="little").view(np.uint64)


def _above(count: np.ndarray, radius: int) -> np.ndarray:
    """Which vertical counters exceed the radius."""
    above, equal = np.zeros(count.shape[1], dtype=np.uint64), np.full(count.shape[1], ONES)
    for level in range(len(count) - 1, -1, -1):
        if radius >> level & 1:
            equal &= count[level]
        else:
            above |= equal & count[level]
            equal &= ~count[level]
    return above


def forest(values: np.ndarray, starts: np.ndarray, sides: np.ndarray | None = None, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Edges (value, a value of its group joined with it) of a spanning forest of the links within the groups."""
    label = np.arange(len(values))
    for a, b in near_pairs(values, starts, sides, radius):
        while True:
            x, y = label[a], label[b]
            apart = np.flatnonzero(x != y)
            if not len(apart):
                break
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
            while True:  # every row points at its root again
                up = label[label]
                if (up == label).all():
                    break
                label = up
    moved = np.flatnonzero(label != np.arange(len(values)))
    return values[moved], values[label[moved]]


def _linked(radius: int):
    """Over rows sorted by (choice, key, tile pair): the links within each group, whole groups at a time."""

    def run(batches):
        held: list[np.ndarray] = []
        for batch in batches:
            held.append(np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("choice", "key", "pair", "side", "fp")]))
            if sum(x.shape[1] for x in held) < 1 << 14 and batch.num_rows:
                continue
            rows = np.concatenate(held, axis=1)
            breaks = np.flatnonzero(_edges(rows))
            if not len(breaks):
                held = [rows]
                continue
            yield from groups(rows[:, : breaks[-1] + 1])
            held = [rows[:, breaks[-1] + 1 :]]
        if held:
            yield from groups(np.concatenate(held, axis=1))

    def groups(rows: np.ndarray):
        if not rows.shape[1]:
            return
        begin = np.concatenate([[0], np.flatnonzero(_edges(rows)) + 1])
        starts = np.repeat(begin, np.diff(np.concatenate([begin, [rows.shape[1]]])))
        a, b = forest(np.ascontiguousarray(rows[4]).view(np.uint64), starts, rows[3] if (rows[3] != 3).any() else None, radius)
        if len(a):
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    return run


def _edges(rows: np.ndarray) -> np.ndarray:
    """Whether the row behind each but the last is of another group."""
    return (rows[:3, 1:] != rows[:3, :-1]).any(axis=0)


def links(nodes: DataFrame, n: int, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """Edges (a, b) that connect what is within the radius among the distinct fingerprints of `nodes` (fp)."""
    parts, choices = parts_of(n, radius)
    masks = masks_of(parts, choices)
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    keyed = nodes.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m).cast("long")) for m in signed])).alias("choice", "key"))
    counts, counted = written(keyed.groupBy("choice", "key").agg(F.count("*").alias("n")).filter(F.col("n") > tile).select("choice", "key", F.ceil(F.col("n") / tile).cast("int").alias("tiles")), "simhash-hot")
    # Rows of hot keys go to every pair of tiles that holds theirs; all others are in one tile that stands for both sides.
    mine = F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("int")
    tiled = keyed.join(counts, ["choice", "key"], "left").withColumn("mine", F.coalesce(mine, F.lit(0)))
    other = F.explode(F.sequence(F.lit(0), F.coalesce(F.col("tiles") - 1, F.lit(0))))
    placed = tiled.withColumn("other", other).select(
        "choice", "key",
        (F.least("mine", "other") * F.coalesce("tiles", F.lit(1)) + F.greatest("mine", "other")).cast("long").alias("pair"),
        F.when(F.col("mine") == F.col("other"), 3).when(F.col("mine") < F.col("other"), 1).otherwise(2).alias("side"),
        "fp",
    )
    grouped = placed.repartition("choice", "key", "pair").sortWithinPartitions("choice", "key", "pair", "fp")
    return grouped.transform(mapped(_linked(radius), "a long, b long")).distinct()


def components(edges: DataFrame) -> tuple[DataFrame, list[str]]:
    """(node, root) of every node of `edges` (a, b); root: the smallest node reached. Large-star, small-star rounds.

    The rounds end when every node has one edge, to a node that has none: then all edges are stars. Nodes with more
    than half of an even share of the rows are dealt to several tasks; there are at most twice as many as tasks.
    """
    spark = edges.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    now, path = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "cc")
    while not _stars(now):
        share = max(16, now.count() // tasks)
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = _with_least(both, share).filter("b > a").select(F.col("b").alias("a"), F.least("a", "low").alias("b"))
        large = large.filter("a <> b").distinct()
        small = _with_least(large, share).select(F.explode(F.array(F.struct("a", F.col("low").alias("b")), F.struct(F.col("b").alias("a"), F.col("low").alias("b")))).alias("e")).select("e.a", "e.b").filter("a <> b").distinct()
        after, new = written(small, "cc")
        remove(spark, path)
        now, path = after, new
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")), [path]


def _with_least(edges: DataFrame, share: int) -> DataFrame:
    """`edges` (a, b) with the least b of each a; a node with more than `share` rows meets its least in several tasks."""
    least = edges.groupBy("a").agg(F.min("b").alias("low"), (F.floor(F.count("*") / share) + 1).cast("int").alias("parts"))
    hubs = least.filter("parts > 1").select(F.col("a").alias("hub"), F.col("parts").alias("of"))
    dealt = edges.join(F.broadcast(hubs), F.col("a") == F.col("hub"), "left").select("a", "b", F.coalesce(F.pmod(F.xxhash64("b"), F.col("of")).cast("int"), F.lit(0)).alias("part"))
    return dealt.join(least.select("a", "low", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")), ["a", "part"])


def _stars(edges: DataFrame) -> bool:
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("down"), F.lit(0).alias("top")).union(edges.select("b", F.lit(0), F.lit(1)))
    return ends.groupBy("node").agg(F.sum("down").alias("down"), F.max("top").alias("top")).filter("down > 1 OR down + top > 1").isEmpty()


def clusters(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """doc_id, ref, fp, root and component_id for each row of `docs` (doc_id, text); ref: a hash of id and text."""
    rows = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("ref"), "text")
    fps, _ = written(rows.transform(mapped(_fingerprints, "doc_id long, ref long, fp long")), "simhash-fp")
    nodes, _ = written(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-nodes")
    roots, _ = components(links(nodes.select("fp"), nodes.count(), radius))
    rooted = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named, _ = written(rooted.join(least, "root").select("fp", "root", "component_id"), "simhash-named")
    return fps.join(named, "fp").select("doc_id", "ref", "fp", "root", "component_id")


def one_of_each(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """The rows of `docs` with the smallest doc_id of their group, one a group, with all their columns."""
    best = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "ref"))
    return kept_rows(docs, clusters(docs, radius).groupBy("root").agg(best.alias("best")))


def kept_rows(docs: DataFrame, stay: DataFrame) -> DataFrame:
    """One row of `docs` for each of `stay` (best: doc_id and ref); a row is known by its id and a hash of id and text."""
    wanted = stay.select(F.col("best.doc_id").alias("of"), F.col("best.ref").alias("wanted"))
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), F.xxhash64("doc_id", "text").alias("ref"), F.xxhash64(*docs.columns).alias("tie"))
    held = rows.join(wanted, (F.col("ref") == F.col("wanted")) & F.col("row.doc_id").eqNullSafe(F.col("of")), "left_semi")
    return held.withColumn("place", F.row_number().over(W.partitionBy("row.doc_id", "ref").orderBy("tie"))).filter("place = 1").select("row.*")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = clusters(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")

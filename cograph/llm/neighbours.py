"""Nearest neighbours by a block matrix join with int8 tiles and error bounds.

Queries are dealt into groups of at most about `QUERY_BYTES`, candidates into packed blocks; every pair of a
query group and a candidate slice is one task that holds the group and streams the blocks. A tile is the product
of int8 vectors (exact integers in float32 matrix products of at most 1,024 components, added up in double precision).
With the norms of the rounding residuals e_q and e_c, a cosine differs from its tile value by at most
e_q + (1 + e_q) e_c, so a pair whose upper bound is below the k-th best score known for its query cannot be an answer;
only the rest is computed again in double precision from the original vectors and merged into the query's heap. The
answer is exact: no index is approximate and nothing is capped. Each task returns at most k rows a query.

Blocks travel in the precision of the table (float vectors as 4 bytes a component), so the tasks can recompute what
survives a tile where they stand: near-ties, however many, never leave a task. Of equal vectors in a block only the
k + 1 smallest ids travel, as no query can have another one among its k nearest. What is sent is the candidates once a query group: with exact
answers to a fixed share of all rows it grows with the square of the rows, by the factor that `QUERY_BYTES` sets.

Defined cases: vectors that are null, empty, zero or hold a null or non-finite component take no part, as do rows
without an id; vectors of different lengths are not compared; repeated equal rows count once, and rows that share a
query's id are not its neighbours; an empty table gives no rows. Ties go to the smaller vec_id.
"""

from __future__ import annotations

from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cograph.llm.common import mapped, table, written

K, EVERY, QUERY_BYTES, BLOCK, EXACT = 5, 50, 64 << 20, 2048, 1024
PACKED = "dim int, width int, ids binary, vectors binary"


def valid_vectors(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    v = F.col(vec_col)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    ok = F.col(id_col).isNotNull() & v.isNotNull() & finite & F.exists(v, lambda x: x != 0)
    kind = "array<float>" if rows.schema[vec_col].dataType.simpleString() == "array<float>" else "array<double>"
    return rows.filter(F.coalesce(ok, F.lit(False))).select(F.col(id_col).cast("long").alias("id"), v.cast(kind).alias("v")).distinct()


def _pack(size: int, most: int = 0):
    """Rows (id, v) in blocks of at most `size`; most: so many of the smallest ids of equal vectors in a block (0: all)."""
    schema = pa.schema([("dim", pa.int32()), ("width", pa.int32()), ("ids", pa.binary()), ("vectors", pa.binary())])

    def run(batches):
        held: dict[int, list] = {}
        for batch in batches:
            vectors, ids = batch.column("v"), batch.column("id").to_numpy()
            sizes = np.diff(vectors.offsets.to_numpy())
            flat, at = vectors.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(sizes)])
            for dim in np.unique(sizes):
                rows = np.flatnonzero(sizes == dim)
                got = flat[(at[rows][:, None] + np.arange(dim)).ravel()].reshape(-1, dim)
                a, b = held.get(int(dim), (ids[:0], got[:0]))
                a, b = np.concatenate([a, ids[rows]]), np.concatenate([b, got])
                while len(a) >= size:
                    yield block(dim, a[:size], b[:size])
                    a, b = a[size:], b[size:]
                held[int(dim)] = (a, b)
        for dim, (a, b) in held.items():
            if len(a):
                yield block(dim, a, b)

    def block(dim, a, b):
        if most:
            same = np.unique(b, axis=0, return_inverse=True)[1].ravel()
            order = np.lexsort((a, same))
            first = np.concatenate([[True], same[order][1:] != same[order][:-1]])
            place = np.arange(len(a)) - np.flatnonzero(first)[np.cumsum(first) - 1]
            stay = order[place < most]
            a, b = a[stay], b[stay]
        return pa.RecordBatch.from_pylist([{"dim": int(dim), "width": b.dtype.itemsize, "ids": a.astype("<i8").tobytes(), "vectors": b.tobytes()}], schema=schema)

    return run


def quantise(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 values (as float32), scale and residual norm of each row of `v` brought to length 1."""
    unit = v / np.abs(v).max(axis=1, keepdims=True)
    unit /= np.sqrt((unit * unit).sum(axis=1, keepdims=True))
    scale = np.abs(unit).max(axis=1) / 127
    small = np.rint(unit / scale[:, None])
    return small.astype(np.int8).astype(np.float32), scale, np.sqrt(((unit - small * scale[:, None]) ** 2).sum(axis=1))


def exact_cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row in double precision, summed from the first component to the last, so equal vectors score equally."""
    dot, x, y = np.zeros(len(a)), np.zeros(len(a)), np.zeros(len(a))
    for d in range(a.shape[1]):
        dot += a[:, d] * b[:, d]
        x += a[:, d] * a[:, d]
        y += b[:, d] * b[:, d]
    return dot / (np.sqrt(x) * np.sqrt(y))


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T of int8 values held as float32: sums of up to EXACT products stay below 2 ** 24, so they are exact."""
    parts = [a[:, i : i + EXACT] @ b[:, i : i + EXACT].T for i in range(0, a.shape[1], EXACT)]
    return parts[0] if len(parts) == 1 else np.sum(parts, axis=0, dtype=np.float64)


class Heaps:
    """The k best (score, smaller id) of each query seen so far."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int):
        self.ids, self.vectors, self.k = ids, vectors, k
        self.small, self.scale, self.residual = quantise(vectors)
        self.best = np.full((len(ids), k), -np.inf)
        self.who = np.full((len(ids), k), np.iinfo(np.int64).max)

    def add(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        small, scale, residual = quantise(vectors)
        for low in range(0, len(self.ids), 512):
            rows = slice(low, low + 512)
            near = _product(self.small[rows], small) * self.scale[rows, None] * scale[None, :]
            slack = self.residual[rows, None] + (1 + self.residual[rows, None]) * residual[None, :] + 1e-9
            own = self.ids[rows, None] == ids[None, :]
            least = np.where(own, -np.inf, near - slack)
            bar = self.best[rows, -1]
            if len(ids) >= self.k:
                bar = np.maximum(bar, -np.partition(-least, self.k - 1, axis=1)[:, self.k - 1])
            # Tiles and bounds: a pair that may still be among the k best (ties included) is computed in full.
            i, j = np.nonzero(~own & (near + slack >= bar[:, None]))
            for at in range(0, len(i), 1 << 15):
                self._merge(low + i[at : at + (1 << 15)], j[at : at + (1 << 15)], ids, vectors)

    def _merge(self, i: np.ndarray, j: np.ndarray, ids: np.ndarray, vectors: np.ndarray) -> None:
        score = exact_cosines(self.vectors[i], vectors[j])
        rows = np.unique(i)
        i = np.concatenate([i, np.repeat(rows, self.k)])
        score, who = np.concatenate([score, self.best[rows].ravel()]), np.concatenate([ids[j], self.who[rows].ravel()])
        order = np.lexsort((who, -score, i))
        i, score, who = i[order], score[order], who[order]
        first = np.searchsorted(i, rows)
        take = first[:, None] + np.arange(self.k)
        self.best[rows], self.who[rows] = score[take], who[take]


def _search(k: int):
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def out(heaps):
        q = np.repeat(heaps.ids, k)
        keep = np.isfinite(heaps.best.ravel())
        return pa.RecordBatch.from_arrays([pa.array(q[keep]), pa.array(heaps.who.ravel()[keep]), pa.array(heaps.best.ravel()[keep])], schema=schema)

    def run(batches):
        now, asked, heaps = None, [], None
        for batch in batches:
            for r in range(batch.num_rows):
                key = tuple(batch.column(c)[r].as_py() for c in ("qg", "cg", "dim"))
                ids = np.frombuffer(batch.column("ids")[r].as_py(), dtype="<i8")
                vectors = np.frombuffer(batch.column("vectors")[r].as_py(), dtype=f"<f{batch.column('width')[r].as_py()}").reshape(len(ids), key[2]).astype(np.float64)
                if key != now:
                    if heaps:
                        yield out(heaps)
                    now, asked, heaps = key, [], None
                if batch.column("side")[r].as_py() == 0:
                    asked.append((ids, vectors))
                elif asked:
                    heaps = heaps or Heaps(*(np.concatenate(x) for x in zip(*asked)), k)
                    heaps.add(ids, vectors)
        if heaps:
            yield out(heaps)

    return run


def nearest(queries: DataFrame, candidates: DataFrame, k: int = K, query_bytes: int = QUERY_BYTES) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest of `candidates` (id, v) for each of `queries` (id, v)."""
    spark = queries.sparkSession
    queries, _ = written(queries, "knn-queries")
    n, longest = queries.agg(F.count("*"), F.max(F.size("v"))).first()
    rows = max(1, query_bytes // (8 * (longest or 1)))
    groups = max(1, ceil(n / rows))
    slices = int(spark.conf.get("spark.sql.shuffle.partitions"))
    asked = queries.repartition(groups, F.pmod(F.xxhash64("id"), F.lit(groups))).transform(mapped(_pack(BLOCK), PACKED))
    asked = asked.withColumn("qg", F.pmod(F.spark_partition_id().cast("long"), F.lit(groups)))
    asked, _ = written(asked, "knn-query-blocks")
    asked = asked.withColumn("cg", F.explode(F.sequence(F.lit(0), F.lit(slices - 1)))).withColumn("side", F.lit(0))
    blocks = candidates.transform(mapped(_pack(BLOCK, k + 1), PACKED)).withColumn("cg", F.pmod(F.xxhash64("ids"), F.lit(slices)).cast("int"))
    blocks = blocks.withColumn("qg", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long")))).withColumn("side", F.lit(1))
    columns = ["qg", "cg", "dim", "side", "width", "ids", "vectors"]
    both = asked.select(columns).unionByName(blocks.select(columns)).repartition("qg", "cg", "dim").sortWithinPartitions("qg", "cg", "dim", "side")
    found = both.transform(mapped(_search(k), "query_id long, vec_id long, score double"))
    ranked = found.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")).cast("int"))
    return ranked.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op10_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = valid_vectors(table(spark, sf_dir, "embeddings"))
    return nearest(rows.filter(F.col("id") % EVERY == 0), rows)


def neighbours_sql() -> str:
    return f"""
WITH v AS (SELECT DISTINCT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id IS NOT NULL AND len(embedding) > 0
           AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_dot_product(q.e, c.e) / (sqrt(list_dot_product(q.e, q.e)) * sqrt(list_dot_product(c.e, c.e))) AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % {EVERY} = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= {K}"""

"""Exact nearest neighbours and votes (JOIN-8, VEC-4..8, WIN-5..7, AGG-11/12).

Queries are dealt into groups of a bounded number of rows and the base into slices; every pair of a group and a slice
is a task that holds the group's matrix and streams the slice. Nothing goes through the driver, and a task returns
at most k rows a query (and label), so what is held and what comes back is bounded whatever the tables' sizes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cograph.functions import constants as C
from cograph.operators.rows import top_k

QUERY_ROWS, TILE_ROWS = 16_384, 1024
FOUND = "query_id long, kb_id long, label string, score double"


def _unit(batch: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a list array at length 1 in double precision, and which rows hold a vector of `dim` numbers."""
    sizes = np.diff(batch.offsets.to_numpy())
    good = (sizes == dim) & (dim > 0) & np.asarray(batch.is_valid())
    flat = batch.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    held = np.where(np.asarray(batch.is_valid()), sizes, 0)
    out = flat[np.repeat(good, held)].reshape(-1, dim) if dim else np.zeros((0, 0))
    size = np.sqrt((out * out).sum(axis=1, keepdims=True))
    return np.divide(out, size, out=np.zeros_like(out), where=size > 0), good


class _Best:
    """The k best (score, smaller id) of each query, of the vectors with one label."""

    def __init__(self, n: int, k: int):
        self.k, self.score, self.who = k, np.full((n, k), -np.inf), np.full((n, k), np.iinfo(np.int64).max)

    def add(self, low: int, score: np.ndarray, ids: np.ndarray) -> None:
        """A tile: the queries from `low` on against `ids`. Only what reaches a query's k-th best so far is sorted."""
        bar = self.score[low : low + len(score), -1]
        if score.shape[1] > self.k:
            bar = np.maximum(bar, np.partition(score, score.shape[1] - self.k, axis=1)[:, score.shape[1] - self.k])
        i, j = np.nonzero(score >= bar[:, None])
        rows = np.unique(i)
        if not len(rows):
            return
        value = np.concatenate([score[i, j], self.score[low + rows].ravel()])
        who = np.concatenate([ids[j], self.who[low + rows].ravel()])
        i = np.concatenate([i, np.repeat(rows, self.k)])
        order = np.lexsort((who, -value, i))
        take = order[np.searchsorted(i[order], rows)[:, None] + np.arange(self.k)]
        self.score[low + rows], self.who[low + rows] = value[take], who[take]


def _searched(k: int, by_label: bool):
    """Over rows (g, s, side, id, label, vector) sorted by group, slice and side: queries first, then the slice's base."""

    def found(ids: np.ndarray, best: dict) -> Iterator[pa.RecordBatch]:
        for tag, b in best.items():
            keep = np.isfinite(b.score.ravel())
            n = int(keep.sum())
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, k)[keep]), pa.array(b.who.ravel()[keep]), pa.array([tag] * n, pa.string()), pa.array(b.score.ravel()[keep])], names=["query_id", "kb_id", "label", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, asked, groups = None, [], []
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("g", "s", "side")])
            edges = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
            for a, b in zip([0, *edges], [*edges, batch.num_rows]):
                if a == b:
                    continue
                part, key, side = batch.slice(a, b - a), tuple(keys[:2, a]), keys[2, a]
                if key != now:
                    for ids, _, best in groups:
                        yield from found(ids, best)
                    now, asked, groups = key, [], []
                if side == 0:
                    asked.append(part)
                    continue
                if asked:
                    groups, asked = _matrices(asked), []
                for ids, matrix, best in groups:
                    _against(part, ids, matrix, best)
        for ids, _, best in groups:
            yield from found(ids, best)

    def _against(part: pa.RecordBatch, ids: np.ndarray, matrix: np.ndarray, best: dict) -> None:
        unit, good = _unit(part.column("vector"), matrix.shape[1])
        if not len(unit):
            return
        kb = part.column("id").to_numpy()[good]
        tags = np.array(part.column("label").to_pylist(), dtype=object)[good] if by_label else np.full(len(kb), None, dtype=object)
        for tag in dict.fromkeys(tags.tolist()):
            mine = np.flatnonzero(np.array([t == tag for t in tags.tolist()]))
            held = best.setdefault(tag, _Best(len(ids), k))
            for low in range(0, len(ids), TILE_ROWS):
                held.add(low, np.round(matrix[low : low + TILE_ROWS] @ unit[mine].T, 6), kb[mine])

    return run


def _matrices(parts: list[pa.RecordBatch]) -> list[tuple[np.ndarray, np.ndarray, dict]]:
    """(ids, unit rows, nothing found yet) of the queries of each dimension: they meet the vectors of their own length."""
    out = []
    for dim in sorted({int(x) for p in parts for x in np.unique(np.diff(p.column("vector").offsets.to_numpy()))} - {0}):
        units = [_unit(p.column("vector"), dim) for p in parts]
        ids = np.concatenate([p.column("id").to_numpy()[good] for p, (_, good) in zip(parts, units)])
        if len(ids):
            out.append((ids, np.concatenate([u for u, _ in units]), {}))
    return out


def nearest(queries: DataFrame, kb: DataFrame, k: int = C.NEIGHBOURS, by_label: bool = False, query_rows: int = QUERY_ROWS) -> DataFrame:
    """query_id, kb_id, label, score, rank: the k nearest of `kb` (kb_id, vector, label) for `queries` (query_id, vector).

    Scores are cosines to six places; ties go to the smaller kb_id. by_label: the k nearest of each label.
    """
    spark = queries.sparkSession
    groups = -(-queries.count() // query_rows) or 1
    slices = int(spark.conf.get("spark.sql.shuffle.partitions"))
    label = F.col("label").cast("string") if "label" in kb.columns else F.lit(None).cast("string")
    dealt = lambda key, n: F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    vector = F.col("vector").cast("array<double>").alias("vector")
    asked = queries.select(dealt("query_id", groups).alias("g"), every(slices).alias("s"), F.lit(0).alias("side"), F.col("query_id").cast("long").alias("id"), F.lit(None).cast("string").alias("label"), vector)
    base = kb.select(every(groups).alias("g"), dealt("kb_id", slices).alias("s"), F.lit(1).alias("side"), F.col("kb_id").cast("long").alias("id"), label.alias("label"), vector)
    both = asked.unionByName(base).filter("id IS NOT NULL AND vector IS NOT NULL").repartition("g", "s").sortWithinPartitions("g", "s", "side")
    best = top_k(both.mapInArrow(_searched(k, by_label), FOUND), ["query_id", "label"] if by_label else ["query_id"], k, F.desc("score"), "kb_id")
    if not by_label and "label" in kb.columns:
        best = best.drop("label").join(kb.select(F.col("kb_id").cast("long"), F.col("label").cast("string")), "kb_id")
    return best.select("query_id", "kb_id", "label", "score", "rank")


def oversampled(queries: DataFrame, kb: DataFrame, sample: int = 100, per_label: int = 3) -> DataFrame:
    """The nearest `per_label` of each label among the nearest `sample`: a rare label may have fewer."""
    return top_k(nearest(queries, kb, sample).drop("rank"), ["query_id", "label"], per_label, F.desc("score"), "kb_id")


def votes(hits: DataFrame, key: str, threshold: float = C.SIMILARITY, positive: str = "MALWARE") -> DataFrame:
    """Squared scores of each side over all hits above the threshold, counts, ratio, verdict and confidence."""
    hit, yes = F.col("score") >= threshold, F.col("label") == positive
    weight = lambda c: F.coalesce(F.sum(F.when(hit & c, F.col("score") * F.col("score"))), F.lit(0.0))
    out = hits.groupBy(key).agg(weight(yes).alias("w_yes"), weight(~yes).alias("w_no"), F.count_if(hit & yes).alias("malware_votes"), F.count_if(hit & ~yes).alias("benign_votes"))
    ratio = F.coalesce(F.try_divide(F.col("w_yes"), F.col("w_yes") + F.col("w_no")), F.lit(0.0))
    return out.withColumn("score", ratio).withColumns({"prediction": vote_verdict(F.col("score")), "confidence": vote_confidence(F.col("score"))})


def vote_verdict(ratio: Column, positive: str = "MALWARE", negative: str = "BENIGN") -> Column:
    return F.when(ratio >= 0.5, positive).otherwise(negative)


def vote_confidence(ratio: Column) -> Column:
    return F.when((ratio >= 0.7) | (ratio <= 0.3), "HIGH").otherwise("MEDIUM")


def top_group(hits: DataFrame, key: str, group: str, threshold: float = C.SIMILARITY, positive: str = "MALWARE", order: str = "kb_id") -> DataFrame:
    """The positive hits' group with the largest sum of squared scores; unknown ones don't count, ties go to the first seen."""
    own = hits.filter((F.col("score") >= threshold) & (F.col("label") == positive) & ~F.lower(F.coalesce(group, F.lit("unknown"))).isin("unknown", "benign", ""))
    sums = own.groupBy(key, group).agg(F.round(F.sum(F.col("score") * F.col("score")), 9).alias("w"), F.min(order).alias("seen"))
    return top_k(sums, [key], 1, F.desc("w"), "seen", rank="__r").select(key, F.col(group).alias("top_family"))


def claim(hits: DataFrame, app: str, order: list, claim_key: str, per: list, most: int) -> DataFrame:
    """First-claim dedup: rows in order; a key claimed before is passed over, and later rows fill the places up to `most`.

    Sequential within an app by nature: sorted partitions are streamed, with the claimed keys of one app in memory
    (at most its number of queries times labels times `most`).
    """
    columns = hits.columns
    per_at, app_at, key_at = [columns.index(c) for c in per], columns.index(app), columns.index(claim_key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, claimed, held = None, set(), {}
        for batch in batches:
            stay = []
            data = [batch.column(i).to_pylist() for i in {*per_at, app_at, key_at}]
            at = {i: data[j] for j, i in enumerate({*per_at, app_at, key_at})}
            for r in range(batch.num_rows):
                if at[app_at][r] != now:
                    now, claimed, held = at[app_at][r], set(), {}
                place = tuple(at[i][r] for i in per_at)
                if held.get(place, 0) < most and at[key_at][r] not in claimed:
                    claimed.add(at[key_at][r])
                    held[place] = held.get(place, 0) + 1
                    stay.append(r)
            if stay:
                yield batch.take(pa.array(stay))

    return hits.repartition(app).sortWithinPartitions(app, *order).mapInArrow(run, hits.schema)

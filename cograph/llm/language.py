"""Language identification: a byte convolutional network, trained in numpy on labelled text.

Texts are cut into windows of 256 bytes. Filters of three widths (3, 4 and 5 bytes) slide over a window; each
filter's largest response in the window feeds a softmax over the learned languages, and a document's probabilities
are the mean over all its windows, so the whole text counts. A filter's weights stand for each byte and offset, which
lets prediction look up the responses of byte pairs in tables instead of multiplying: three lookups a byte.

Training takes a bounded sample: for each language, `PER_LANGUAGE` documents in the order of a seeded hash, with
`PIECES` windows each; with very many languages fewer documents each, so that at most `SAMPLE` are taken in all, but
every language that a label names is learned. Rows beyond `SPARE` times that number are passed over by their hash
beforehand, so no task gets more. The query learns only from documents whose crc32 of the id is not 2 modulo 4, and no
prediction looks at lang, source or doc_id.

Defined cases: null texts and texts without a letter are `und` with score 0; without labelled text everything is
`und`; a null doc_id is not held out and not learned from; repeated rows stay; an empty table gives no rows; columns
of the input called lang_pred or score are replaced by the result's; more labels than `SAMPLE` are an error.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cograph.llm.common import mapped, table, text_bytes

WINDOW, WIDTHS, FILTERS, SEED = 256, (3, 4, 5), 8, 7
PER_LANGUAGE, PIECES, SAMPLE, SPARE, STEPS, BATCH = 400, 3, 100_000, 4, 500, 64
UNKNOWN, LEAST_SCORE = "und", 0.3
_TAPS = max(WIDTHS)
_MASK = np.repeat(np.array([[k < w for w in WIDTHS] for k in range(_TAPS)]), FILTERS, axis=1)


def windows_of(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All windows (padded with zero bytes) of the rows of `raw`, and the number of windows before each row."""
    sizes = np.diff(at)
    many = -(-sizes // WINDOW)
    first = np.concatenate([[0], np.cumsum(many)])
    out = np.zeros(int(first[-1]) * WINDOW, dtype=np.uint8)
    out[np.arange(len(raw)) + np.repeat(first[:-1] * WINDOW - at[:-1], sizes)] = raw
    return out.reshape(-1, WINDOW), first


def train(windows: np.ndarray, labels: np.ndarray, classes: int, steps: int = STEPS, seed: int = SEED) -> tuple[np.ndarray, ...]:
    """Filter weights (tap, byte, filter), filter biases, softmax weights and biases, by Adam on cross entropy."""
    rng = np.random.default_rng(seed)
    filters = FILTERS * len(WIDTHS)
    weights = (rng.normal(0, 0.1, (_TAPS, 256, filters)) * _MASK[:, None, :]).astype(np.float32)
    params = [weights, np.zeros(filters, np.float32), rng.normal(0, 0.3, (filters, classes)).astype(np.float32), np.zeros(classes, np.float32)]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    span, steps = WINDOW - _TAPS + 1, max(steps, steps * classes // BATCH)
    by_class = [np.flatnonzero(labels == c) for c in range(classes)]
    by_class = [x for x in by_class if len(x)]
    for step in range(1, steps + 1):
        pick = np.array([x[rng.integers(len(x))] for x in (by_class[(step * BATCH + i) % len(by_class)] for i in range(BATCH))])
        x, y = windows[pick], labels[pick]
        response = params[0][0][x[:, :span]]
        for k in range(1, _TAPS):
            response += params[0][k][x[:, k : k + span]]
        best = response.argmax(axis=1)
        top = np.take_along_axis(response, best[:, None, :], axis=1)[:, 0, :] + params[1]
        hidden = np.maximum(top, 0.01 * top)
        logits = hidden @ params[2] + params[3]
        chance = np.exp(logits - logits.max(axis=1, keepdims=True))
        chance /= chance.sum(axis=1, keepdims=True)
        chance[np.arange(len(y)), y] -= 1
        chance /= len(y)
        into = (chance @ params[2].T) * np.where(top > 0, 1, 0.01)
        slope = np.zeros_like(params[0])
        rows, cols = np.arange(len(y))[:, None], np.arange(filters)[None, :]
        for k in range(_TAPS):
            np.add.at(slope[k], (x[rows, best + k], np.broadcast_to(cols, best.shape)), into * _MASK[k])
        grads = [slope, into.sum(axis=0), hidden.T @ chance, chance.sum(axis=0)]
        for p, g, m, v in zip(params, grads, first, second, strict=True):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p -= (0.02 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    return tuple(params)


class Network:
    """A trained network with its lookup tables in 16-bit integers."""

    _kept: tuple[tuple, Network] | None = None

    def __init__(self, languages: list[str], params: tuple[np.ndarray, ...]):
        self.languages, (weights, self.bias, self.out, self.shift) = languages, params
        most = float(np.abs(weights).max(axis=1).sum(axis=0).max()) or 1.0
        self.scale = most / 32000
        small = np.rint(weights / self.scale).astype(np.int16)
        self.low = (small[0][:, None, :] + small[1][None, :, :]).reshape(65536, -1)
        self.mid = (small[2][:, None, :] + small[3][None, :, :]).reshape(65536, -1)
        self.high = small[4]

    @classmethod
    def of(cls, languages: list[str], params: tuple[np.ndarray, ...]) -> Network:
        mark = (tuple(languages), *(p.tobytes() for p in params))
        if cls._kept is None or cls._kept[0] != mark:
            cls._kept = (mark, cls(languages, params))
        return cls._kept[1]

    def probabilities(self, windows: np.ndarray, chunk: int = 32) -> np.ndarray:
        out = np.empty((len(windows), len(self.languages)))
        span = WINDOW - _TAPS + 1
        buffers = [np.empty((chunk, span, self.low.shape[1]), np.int16) for _ in range(3)]
        for i in range(0, len(windows), chunk):
            x = windows[i : i + chunk].astype(np.uint16)
            pairs = (x[:, :-1] << np.uint16(8)) | x[:, 1:]
            a, b, c = (t[: len(x)] for t in buffers)
            np.take(self.low, pairs[:, :span], axis=0, out=a, mode="clip")
            np.take(self.mid, pairs[:, 2 : 2 + span], axis=0, out=b, mode="clip")
            np.take(self.high, x[:, 4:], axis=0, out=c, mode="clip")
            a += b
            a += c
            left = span
            while left > 1:
                half = (left + 1) // 2
                np.maximum(a[:, : left - half], a[:, half:left], out=a[:, : left - half])
                left = half
            top = a[:, 0, :] * self.scale + self.bias
            logits = np.maximum(top, 0.01 * top) @ self.out + self.shift
            chance = np.exp(logits - logits.max(axis=1, keepdims=True))
            out[i : i + chunk] = chance / chance.sum(axis=1, keepdims=True)
        return out

    def predict(self, texts: pa.Array) -> tuple[list[str], list[float]]:
        names, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        for low in range(0, len(texts), 256):
            part = texts.slice(low, 256)
            raw, at = text_bytes(part)
            windows, first = windows_of(raw, at)
            if not len(windows):
                continue
            full = np.flatnonzero(np.diff(first))
            mean = np.add.reduceat(self.probabilities(windows), first[full], axis=0) / np.diff(first)[full][:, None]
            best = mean.argmax(axis=1)
            for r, b, p in zip(full.tolist(), best.tolist(), mean[np.arange(len(best)), best].tolist()):
                if any(map(str.isalpha, part[r].as_py())):
                    names[low + r], scores[low + r] = self.languages[b], min(1.0, p)
        return names, scores


def learn(labelled: DataFrame, per_language: int = PER_LANGUAGE) -> tuple[list[str], tuple[np.ndarray, ...]] | None:
    """Trains on a bounded sample of rows (text, lang, key); key: what the sample is ordered by."""
    frequent = labelled.groupBy("lang").agg(F.count("*").alias("n")).limit(SAMPLE + 1).collect()
    languages = sorted(r.lang for r in frequent)
    if not languages:
        return None
    if len(languages) > SAMPLE:
        raise ValueError(f"more than {SAMPLE} labels: these are no languages")
    per_language = min(per_language, max(1, SAMPLE // len(languages)))
    # Rows of large languages are thinned by their key to a few times what is wanted before they meet in a task.
    rates = F.create_map(*[F.lit(x) for r in frequent for x in (r.lang, min(1.0, SPARE * per_language / r.n))])
    thin = F.shiftrightunsigned("key", 11) / float(1 << 53) <= rates[F.col("lang")]
    spread = F.greatest(F.length("text") - WINDOW + 1, F.lit(1))
    piece = [F.substring("text", F.pmod(F.xxhash64(F.lit(i), "key"), spread).cast("int") + 1, F.lit(WINDOW)) for i in range(PIECES)]
    cut = labelled.filter(thin).select("lang", "key", F.array(*piece).alias("pieces"))
    order = W.partitionBy("lang").orderBy("key", "pieces")
    sample = cut.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= per_language).select("lang", "n", F.explode("pieces").alias("piece"))
    rows = sorted(tuple(r) for r in sample.collect())
    encoded = [r[2].encode()[:WINDOW] for r in rows]
    windows = np.zeros((len(rows), WINDOW), dtype=np.uint8)
    for i, e in enumerate(encoded):
        windows[i, : len(e)] = np.frombuffer(e, dtype=np.uint8)
    return languages, train(windows, np.array([languages.index(r[0]) for r in rows]), len(languages))


def _predictor(model):
    def run(batches):
        network = Network.of(*model) if model else None
        for batch in batches:
            texts = batch.column("text")
            names, scores = network.predict(texts) if network else ([UNKNOWN] * len(texts), [0.0] * len(texts))
            columns = [batch.column(i) for i in range(batch.num_columns)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=[*batch.schema.names, "lang_pred", "score"])

    return run


def trained(docs: DataFrame):
    """The model learned from `docs` (doc_id, text, lang), without the held-out quarter."""
    fold = F.crc32(F.col("doc_id").cast("string")) % 4
    ok = (fold != 2) & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")
    return learn(docs.filter(ok).select("text", "lang", F.xxhash64(F.lit(SEED), "doc_id").alias("key")))


def identify(docs: DataFrame, model) -> DataFrame:
    """`docs` (with text) and lang_pred and score, which replace columns of these names."""
    docs = docs.drop("lang_pred", "score")
    schema = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return docs.transform(mapped(_predictor(model), schema))


def _recognised(model, least: float):
    def run(batches):
        network = Network.of(*model)
        for batch in batches:
            names, scores = network.predict(batch.column("text"))
            stay = [i for i, (n, s) in enumerate(zip(names, scores, strict=True)) if n != UNKNOWN and s >= least]
            yield batch if len(stay) == batch.num_rows else batch.take(pa.array(stay, pa.int64()))

    return run


def recognised(docs: DataFrame, model, least: float = LEAST_SCORE) -> DataFrame:
    """The rows of `docs` in a learned language, with all their columns; without a model, none is recognised."""
    return docs.transform(mapped(_recognised(model, least), docs.schema)) if model else docs.filter(F.lit(False))


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    judged = identify(docs.select("doc_id", held_out.alias("held_out"), "text"), trained(docs))
    return judged.select("doc_id", "held_out", "lang_pred", "score")

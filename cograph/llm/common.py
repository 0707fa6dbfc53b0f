"""Helpers that the operators of this subpackage share: tables, shared folders, cut lineage, word scanning."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space between words in every contract: space, tab, line feed, vertical tab, form feed, carriage return.
WORD = r"[^\x20\x09-\x0D]+"
BATCH_ROWS, BATCH_BYTES = "1024", "8m"
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, every other character as it is."""
    return F.translate(text, UPPER, LOWER)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir).

    Where none is set, a local session gets a temporary one; on a cluster that would be a folder of one machine: an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="cograph-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/cograph/{name}-{uuid.uuid4().hex}"


def _file_system(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def path_exists(spark: SparkSession, path: str) -> bool:
    fs, where = _file_system(spark, path)
    return bool(fs.exists(where))


def remove(spark: SparkSession, *paths: str) -> None:
    """Deletes tables that no later step reads, and lets the driver forget the shuffles behind them."""
    for path in paths:
        fs, where = _file_system(spark, path)
        fs.delete(where, True)
    gc.collect()  # frames that only cycles of Python objects hold are dropped first
    spark.sparkContext._jvm.System.gc()


def written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Writes `df` to the shared folder and reads it back: lineage is cut and survives lost executors.

    What no step removes before (a result may still be read from it) goes when the application ends.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    fs, where = _file_system(spark, path)
    fs.deleteOnExit(where)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def _tidy(function):
    """`function`, giving memory back to the system when its task ends: workers are used again by other operators."""

    def run(batches):
        yield from function(batches)
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):
            ctypes.CDLL("libc.so.6").malloc_trim(0)

    return run


def _lowered(spark: SparkSession, key: str, most: str) -> None:
    """Lowers a batch limit of the session where it is unset or higher. Plans are made when a result is used, so it stays."""
    number = lambda x: int(re.sub(r"\D", "", x)) << {"k": 10, "m": 20, "g": 30}.get(x.rstrip("b")[-1:], 0)
    now = spark.conf.get(key, None)
    if not now or now.startswith("-") or not number(now) or number(now) > number(most):
        spark.conf.set(key, most)


def mapped(function, schema):
    """For DataFrame.transform: mapInArrow with batches of a bounded size, as texts may be long."""

    def apply(df: DataFrame) -> DataFrame:
        _lowered(df.sparkSession, "spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
        _lowered(df.sparkSession, "spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
        return df.mapInArrow(_tidy(function), schema)

    return apply


def splitmix(x: np.ndarray) -> np.ndarray:
    """The finaliser of SplitMix64 on unsigned 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of an Arrow string array (null: empty) and the n + 1 offsets of its rows."""
    texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
    if texts.null_count:
        texts = texts.fill_null("")
    texts = texts.cast(pa.large_string())
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]] if data is not None and len(at) and at[-1] > at[0] else np.zeros(0, np.uint8)
    return raw, at - at[0]


def word_spans(raw: np.ndarray, at: np.ndarray, space: np.ndarray = _IS_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words in `raw`, and for each row of `at` the number of words before it (n + 1 numbers)."""
    inside = ~space[raw]
    before = np.empty(len(raw), dtype=bool)
    if len(raw):
        before[0] = False
        before[1:] = inside[:-1]
        cut = at[1:-1]
        before[cut[cut < len(raw)]] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty(len(raw), dtype=bool)
    if len(raw):
        after[-1] = False
        after[:-1] = inside[1:]
        cut = at[1:-1]
        after[cut[cut > 0] - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, at)


LONG_WORD = 64


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each word's bytes, the same wherever the word stands.

    Eight bytes at a time go through a mixing step that is one-to-one for what was before, so words of one length of
    up to 8 bytes never hash alike, and no algebra of long words carries over. Very long words are hashed one by one.
    """
    sizes = ends - starts
    out = splitmix(sizes.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(seed))
    if not len(starts):
        return out
    padded = np.concatenate([raw, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(raw) + 1,), dtype="<u8", buffer=padded, strides=(1,))
    live = np.flatnonzero(sizes <= LONG_WORD)
    for k in range(0, LONG_WORD, 8):
        live = live[sizes[live] > k]
        if not len(live):
            break
        piece = eight[starts[live] + k]
        short = np.minimum(sizes[live] - k, 8).astype(np.uint64)
        piece &= np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(64) - np.uint64(8) * short)
        out[live] = splitmix((out[live] ^ piece) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(k + 1))
    for i in np.flatnonzero(sizes > LONG_WORD).tolist():
        out[i] = xxhash.xxh3_64_intdigest(raw[starts[i] : ends[i]].tobytes(), seed)
    return out


#: Words without marks: runs of ASCII letters and digits and of non-ASCII characters.
NOT_WORD = np.ones(256, dtype=bool)
NOT_WORD[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
WORD_SQL = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words of all texts, and for each text the number of words before it."""
    raw, at = text_bytes(texts)
    raw = raw | (((raw >= 65) & (raw <= 90)).astype(np.uint8) << 5)
    starts, ends, first = word_spans(raw, at, NOT_WORD)
    return word_hashes(raw, starts, ends), first

"""Token-ID output as one wavelet-matrix file per shard.

Documents are dealt to shards by ranges of doc_id (and of their texts' hashes, where ids are equal) and sorted. A shard's file is one Parquet file whose rows are
segments of whole documents (about 131,000 tokens each: memory is bounded and planes fit the processor's cache); a segment holds its document ids
and lengths and the wavelet matrix of its token ids: one packed bit plane for each bit of an id from the highest
down, the number of zeros of each plane, and cumulative counts of ones every 512 bits. Access, counting and finding
occurrences of a token touch one bit of each plane; reading everything back undoes the stable partitions plane by
plane. `Shard` does so for one file, `token_counts` and `occurrences` for all files. Files go through Spark's own writer, so any store that Spark reaches will do.

Encoding: the tokenizer never merges over white space, nor between a letter or digit and the ASCII marks behind it, so
each distinct piece of a batch is encoded once by the library and its ids are gathered for every place it stands at.
Pieces are compared in lower case, as the tokenizer does it, save those with a "<": special tokens are known by case.

Defined cases: null text is empty and gives the end id alone; a null id sorts first; rows with equal ids stay, in
the order of a hash of their texts; an empty table gives no rows.
"""

from __future__ import annotations

import re
import zlib
from itertools import chain, repeat
from operator import attrgetter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cograph.llm.common import fresh_path, mapped, table, text_bytes, word_spans

END_ID, SEGMENT_TOKENS, RANK_STEP, CACHE_WORDS, MARKS = 2, 1 << 17, 512, 600_000, 16
SEGMENT = "shard long, segment long, n_tokens long, ids array<long>, lengths array<long>, zeros array<long>, planes array<binary>, ranks array<binary>"
_POPCOUNT = np.array([bin(i).count("1") for i in range(256)], dtype=np.uint8)


class WaveletMatrix:
    """A sequence of unsigned integers as bit planes with rank directories."""

    def __init__(self, n: int, zeros: list[int], planes: list[bytes], ranks: list[bytes]):
        self.n, self.zeros, self.depth = n, zeros, len(planes)
        self.planes = [np.frombuffer(p, dtype=np.uint8) for p in planes]
        self.ranks = [np.frombuffer(r, dtype="<u4") for r in ranks]

    @classmethod
    def build(cls, values: np.ndarray) -> WaveletMatrix:
        depth = max(1, int(values.max()).bit_length()) if len(values) else 1
        now, zeros, planes, ranks = values, [], [], []
        for bit in range(depth - 1, -1, -1):
            ones = ((now >> now.dtype.type(bit)) & now.dtype.type(1)).astype(bool)
            packed = np.packbits(ones)
            padded = np.zeros(-(-len(packed) * 8 // RANK_STEP) * RANK_STEP // 8 + RANK_STEP // 8, dtype=np.uint8)
            padded[: len(packed)] = packed
            counts = _POPCOUNT[padded].reshape(-1, RANK_STEP // 8).sum(axis=1, dtype=np.uint32)
            planes.append(packed.tobytes())
            ranks.append(np.concatenate([[0], np.cumsum(counts)[:-1]]).astype("<u4").tobytes())
            up, down = np.flatnonzero(ones), np.flatnonzero(~ones)
            now = np.concatenate([now.take(down), now.take(up)])
            zeros.append(len(down))
        return cls(len(values), zeros, planes, ranks)

    def _bit(self, level: int, i: int) -> int:
        return (int(self.planes[level][i >> 3]) >> (7 - (i & 7))) & 1

    def _ones(self, level: int, i: int) -> int:
        """Ones before place i."""
        block = i // RANK_STEP
        at, plane = block * RANK_STEP // 8, self.planes[level]
        total = int(self.ranks[level][block]) + int(_POPCOUNT[plane[at : i >> 3]].sum())
        return total + (int(_POPCOUNT[plane[i >> 3] & (0xFF00 >> (i & 7) & 0xFF)]) if i & 7 else 0)

    def access(self, i: int) -> int:
        value = 0
        for level in range(self.depth):
            bit, ones = self._bit(level, i), self._ones(level, i)
            value, i = value << 1 | bit, self.zeros[level] + ones if bit else i - ones
        return value

    def rank(self, value: int, i: int) -> int:
        """How often `value` stands before place i."""
        if value < 0 or value >> self.depth:
            return 0
        low = 0
        for level in range(self.depth):
            a, b = self._ones(level, low), self._ones(level, i)
            low, i = (self.zeros[level] + a, self.zeros[level] + b) if value >> (self.depth - 1 - level) & 1 else (low - a, i - b)
        return i - low

    def count(self, value: int) -> int:
        return self.rank(value, self.n)

    def _place(self, level: int, bit: int, k: int) -> int:
        """The place of one (or zero) number k of a plane: by the directory, then by the bytes of one block."""
        ranks = self.ranks[level].astype(np.int64)
        before = ranks if bit else np.arange(len(ranks)) * RANK_STEP - ranks
        block = int(np.searchsorted(before, k, side="right")) - 1
        at = block * RANK_STEP // 8
        ones = np.unpackbits(self.planes[level][at : at + RANK_STEP // 8])
        return block * RANK_STEP + int(np.flatnonzero(ones == bit)[k - int(before[block])])

    def select(self, value: int, k: int) -> int:
        """The place of occurrence k (from 0) of `value`: down to where its run begins in the last plane, then back up."""
        if not 0 <= k < self.count(value):
            raise IndexError(k)
        low, bits = 0, [value >> (self.depth - 1 - level) & 1 for level in range(self.depth)]
        for level, bit in enumerate(bits):
            ones = self._ones(level, low)
            low = self.zeros[level] + ones if bit else low - ones
        at = low + k
        for level in range(self.depth - 1, -1, -1):
            at = self._place(level, bits[level], at - self.zeros[level] if bits[level] else at)
        return at

    def occurrences(self, value: int) -> list[int]:
        return [self.select(value, k) for k in range(self.count(value))]

    def decode(self) -> np.ndarray:
        """All values: the stable partitions undone from the last plane up."""
        now = np.zeros(self.n, dtype=np.uint16 if self.depth <= 16 else np.uint32)
        for level in range(self.depth - 1, -1, -1):
            ones = np.unpackbits(self.planes[level], count=self.n).astype(bool)
            up = np.empty_like(now)
            up[np.flatnonzero(~ones)] = now[: self.zeros[level]]
            up[np.flatnonzero(ones)] = now[self.zeros[level] :] | now.dtype.type(1 << (self.depth - 1 - level))
            now = up
        return now


class Encoder:
    """Whole texts to ids, each distinct piece once; the memory of pieces is bounded."""

    _kept: dict[str, Encoder] = {}

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(path)
        level, latin = ByteLevel(add_prefix_space=False, use_regex=False), "".join(map(chr, [*range(0xC0, 0xD7), *range(0xD8, 0xF7), *range(0xF8, 0x100)]))
        self.latin = {ord(c): level.pre_tokenize_str(c.lower())[0][0] for c in latin}
        self.plain = re.compile(f"[a-z{latin}]+")
        self._clear()
        self.is_letter = np.zeros(256, dtype=bool)
        self.is_letter[[*range(48, 58), *range(97, 123)]] = True
        self.is_mark = np.zeros(256, dtype=bool)
        self.is_mark[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True

    @classmethod
    def of(cls, path: str) -> Encoder:
        if path not in cls._kept:
            cls._kept[path] = cls(path)
        return cls._kept[path]

    def _clear(self) -> None:
        """No pieces: their numbers, and for each number where its ids begin and how many they are."""
        self.known: dict[bytes, int] = {}
        self.ids, self.begin, self.counts = np.zeros(0, "<u4"), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _learn(self, pieces: list[bytes]) -> None:
        """Gives the next numbers to `pieces`, none of them known."""
        tokenize, id_of, plain, rest, ids, counts = self.tokenizer.model.tokenize, attrgetter("id"), [], [], [], []
        for piece in pieces:
            # Latin letters in lower case: what the normaliser and splitter leave as it is. A-Z stand beside a "<" only.
            text = piece.decode()
            if text.isascii():
                ready = text if text.isalpha() else None
            else:
                ready = text.translate(self.latin) if self.plain.fullmatch(text) else None
            if ready is None:
                rest.append((piece, text))
                continue
            found = tokenize(ready)
            plain.append(piece)
            ids.extend(map(id_of, found))
            counts.append(len(found))
        for x in self.tokenizer.encode_batch_fast([text for _, text in rest], add_special_tokens=False):
            found = x.ids
            ids.extend(found)
            counts.append(len(found))
        self.known.update(zip(chain(plain, (piece for piece, _ in rest)), range(len(self.counts), len(self.counts) + len(pieces))))
        self.begin = np.concatenate([self.begin, len(self.ids) + np.cumsum(counts, dtype=np.int64) - counts])
        self.ids, self.counts = np.concatenate([self.ids, np.array(ids, dtype="<u4")]), np.concatenate([self.counts, counts])

    def _numbers(self, pieces: list[bytes]) -> np.ndarray:
        """The numbers of `pieces`, all of them different."""
        out = np.fromiter(map(self.known.get, pieces, repeat(-1)), np.int64, len(pieces))
        new = np.flatnonzero(out < 0)
        if len(new):
            if len(self.known) > CACHE_WORDS:
                self._clear()
                new = np.arange(len(pieces))
            missing = [pieces[i] for i in new.tolist()]
            self._learn(missing)
            out[new] = np.fromiter(map(self.known.get, missing), np.int64, len(missing))
        return out

    def encode(self, texts: pa.Array, end: int | None = END_ID) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another, and the number of ids of each (with the end id)."""
        raw, at = text_bytes(texts)
        starts, ends, first = word_spans(raw, at)
        given, raw = raw, np.where((raw >= 65) & (raw <= 90), raw + 32, raw).astype(np.uint8)
        special = np.unique(np.searchsorted(starts, np.flatnonzero(given == 60), side="right") - 1)
        for i in special.tolist():
            raw[starts[i] : ends[i]] = given[starts[i] : ends[i]]
        middle = ends.copy()  # where the marks at the end of a word begin
        live = np.flatnonzero(self.is_mark[raw[ends - 1]])
        for _ in range(MARKS):
            middle[live] -= 1
            live = live[middle[live] > starts[live]]
            live = live[self.is_mark[raw[middle[live] - 1]]]
        middle[live] = ends[live]
        middle[special] = ends[special]
        cut = (middle < ends) & (middle > starts)
        before, ahead = raw[np.maximum(middle - 1, 0)], raw[np.maximum(middle - 2, 0)]
        cut &= self.is_letter[before] | ((before >= 0x80) & (before != 0x97) & (before != 0xB7) & (ahead == 0xC3) & (middle - starts > 1))
        extra = np.cumsum(cut)
        place = np.arange(len(starts)) + extra - cut
        n = len(starts) + (int(extra[-1]) if len(extra) else 0)
        lows, highs = np.empty(n, dtype=np.int64), np.empty(n, dtype=np.int64)
        lows[place], highs[place] = starts, np.where(cut, middle, ends)
        lows[place[cut] + 1], highs[place[cut] + 1] = middle[cut], ends[cut]
        first = first + np.concatenate([[0], extra])[first]
        sizes = highs - lows
        offsets = np.concatenate([[0], np.cumsum(sizes)])
        keep = np.zeros(len(raw) + 1, dtype=np.int8)
        keep[starts] += 1
        keep[ends] -= 1  # words are parted by white space or rows; a start at an end adds up to 0
        body = raw[np.cumsum(keep[:-1], dtype=np.int8).astype(bool)]
        pieces = pa.LargeBinaryArray.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(body))]).dictionary_encode()
        _, cuts, data = pieces.dictionary.buffers()
        cuts, data = np.frombuffer(cuts, dtype=np.int64)[: len(pieces.dictionary) + 1].tolist(), data.to_pybytes() if data else b""
        names, which = [data[a:b] for a, b in zip(cuts, cuts[1:])], pieces.indices.to_numpy()
        known = self._numbers(names)
        counts, begin = self.counts[known], self.begin[known]
        each = counts[which] if n else np.zeros(0, np.int64)
        upto = np.concatenate([[0], np.cumsum(each)])
        ids = self.ids[np.repeat(begin[which] - upto[:-1], each) + np.arange(upto[-1])] if n else np.zeros(0, "<u4")
        edges = upto[first]
        lengths = np.diff(edges)
        if end is not None:
            ids = np.insert(ids, edges[1:], end)
            lengths = lengths + 1
        return ids, lengths


def _batches(batches, rows: int = 512):
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


def _encode_shard(path: str):
    def run(batches):
        encoder, shard, segment = Encoder.of(path), TaskContext.get().partitionId(), 0
        ids, lengths, tokens, held = [], [], [], 0

        def flush():
            nonlocal segment, ids, lengths, tokens, held
            whole = np.concatenate(tokens).astype(np.uint32)
            if len(whole) and whole.max() < 1 << 16:
                whole = whole.astype(np.uint16)
            m = WaveletMatrix.build(whole)
            row = [{"shard": shard, "segment": segment, "n_tokens": len(whole), "ids": ids, "lengths": lengths, "zeros": m.zeros, "planes": [p.tobytes() for p in m.planes], "ranks": [r.tobytes() for r in m.ranks]}]
            segment, ids, lengths, tokens, held = segment + 1, [], [], [], 0
            return pa.RecordBatch.from_pylist(row, schema=_ARROW)

        for batch in _batches(batches):
            got, each = encoder.encode(batch.column("text"))
            ids += batch.column("doc_id").to_pylist()
            lengths += each.tolist()
            tokens.append(got)
            held += len(got)
            if held >= SEGMENT_TOKENS:
                yield flush()
        if ids:
            yield flush()

    return run


_ARROW = pa.schema([("shard", pa.int64()), ("segment", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("zeros", pa.list_(pa.int64())), ("planes", pa.list_(pa.binary())), ("ranks", pa.list_(pa.binary()))])
_DIGEST = pa.schema([("doc_id", pa.int64()), ("shard", pa.int64()), ("segment", pa.int64()), ("inside", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


def _read_segments(batches):
    for batch in batches:
        for row in range(batch.num_rows):
            x = {name: batch.column(name)[row].as_py() for name in ("shard", "segment", "n_tokens", "ids", "lengths", "zeros", "planes", "ranks")}
            values = WaveletMatrix(x["n_tokens"], x["zeros"], x["planes"], x["ranks"]).decode().astype("<u4")
            edges = np.concatenate([[0], np.cumsum(x["lengths"])]).astype(np.int64)
            cuts, view = edges.tolist(), memoryview(values).cast("B")
            sums = [zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(cuts, cuts[1:])]
            n = len(sums)
            yield pa.RecordBatch.from_arrays([pa.array(x["ids"], pa.int64()), pa.array([x["shard"]] * n, pa.int64()), pa.array([x["segment"]] * n, pa.int64()), pa.array(edges[:-1]), pa.array(x["lengths"], pa.int64()), pa.array(sums, pa.int64())], schema=_DIGEST)


def write_shards(docs: DataFrame, out: str, tokenizer: str) -> None:
    """Writes doc_id and text of `docs` to `out`, one file a shard, in ascending doc_id order."""
    order = ["doc_id", F.xxhash64("text")]
    docs.select("doc_id", "text").repartitionByRange(*order).sortWithinPartitions(*order).transform(mapped(_encode_shard(tokenizer), SEGMENT)).write.parquet(out)


def _matrix(row) -> WaveletMatrix:
    return WaveletMatrix(row["n_tokens"], row["zeros"], row["planes"], row["ranks"])


class Shard:
    """One shard's file: tokens by place, counts and occurrences over all its segments.

    The lengths of the segments are known from the start (one number each); a segment's planes are read when they are asked for, and
    the last few are kept.
    """

    def __init__(self, spark: SparkSession, out: str, shard: int, keep: int = 4):
        self._rows = spark.read.schema(SEGMENT).parquet(out).filter(F.col("shard") == shard)
        self._sizes = np.array([r.n_tokens for r in self._rows.select("segment", "n_tokens").orderBy("segment").collect()], dtype=np.int64)
        self._begin, self._keep, self._held = np.concatenate([[0], np.cumsum(self._sizes)]), keep, {}

    def __len__(self) -> int:
        return int(self._begin[-1])

    def segment(self, i: int) -> WaveletMatrix:
        if i not in self._held:
            while len(self._held) >= self._keep:
                self._held.pop(next(iter(self._held)))
            self._held[i] = _matrix(self._rows.filter(F.col("segment") == i).first())
        return self._held[i]

    def access(self, place: int) -> int:
        if not 0 <= place < len(self):
            raise IndexError(place)
        i = int(np.searchsorted(self._begin, place, side="right")) - 1
        return self.segment(i).access(place - int(self._begin[i]))

    def rank(self, value: int, place: int) -> int:
        """How often `value` stands before `place`."""
        total = 0
        for i, low in enumerate(self._begin[:-1].tolist()):
            if low < place:
                total += self.segment(i).rank(value, min(place - low, int(self._sizes[i])))
        return total

    def count(self, value: int) -> int:
        return self.rank(value, len(self))

    def select(self, value: int, k: int) -> int:
        """The place of occurrence k (from 0) of `value`."""
        left = k
        for i, low in enumerate(self._begin[:-1].tolist()):
            many = self.segment(i).count(value)
            if 0 <= left < many:
                return low + self.segment(i).select(value, left)
            left -= many
        raise IndexError(k)


def token_counts(spark: SparkSession, out: str, values: list[int]) -> DataFrame:
    """value, n: how often each of `values` stands in all files of `out`, two ranks a plane and segment."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                m = _matrix(row)
                yield pa.RecordBatch.from_arrays([pa.array(values, pa.int64()), pa.array([m.count(v) for v in values], pa.int64())], names=["value", "n"])

    return spark.read.schema(SEGMENT).parquet(out).transform(mapped(run, "value long, n long")).groupBy("value").agg(F.sum("n").alias("n"))


def occurrences(spark: SparkSession, out: str, value: int) -> DataFrame:
    """doc_id, place: where `value` stands in the documents of `out` (places from 0 within a document)."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                at = np.array(_matrix(row).occurrences(value), dtype=np.int64)
                edges = np.concatenate([[0], np.cumsum(row["lengths"])]).astype(np.int64)
                which = np.searchsorted(edges, at, side="right") - 1
                yield pa.RecordBatch.from_arrays([pa.array([row["ids"][i] for i in which.tolist()], pa.int64()), pa.array(at - edges[which])], names=["doc_id", "place"])

    return spark.read.schema(SEGMENT).parquet(out).transform(mapped(run, "doc_id long, place long"))


def read_digests(spark: SparkSession, out: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document in the files of `out`."""
    files = spark.read.schema(SEGMENT).parquet(out)
    sizes = files.select("shard", "segment", "n_tokens")
    before = lambda *order: W.orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    shards = sizes.groupBy("shard").agg(F.sum("n_tokens").alias("n")).select("shard", F.coalesce(F.sum("n").over(before("shard")), F.lit(0)).alias("base"))
    inner = W.partitionBy("shard").orderBy("segment").rowsBetween(W.unboundedPreceding, -1)
    bases = sizes.withColumn("ahead", F.coalesce(F.sum("n_tokens").over(inner), F.lit(0))).join(shards, "shard").select("shard", "segment", (F.col("base") + F.col("ahead")).alias("base"))
    digests = files.transform(mapped(_read_segments, "doc_id long, shard long, segment long, inside long, n_tokens long, ids_crc32 long"))
    return digests.join(bases, ["shard", "segment"]).select("doc_id", (F.col("base") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")


def encode_documents(spark: SparkSession, docs: DataFrame, tokenizer: str) -> DataFrame:
    out = fresh_path(spark, "tokens")
    write_shards(docs, out, tokenizer)
    return read_digests(spark, out)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op5_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(spark, table(spark, sf_dir, "documents"), default_tokenizer())

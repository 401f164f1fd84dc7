"""Token ids in wavelet matrices: succinct bit-planes, many documents to a matrix.

Documents are dealt into shards by ranges of doc_id; a shard is one Parquet file (zstd) whose rows are
matrices of at most about `block` tokens: the bit-planes from the highest bit down, each with its number
of zeros and the ones before every 512th bit, and the documents' ids and token counts.  From a matrix
alone: the id at a place, the number of occurrences of an id in a range, and the place of its k-th
occurrence, in as many steps as an id has bits.  Files go through Spark's writers and readers, so any
store that Spark reaches can hold them.

Null text counts as empty (only the end id).  Rows that repeat a doc_id stand side by side, in text order.
An empty table gives an empty file set.  A document always lies in one matrix.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pulseloom.llm.byte_tokens import byte_tokens, crc32
from pulseloom.llm.tables import partitions
from pulseloom.llm.words import slices

BLOCK = 1 << 20
_EVERY = 512
_SCHEMA = "shard int, block int, n_tokens long, bits int, doc_ids array<long>, counts array<long>, planes array<binary>, zeros array<long>, ranks array<binary>"


@dataclass
class WaveletMatrix:
    n: int
    planes: list[np.ndarray]  # packed bits, first bit highest
    zeros: list[int]
    ranks: list[np.ndarray]  # ones before every 512th bit

    @classmethod
    def build(cls, ids: np.ndarray, bits: int) -> WaveletMatrix:
        planes, zeros, ranks, now = [], [], [], ids
        for level in range(bits - 1, -1, -1):
            one = (now >> now.dtype.type(level)) & now.dtype.type(1) != 0
            planes.append(np.packbits(one))
            sums = np.add.reduceat(one, np.arange(0, len(one), _EVERY), dtype=np.int64) if len(one) else np.zeros(0, np.int64)
            ranks.append(np.concatenate([[0], np.cumsum(sums)]).astype("<u4"))
            low = np.flatnonzero(~one)
            zeros.append(len(low))
            now = now.take(np.concatenate([low, np.flatnonzero(one)]))
        return cls(len(ids), planes, zeros, ranks)

    def decode(self, dtype=np.uint16) -> np.ndarray:
        """All ids at once, from the lowest plane up."""
        now = np.zeros(self.n, dtype)
        for level, (plane, zeros) in enumerate(zip(reversed(self.planes), reversed(self.zeros), strict=True)):
            one = np.unpackbits(plane, count=self.n).view(bool)
            out = np.empty_like(now)
            out[np.flatnonzero(~one)] = now[:zeros]
            out[np.flatnonzero(one)] = now[zeros:] | now.dtype.type(1 << level)
            now = out
        return now

    def _rank(self, level: int, at: int) -> int:
        """Ones before place `at` of a plane."""
        block = at // _EVERY
        low = block * _EVERY // 8
        bits = np.unpackbits(self.planes[level][low : (at + 7) // 8], count=at - block * _EVERY) if at > block * _EVERY else np.zeros(0, np.uint8)
        return int(self.ranks[level][block]) + int(bits.sum())

    def _bit(self, level: int, at: int) -> int:
        return int(self.planes[level][at >> 3]) >> (7 - (at & 7)) & 1

    def access(self, at: int) -> int:
        if not 0 <= at < self.n:
            raise IndexError(at)
        value = 0
        for level, zeros in enumerate(self.zeros):
            bit, ones = self._bit(level, at), self._rank(level, at)
            at = zeros + ones if bit else at - ones
            value = value << 1 | bit
        return value

    def _range(self, token: int, low: int, high: int) -> tuple[int, int]:
        for level, zeros in enumerate(self.zeros):
            a, b = self._rank(level, low), self._rank(level, high)
            if token >> (len(self.zeros) - 1 - level) & 1:
                low, high = zeros + a, zeros + b
            else:
                low, high = low - a, high - b
        return low, high

    def count(self, token: int, low: int = 0, high: int | None = None) -> int:
        if not 0 <= token < 1 << len(self.zeros):
            return 0
        a, b = self._range(token, low, self.n if high is None else high)
        return b - a

    def _select_bit(self, level: int, bit: int, k: int) -> int:
        """Place of the k-th (from 0) bit of this kind in a plane."""
        ranks = self.ranks[level].astype(np.int64)
        before = ranks if bit else np.minimum(np.arange(len(ranks)) * _EVERY, self.n) - ranks
        block = int(np.searchsorted(before, k, "right")) - 1
        low = block * _EVERY
        bits = np.unpackbits(self.planes[level][low // 8 : (low + _EVERY) // 8], count=min(_EVERY, self.n - low))
        return low + int(np.flatnonzero(bits == bit)[k - int(before[block])])

    def select(self, token: int, k: int) -> int:
        """Place of the k-th (from 0) occurrence of a token."""
        if not 0 <= token < 1 << len(self.zeros):
            raise IndexError(k)
        low, high = self._range(token, 0, self.n)
        if not 0 <= k < high - low:
            raise IndexError(k)
        at = low + k
        for level in range(len(self.zeros) - 1, -1, -1):
            if token >> (len(self.zeros) - 1 - level) & 1:
                at = self._select_bit(level, 1, at - self.zeros[level])
            else:
                at = self._select_bit(level, 0, at)
        return at

    def occurrences(self, token: int) -> list[int]:
        return [self.select(token, k) for k in range(self.count(token))]


def _row(shard: int, block: int, bits: int, docs: list[int], parts: list[np.ndarray]) -> pa.RecordBatch:
    m = WaveletMatrix.build(np.concatenate(parts), bits)
    planes, ranks = [p.tobytes() for p in m.planes], [r.tobytes() for r in m.ranks]
    return pa.RecordBatch.from_arrays(
        [pa.array([shard], pa.int32()), pa.array([block], pa.int32()), pa.array([m.n], pa.int64()), pa.array([bits], pa.int32()), pa.array([docs], pa.list_(pa.int64())), pa.array([[len(p) for p in parts]], pa.list_(pa.int64())), pa.array([planes], pa.list_(pa.binary())), pa.array([m.zeros], pa.list_(pa.int64())), pa.array([ranks], pa.list_(pa.binary()))],
        ["shard", "block", "n_tokens", "bits", "doc_ids", "counts", "planes", "zeros", "ranks"],
    )


def write_tokens(docs: DataFrame, vocab: str, path: str, end_id: int = 0, block: int = BLOCK) -> None:
    """Writes the ids of all documents, each followed by end_id, in ascending doc_id order of shards, rows and documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, shard = byte_tokens(vocab), TaskContext.get().partitionId()
        bits = max(own.bits, end_id.bit_length())
        end = np.array([end_id], own.dtype)
        held, parts, size, k = [], [], 0, 0
        for batch in batches:
            doc_ids, texts = batch.column(0).to_pylist(), batch.column(1)
            for low, high in slices(texts, 8 << 20):
                for doc, ids in zip(doc_ids[low:high], own.encode([t or "" for t in texts.slice(low, high - low).to_pylist()]), strict=True):
                    if size and size + len(ids) + 1 > block:
                        yield _row(shard, k, bits, held, parts)
                        held, parts, size, k = [], [], 0, k + 1
                    held.append(doc)
                    parts.append(np.append(ids, end))
                    size += len(ids) + 1
        if parts:
            yield _row(shard, k, bits, held, parts)

    dealt = docs.select(F.col("doc_id").cast("long"), "text").repartitionByRange(partitions(docs.sparkSession), "doc_id").sortWithinPartitions("doc_id", "text")
    dealt.mapInArrow(run, _SCHEMA).write.option("compression", "zstd").option("parquet.block.size", 32 << 20).parquet(path)


def matrices(batch: pa.RecordBatch) -> Iterator[tuple[int, int, list[int], list[int], WaveletMatrix]]:
    """(shard, block, doc ids, token counts, matrix) of rows read back."""
    for k in range(batch.num_rows):
        row = {name: batch.column(name)[k].as_py() for name in batch.schema.names}
        planes = [np.frombuffer(p, np.uint8) for p in row["planes"]]
        yield row["shard"], row["block"], row["doc_ids"], row["counts"], WaveletMatrix(row["n_tokens"], planes, row["zeros"], [np.frombuffer(r, "<u4") for r in row["ranks"]])


def first_tokens(files: DataFrame) -> DataFrame:
    """shard, block, first_token: ids in all matrices before."""
    sizes = files.select("shard", "block", "n_tokens")
    shards = sizes.groupBy("shard").agg(F.sum("n_tokens").alias("total"))
    # one row a shard; shards are as many as the writer had partitions
    shards = shards.select("shard", (F.sum("total").over(Window.orderBy("shard")) - F.col("total")).alias("before"))
    return sizes.join(shards, "shard").select("shard", "block", (F.col("before") + F.sum("n_tokens").over(Window.partitionBy("shard").orderBy("block")) - F.col("n_tokens")).alias("first_token"))


def token_digests(spark: SparkSession, path: str) -> DataFrame:
    """Per document, from the files alone: doc_id, start, n_tokens, ids_crc32."""

    def run(batches):
        for batch in batches:
            for shard, block, docs, counts, m in matrices(batch):
                ids = m.decode(np.uint16 if len(m.planes) <= 16 else np.uint32)
                ends = np.cumsum(counts)
                starts = ends - counts
                crc = [crc32(ids[a:b]) for a, b in zip(starts, ends, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([shard] * len(docs), pa.int32()), pa.array([block] * len(docs), pa.int32()), pa.array(docs, pa.int64()), pa.array(starts, pa.int64()), pa.array(counts, pa.int64()), pa.array(crc, pa.int64())], ["shard", "block", "doc_id", "inner", "n_tokens", "ids_crc32"])

    files = spark.read.schema(_SCHEMA).parquet(path)
    found = files.mapInArrow(run, "shard int, block int, doc_id long, inner long, n_tokens long, ids_crc32 long")
    return found.join(first_tokens(files), ["shard", "block"]).select("doc_id", (F.col("first_token") + F.col("inner")).alias("start"), "n_tokens", "ids_crc32")


def find_token(spark: SparkSession, path: str, token: int) -> DataFrame:
    """Every occurrence of a token: doc_id and the place in its document, by select on each matrix."""

    def run(batches):
        for batch in batches:
            for _, _, docs, counts, m in matrices(batch):
                at = np.array(m.occurrences(token), np.int64)
                ends = np.cumsum(counts)
                row = np.searchsorted(ends, at, "right")
                yield pa.RecordBatch.from_arrays([pa.array([docs[r] for r in row], pa.int64()), pa.array(at - (ends - counts)[row], pa.int64())], ["doc_id", "place"])

    return spark.read.schema(_SCHEMA).parquet(path).mapInArrow(run, "doc_id long, place long")

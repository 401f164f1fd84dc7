"""Packing of tokenised documents into sequences of at most `window` tokens.

Every document (ids, then the end id) is first cut into full windows, which are sequences of their own.
The remainders are packed best fit, decreasing: longest first, each into the open window with the least
room that still holds it; a segment tree over remaining room finds that window.  Full windows stay where they are;
remainders are dealt evenly, whatever their documents, to shards of about PIECES each at every size of the corpus and
in every session, and each shard is packed on its own by one task.  Only lengths and checksums travel, not ids.  A shard's
part-empty windows are few beside the many that its remainders fill.

Null text counts as empty and gives one piece with the end id.  Repeated rows are packed as often as they
come.  An empty table gives no pieces.  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulseloom.llm.byte_tokens import byte_tokens, crc32
from pulseloom.llm.tables import give_back, stored
from pulseloom.llm.words import slices

PIECES = 100_000  # remainders of a shard, about


class RoomTree:
    """Open windows by remaining room, under a segment tree whose nodes count the windows below."""

    def __init__(self, window: int):
        self.leaves = 1 << window.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.open: list[list[int]] = [[] for _ in range(window + 1)]

    def _add(self, room: int, by: int) -> None:
        node, count = room + self.leaves, self.count
        while node:
            count[node] += by
            node >>= 1

    def put(self, room: int, sequence: int) -> None:
        if room:
            self.open[room].append(sequence)
            self._add(room, 1)

    def tightest(self, length: int) -> tuple[int, int] | None:
        """Removes and returns (room, window) of the open window with the least room >= length."""
        count, node = self.count, length + self.leaves
        if not count[node]:
            while node > 1 and (node & 1 or not count[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node = 2 * node if count[2 * node] else 2 * node + 1
        room = node - self.leaves
        self._add(room, -1)
        return room, self.open[room].pop()


def best_fit(lengths: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(sequence, offset) of each length, and the number of sequences; lengths come longest first."""
    tree, sequence, offset, n = RoomTree(window), np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), 0
    for k, length in enumerate(lengths.tolist()):
        found = tree.tightest(length) if length < window else None
        room, place = found or (window, n)
        n += found is None
        sequence[k], offset[k] = place, window - room
        tree.put(room - length, place)
    return sequence, offset, n


def token_pieces(docs: DataFrame, vocab: str, window: int = 1024, end_id: int = 0) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens."""

    def run(batches):
        give_back()
        own = byte_tokens(vocab)
        for batch in batches:
            doc_ids, texts = batch.column(0), batch.column(1)
            for low, high in slices(texts, 4 << 20):
                row, start, length, crc, total = [], [], [], [], []
                for k, ids in enumerate(own.encode([t or "" for t in texts.slice(low, high - low).to_pylist()]), low):
                    ids = np.append(ids, np.array([end_id], ids.dtype))
                    for at in range(0, len(ids), window):
                        piece = ids[at : at + window]
                        row.append(k)
                        start.append(at)
                        length.append(len(piece))
                        crc.append(crc32(piece))
                        total.append(len(ids))
                yield pa.RecordBatch.from_arrays([doc_ids.take(pa.array(row, pa.int64())), *(pa.array(x, pa.int64()) for x in (start, length, crc, total))], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long")


def pack(pieces: DataFrame, window: int = 1024) -> DataFrame:
    """Adds sequence_id, offset and padded_to (the sequence's length with padding: window, or its own length at a power of two)."""
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    pieces = stored(pieces.select(*names), "pieces")
    short = pieces.where(F.col("length") < window)
    shards = max(1, -(-short.count() // PIECES))
    shard = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(shards)).cast("int")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        part = pa.Table.from_batches(held).sort_by([("length", "descending"), ("doc_id", "ascending"), ("start", "ascending"), ("ids_crc32", "ascending")])
        lengths = part.column("length").to_numpy()
        sequence, offset, n = best_fit(lengths, window)
        fill = np.bincount(sequence, lengths, n).astype(np.int64)
        padded = np.where(fill & (fill - 1), window, fill)
        shard = TaskContext.get().partitionId()
        part = part.append_column("sequence_id", pa.array(2 * (sequence * shards + shard))).append_column("offset", pa.array(offset)).append_column("padded_to", pa.array(padded[sequence]))
        yield from part.to_batches(max_chunksize=10_000)

    kind = pieces.schema["doc_id"].dataType.simpleString()
    packed = short.repartitionById(shards, shard).mapInArrow(run, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, padded_to long")
    # odd numbers for windows that are full as they come
    full = pieces.where(F.col("length") >= window).select(*names, (2 * F.monotonically_increasing_id() + 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"), F.lit(window).cast("long").alias("padded_to"))
    return packed.unionByName(full)


def pack_documents(docs: DataFrame, vocab: str, window: int = 1024, end_id: int = 0) -> DataFrame:
    return pack(token_pieces(docs, vocab, window, end_id), window)

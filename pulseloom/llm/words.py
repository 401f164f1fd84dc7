"""Word splitting and word digests over Arrow text batches, vectorised with numpy.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D.  Every distinct word of a batch gets a number
(exact within the batch) and, where words of several batches must meet, a keyed 128-bit digest (BLAKE2b), which
no arithmetic on its letters can make equal to another's.  Texts are handled whole; the work arrays cover a few
MB of bytes at a time, however long a text is.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute

STEP = 1 << 20
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_PERSON = b"words of texts"


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose output bits all depend on all input bits."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def digests(values: list[bytes], salt: bytes = b"") -> np.ndarray:
    """A row of two 64-bit halves of the keyed digest for each value."""
    return np.frombuffer(b"".join([blake2b(v, digest_size=16, person=_PERSON, salt=salt).digest() for v in values]), np.uint64).reshape(-1, 2)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column, and each text's bounds in them (nulls: empty)."""
    column = column.fill_null("")
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    data = column.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


@dataclass
class Words:
    """Words of a batch: those of text i are first[i] .. first[i + 1]; equal words have equal codes."""

    first: np.ndarray
    start: np.ndarray
    length: np.ndarray
    pieces: list[pa.Array]  # the words themselves

    @cached_property
    def _numbered(self) -> tuple[np.ndarray, pa.Array]:
        if not self.pieces:
            return np.zeros(0, np.int64), pa.array([], pa.large_binary())
        numbered = pa.chunked_array(self.pieces).dictionary_encode().unify_dictionaries()
        return np.concatenate([np.asarray(c.indices) for c in numbered.chunks]).astype(np.int64), numbered.chunk(0).dictionary

    @property
    def codes(self) -> np.ndarray:
        return self._numbered[0]

    @property
    def vocabulary(self) -> pa.Array:
        """The word of each code."""
        return self._numbered[1]

    @cached_property
    def named(self) -> np.ndarray:
        """The digest of each code, as two halves."""
        return digests(self.distinct())

    def distinct(self) -> list[bytes]:
        """The word of each code, as Python has it."""
        return _strings(self.vocabulary)

    @property
    def hashes(self) -> np.ndarray:
        """The first half of every word's digest."""
        return self.named[:, 0][self.codes]

    def heads(self, k: int) -> np.ndarray:
        """For every word, a hash of its first k bytes; 0 where it has no more than those."""
        if not self.pieces:
            return np.zeros(0, np.uint64)
        longer = np.asarray(pa.compute.greater(pa.compute.binary_length(self.vocabulary), k))
        head = pa.compute.binary_slice(self.vocabulary, 0, k).dictionary_encode()  # far fewer than words
        named = digests(_strings(head.dictionary))[:, 0] | np.uint64(1)
        return np.where(longer, named[np.asarray(head.indices)], np.uint64(0))[self.codes]


def _strings(words: pa.Array) -> list[bytes]:
    raw, bounds = text_bytes(words.view(pa.large_string()) if len(words) else pa.array([], pa.large_string()))
    raw, bounds = raw.tobytes(), bounds.tolist()
    return [raw[a:b] for a, b in zip(bounds, bounds[1:], strict=False)]


def _piece(data: np.ndarray, at: int, cuts: np.ndarray, lower: bool, between: np.ndarray) -> tuple[np.ndarray, ...]:
    raw = _LOWER[data] if lower else data
    solid = ~between[raw]
    before = np.empty(len(raw) + 1, bool)
    before[0], before[1:] = False, solid
    breaks = np.zeros(len(raw) + 1, bool)
    breaks[cuts] = True
    start = np.flatnonzero(solid & (~before[:-1] | breaks[:-1]))
    after = np.empty(len(raw), bool)
    after[-1], after[:-1] = False, solid[1:]
    end = np.flatnonzero(solid & (~after | breaks[1:])) + 1
    offsets = np.concatenate([[0], np.cumsum(end - start)])
    words = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(raw[solid])])
    return start + at, end - start, words


def split_words(column: pa.Array, lower: bool = False, between: np.ndarray = _SPACE) -> Words:
    """between: the bytes that part words, as 256 booleans; white space always belongs to them."""
    data, bounds = text_bytes(column)
    parts, at = [], 0
    while at < len(data):
        stop = min(at + STEP, len(data))
        if stop < len(data) and bounds[np.searchsorted(bounds, stop)] != stop:
            # back to a text's start or a space, or on to the next if one word fills the step
            inner = bounds[np.searchsorted(bounds, stop) - 1]
            if inner > at:
                stop = int(inner)
            else:
                spaces = np.flatnonzero(_SPACE[data[at:stop]])
                if len(spaces):
                    stop = at + int(spaces[-1]) + 1
                else:
                    limit = int(bounds[np.searchsorted(bounds, stop)])
                    while stop < limit:
                        more = np.flatnonzero(_SPACE[data[stop : min(stop + STEP, limit)]])
                        if len(more):
                            stop += int(more[0]) + 1
                            break
                        stop = min(stop + STEP, limit)
        low, high = np.searchsorted(bounds, at), np.searchsorted(bounds, stop, "right")
        parts.append(_piece(data[at:stop], at, bounds[low:high] - at, lower, between))
        at = stop
    start, length = (np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, np.int64) for k in range(2))
    return Words(np.searchsorted(start, bounds), start, length, [p[2] for p in parts])


def slices(column: pa.Array, step: int = 4 * STEP):
    """(low, high) row ranges of about step bytes, one row at least."""
    column = column.fill_null("")
    size = np.cumsum(np.asarray(pa.compute.binary_length(column), dtype=np.int64)) if len(column) else np.zeros(0, np.int64)
    low = 0
    while low < len(column):
        done = int(size[low - 1]) if low else 0
        high = max(low + 1, int(np.searchsorted(size, done + step, "right")))
        yield low, high
        low = high

"""Ids of a byte-level BPE vocabulary file of the tokenizers library, for batches of whole texts.

A space between two characters that are not white space always starts a new pre-token in this family
of vocabularies, so in a text whose spaces are all of that kind the words between them can be encoded apart.
Words recur, so each distinct word of a batch is looked up once; each Python worker keeps the ids of words
met (a bounded number; later ones are encoded again in each batch, with the same ids), and the library
encodes the others many at a time.  Texts with other spaces go to the library whole.
"""

from __future__ import annotations

import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute

LOT = 1 << 18  # characters, about, that the library encodes at a time
_GAP = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]"
_UNSAFE = rf"\A | \z|{_GAP} | {_GAP}"  # a space at an end of the text or beside other white space


class ByteTokens:
    """Encoder for one vocabulary file.  kept: how many words it remembers at most."""

    def __init__(self, path: str, kept: int = 1_000_000):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.size = self.library.get_vocab_size()
        self.dtype = np.dtype("<u2") if self.size <= 1 << 16 else np.dtype("<u4")
        self.bits = max(1, (self.size - 1).bit_length())
        self.opens = np.zeros(self.size, bool)
        for token, i in self.library.get_vocab().items():
            self.opens[i] = token.startswith("Ġ")
        self.kept = kept
        self.words = pa.array([], pa.large_string())  # words met, and their ids one after the other
        self.pool, self.bounds = np.zeros(0, self.dtype), np.zeros(1, np.int64)

    def _library(self, texts: list[str]) -> list[np.ndarray]:
        out, low, held = [], 0, 0
        for k, text in enumerate(texts, 1):
            held += len(text)
            if held >= LOT or k == len(texts):  # the library's results hold far more than ids
                out += [np.array(e.ids, self.dtype) for e in self.library.encode_batch_fast(texts[low:k], add_special_tokens=False)]
                low, held = k, 0
        return out

    def _unknown(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a space and each word, one after the other, and their bounds; the words hold no space."""
        groups = [words[k : k + 64] for k in range(0, len(words), 64)]
        parts, sizes = [], []
        for group, ids in zip(groups, self._library(["".join(map(" ".__add__, g)) for g in groups]), strict=True):
            at = np.append(np.flatnonzero(self.opens[ids]), len(ids))
            if len(at) == len(group) + 1:
                parts.append(ids)
                sizes.append(np.diff(at))
            else:
                apart = self._library([f" {g}" for g in group])
                parts += apart
                sizes.append(np.array([len(i) for i in apart]))
        ids = np.concatenate(parts) if parts else np.zeros(0, self.dtype)
        return ids, np.concatenate([[0], np.cumsum(np.concatenate(sizes))]).astype(np.int64) if sizes else np.zeros(1, np.int64)

    def _apart(self, texts: list[str]) -> list[np.ndarray]:
        """Texts whose spaces all stand alone, as words."""
        split = pa.compute.split_pattern(pa.array(texts, pa.large_string()), " ")
        coded = split.flatten().dictionary_encode()
        words, code, bounds = coded.dictionary, coded.indices.to_numpy().astype(np.int64), split.offsets.to_numpy().astype(np.int64)
        known = pa.compute.index_in(words, value_set=self.words)
        new = words.filter(known.is_null())
        fresh, ends = self._unknown(new.to_pylist())
        heads = words.take(pa.array(code[bounds[:-1]])).dictionary_encode()  # these have no space before them
        alone = self._library(heads.dictionary.to_pylist())
        # all ids there are: of words met, of new ones, and of first words
        pool = np.concatenate([self.pool, fresh, *alone])
        place = np.asarray(known.fill_null(-1), np.int64)
        start, size = self.bounds[place], np.diff(self.bounds, append=0)[place]
        missing = np.flatnonzero(place < 0)
        start[missing], size[missing] = len(self.pool) + ends[:-1], np.diff(ends)
        first = np.array([len(i) for i in alone], np.int64)
        at = np.asarray(heads.indices, np.int64)
        start = np.concatenate([start, (len(self.pool) + len(fresh) + np.cumsum(first) - first)[at]])
        size = np.concatenate([size, first[at]])
        code[bounds[:-1]] = len(words) + np.arange(len(texts))
        if len(self.words) < self.kept and len(new):
            self.words, self.bounds = pa.concat_arrays([self.words, new]), np.concatenate([self.bounds, len(self.pool) + ends[1:]])
            self.pool = np.concatenate([self.pool, fresh])
        n = size[code]
        total = np.cumsum(n)
        ids = pool[np.repeat(start[code] - (total - n), n) + np.arange(total[-1])]
        cuts = np.concatenate([[0], total])[bounds]
        return [ids[x:y] for x, y in zip(cuts, cuts[1:], strict=False)]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text, as the library gives them without special tokens."""
        whole = np.flatnonzero(pa.compute.match_substring_regex(pa.array(texts, pa.large_string()), _UNSAFE)).tolist()
        if not whole:
            return self._apart(texts) if texts else []
        rest = sorted(set(range(len(texts))) - set(whole))
        out = dict(zip(whole, self._library([texts[k] for k in whole]), strict=True)) | dict(zip(rest, self._apart([texts[k] for k in rest]) if rest else [], strict=True))
        return [out[k] for k in range(len(texts))]


@lru_cache(maxsize=4)
def byte_tokens(path: str) -> ByteTokens:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallel units
    return ByteTokens(path)


def crc32(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())

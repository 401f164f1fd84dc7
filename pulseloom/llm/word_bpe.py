"""Encoding and decoding with a word-level BPE vocabulary: speculate, verify, and merge only what fails.

Texts are normalised and cut into words as the vocabulary file says.  For all distinct words of a lot at once, the
longest vocabulary entry at every place is looked up and followed from each word's start (the speculation).  Every
adjacent pair of proposed tokens is then tested, again all at once: a pair stands if no merge across its border would
have come before one of the merges that made the two tokens.  A word whose pairs all stand is what the merges would
have given; only the words with a pair that fails are merged step by step.

Null texts count as empty; an empty text has no ids.  Texts are never cut short; long ones are worked through
from white space to white space.  Repeated rows are encoded alike, each as a row of its own; an empty table gives an
empty result; columns other than id and text are ignored, whatever their names.  The names of special tokens within a
text are these tokens, as in the library.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from pulseloom.llm.tables import give_back
from pulseloom.llm.words import slices

LOT = 1 << 20  # bytes of text, about, that are worked on at a time
SHORT = 64  # symbols of words that are merged together
NEVER = np.int64(1 << 40)  # the rank of pairs that don't merge
#: The bytes that byte-level vocabularies write as the character of the same number; others follow from 256 on.
SHOWN = [(33, 126), (161, 172), (174, 255)]
#: The settings that this codec follows.
CONTRACTIONS = "'s|'t|'re|'ve|'m|'ll|'d"
NORMAL = ["NFC", "Replace", "Lowercase"]
SPLIT = CONTRACTIONS + r"|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Characters for which Python's tables are known to say what the library's say; no text of these alone changes under NFC.
PLAIN = "\x00-ǿ‐-‧‰-⁞€"


def _byte_characters() -> list[str]:
    shown = {b for low, high in SHOWN for b in range(low, high + 1)}
    rest = iter(range(256, 512))
    return [chr(b if b in shown else next(rest)) for b in range(256)]


class Merges:
    """Merge rules as arrays over token ids; rank is the merge that makes a token, -1 for single bytes."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], suffix: str):
        self.size = max(vocab.values()) + 1
        self.left, self.right = np.full(self.size, -1, np.int64), np.full(self.size, -1, np.int64)
        self.rank = np.full(self.size, -1, np.int64)
        for k, (a, b) in enumerate(merges):
            t, x, y = vocab[a + b], vocab[a], vocab[b]
            if self.rank[t] >= 0 or max(self.rank[x], self.rank[y]) >= k:
                raise ValueError("a token has two merges, or one before its parts")
            self.left[t], self.right[t], self.rank[t] = x, y, k
        characters = _byte_characters()
        if missing := [b for b, c in enumerate(characters) if c not in vocab or c + suffix not in vocab]:
            raise ValueError(f"bytes {missing} have no token")
        self.base = np.array([vocab[c + end] for end in ("", suffix) for c in characters])  # by symbol: a byte, + 256 for a word's last
        made = np.flatnonzero(self.rank >= 0)
        key = self.left[made] * self.size + self.right[made]
        order = np.argsort(key)
        self.keys, self.made = key[order], made[order]
        self.table = {int(k): int(t) for k, t in zip(self.keys, self.made, strict=True)}
        self.order = np.append(self.rank, NEVER)  # so that the merge -1, none, never comes
        self._spell(made)

    def _spell(self, made: np.ndarray) -> None:
        """The trie of all tokens that stand alone: those whose own bytes merge to them."""
        spelled: dict[int, tuple[int, ...]] = {int(t): (s,) for s, t in enumerate(self.base)}
        alone = np.ones(self.size, bool)
        stands = self.compatible(self.left[made], self.right[made], 2 * self.rank[made])
        edges: dict[tuple[int, int], int] = {}
        self.token = [-1]  # by node
        stood = dict(zip(made.tolist(), stands.tolist(), strict=True))
        for t in self.base.tolist() + made[np.argsort(self.rank[made])].tolist():
            if t in stood:
                x, y = int(self.left[t]), int(self.right[t])
                spelled[t] = spelled[x] + spelled[y]
                alone[t] = stood[t] and alone[x] and alone[y]
            if alone[t]:
                node = 0
                for s in spelled[t]:
                    if (node, s) not in edges:
                        edges[node, s] = len(self.token)
                        self.token.append(-1)
                    node = edges[node, s]
                self.token[node] = t
        self.token = np.array(self.token)
        key = np.array([n * 512 + s for n, s in edges], np.int64)
        order = np.argsort(key)
        self.steps, self.nodes = key[order], np.array(list(edges.values()))[order]

    def together(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """The token that each pair merges to, -1 for none."""
        key = x * self.size + y
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.made[at], -1)

    def compatible(self, x: np.ndarray, y: np.ndarray, before: np.ndarray | None = None) -> np.ndarray:
        """Whether merging keeps the border of x and y, as tokens side by side.

        Going back in time, the younger of the two is taken apart at the border.  While a piece lay there, a merge
        across the border would have happened if it ranks before the merge that took the piece up; with equal ranks
        the left one happens first.  before: twice the rank before which borders must hold, for a border within a token.
        """
        out, at = np.ones(len(x), bool), np.arange(len(x))
        end = np.full(len(x), 2 * NEVER) if before is None else before
        while len(at):
            fails = 2 * self.order[self.together(x, y)] < end
            out[at[fails]] = False
            rx, ry = self.rank[x], self.rank[y]
            on = ~fails & (np.maximum(rx, ry) >= 0)
            x, y, rx, ry, at = x[on], y[on], rx[on], ry[on], at[on]
            lefts = rx > ry
            end = np.where(lefts, 2 * rx, 2 * ry + 1)
            x, y = np.where(lefts, self.right[x], x), np.where(lefts, y, self.left[y])
        return out

    def propose(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of greedy longest matches of all words (none empty), and each word's bounds in them."""
        symbols, bounds = self._symbols(words)
        n = len(symbols)
        symbols = np.append(symbols, 511)
        best, after = self.base[symbols[:-1]], np.arange(1, n + 1)
        at, node, depth = np.arange(n), np.zeros(n, np.int64), 0
        while len(at):
            key = node * 512 + symbols[np.minimum(at + depth, n)]
            place = np.minimum(np.searchsorted(self.steps, key), len(self.steps) - 1)
            on = (self.steps[place] == key) & (at + depth < n)
            at, node, depth = at[on], self.nodes[place[on]], depth + 1
            found = self.token[node]
            have = found >= 0
            best[at[have]], after[at[have]] = found[have], at[have] + depth
        # places that the walk from each word's start comes to, by doubling strides
        begins = np.zeros(n + 1, bool)
        begins[bounds[:-1]] = True
        stride, reach = np.append(after, n), 1
        while reach <= np.diff(bounds).max():
            begins[stride[np.flatnonzero(begins)]] = True
            stride, reach = stride[stride], 2 * reach
        starts = np.flatnonzero(begins[:n])
        return best[starts], np.searchsorted(starts, bounds)

    def _symbols(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all words as symbols, and each word's bounds in them."""
        bounds = np.concatenate([[0], np.cumsum([len(w) for w in words])]).astype(np.int64)
        symbols = np.frombuffer(b"".join(words), np.uint8).astype(np.int64)
        symbols[bounds[1:] - 1] += 256
        return symbols, bounds

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of all words by merging step by step, and each word's bounds in them.

        Short words take their steps together: a step makes the merge of lowest rank that each word has, from left to
        right.  Long ones, which take many steps, go one by one.
        """
        symbols, bounds = self._symbols(words)
        ids, owner = self.base[symbols], np.repeat(np.arange(len(words)), np.diff(bounds))
        short = np.diff(bounds) <= SHORT
        parts, owners = [], []
        for k in np.flatnonzero(~short).tolist():
            parts.append(np.array(self.merge_one(words[k]), np.int64))
            owners.append(np.full(len(parts[-1]), k))
        ids, owner = ids[short[owner]], owner[short[owner]]
        while len(ids):
            first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            whole = np.append(self.together(ids[:-1], ids[1:]), -1)
            whole[first[1:] - 1] = -1
            rank = self.order[whole]
            low = np.minimum.reduceat(rank, first)
            low = np.repeat(low, np.diff(np.append(first, len(ids))))
            over = low == NEVER
            parts.append(ids[over])
            owners.append(owner[over])
            at = np.flatnonzero((rank == low) & ~over)
            begins = np.append(True, np.diff(at) != 1)  # of runs, in which every other pair is free
            run = np.flatnonzero(begins)[np.cumsum(begins) - 1] if len(at) else at
            at = at[(np.arange(len(at)) - run) % 2 == 0]
            ids[at] = whole[at]
            gone = over
            gone[at + 1] = True
            ids, owner = ids[~gone], owner[~gone]
        ids, owner = (np.concatenate([x, np.zeros(0, np.int64)]) if not p else np.concatenate(p) for x, p in ((ids, parts), (owner, owners)))
        order = np.argsort(owner, kind="stable")
        return ids[order], np.searchsorted(owner[order], np.arange(len(words) + 1))

    def merge_one(self, word: bytes) -> list[int]:
        """One word merged step by step: the lowest rank first, from left to right."""
        ids = self.base[np.frombuffer(word, np.uint8)].tolist()
        ids[-1] = int(self.base[256 + word[-1]])
        n = len(ids)
        before, behind = list(range(-1, n - 1)), list(range(1, n + 1))
        due: list[tuple[int, int, int, int]] = []

        def look(i: int) -> None:
            j = behind[i]
            if j < n and (t := self.table.get(ids[i] * self.size + ids[j])) is not None:
                heapq.heappush(due, (int(self.rank[t]), i, j, t))

        for i in range(n - 1):
            look(i)
        while due:
            _, i, j, t = heapq.heappop(due)
            if ids[i] != self.left[t] or behind[i] != j or ids[j] != self.right[t]:
                continue  # one of the two is gone
            ids[i], ids[j] = t, -1
            behind[i] = behind[j]
            if behind[i] < n:
                before[behind[i]] = i
            look(i)
            if before[i] >= 0:
                look(before[i])
        return [t for t in ids if t >= 0]


def _gather(pool: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """pool[start : start + size] of all, one after the other."""
    total = np.cumsum(size)
    return pool[np.repeat(start - (total - size), size) + np.arange(total[-1] if len(total) else 0)]


class _Numbered(dict):
    """Words numbered in the order in which they are met."""

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


class WordCodec:
    """Encoder and decoder for one vocabulary file.  kept: how many words it remembers at most; changes no result."""

    def __init__(self, path: str, kept: int = 300_000):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, normal, cut = spec["model"], spec["normalizer"], spec["pre_tokenizer"]["pretokenizers"]
        odd = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges") if model.get(k)]
        if odd or [x["type"] for x in normal["normalizers"]] != NORMAL or cut[0]["pattern"].get("Regex") != SPLIT or not cut[0]["invert"] or cut[1]["add_prefix_space"] or spec["decoder"] or spec["post_processor"]:
            raise ValueError(f"{path} has settings that this codec doesn't follow {odd}")
        if any(x["normalized"] or x["lstrip"] or x["rstrip"] or x["single_word"] for x in spec["added_tokens"]):
            raise ValueError(f"{path} has special tokens that take more than their own characters")
        self.library = Tokenizer.from_file(path)
        self.merges = Merges(model["vocab"], [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]], model.get("end_of_word_suffix") or "")
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        names = {i: t for t, i in (model["vocab"] | self.special).items()}
        self.names = [names[i].encode() if i in names else None for i in range(max(names) + 1)]
        self.decimals = [b"%d" % i for i in range(len(self.names))]
        self.dtype = np.dtype("<u2") if len(self.names) <= 1 << 16 else np.dtype("<u4")
        kinds: dict[str, list[str]] = {"L": [], "N": []}
        for c in map(chr, range(0x2500)):
            kinds.setdefault(unicodedata.category(c)[0], []).append(re.escape(c))
        letters, numbers = "".join(kinds["L"]), "".join(kinds["N"])
        white = r"\t-\r \x85\xa0"
        self.find = re.compile(f"{CONTRACTIONS}|[{letters}]+|[{numbers}]|[^{white}{letters}{numbers}]+").findall
        self.odd = re.compile(f"[^{PLAIN}]").search
        self.gap = re.compile(f"[{white}]").search
        self.specials = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.bytes_of = {c: b for b, c in enumerate(_byte_characters())}
        self.kept = kept
        self._forget()

    def _forget(self) -> None:
        self.index = _Numbered()
        for word in self.special:
            self.index[word]
        self.pool, self.bounds, self.failed = np.array(list(self.special.values()), self.dtype), np.arange(len(self.special) + 1), np.zeros(len(self.special), bool)

    def _stretches(self, text: str) -> Iterator[str]:
        """The text in parts of at most about LOT characters, cut before white space."""
        at = 0
        while len(text) - at > LOT and (gap := self.gap(text, at + LOT)):
            yield text[at : gap.start()]
            at = gap.start()
        yield text[at:]

    def words(self, text: str) -> Iterator[list[str]]:
        """The words of a text, normalised, in lots; a special token is a word of its own."""
        for part in self.specials.split(text) if self.specials else [text]:
            if part in self.special:
                yield [part]
                continue
            for stretch in self._stretches(part):
                if stretch.isascii() or not self.odd(stretch):
                    yield self.find(stretch.lower())
                else:  # the library's own tables
                    found = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(stretch))
                    yield [bytes(map(self.bytes_of.__getitem__, w)).decode() for w, _ in found]

    def _learn(self, words: list[str]) -> None:
        """Ids of words not met before, in the order of their numbers."""
        raw = [w.encode() for w in words]
        tokens, bounds = self.merges.propose(raw)
        inner = np.ones(len(tokens), bool)
        inner[bounds[:-1]] = False  # the first of a word pairs with none before it
        right = np.flatnonzero(inner)
        pairs, which = np.unique(tokens[right - 1] * self.merges.size + tokens[right], return_inverse=True)
        stands = self.merges.compatible(pairs // self.merges.size, pairs % self.merges.size)[which]
        wrong = np.unique(np.searchsorted(bounds, right[~stands], "right") - 1)
        exact, ends = self.merges.merge([raw[k] for k in wrong.tolist()])
        start, size = bounds[:-1].copy(), np.diff(bounds)
        start[wrong], size[wrong] = len(tokens) + ends[:-1], np.diff(ends)
        self.pool = np.concatenate([self.pool, _gather(np.concatenate([tokens, exact]), start, size).astype(self.dtype)])
        self.bounds = np.concatenate([self.bounds, self.bounds[-1] + np.cumsum(size)])
        failed = np.zeros(len(words), bool)
        failed[wrong] = True
        self.failed = np.concatenate([self.failed, failed])

    def _lot(self, words: list[str], counts: list[int]) -> Iterator[tuple[np.ndarray, int]]:
        """Ids, and the number of words that were merged, for each of the stretches of so many words."""
        if len(self.index) > self.kept:
            self._forget()
        known = len(self.index)
        numbers = np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))
        if (new := len(self.index) - known) > 0:
            self._learn(list(islice(reversed(self.index), new))[::-1])
        size = np.diff(self.bounds)[numbers]
        ids, ends = _gather(self.pool, self.bounds[numbers], size), np.concatenate([[0], np.cumsum(size)])
        failed, stops = np.concatenate([[0], np.cumsum(self.failed[numbers])]), np.cumsum(counts)
        for low, high in zip([0, *stops[:-1].tolist()], stops.tolist(), strict=True):
            yield ids[ends[low] : ends[high]], int(failed[high] - failed[low])

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, int, int]]:
        """Per text: ids, the number of words, and how many of these the speculation got wrong."""
        found = [[np.zeros(0, self.dtype)] for _ in texts]
        n_words, n_wrong = [0] * len(texts), [0] * len(texts)
        words, stretches = [], []

        def settle() -> None:
            for (k, n), (ids, wrong) in zip(stretches, self._lot(words, [n for _, n in stretches]), strict=True):
                found[k].append(ids)
                n_words[k] += n
                n_wrong[k] += wrong
            words.clear()
            stretches.clear()

        for k, text in enumerate(texts):
            for some in self.words(text):
                words += some
                stretches.append((k, len(some)))
                if len(words) >= LOT // 4:
                    settle()
        if stretches:
            settle()
        return [(np.concatenate(f), n, w) for f, n, w in zip(found, n_words, n_wrong, strict=True)]

    def decode(self, ids: list[int]) -> bytes:
        """The tokens' names with a space between, as the library joins them where a file names no decoder; unknown ids count for nothing."""
        n = len(self.names)
        return b" ".join([name for i in ids if 0 <= i < n and (name := self.names[i]) is not None])


@lru_cache(maxsize=4)
def codec(path: str) -> WordCodec:
    return WordCodec(path)


def _texts(batches, column: str) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    give_back()
    for batch in batches:
        for low, high in slices(batch.column(column), LOT):
            part = batch.slice(low, high - low)
            yield part, [t or "" for t in part.column(column).to_pylist()]


def encode_words(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, ids array<int>, n_words, and n_merged, the words that had to be merged step by step."""

    def run(batches):
        for part, texts in _texts(batches, text_col):
            ids, n_words, n_merged = zip(*codec(path).encode(texts), strict=True)
            yield pa.RecordBatch.from_arrays([part.column(id_col), pa.array([i.astype(np.int32) for i in ids], pa.list_(pa.int32())), pa.array(n_words, pa.int64()), pa.array(n_merged, pa.int64())], [id_col, "ids", "n_words", "n_merged"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"{id_col} {kind}, ids array<int>, n_words long, n_merged long")


def decode_words(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Per row: id and the decoded text (null ids: empty)."""

    def run(batches):
        for batch in batches:
            texts = [codec(path).decode([i for i in ids or [] if i is not None]).decode() for ids in batch.column(ids_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(id_col), pa.array(texts, pa.string())], [id_col, "text"])

    return encoded.select(id_col, ids_col).mapInArrow(run, f"{id_col} {encoded.schema[id_col].dataType.simpleString()}, text string")


def word_digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes and decodes in one pass and keeps counts and digests."""

    def run(batches):
        for part, texts in _texts(batches, text_col):
            own, out = codec(path), []
            for found, n_words, n_merged in own.encode(texts):
                ids = found.tolist()
                decimals = b" ".join(map(own.decimals.__getitem__, ids))
                out.append((len(ids), hashlib.sha256(decimals).hexdigest(), hashlib.sha256(own.decode(ids)).hexdigest(), n_words, n_merged))
            n, digest, decoded, n_words, n_merged = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([part.column(id_col), pa.array(n, pa.int64()), pa.array(digest), pa.array(decoded), pa.array(n_words, pa.int64()), pa.array(n_merged, pa.int64())], [id_col, "n_tokens", "ids_sha256", "decoded_sha256", "n_words", "n_merged"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"{id_col} {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string, n_words long, n_merged long")

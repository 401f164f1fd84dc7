"""Removal of repeated passages, found by recompression.

A window is `width` consecutive words of one document.  A word goes if any window over it has a word
sequence that also starts earlier (smaller doc_id, or earlier in the same document), judged on the input.

Recompression gives equal word sequences equal symbols inside.  A first round names runs of one word; each
further round splits all symbols into a left and a right class by a bit of their name and names every
adjacent left-right pair, so symbols grow by a third a round.  Names are 128-bit digests of what they stand
for, so they agree across the whole corpus without a dictionary.  What a round does inside a passage depends on
the passage alone: its first run and its last, which may go on outside, and in each round a first symbol of the
right class and a last one of the left, which may pair with what is outside, are popped off; the rest is the
same wherever the passage stands.  A window's name is that of its pops and of what is left of it after ROUNDS.

1. Documents are dealt into slices of about SLICE bytes by a hash of doc_id.  Each slice sends, in packed
   buckets, every distinct symbol of round FILTER, and the high symbols of the rounds REVEAL that span a window
   or more, with their places.  A bucket tells which slices hold a symbol that occurs twice, and where a high
   symbol stands first: all windows inside its later places are repeats, and need no more messages.
2. Each slice sends every other distinct window that can repeat, that is one whose inner symbols of round FILTER
   all occur twice; the bucket keeps the earliest of each and tells the others where that is.
3. Each slice joins what it was told to ranges, and sends the words of each range to where they are said to
   stand earlier; there they are compared word by word.  Repeats within a slice are compared in place.  Should
   words differ under one name, the job fails and asks for another `salt`; it never removes the wrong words.
4. Each slice takes out the words that confirmed windows cover.

A passage, word or document that recurs sends one entry from a slice however often it stands there, so no
bucket grows with a hot value by more than the number of slices.  Slices and buckets hold about the same bytes at
every size of the corpus, and messages are never more than symbols.  The steps are one plan and read one shuffle
of the texts.  Nothing is sampled or cut.

doc_id must be an integer column.  Null texts have no words.  Texts with fewer words than the window lose nothing.
Rows that repeat a doc_id count as standing one after the other, in text order; rows without doc_id come first.
An empty table gives an empty result.  All other columns are carried along; those named slice, n_words, n_removed
or kept_text are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulseloom.llm.tables import give_back, partitions
from pulseloom.llm.words import digests, mix, split_words, text_bytes

FILTER, ROUNDS, REVEAL = 4, 6, (10, 14)  # symbols of about 3, 5, 17 and 50 words
SLICE, BUCKET = 4 << 20, 16 << 20  # bytes of text for each
_A, _B, _C = np.uint64(0x9FB21C651E98DF25), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xA24BAED4963EE407)
_LOW = np.uint64(0xFFFFFFFF)
_HIGH = np.dtype([("one", "<u8"), ("two", "<u8"), ("doc", "<i8"), ("at", "<i8")])
_FACT = ("place", "length", "source", "at")  # words [place, place + length) also stand earlier, in slice `source` from `at` (-1: confirmed)


def _packed(values: np.ndarray, kind: str = "<u4") -> bytes:
    """Integers as compressed differences."""
    return pa.compress(np.diff(values.astype(kind), prepend=np.zeros(1, kind)).tobytes(), codec="zstd", asbytes=True) + len(values).to_bytes(8, "little")


def _unpacked(raw: bytes, kind: str = "<u4") -> np.ndarray:
    n = int.from_bytes(raw[-8:], "little")
    size = n * np.dtype(kind).itemsize
    return np.cumsum(np.frombuffer(pa.decompress(raw[:-8], size, codec="zstd", asbytes=True), kind), dtype=kind) if n else np.zeros(0, kind)


def _facts(*columns: np.ndarray) -> bytes:
    """Columns of integers as compressed differences, in one piece: there are many messages, most of them short."""
    values = np.stack([np.asarray(c, "<i8") for c in columns])
    raw = np.diff(values, prepend=np.zeros((len(values), 1), "<i8")).tobytes()
    return pa.compress(raw, codec="zstd", asbytes=True) + values.shape[1].to_bytes(8, "little")


def _read_facts(raw: bytes) -> np.ndarray:
    """An array of four rows, as _FACT."""
    n = int.from_bytes(raw[-8:], "little")
    values = np.frombuffer(pa.decompress(raw[:-8], 8 * n * len(_FACT), codec="zstd", asbytes=True) if n else b"", "<i8")
    return np.cumsum(values.reshape(len(_FACT), n), axis=1)


def _fold(one: np.ndarray, two: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Digests of what `one` and `two` stand for, followed by what x and y stand for."""
    return mix(one * _A + mix(x ^ _C)), mix(two * _B + mix(y ^ _A))


class Level:
    """Symbols of a round: their names (two halves), class, first run, and the symbol of the next round that holds each."""

    def __init__(self, one: np.ndarray, two: np.ndarray, doc: np.ndarray, at: np.ndarray, k: int):
        self.one, self.two, self.at, self.doc, self.k = one, two, at, doc, k
        self.left = one & np.uint64(1 << k) == 0

    def following(self) -> Level:
        pair = np.zeros(len(self.one), bool)
        pair[:-1] = self.left[:-1] & ~self.left[1:] & (self.doc[:-1] == self.doc[1:])
        stay = np.ones(len(self.one), bool)
        stay[1:] = ~pair[:-1]
        self.to = np.concatenate([np.cumsum(stay) - 1, [stay.sum()]])
        one, two, head = self.one.copy(), self.two.copy(), np.flatnonzero(pair)
        one[head], two[head] = _fold(one[head], two[head], one[head + 1], two[head + 1])
        return Level(one[stay], two[stay], self.doc[stay], self.at[stay], self.k + 1)


class Slice:
    """Words, runs and symbols of one slice's documents, in ascending order."""

    def __init__(self, docs: pa.Table, width: int, salt: bytes = b""):
        self.docs = docs.sort_by([("doc_id", "ascending"), ("text", "ascending")])
        ids = self.docs.column("doc_id")
        nulls = np.asarray(ids.is_null())
        self.docs = pa.concat_tables([self.docs.filter(pa.array(nulls)), self.docs.filter(pa.array(~nulls))]) if nulls.any() else self.docs
        texts = self.docs.column("text").combine_chunks()
        self.texts = pa.concat_arrays(texts.chunks) if isinstance(texts, pa.ChunkedArray) else texts
        self.words, self.width, self.salt = split_words(self.texts), width, salt
        self.n, self.first = len(self.words.start), self.words.first

    def name(self) -> None:
        """Makes runs and all levels."""
        self.codes, self.names = self.words.codes, digests(self.words.distinct(), self.salt)
        self.doc = np.repeat(np.arange(len(self.first) - 1, dtype=np.int32), np.diff(self.first))
        self.starts = np.flatnonzero(self.doc[: max(0, self.n - self.width + 1)] == self.doc[self.width - 1 :])
        opens = np.ones(self.n, bool)
        opens[1:] = (self.codes[1:] != self.codes[:-1]) | (self.doc[1:] != self.doc[:-1])
        at = np.flatnonzero(opens)
        self.run, self.opens = np.cumsum(opens) - 1, np.append(at, self.n)
        one, two = self.runs(self.codes[at], np.diff(self.opens))
        self.levels = [Level(one, two, self.doc[at], np.arange(len(at)), 0)]
        for _ in range(max(REVEAL)):
            self.levels.append(self.levels[-1].following())

    def runs(self, codes: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        one, two = self.names[codes, 0], self.names[codes, 1]
        many = np.flatnonzero(count > 1)
        times = count[many].astype(np.uint64)
        one, two = one.copy(), two.copy()
        one[many], two[many] = _fold(one[many], two[many], times, times)
        return one, two

    def bounds(self, level: Level) -> np.ndarray:
        """The first word of every symbol of a level, and the end."""
        return np.append(self.opens[level.at], self.n)

    def ids(self) -> np.ndarray:
        return self.docs.column("doc_id").cast(pa.int64()).fill_null(np.iinfo(np.int64).min).to_numpy()

    def distinct(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of round FILTER: (places of symbols that stand here once, first places of the others, whether each symbol is one of the others)."""
        name = self.levels[FILTER].one
        order = np.argsort(name, kind="stable")
        s = name[order]
        new = np.ones(len(s), bool)
        new[1:] = s[1:] != s[:-1]
        last = np.ones(len(s), bool)
        last[:-1] = new[1:]
        many = np.zeros(len(s), bool)
        many[order] = ~(new & last)
        return np.sort(order[new & last]), order[new & ~last], many

    def high(self) -> tuple[np.ndarray, np.ndarray]:
        """High symbols (one, two, doc, first word), each where it stands here first, with their lengths; and facts of its later places here."""
        ids, found, lengths, facts = self.ids(), [], [], []
        for k in REVEAL:
            level = self.levels[k]
            bounds = self.bounds(level)
            some = np.flatnonzero(np.diff(bounds) >= self.width)
            rows = np.empty(len(some), _HIGH)
            rows["one"], rows["two"], rows["at"], rows["doc"] = level.one[some], level.two[some], bounds[some], ids[level.doc[some]]
            found.append(rows)
            lengths.append(np.diff(bounds)[some])
        found, lengths = np.concatenate(found), np.concatenate(lengths)
        order = np.lexsort((found["at"], found["two"], found["one"]))
        found, lengths = found[order], lengths[order]
        new = np.ones(len(found), bool)
        new[1:] = (found["one"][1:] != found["one"][:-1]) | (found["two"][1:] != found["two"][:-1])
        self.high_lengths = lengths[new]
        leader = found["at"][np.maximum.accumulate(np.where(new, np.arange(len(found)), 0))]
        later = ~new & (leader != found["at"])  # a symbol that two rounds hold unchanged is one
        facts = np.stack([found["at"][later], lengths[later], np.full(later.sum(), -1), leader[later]]) if len(found) else np.zeros((4, 0), np.int64)
        self.compare(facts)
        return found[new], facts

    def compare(self, facts: np.ndarray) -> None:
        """Checks repeats within this slice on the words."""
        for place, length, _, at in facts.T.tolist():
            if not np.array_equal(self.codes[place : place + length], self.codes[at : at + length]):
                raise RuntimeError("different words have the same name: choose another salt")

    def inside(self, starts: np.ndarray, upto: int, name: bool = False) -> tuple[np.ndarray, ...]:
        """Symbols [a, b) of round `upto` inside each window; with name=True also the digest of the window by its pops and what is left."""
        last = starts + self.width - 1
        a, b = self.run[starts] + 1, self.run[last]
        if name:
            heads = np.minimum(self.opens[self.run[starts] + 1], last + 1) - starts
            tails = np.where(b >= a, last + 1 - self.opens[b], 0)
            left = self.runs(self.codes[starts], heads)
            right = self.runs(self.codes[last], tails)
        b = np.maximum(a, b)
        for level in self.levels[:upto]:
            live = a < b
            pop = np.flatnonzero(live)
            pop = pop[~level.left[a[pop]]]
            if name:
                left[0][pop], left[1][pop] = _fold(left[0][pop], left[1][pop], level.one[a[pop]], level.two[a[pop]])
            a[pop] += 1
            pop = np.flatnonzero(a < b)
            pop = pop[level.left[b[pop] - 1]]
            if name:
                right[0][pop], right[1][pop] = _fold(right[0][pop], right[1][pop], level.one[b[pop] - 1], level.two[b[pop] - 1])
            b[pop] -= 1
            a, b = level.to[a], np.where(a < b, level.to[b], level.to[a])
        if not name:
            return a, b
        level, core = self.levels[upto], (left[0].copy(), left[1].copy())
        for k in range(int((b - a).max(initial=0))):
            some = np.flatnonzero(b - a > k)
            core[0][some], core[1][some] = _fold(core[0][some], core[1][some], level.one[a[some] + k], level.two[a[some] + k])
        one, two = _fold(*core, *right)
        return a, b, one, two

    def candidates(self, shared: np.ndarray, settled: np.ndarray) -> np.ndarray:
        """Starts of windows that no fact settles and whose inner symbols of round FILTER are all shared, or that have none."""
        a, b = self.inside(self.starts, FILTER)
        total = np.concatenate([[0], np.cumsum(shared)])
        return self.starts[(total[b] - total[a] == b - a) & ~settled[self.starts]]

    def text(self, place: int, length: int) -> bytes:
        """Words joined by one space."""
        start, size = self.words.start[place], self.words.length
        stop = self.words.start[place + length - 1] + size[place + length - 1]
        return b" ".join(self.raw[start:stop].split())

    @property
    def raw(self) -> bytes:
        if not hasattr(self, "_raw"):
            self._raw = text_bytes(self.texts)[0].tobytes()
        return self._raw


def _by_bucket(bucket: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(bucket, kind="stable")
    return order, np.searchsorted(bucket[order], np.arange(n + 1))


def _ranges(facts: np.ndarray) -> np.ndarray:
    """Facts whose places and sources overlap in step, or meet, as one."""
    place, length, source, at = facts
    order = np.lexsort((place, at - place, source))
    place, length, source, at = facts[:, order]
    end = place + length
    same = np.zeros(len(place), bool)
    same[1:] = (source[1:] == source[:-1]) & ((at - place)[1:] == (at - place)[:-1])
    # ends only grow within one source and shift, as shorter facts that begin later may end earlier
    group = np.cumsum(~same)
    reach = np.maximum.accumulate(end + group * (1 << 40)) - group * (1 << 40)
    opens = ~same
    opens[1:] |= place[1:] > reach[:-1]
    head = np.flatnonzero(opens)
    return np.stack([place[head], np.maximum.reduceat(end, head) - place[head], source[head], at[head]]) if len(head) else facts


def remove_repeats(docs: DataFrame, width: int = 20, salt: bytes = b"") -> DataFrame:
    """docs with n_words, n_removed and kept_text (the kept words joined by one space)."""
    if not isinstance(docs.schema["doc_id"].dataType, T.IntegralType):
        raise TypeError("doc_id must be an integer column")
    size = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    n = partitions(docs.sparkSession)
    n_slices, n_buckets = max(n, -(-size // SLICE)), max(n, -(-size // BUCKET))
    own = ["slice", "n_words", "n_removed", "kept_text"]
    dealt = docs.drop(*own).withColumn("slice", F.pmod(F.xxhash64("doc_id"), F.lit(n_slices)).cast("int"))

    def name(group: pa.Table) -> pa.Table:
        give_back()
        out = []
        here = group.column("slice")[0].as_py()
        s = Slice(group, width, salt)
        s.name()
        names = s.levels[FILTER].one
        single, many, _ = s.distinct()
        high, _ = s.high()
        bucket = lambda name: ((name >> np.uint64(32)) % np.uint64(n_buckets)).astype(np.int64)
        (o1, cut1), (o2, cut2), (o3, cut3) = (_by_bucket(bucket(x), n_buckets) for x in (names[single], names[many], high["one"]))
        for b in np.flatnonzero((np.diff(cut1) + np.diff(cut2) + np.diff(cut3)) > 0).tolist():
            one, two, three = single[o1[cut1[b] : cut1[b + 1]]], many[o2[cut2[b] : cut2[b + 1]]], o3[cut3[b] : cut3[b + 1]]
            out.append((b, here, (names[one] & _LOW).astype("<u4").tobytes(), _packed(one), (names[two] & _LOW).astype("<u4").tobytes(), high[three].tobytes(), _packed(three)))
        return _table(out, name_schema)

    def shared(group: pa.Table) -> pa.Table:
        give_back()
        rows = group.to_pylist()
        keys = [np.frombuffer(r["names"], "<u4") for r in rows]
        every = np.sort(np.concatenate(keys + [np.frombuffer(r["others"], "<u4") for r in rows]))
        twice = np.unique(every[1:][every[1:] == every[:-1]])
        known = _among(keys, twice)
        high, sizes = np.concatenate([np.frombuffer(r["high"], _HIGH) for r in rows]), [len(r["high"]) // _HIGH.itemsize for r in rows]
        source = np.repeat([r["slice"] for r in rows], sizes)
        later, first = _later(high["one"], high["two"], high["doc"])
        out, at = [], 0
        for r, found, size in zip(rows, known, sizes, strict=True):
            tell = np.flatnonzero(later[at : at + size]) + at
            facts = _facts(_unpacked(r["symbols"])[tell - at], np.zeros(len(tell)), source[first[tell]], high["at"][first[tell]]) if len(tell) else None
            if found.any() or facts:
                out.append((r["slice"], _packed(_unpacked(r["places"])[found]), facts))
            at += size
        return _table(out, reply_schema)

    def candidates(group: pa.Table, replies: pa.Table) -> pa.Table:
        give_back()
        if not group.num_rows:
            return _table([], window_schema)
        here = group.column("slice")[0].as_py()
        s = Slice(group, width, salt)
        s.name()
        _, _, flags = s.distinct()
        high, facts = s.high()
        facts = [facts]
        for raw, told in zip(replies.column("places").to_pylist(), replies.column("facts").to_pylist(), strict=True):
            flags[_unpacked(raw)] = True
            if told is not None:
                k, _, source, at = _read_facts(told)
                facts.append(np.stack([high["at"][k], s.high_lengths[k], source, at]))
        facts = np.concatenate(facts, 1).astype(np.int64)
        settled = _covered(facts[0], facts[1] - width + 1, s.n)
        starts = s.candidates(flags, settled)
        _, _, one, two = s.inside(starts, ROUNDS, name=True)
        order = np.lexsort((starts, two, one))
        new = np.ones(len(order), bool)
        new[1:] = (one[order[1:]] != one[order[:-1]]) | (two[order[1:]] != two[order[:-1]])
        leader = starts[order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]]
        again = np.stack([starts[order[~new]], np.full((~new).sum(), width), np.full((~new).sum(), -1), leader[~new]])
        out = []
        if again.shape[1]:
            again = _ranges(again)
            s.compare(again)
            facts = np.concatenate([facts, again], 1)
        if facts.shape[1]:
            out.append((here % n_buckets, here, None, None, None, None, _facts(*facts)))
        first = np.sort(order[new])
        starts, one, two = starts[first], one[first], two[first]
        doc = s.ids()[s.doc[starts]]
        o, cut = _by_bucket(((one >> np.uint64(32)) % np.uint64(n_buckets)).astype(np.int64), n_buckets)
        for b in np.flatnonzero(np.diff(cut)).tolist():
            k = o[cut[b] : cut[b + 1]]
            out.append((b, here, one[k].astype("<u8").tobytes(), two[k].astype("<u8").tobytes(), _packed(doc[k], "<i8"), _packed(starts[k]), None))
        return _table(out, window_schema)

    def earliest(group: pa.Table) -> pa.Table:
        give_back()
        out, rows = [], []
        for r in group.to_pylist():
            if r["facts"] is not None:
                out.append((r["slice"], None, r["facts"]))
            else:
                rows.append(r)
        if rows:
            one, two, doc = (np.concatenate([f(r) for r in rows]) for f in (lambda r: np.frombuffer(r["one"], "<u8"), lambda r: np.frombuffer(r["two"], "<u8"), lambda r: _unpacked(r["docs"], "<i8")))
            places = [_unpacked(r["places"]).astype(np.int64) for r in rows]
            every, source = np.concatenate(places), np.repeat([r["slice"] for r in rows], [len(p) for p in places])
            later, first = _later(one, two, doc)
            at = 0
            for r, p in zip(rows, places, strict=True):
                tell = np.flatnonzero(later[at : at + len(p)]) + at
                if len(tell):
                    out.append((r["slice"], None, _facts(every[tell], np.full(len(tell), width), source[first[tell]], every[first[tell]])))
                at += len(p)
        return _table(out, reply_schema)

    def ask(group: pa.Table, replies: pa.Table) -> pa.Table:
        give_back()
        if not group.num_rows or not replies.num_rows:
            return _table([], ask_schema)
        here = group.column("slice")[0].as_py()
        s = Slice(group, width)
        facts = _ranges(np.concatenate([_read_facts(raw) for raw in replies.column("facts").to_pylist()], 1))
        out = [(here, _facts(*facts), None)]
        for source in np.unique(facts[2][facts[2] >= 0]).tolist():
            mine = facts[:, facts[2] == source]
            out.append((source, _facts(*mine), pa.compress(text := b"\n".join(s.text(p, n) for p, n in mine[:2].T.tolist()), codec="zstd", asbytes=True) + len(text).to_bytes(8, "little")))
        return _table(out, ask_schema)

    kept_fields = [f for f in dealt.schema.fields if f.name != "slice"]
    result = T.StructType([*kept_fields, T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_text", T.StringType())])

    def cut(group: pa.Table, asks: pa.Table) -> pa.Table:
        give_back()
        if not group.num_rows:
            return None
        s = Slice(group, width)
        gone = np.zeros(s.n, bool)
        for facts, text in zip(asks.column("facts").to_pylist(), asks.column("words").to_pylist(), strict=True):
            place, length, _, at = _read_facts(facts)
            if text is None:
                gone |= _covered(place, length, s.n)
                continue
            texts = pa.decompress(text[:-8], int.from_bytes(text[-8:], "little"), codec="zstd", asbytes=True).split(b"\n")
            if any(s.text(q, k) != other for q, k, other in zip(at.tolist(), length.tolist(), texts, strict=True)):
                raise RuntimeError("different words have the same name: choose another salt")
        sums = np.concatenate([[0], np.cumsum(gone)])
        n_words, n_removed = np.diff(s.first), sums[s.first[1:]] - sums[s.first[:-1]]
        _, bounds = text_bytes(s.texts)
        kept = []
        for k, removed in enumerate(n_removed.tolist()):
            a, b = int(s.first[k]), int(s.first[k + 1])
            if not removed:
                kept.append(b" ".join(s.raw[bounds[k] : bounds[k + 1]].split()))
                continue
            flags = np.concatenate([[True], gone[a:b], [True]])
            turn = np.flatnonzero(flags[1:] != flags[:-1]) + a
            kept.append(b" ".join(s.text(i, j - i) for i, j in zip(turn[::2], turn[1::2], strict=True)))
        out = s.docs.drop_columns(["slice"])
        return out.append_column("n_words", pa.array(n_words, pa.int64())).append_column("n_removed", pa.array(n_removed, pa.int64())).append_column("kept_text", pa.array(kept, pa.binary()).cast(pa.string()))

    by_slice = dealt.groupBy("slice")
    names = by_slice.applyInArrow(name, "bucket int, slice int, names binary, places binary, others binary, high binary, symbols binary")
    told = names.groupBy("bucket").applyInArrow(shared, "slice int, places binary, facts binary")
    found = by_slice.cogroup(told.groupBy("slice")).applyInArrow(candidates, "bucket int, slice int, one binary, two binary, docs binary, places binary, facts binary")
    verdicts = found.groupBy("bucket").applyInArrow(earliest, "slice int, places binary, facts binary")
    asked = by_slice.cogroup(verdicts.groupBy("slice")).applyInArrow(ask, "slice int, facts binary, words binary")
    return by_slice.cogroup(asked.groupBy("slice")).applyInArrow(cut, result)


def _among(keys: list[np.ndarray], known: np.ndarray) -> list[np.ndarray]:
    """Whether the keys of each array are in `known`, which is sorted; the work goes with the keys, not with arrays times `known`."""
    every = np.concatenate([*keys, known[:0]])
    at = np.minimum(np.searchsorted(known, every), max(0, len(known) - 1))
    return np.split(known[at] == every if len(known) else np.zeros(len(every), bool), np.cumsum([len(k) for k in keys])[:-1])


def _later(one: np.ndarray, two: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each entry has an equal name of a smaller doc, and which entry is the first of its name."""
    order = np.lexsort((doc, two, one))
    same = np.zeros(len(order), bool)
    same[1:] = (one[order[1:]] == one[order[:-1]]) & (two[order[1:]] == two[order[:-1]])
    later, first = np.zeros(len(order), bool), np.zeros(len(order), np.int64)
    later[order] = same
    first[order] = order[np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))]
    return later, first


def _covered(place: np.ndarray, length: np.ndarray, n: int) -> np.ndarray:
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, place, 1)
    np.add.at(edge, place + length, -1)
    return np.cumsum(edge[:-1]) > 0


name_schema = pa.schema([("bucket", pa.int32()), ("slice", pa.int32()), *((k, pa.binary()) for k in ("names", "places", "others", "high", "symbols"))])
reply_schema = pa.schema([("slice", pa.int32()), ("places", pa.binary()), ("facts", pa.binary())])
window_schema = pa.schema([("bucket", pa.int32()), ("slice", pa.int32()), *((k, pa.binary()) for k in ("one", "two", "docs", "places", "facts"))])
ask_schema = pa.schema([("slice", pa.int32()), ("facts", pa.binary()), ("words", pa.binary())])


def _table(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(schema)
    return pa.table([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

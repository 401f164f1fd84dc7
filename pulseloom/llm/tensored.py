"""Near-duplicate documents by tensored MinHash banding.

A document's set holds its distinct shingles of lower-case words.  Two collections of `groups` groups, each of
ROWS minhashes, are computed, 2 * groups * ROWS minhashes in all; a table key combines one group of the first
with one of the second, which gives groups * groups tables of 2 * ROWS minhashes each.  Two documents share a
table exactly if they agree in a group of both collections.  The number of groups follows from the threshold
(16 for 0.85, 22 for 0.8): all but 2 pairs in 100,000 at the threshold do, and of more similar pairs all but fewer.

Only combinations of groups that some other document has too are formed.  Every document is first compared with
one other, and components of the links found are contracted.  Of those with one key of the first collection, all
outside the component that holds most are compared with one in it; components are contracted again, and then
only documents of one bucket that lie in different components are compared, in tiles: those of the bucket's largest
component with the others alone, and only sizes that can be alike.  A large group of near copies so costs a
comparison a member, not one a pair, and no link between components is lost.  Buckets that share a key of the
first collection are compared as one where that holds no more pairs than they do together.  Tiles bound an intersection from
above by parities, as many bits as a set has shingles; no pairs but possible links leave a tile.

Hashes only propose.  Every link, and every document held equal to another, is confirmed on the words
themselves, whose full shingle sets are compared without hashing.  Texts with the same SHA-256 count as equal.

Every row is a document of its own, with or without doc_id, and rows that repeat a doc_id may have different
texts; component_id is the smallest doc_id among the rows within reach (null if none has any).  Null and empty
texts, and those of spaces alone, have empty sets and link with nothing.  Texts with fewer words than a shingle
have their whole word sequence as their only shingle.  Empty tables give empty results.  Other columns are ignored.
"""

from __future__ import annotations

import math
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulseloom.llm.components import connected_components
from pulseloom.llm.tables import give_back, scratch, skew_join, stored
from pulseloom.llm.words import Words, mix, slices, split_words

GROUPS, ROWS = 16, 4  # groups at least
MISSED = 1e-5  # of pairs at the threshold, by the groups of one collection
TILE, TILE_SHINGLES = 1024, 1 << 22  # documents and shingles of a tile's side
LOT, STEP = 8192, 64  # rows of tiles that one call compares, and rows that are held against all others of a tile at once
TASK_SHINGLES = 50_000  # of texts that are compared with one text in one task
TASK_PAIRS = 4096  # of one row whose parities are compared in one task
_FACTOR = np.uint64(0xC2B2AE3D27D4EB4F)


def groups_for(percent: int) -> int:
    """Groups of a collection in all of which a pair at the threshold differs with probability MISSED at most."""
    same = (percent / 100) ** ROWS
    return GROUPS if same >= 1 else max(GROUPS, math.ceil(math.log(MISSED) / math.log1p(-same)))


def _runs(words: Words, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, number of words, bounds of each text's) of every shingle: `size` words, or the whole of a shorter text."""
    n = np.diff(words.first)
    short = (n > 0) & (n < size)
    counts = np.where(short, 1, np.maximum(n - size + 1, 0))
    bounds = np.concatenate([[0], np.cumsum(counts)])
    return np.arange(bounds[-1]) + np.repeat(words.first[:-1] - bounds[:-1], counts), np.repeat(np.minimum(n, size), counts), bounds


def shingle_sets(column: pa.Array, size: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    words = split_words(column, lower=True)
    start, held, bounds = _runs(words, size)
    hashes = np.append(words.hashes, np.zeros(size, np.uint64))
    out = held.astype(np.uint64)
    for k in range(size):
        out = np.where(held > k, mix(out * _FACTOR ^ hashes[start + k]), out)
    return [np.unique(out[a:b]) for a, b in zip(bounds, bounds[1:], strict=False)]


def exact_sets(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, shingle number) of every distinct shingle of each text; equal numbers are equal words, without hashing."""
    words = split_words(column, lower=True)
    start, held, bounds = _runs(words, size)
    codes, base = np.append(words.codes + 1, np.zeros(size, np.int64)), len(words.vocabulary) + 1
    number, bound = np.zeros(len(start), np.int64), 1
    for k in range(size):
        if bound * base >= 1 << 62:
            number = np.unique(number, return_inverse=True)[1]
            bound = int(number.max(initial=0)) + 1
        number, bound = number * base + np.where(held > k, codes[start + k], 0), bound * base
    number = np.unique(number, return_inverse=True)[1]
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    both = np.unique(text * (int(number.max(initial=0)) + 1) + number)
    return np.divmod(both, int(number.max(initial=0)) + 1)


def _keys(sets: list[np.ndarray], groups: int) -> tuple[np.ndarray, np.ndarray]:
    """Group keys of non-empty sets for both collections: arrays of (set, group)."""
    bounds = np.concatenate([[0], np.cumsum([len(s) for s in sets])])[:-1]
    values = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
    factors = np.random.default_rng(20240301).integers(0, 1 << 31, 2 * groups * ROWS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    out = np.empty((2 * groups, len(sets)), np.uint64)
    for g in range(2 * groups):
        key = np.full(len(sets), g + 1, np.uint64)
        for r in range(ROWS):
            key = mix(key * _FACTOR + np.minimum.reduceat(values * factors[g * ROWS + r], bounds).astype(np.uint64))
        out[g] = key
    return out[:groups].T, out[groups:].T


def mark(text: str = "text") -> Column:
    """64 bits of a text's SHA-256; tells rows of one doc_id, or of one set digest, apart."""
    return F.xxhash64(F.sha2(F.coalesce(F.col(text), F.lit("")), 256))


def signatures(docs: DataFrame, size: int, groups: int) -> DataFrame:
    """doc_id, mark, n_shingles, one and two (a digest of the set), first and second (group keys)."""

    def run(batches):
        give_back()
        for batch in batches:
            for low, high in slices(batch.column("text"), 2 << 20):
                part = batch.slice(low, high - low)
                sets = shingle_sets(part.column("text"), size)
                some = np.array([len(s) > 0 for s in sets])
                first, second = _keys([s for s in sets if len(s)], groups) if some.any() else (np.zeros((0, groups), np.uint64),) * 2
                lists = [pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(some * groups)]), pa.int32()), pa.array(np.ascontiguousarray(k).view(np.int64).ravel())) for k in (first, second)]
                digest = np.frombuffer(b"".join(blake2b(s.tobytes(), digest_size=16).digest() for s in sets), np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("mark"), pa.array([len(s) for s in sets], pa.int64()), *(pa.array(np.ascontiguousarray(digest[:, k])) for k in (0, 1)), *lists], ["doc_id", "mark", "n_shingles", "one", "two", "first", "second"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", mark().alias("mark"), "text").mapInArrow(run, f"doc_id {kind}, mark long, n_shingles long, one long, two long, first array<long>, second array<long>")


def with_parities(texts: DataFrame, size: int) -> DataFrame:
    """texts (row, n, text) with bits: parities of the set's elements by their hashes, at least as many as elements, and 1024."""

    def run(batches):
        give_back()
        for batch in batches:
            for low, high in slices(batch.column("text"), 2 << 20):
                part = batch.slice(low, high - low)
                bits = []
                for s in shingle_sets(part.column("text"), size):
                    width = max(1024, 1 << (len(s) - 1).bit_length()) if len(s) else 1024
                    bits.append(np.packbits(np.bincount((s & np.uint64(width - 1)).astype(np.int64), minlength=width).astype(np.uint8) & 1).view(np.int64))
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(b) for b in bits])]), pa.int32()), pa.array(np.concatenate(bits) if bits else np.zeros(0, np.int64)))
                yield pa.RecordBatch.from_arrays([*part.columns, lists], [*part.schema.names, "bits"])

    return texts.select("row", "n", "text").mapInArrow(run, "row long, n long, text string, bits array<long>")


def _folded(bits: Column, n: Column) -> Column:
    """The parities by fewer bits, as n longs; both are powers of two."""
    parts = F.sequence(F.lit(0), (F.size(bits) / n).cast("int") - 1)
    at = lambda i: F.aggregate(parts, F.lit(0).cast("long"), lambda x, k: x.bitwiseXOR(F.get(bits, i + k * n)))
    return F.when(F.size(bits) == n, bits).otherwise(F.transform(F.sequence(F.lit(0), n - 1), at))


def dealt(pairs: DataFrame, loads: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """(pairs with part, rows (a, parts)): the pairs of one a in as many parts as keep each part's share of a's loads (a, load) near `most`."""
    many = loads.groupBy("a").agg(F.ceil(F.sum("load") / F.lit(most)).cast("int").alias("parts"))
    parted = skew_join(pairs, many, ["a"], "inner").withColumn("part", F.pmod(F.xxhash64("b"), "parts").cast("int"))
    return parted.drop("parts"), many


def possible(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that parities do not rule out: elements in one set only are at least as many as differing parities."""
    brief = lambda k: sets.select(F.col("row").alias(k), F.col("bits").alias(f"bits_{k}"), F.col("n").alias(f"n_{k}"))
    width = F.least(F.size("bits_a"), F.size("bits_b"))
    apart = F.aggregate(F.zip_with(_folded(F.col("bits_a"), width), _folded(F.col("bits_b"), width), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda x, y: x + y)
    most = F.floor((F.col("n_a") + F.col("n_b") - apart) / 2)
    pairs, many = dealt(pairs, pairs.select("a", F.lit(1).alias("load")), TASK_PAIRS)
    left = many.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts").join(brief("a"), "a")
    return pairs.join(left, ["a", "part"]).join(brief("b"), "b").where(100 * most >= percent * (F.col("n_a") + F.col("n_b") - most)).select("a", "b")


def _unpacked(column: pa.Array) -> np.ndarray:
    """Parities of all rows, folded to the least width among them: an array of (row, 64-bit word)."""
    flat, size = np.asarray(column.flatten(), np.int64).view(np.uint64), np.asarray(column.value_lengths())
    width, at = int(size.min()), np.concatenate([[0], np.cumsum(size)])
    return np.array([np.bitwise_xor.reduce(flat[a:b].reshape(-1, width), 0) for a, b in zip(at, at[1:], strict=False)])


def _alike(n: Column, m: Column, percent: int) -> Column:
    return 100 * F.least(n, m) >= percent * F.greatest(n, m)


def buckets(df: DataFrame) -> DataFrame:
    """A row for each table that a document has: p, the key of the first collection, and bucket, of both keys."""
    return df.withColumn("p", F.explode("first")).withColumn("q", F.explode("second")).withColumn("bucket", F.xxhash64("p", "q")).drop("q", "first", "second")


def nearest(shared: DataFrame, percent: int) -> DataFrame:
    """A pair (a, b) at most for each row b of shared (row, n, first, second): of the smallest rows with one of b's keys of the first collection, the one with most of them."""
    keys = shared.select("row", "n", F.explode("first").alias("key"))
    least = keys.groupBy("key").agg(F.min(F.struct(F.col("row").alias("a"), F.col("n").alias("m"))).alias("s")).select("key", "s.*")
    held = skew_join(keys, least, ["key"], "inner").where((F.col("a") != F.col("row")) & _alike(F.col("n"), F.col("m"), percent))
    return held.groupBy("row", "a").agg(F.count("*").alias("keys")).groupBy(F.col("row").alias("b")).agg(F.max_by("a", F.struct("keys", -F.col("a"))).alias("a")).select("a", "b")


def stars(placed: DataFrame, percent: int) -> DataFrame:
    """A pair (a, b) at most for each row b and key of its first collection; placed as to_compare() takes it.

    Of a key's rows, a is the smallest in the component that has most of them, and b lies in another.  Keys that lie in
    one component give no pairs.  A row so lists as many pairs as groups, and not one for each of its tables, which are their square.
    """
    keys = placed.select("row", "n", "component", F.explode("first").alias("key"))
    by = keys.groupBy("key", "component").agg(F.count("*").alias("rows"), F.min(F.struct("row", "n")).alias("s"))
    main = F.max_by(F.struct(F.col("s.row").alias("a"), F.col("s.n").alias("m"), F.col("component").alias("of")), F.struct("rows", -F.col("component")))
    least = by.groupBy("key").agg(main.alias("s"), F.count("*").alias("components")).where("components > 1")
    held = skew_join(keys, stored(least.select("key", "s.*"), "mixed"), ["key"], "inner")
    return held.where((F.col("component") != F.col("of")) & _alike(F.col("n"), F.col("m"), percent)).select("a", F.col("row").alias("b")).distinct()


def to_compare(placed: DataFrame) -> DataFrame:
    """bucket, row, n, component of the buckets with several components; placed: row, n, first, second, component.

    Much alike documents share most of the tables of a key p of the first collection, and would be compared in each.
    The buckets of such a p become one, of all documents with p, wherever that holds no more pairs than they do
    together.  No pair that shares a table is lost by it.  Buckets of the same rows are compared once.
    """
    rows = (F.count("*").alias("rows"), F.sum(F.xxhash64("row").cast("decimal(20,0)")).alias("one"), F.sum(F.xxhash64("row", F.lit(1)).cast("decimal(20,0)")).alias("two"))
    dealt, whole = buckets(placed), placed.withColumn("p", F.explode("first")).drop("first", "second")
    spans = dealt.groupBy("p", "bucket").agg(F.min("component").alias("from"), F.max("component").alias("to"), *rows)
    spans = stored(spans.where("`from` <> `to`").drop("from", "to"), "spans")
    pairs = F.sum(F.col("rows").cast("double") * F.col("rows")).alias("pairs")
    merged = whole.groupBy("p").agg(*rows).join(spans.groupBy("p").agg(pairs, F.count("*").alias("buckets")), "p").where("buckets > 1 and cast(rows as double) * rows <= pairs")
    merged = stored(merged.select("p", F.xxhash64("p").alias("bucket"), "rows", "one", "two", F.lit(True).alias("merged")), "merged")
    every = spans.withColumn("merged", F.lit(False)).join(merged.select("p"), "p", "left_anti").unionByName(merged)
    once = stored(every.groupBy("rows", "one", "two").agg(F.min(F.struct("merged", "p", "bucket")).alias("s")).select("s.*"), "once")
    apart = dealt.join(once.where("not merged").select("bucket"), "bucket", "left_semi")
    joint = whole.join(once.where("merged").select("p", "bucket"), "p")
    of = ("bucket", "row", "n", "component")
    return apart.select(*of).union(joint.select(*of))


def tiles_of(rows: DataFrame, percent: int) -> DataFrame:
    """tile, side, row, n, component, bits, lot: rows (bucket, row, n, component, bits) copied to every tile that compares them.

    A bucket's rows are cut into chunks by whether they belong to its largest component, by size class (alike sizes
    are in one class or in neighbouring ones), and by a hash.  Every two chunks that may hold a link are a tile.  Lots
    are as many as keep the copies in one near LOT rows, and near LOT / TILE chunks' shingles, however many tiles a bucket has.
    """
    by = rows.groupBy("bucket", "component").agg(F.count("*").alias("rows"), F.sum("n").alias("shingles"))
    small = (F.sum("rows") <= TILE) & (F.sum("shingles") <= TILE_SHINGLES)  # one chunk
    by = by.groupBy("bucket").agg(F.max_by("component", F.struct("rows", "component")).alias("main"), F.count("*").alias("components"), small.alias("small"))
    sized = F.floor(F.log(F.col("n").cast("double")) / -math.log(min(percent, 99) / 100) + 1e-9).cast("int")
    held = rows.join(by.where("components > 1").drop("components"), "bucket")
    held = held.withColumns({"class": F.when(F.col("small"), 0).otherwise(sized), "minor": (F.col("small") | (F.col("component") != F.col("main"))).cast("int")}).drop("main", "small")
    chunks = F.ceil(F.count("*") / F.lit(TILE) + F.sum("n") / F.lit(TILE_SHINGLES)).cast("int")
    load = F.count("*") / F.lit(LOT) + F.sum("n") / F.lit(TILE_SHINGLES * (LOT // TILE))
    sizes = held.groupBy("bucket", "class", "minor").agg(chunks.alias("chunks"), load.alias("load"))
    lists = stored(sizes.groupBy("bucket").agg(F.collect_list(F.struct("class", "minor", "chunks", "load")).alias("all")), "chunks")  # a few a bucket: classes are logarithms
    meets = lambda c, d: (F.abs(c["class"] - d["class"]) <= 1) & (c["minor"] + d["minor"] > 0)
    met = lambda d: F.aggregate("all", F.lit(0), lambda x, c: F.when(meets(c, d), x + c["chunks"]).otherwise(x))
    lots = 1 + int(lists.agg(F.sum(F.aggregate("all", F.lit(0.0), lambda x, d: x + d["load"] * met(d)))).first()[0] or 0)
    own = F.aggregate("all", F.lit(1), lambda x, c: F.when((c["class"] == F.col("class")) & (c["minor"] == F.col("minor")), c["chunks"]).otherwise(x))
    held = held.join(lists, "bucket").withColumn("chunk", F.struct("class", "minor", F.pmod(F.xxhash64("row"), own).cast("int").alias("part")))
    fits = F.filter("all", lambda c: (F.abs(c["class"] - F.col("class")) <= 1) & (c["minor"] + F.col("minor") > 0))
    others = F.flatten(F.transform(fits, lambda c: F.transform(F.sequence(F.lit(0), c["chunks"] - 1), lambda k: F.struct(c["class"].alias("class"), c["minor"].alias("minor"), k.alias("part")))))
    tiles = held.withColumn("other", F.explode(others)).select(F.xxhash64("bucket", F.least("chunk", "other"), F.greatest("chunk", "other")).alias("tile"), F.when(F.col("chunk") <= F.col("other"), 0).otherwise(1).alias("side"), "row", "n", "component", "bits")
    return tiles.withColumn("lot", F.pmod("tile", F.lit(lots)))  # most tiles are small; a lot has many


def near_misses(rows: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of one bucket in different components that sizes and parities do not rule out; rows as tiles_of() takes them."""

    def compare(lot: pa.Table) -> pa.Table:
        give_back()
        lot = lot.sort_by("tile")
        tile = lot.column("tile").to_numpy()
        side, n, component, row = (lot.column(c).to_numpy() for c in ("side", "n", "component", "row"))
        bits = lot.column("bits").combine_chunks()
        cuts = np.flatnonzero(np.concatenate([[True], tile[1:] != tile[:-1], [True]])) if len(tile) else np.zeros(1, np.int64)
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for low, high in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            here = np.arange(low, high)
            x, y = here[side[low:high] == 0], here[side[low:high] == 1]
            alone = not len(y)  # a chunk with itself
            y, parity = x if alone else y, None
            # pairs of other components whose sizes are alike; most tiles have few
            for k in range(0, len(x), STEP):
                few = x[k : k + STEP]
                may = (component[few][:, None] != component[y][None]) & (100 * np.minimum(n[few][:, None], n[y][None]) >= percent * np.maximum(n[few][:, None], n[y][None]))
                if alone:
                    may &= few[:, None] < y[None]
                i, j = np.nonzero(may)
                i, j = few[i], y[j]
                if len(i):
                    parity = _unpacked(bits.slice(low, high - low)) if parity is None else parity
                    apart = np.concatenate([np.bitwise_count(parity[p - low] ^ parity[q - low]).sum(1, dtype=np.int64) for p, q in zip(np.array_split(i, 1 + len(i) * parity.shape[1] // (1 << 20)), np.array_split(j, 1 + len(i) * parity.shape[1] // (1 << 20)), strict=True)])
                    most = (n[i] + n[j] - apart) // 2
                    link = 100 * most >= percent * (n[i] + n[j] - most)
                    a.append(row[i[link]])
                    b.append(row[j[link]])
        a, b = np.concatenate(a), np.concatenate(b)
        found = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0)
        return pa.table({"a": np.ascontiguousarray(found[:, 0]), "b": np.ascontiguousarray(found[:, 1])})

    return tiles_of(rows, percent).groupBy("lot").applyInArrow(compare, "a long, b long").distinct()


def confirmed(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) with 100 * intersection >= percent * union of their shingles, by words; an a with many pairs is dealt to many tasks."""
    held = pairs.join(texts.select(F.col("row").alias("b"), "n"), "b")
    pairs, many = dealt(pairs, held.select("a", (F.col("n") + 400).alias("load")), TASK_SHINGLES)
    left = many.join(texts.select(F.col("row").alias("a"), "text"), "a").select("a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "text")
    right = pairs.select(F.col("a").alias("to"), "b", F.col("part").alias("at")).join(texts.select(F.col("row").alias("b"), "text"), "b")

    def compare(one: pa.Table, more: pa.Table) -> pa.Table:
        if not one.num_rows or not more.num_rows:
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        column = pa.concat_arrays([one.column("text").chunk(0).slice(0, 1), *more.column("text").chunks])
        text, number = exact_sets(column, size)
        count = np.bincount(text, minlength=len(column))
        inside = np.zeros(int(number.max(initial=0)) + 1, bool)
        inside[number[text == 0]] = True
        both = np.bincount(text, inside[number], len(column)).astype(np.int64)
        linked = 100 * both >= percent * (count + count[0] - both)
        found = more.select(["to", "b"]).filter(pa.array(linked[1:]))
        return pa.table({"a": found.column("to"), "b": found.column("b")})

    return left.groupBy("a", "part").cogroup(right.groupBy("to", "at")).applyInArrow(compare, "a long, b long")


def grouped(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """Per row: row, doc_id, mark, n_shingles, component_id, and whether it is the first row of its component."""
    spark = docs.sparkSession
    with scratch(spark):
        signed = stored(signatures(docs, size, groups_for(percent)).withColumn("row", F.monotonically_increasing_id()), "signatures")
        full, own = signed.where("n_shingles > 0"), ["n_shingles", "one", "two"]
        low = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("low")
        # of rows with one text, and of texts with one set, one stands for all
        texts = stored(full.groupBy(*own, "mark").agg(F.min("row").alias("row"), low), "texts")
        classes = stored(texts.groupBy(*own).agg(F.min("row").alias("rep"), F.min("low").alias("low"), F.count("*").alias("texts")), "classes")

        def with_text(rows: DataFrame) -> DataFrame:
            """row, n and text of the rows asked for."""
            asked = signed.join(rows.select("row").distinct(), "row", "left_semi").select("row", F.col("n_shingles").alias("n"), F.col("doc_id").alias("of"), F.col("mark").alias("seen"))
            held = docs.select("doc_id", mark().alias("mark"), "text")
            return held.join(asked, held.doc_id.eqNullSafe(F.col("of")) & (F.col("mark") == F.col("seen"))).select("row", "n", "text").dropDuplicates(["row"])

        copies = stored(texts.join(classes.where("texts > 1").select(*own, "rep"), own).where("row <> rep").select(F.col("rep").alias("a"), F.col("row").alias("b")), "copies")
        apart = None  # texts whose sets have another's digest, but not its words
        if not copies.isEmpty():
            words = stored(with_text(copies.select(F.col("a").alias("row")).union(copies.select("b"))), "words")
            apart = stored(copies.join(confirmed(copies, words, size, 100), ["a", "b"], "left_anti").select(F.col("b").alias("row")), "apart")
            apart = None if apart.isEmpty() else apart
        nodes = classes.select(F.col("rep").alias("row"), "low")
        if apart is not None:
            nodes = nodes.union(texts.join(apart, "row", "left_semi").select("row", "low"))
        lone = full.join(nodes.select("row"), "row", "left_semi")
        side = lambda c, s: F.transform(c, lambda k: F.struct(F.lit(s).alias("side"), k.alias("key")))
        keys = stored(lone.select("row", F.col("n_shingles").alias("n"), F.explode(F.concat(side("first", 0), side("second", 1))).alias("k")).select("row", "n", "k.side", "k.key"), "keys")
        common = keys.groupBy("key").agg(F.count("*").alias("rows")).where("rows > 1").select("key")
        of = lambda s: F.collect_list(F.when(F.col("side") == s, F.col("key")))
        shared = stored(keys.join(common, "key", "left_semi").groupBy("row", "n").agg(of(0).alias("first"), of(1).alias("second")).where("size(first) > 0 and size(second) > 0"), "shared")
        sets = stored(with_parities(with_text(shared), size), "sets")

        def joined(components: DataFrame, links: DataFrame) -> DataFrame:
            """The components with more links between them."""
            if links.isEmpty():
                return components
            return connected_components(components.select(F.col("node").alias("a"), F.col("component").alias("b")).union(links))

        def placed_by(components: DataFrame) -> DataFrame:
            held = shared.join(components, shared.row == components.node, "left")
            return stored(held.select("row", "n", "first", "second", F.coalesce("component", "row").alias("component")), "placed")

        links = stored(confirmed(nearest(shared, percent), sets, size, percent), "links")
        components = connected_components(links)
        star = stored(stars(placed_by(components), percent), "star")
        more = stored(possible(star, sets, percent), "pairs")
        components = joined(components, stored(confirmed(more, sets, size, percent), "links"))
        # what is left: documents that share a table and lie in different components
        placed = placed_by(components)
        left = to_compare(placed).join(sets.select("row", "bits"), "row")
        pairs = stored(near_misses(left, percent), "pairs")
        components = joined(components, stored(confirmed(pairs, sets, size, percent), "links"))
        of_node = stored(nodes.join(components, nodes.row == components.node, "left").select("row", "low", F.coalesce("component", "row").alias("component")), "nodes")
        first = of_node.groupBy("component").agg(F.min("low").alias("low"))
        of_node = stored(skew_join(of_node.select("row", "component"), first, ["component"]).select(F.col("row").alias("rep"), "low"), "nodes")
        of_class = classes.drop("low").join(of_node, "rep").select(*own, "low")
        out = skew_join(signed.select("row", "doc_id", "mark", *own), of_class, own)
        if apart is not None:
            other = texts.select(*own, "mark", F.col("row").alias("rep")).join(apart.withColumnRenamed("row", "rep"), "rep", "left_semi").join(of_node, "rep").select(*own, "mark", F.col("low").alias("true_low"))
            out = out.join(other, [*own, "mark"], "left").withColumn("low", F.coalesce("true_low", "low"))
        found = F.col("low").isNotNull()
        out = out.select("row", "doc_id", "mark", "n_shingles", F.when(found, F.col("low.doc_id")).otherwise(F.col("doc_id")).alias("component_id"), F.coalesce(F.col("low.row") == F.col("row"), F.lit(True)).alias("first"))
        return stored(out, "groups", outer=True)


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (smallest doc_id within reach of links), kept (doc_id = component_id)."""
    return grouped(docs, size, percent).select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def one_of_each(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """docs with one row of each component, the first by (doc_id, nulls last); rows without words all stay.  Other columns may have any names."""
    found = grouped(docs, size, percent).groupBy("doc_id", "mark").agg(F.count("*").alias("rows"), F.count_if("first").alias("stay"))
    taken = {c.lower() for c in docs.columns}
    own, of, seen = (next(f"_{name}{k}" for k in range(len(taken) + 1) if f"_{name}{k}" not in taken) for name in ("mark", "of", "seen"))
    gone = found.where("stay = 0").select(F.col("doc_id").alias(of), F.col("mark").alias(seen))
    once = found.where("stay > 0 and stay < rows").select(F.col("doc_id").alias(of), F.col("mark").alias(seen))
    marked = docs.withColumn(own, mark())
    same = marked["doc_id"].eqNullSafe(F.col(of)) & (F.col(own) == F.col(seen))
    kept = marked.join(gone.hint("shuffle_hash"), same, "left_anti")
    if not once.isEmpty():
        repeated = kept.join(once.hint("shuffle_hash"), same, "left_semi").dropDuplicates(["doc_id", own])
        kept = kept.join(once.hint("shuffle_hash"), same, "left_anti").union(repeated)
    return kept.select(*docs.columns)

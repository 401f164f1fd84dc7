"""The prefix trie of conversations, with what sharing prefixes saves.

Nodes are owned: the smallest conversation through a node owns it, and owns all deeper nodes on its own path too, so
each conversation owns a suffix of its path (or nothing).  A first group-by over prefixes finds owners; windows over each
conversation mark its owned nodes; a second group-by sums, for every node, the words of all occurrences at and below it less
the words of owned nodes, and the leaves that its members own.  Counts that belong to a subtree come out without walking the tree.

Prefixes are named by a chain of SHA-256 digests over (role, text), so after the first pass no text is moved.  A
prefix that very many conversations share is summed before the shuffle in every group-by, and joined by broadcast
where a join meets it.  Conversations are streamed through windows that spill, so a long one needs time but not memory.

Null roles and texts count as empty, null turns come first, rows of equal turn are ordered by role, then text; repeated
rows are turns of their own.  Rows without a conv_id belong to no conversation.  An empty table has no nodes.  Columns
other than conv_id, turn, role and text are ignored.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pulseloom.llm.tables import scratch, skew_join, stored

ROOT = hashlib.sha256(b"root").digest()
#: conv_ids of one piece of a list of members span at most so many numbers.
SPAN = 4096
#: Conversations that share their first turns in the query, and how many turns at most.
FAMILY, HEADS = 20, 4


def turns(conversations: DataFrame) -> DataFrame:
    """conv_id, place (from 1), key (digest of role and text), words: without texts."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), role, text)
    rows = conversations.where("conv_id is not null").select("conv_id", "turn", role.alias("role"), text.alias("text"))
    key = F.unhex(F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256))
    words = F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    return rows.select("conv_id", F.row_number().over(order).alias("place"), key.alias("key"), words.alias("words"))


def share_heads(rows: DataFrame, family: int = FAMILY, heads: int = HEADS) -> DataFrame:
    """turns() of conversations whose first turns are those of the first of their family.

    Conversation c has the first h turns of c - c % family, h = crc32(c) % heads, then its own after its first h.
    A conversation that is left without turns has one row with null place.
    """
    h = (F.crc32(F.col("conv_id").cast("string")) % heads).cast("int")
    convs = rows.select("conv_id").distinct().select("conv_id", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % family).alias("from"))
    given = rows.where((F.col("conv_id") % family == 0) & (F.col("place") < heads)).groupBy(F.col("conv_id").alias("from"))
    given = given.agg(F.sort_array(F.collect_list(F.struct("place", "key", "words"))).alias("given"))  # fewer than `heads`
    ready = convs.join(given, "from", "left").select("conv_id", "h", F.expr("slice(coalesce(given, array()), 1, h)").alias("given"))
    first = ready.select("conv_id", F.explode_outer("given").alias("t")).select("conv_id", "t.place", "t.key", "t.words")
    own = rows.where(F.col("place") > h).join(ready.select("conv_id", "h", F.size("given").alias("n")), "conv_id")
    return first.unionByName(own.select("conv_id", (F.col("place") - F.col("h") + F.col("n")).alias("place"), "key", "words"))


def _paths(rows: DataFrame) -> DataFrame:
    """conv_id, depth, name, parent, words, length: every occurrence of a prefix, that of no turn included."""
    top = F.when(F.col("place").isNull(), 0).otherwise(F.col("place"))
    whole = Window.partitionBy("conv_id")
    rows = rows.repartition("conv_id").withColumn("length", F.max(top).over(whole)).where("place is not null or length = 0")
    with_root = rows.withColumn("root", F.coalesce(F.col("place"), F.lit(1)) == 1).sortWithinPartitions("conv_id", "place")

    def run(batches):
        conv, name = None, b""
        for batch in batches:
            out = []
            for c, place, key, words, length, root in zip(*(batch.column(k).to_pylist() for k in ("conv_id", "place", "key", "words", "length", "root")), strict=True):
                if root:
                    conv, name = c, ROOT
                    out.append((c, 0, ROOT, None, 0, length))
                if place is not None:
                    if c != conv:
                        raise ValueError("a conversation's turns aren't together")
                    parent, name = name, hashlib.sha256(name + key).digest()
                    out.append((c, place, name, parent, words, length))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), _PATH.types, strict=True)], schema=_PATH)

    return with_root.select("conv_id", "place", "key", "words", "length", "root").mapInArrow(run, "conv_id long, depth int, name binary, parent binary, words long, length int")


_PATH = pa.schema([("conv_id", pa.int64()), ("depth", pa.int32()), ("name", pa.binary()), ("parent", pa.binary()), ("words", pa.int64()), ("length", pa.int32())])


def _ends(paths: DataFrame) -> DataFrame:
    """name, ends_sha256: the digest of the sorted conv_ids of the members that end at a node.

    Members are first gathered in pieces of near conv_ids, and a node's pieces are streamed in order through its digest.
    """
    piece = F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda c: c.cast("string")), ",")
    span = F.floor(F.col("conv_id") / SPAN)
    pieces = paths.where("depth = length").groupBy("name", span.alias("span")).agg(piece.alias("piece"))

    def run(batches):
        last, digest = None, None
        for batch in batches:
            names, done = [], []
            for name, piece in zip(batch.column("name").to_pylist(), batch.column("piece").to_pylist(), strict=True):
                if name == last:
                    digest.update(b",")
                else:
                    if last is not None:
                        names.append(last)
                        done.append(digest.hexdigest())
                    last, digest = name, hashlib.sha256()
                digest.update(piece.encode())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array(done, pa.string())], ["name", "ends_sha256"])
        if last is not None:
            yield pa.RecordBatch.from_arrays([pa.array([last], pa.binary()), pa.array([digest.hexdigest()])], ["name", "ends_sha256"])

    return pieces.repartition("name").sortWithinPartitions("name", "span").select("name", "piece").mapInArrow(run, "name binary, ends_sha256 string")


def trie(rows: DataFrame) -> DataFrame:
    """One row a node of the trie of turns(): conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    with scratch(rows.sparkSession):
        paths = stored(_paths(rows), "paths")
        found = paths.groupBy("name").agg(F.min("depth").alias("depth"), F.min("parent").alias("parent"), F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.max("length").alias("deepest"))
        nodes = stored(found, "nodes")
        # a conversation's owned nodes are those from its first owned depth on
        owned = nodes.groupBy("conv_id").agg(F.min("depth").alias("since"), F.max((F.col("deepest") == F.col("depth")).cast("int")).alias("leaf"))
        below = Window.partitionBy("conv_id").orderBy(F.desc("depth"))
        others = F.when(F.col("since").isNull() | (F.col("depth") < F.col("since")), F.col("words")).otherwise(0)
        marked = paths.join(owned, "conv_id", "left").select("name", F.sum(others).over(below).alias("others"), F.coalesce("leaf", F.lit(0)).alias("leaf"))
        sums = marked.groupBy("name").agg(F.sum("others").cast("long").alias("saved_tokens"), F.sum("leaf").cast("long").alias("n_leaves"))
        children = nodes.where("parent is not null").groupBy(F.col("parent").alias("name")).agg(F.count("*").alias("n_children"))
        # a node's parent has the same owner, unless it is the first that its owner owns
        first = nodes.join(owned.select("conv_id", F.col("since").alias("depth")), ["conv_id", "depth"], "left_semi").where("parent is not null").select("name", "parent")
        parents = skew_join(first, nodes.select(F.col("name").alias("parent"), F.col("conv_id").alias("above")), ["parent"]).select("name", "above")
        none = hashlib.sha256(b"").hexdigest()
        out = nodes.join(sums, "name").join(children, "name", "left").join(parents, "name", "left").join(_ends(paths), "name", "left")
        return stored(
            out.select(
                "conv_id", F.col("depth").cast("long").alias("depth"), F.when(F.col("parent").isNotNull(), F.coalesce("above", "conv_id")).alias("parent_conv_id"),
                "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"), "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"),
            ),
            "trie",
            outer=True,
        )


def family_trie(conversations: DataFrame) -> DataFrame:
    """The trie of conversations that share first turns by family."""
    with scratch(conversations.sparkSession):
        return stored(trie(share_heads(stored(turns(conversations), "turns"))), "trie", outer=True)


#: DuckDB's own: the standard CRC table from its polynomial, prefixes as lists, subtrees by joining lists' heads.
SQL = r"""
WITH t AS (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, b: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS v FROM range(256) r(i))),
c AS (SELECT DISTINCT conv_id FROM conversations WHERE conv_id IS NOT NULL),
h AS (SELECT conv_id, conv_id - conv_id % 20 AS donor, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
  lambda a, b: xor(a // 256, t[xor(a % 256, b) + 1])), 4294967295) % 4 AS h FROM c, t),
r AS (SELECT conv_id, {'role': coalesce(role, ''), 'text': coalesce(text, '')} AS x, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS k FROM conversations WHERE conv_id IS NOT NULL),
l AS (SELECT conv_id, list(x ORDER BY k) AS xs FROM r GROUP BY conv_id),
b AS (SELECT h.conv_id, list_concat(coalesce(d.xs[1:h], []), o.xs[h + 1:]) AS xs FROM h JOIN l o USING (conv_id) LEFT JOIN l d ON d.conv_id = h.donor),
m AS (SELECT conv_id, d, xs[1:d] AS p, len(xs) AS n FROM b, unnest(range(0, len(xs) + 1)) AS u(d)),
n AS (SELECT p, d, min(conv_id) AS conv_id, count(*) AS n_convs, max(n) = d AS leaf, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (n = d), '')) AS ends_sha256,
  CASE WHEN d = 0 THEN 0 ELSE len(regexp_extract_all(p[d].text, '[^\x20\x09-\x0D]+')) END AS words FROM m GROUP BY p, d),
s AS (SELECT a.p, sum((z.n_convs - 1) * z.words)::BIGINT AS saved_tokens, count(*) FILTER (z.leaf) AS n_leaves, count(*) FILTER (z.d = a.d + 1) AS n_children FROM n a JOIN n z ON z.d >= a.d AND z.p[1:a.d] = a.p GROUP BY a.p)
SELECT n.conv_id, n.d AS depth, q.conv_id AS parent_conv_id, n.n_convs, s.n_children, s.n_leaves, s.saved_tokens, n.ends_sha256
FROM n JOIN s ON s.p = n.p LEFT JOIN n q ON q.p = n.p[1:n.d - 1] AND q.d = n.d - 1 AND n.d > 0
"""

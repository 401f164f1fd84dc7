"""Repair of conversations' structure: the cheapest edits that make their roles follow the grammar (s?(ua)+)?.

Rows are shuffled by a hash of conv_id and sorted; each task streams its partition in lots of whole conversations, and runs
one DuckDB query a lot.  Its recursive part advances one turn a step for all conversations of the lot and keeps, for each
state of the grammar, the least cost with its audit (the edits' initials, ASCII-least among equals).  The state says which
role an edit may set, so an audit tells the whole repair.

Two audits of one state and one row never begin with each other at equal cost (the longer would have more inserts), so the
least audit of a state is always continued by the least one.

Nulls: a null role or text is one space (a blank text), a null turn comes first, a null conv_id is a conversation of its
own.  Rows of equal turn are ordered by role, then text; repeated rows are rows of their own, the later ones duplicates.
An empty table gives an empty result; columns other than conv_id, turn, role and text are ignored.  A conversation's
rows are held together in one task, as its audit and its repaired text are single values anyway.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows, and bytes of text, of a lot; a conversation is never parted.
ROWS, BYTES = 20_000, 8 << 20
#: Costs of edits.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5

OUT = pa.schema([
    ("conv_id", pa.int64()), ("gaps", pa.int64()), ("blank", pa.int64()), ("duplicate", pa.int64()), ("truncated", pa.int64()), ("illegal", pa.int64()),
    ("cost", pa.int64()), ("audit", pa.string()), ("repaired", pa.string()),
])

#: FAULTS numbers the conversations and rows of `lot` and finds faults; SOLVE finds the audits.  Before any row the state is '',
#: after one it is the last role's initial.  `moves` are the roles that the grammar lets follow each state.
FAULTS = r"""
WITH p AS (SELECT conv_id, turn, role, text, left(role, 1) AS initial,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k,
    NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS empty, regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') AS ended FROM lot WHERE NOT dropped),
q AS (SELECT *, lag(initial) OVER (PARTITION BY conv_id ORDER BY k) || initial AS pair, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY k) > 1 AS seen FROM p)
SELECT dense_rank() OVER (ORDER BY conv_id NULLS FIRST) AS c, conv_id, k, turn, role, text, initial, coalesce(pair NOT IN ('su', 'ua', 'au'), false) AS illegal,
    CASE WHEN empty THEN 'blank' WHEN seen THEN 'duplicate' WHEN NOT ended THEN 'truncated' END AS fault FROM q
"""
SOLVE = f"""
WITH RECURSIVE moves(state, role) AS (VALUES ('', 's'), ('', 'u'), ('s', 'u'), ('u', 'a'), ('a', 'u')),
fills(state, past, cost, audit) AS (
    SELECT state, state, 0, '' FROM (VALUES ('', ''), ('s', ''), ('u', ''), ('a', '')) v(state, x)
    UNION ALL SELECT state, role, {INSERT}, 'I' FROM moves WHERE role <> 's'
    UNION ALL SELECT m.state, o.role, {2 * INSERT}, 'II' FROM moves m JOIN moves o ON o.state = m.role WHERE m.role <> 's' AND o.role <> 's'),
best(c, state, k, b) USING KEY (c, state) AS (
    SELECT c, '' AS state, 0::BIGINT AS k, {{'cost': 0::BIGINT, 'audit': ''}} AS b FROM (SELECT DISTINCT c FROM r)
    UNION
    SELECT c, state, k, min(b) FROM (
        SELECT t.c, e.state, t.k + 1 AS k, {{'cost': t.b.cost + f.cost + e.cost, 'audit': t.b.audit || f.audit || e.edit}} AS b
        FROM best t JOIN r ON r.c = t.c AND r.k = t.k + 1 JOIN fills f ON f.state = t.state,
        LATERAL (
            SELECT f.past AS state, {DELETE} AS cost, 'D' AS edit
            UNION ALL SELECT m.role, CASE WHEN r.fault = 'truncated' THEN {TRUNCATED} ELSE 0 END + CASE WHEN m.role = r.initial THEN {KEEP} ELSE {REROLE} END, CASE WHEN m.role = r.initial THEN 'K' ELSE 'R' END
                FROM moves m WHERE m.state = f.past AND (m.role = r.initial OR m.role <> 's') AND coalesce(r.fault, '') NOT IN ('blank', 'duplicate')) e)
    GROUP BY c, state, k)
SELECT c, min({{'cost': b.cost + f.cost, 'audit': b.audit || f.audit}}) AS b
FROM best JOIN fills f ON f.state = best.state WHERE f.past IN ('', 'a') AND k = (SELECT max(k) FROM r WHERE r.c = best.c) GROUP BY c
"""
#: The edits of an audit, each with its row (the number of edits so far that take a row) and its place in what results.
REPAIRED = """
WITH e AS (SELECT c, i, b.audit[i] AS edit FROM solved, unnest(range(1, len(b.audit) + 1)) u(i)),
n AS (SELECT c, i, edit, CASE WHEN edit <> 'I' THEN count(*) FILTER (edit <> 'I') OVER w END AS k, count(*) FILTER (edit <> 'D') OVER w AS place FROM e WINDOW w AS (PARTITION BY c ORDER BY i)),
j AS (SELECT n.*, r.role, r.text, r.initial, bool_or(edit = 'K' AND initial = 's') OVER (PARTITION BY n.c) AS led FROM n LEFT JOIN r ON r.c = n.c AND r.k = n.k WHERE edit <> 'D')
SELECT c, string_agg(CASE WHEN edit = 'K' THEN role WHEN (place - led::INT) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || coalesce(text, ''), chr(10) ORDER BY i) AS repaired FROM j GROUP BY c
"""
REPORT = """
WITH a AS (SELECT DISTINCT conv_id FROM lot),
f AS (SELECT c, conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (illegal) AS illegal FROM r GROUP BY c, conv_id)
SELECT a.conv_id::BIGINT AS conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
    coalesce(illegal, 0)::BIGINT AS illegal, coalesce(b.cost, 0)::BIGINT AS cost, coalesce(b.audit, '') AS audit, coalesce(repaired, '') AS repaired
FROM a LEFT JOIN f ON f.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN solved s ON s.c = f.c LEFT JOIN fixed x ON x.c = f.c
"""


@lru_cache(maxsize=1)
def _duck():
    import duckdb

    con = duckdb.connect(config={"threads": 1, "memory_limit": "1GB", "temp_directory": ""})
    con.execute("SET enable_progress_bar = false")
    return con


def repair_lot(lot: pa.Table) -> pa.Table:
    """The report of OUT for whole conversations: rows of conv_id, turn, role, text, dropped."""
    con = _duck()
    con.register("lot", lot)
    try:
        for name, sql in (("r", FAULTS), ("solved", SOLVE), ("fixed", REPAIRED)):
            con.execute(f"CREATE OR REPLACE TEMP TABLE {name} AS {sql}")
        return con.sql(REPORT).to_arrow_table().cast(OUT)
    finally:
        con.unregister("lot")


def _lots(batches, key: str) -> Iterator[pa.Table]:
    """Rows sorted by key in lots that part no key."""
    held: list[pa.RecordBatch] = []
    n = size = 0
    times = 1
    for batch in batches:
        held.append(batch)
        n, size = n + batch.num_rows, size + batch.nbytes
        if n < times * ROWS and size < times * BYTES:
            continue
        whole = pa.Table.from_batches(held)
        keys = whole.column(key).combine_chunks()
        last = keys[-1]
        other = pa.compute.invert(pa.compute.is_null(keys)) if not last.is_valid else pa.compute.fill_null(pa.compute.not_equal(keys, last), True)
        low = int(pa.compute.sum(other).as_py() or 0)  # the last key's rows stand at the end
        if low:
            yield whole.slice(0, low)
        held, n = whole.slice(low).combine_chunks().to_batches(), whole.num_rows - low
        size = sum(b.nbytes for b in held)
        times = 1 + max(n // ROWS, size // BYTES) * 2  # a long conversation isn't joined anew with each batch
    if n:
        yield pa.Table.from_batches(held)


def repair(rows: DataFrame) -> DataFrame:
    """One row a conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired.

    rows: conv_id, turn, role, text and dropped, a boolean: such rows count only for their conversation being there.
    """

    def run(batches):
        for lot in _lots(batches, "conv_id"):
            yield from repair_lot(lot).to_batches()

    space = F.lit(" ")
    ready = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"), F.coalesce("dropped", F.lit(False)).alias("dropped"))
    ready = ready.repartition("conv_id").sortWithinPartitions("conv_id")
    return ready.mapInArrow(run, "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired string")


def damage(conversations: DataFrame) -> DataFrame:
    """Rows damaged by crc32 of "conv_id:turn" % 20: 0 drops, 1 empties, 2 takes [.!?] away, 3 repeats, 4 makes it the user's."""
    space = F.lit(" ")
    name = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    kind = (F.crc32(name) % 20).cast("int")
    rows = conversations.select("conv_id", "turn", F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    times = F.explode(F.sequence(F.lit(1), F.when(F.col("kind") == 3, 2).otherwise(1)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("kind") == 0).alias("dropped"), times.alias("copy")).drop("copy")


def repair_digests(conversations: DataFrame) -> DataFrame:
    """repair() of damaged conversations, with the digest of each repaired text in its place."""
    found = repair(damage(conversations))
    return found.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", F.sha2("repaired", 256).alias("repaired_sha256"))


#: Plain DuckDB over the whole table: every sequence of edits of a row is tried, all states kept as rows of one recursion.
SQL = rf"""
WITH RECURSIVE t AS (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, b: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS v FROM range(256) z(i))),
src AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda x: ascii(x)::BIGINT)),
  lambda a, b: xor(a // 256, t[xor(a % 256, b) + 1])), 4294967295) % 20 AS kind FROM conversations, t),
d AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM src, unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS u(x) WHERE kind <> 0),
o AS (SELECT *, left(role, 1) AS g, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k FROM d),
r AS (SELECT *, CASE WHEN len(regexp_extract_all(text, '[^\x20\x09-\x0D]')) = 0 THEN 'b' WHEN EXISTS (SELECT 1 FROM o y WHERE y.conv_id IS NOT DISTINCT FROM o.conv_id AND y.k < o.k AND y.role = o.role AND y.text = o.text) THEN 'd'
  WHEN regexp_extract_all(text, '[^\x20\x09-\x0D]')[-1] NOT IN ('.', '!', '?') THEN 't' ELSE '-' END AS f, lag(g) OVER (PARTITION BY conv_id ORDER BY k) || g AS gg FROM o),
s(conv_id, k, q, cost, audit, body) AS (
  SELECT DISTINCT conv_id, 0::BIGINT, '0', 0::BIGINT, '', '' FROM r
  UNION ALL
  SELECT conv_id, k, q, cost, audit, body FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, q ORDER BY cost, audit) AS best FROM (
    WITH i0 AS (SELECT * FROM s), i1 AS (SELECT conv_id, k, CASE q WHEN 'u' THEN 'a' ELSE 'u' END AS q, cost + 5 AS cost, audit || 'I' AS audit, body || CASE q WHEN 'u' THEN 'assistant:' ELSE 'user:' END || chr(10) AS body FROM i0),
    i2 AS (SELECT conv_id, k, CASE q WHEN 'u' THEN 'a' ELSE 'u' END AS q, cost + 5 AS cost, audit || 'I' AS audit, body || CASE q WHEN 'u' THEN 'assistant:' ELSE 'user:' END || chr(10) AS body FROM i1),
    i AS (SELECT * FROM i0 UNION ALL SELECT * FROM i1 UNION ALL SELECT * FROM i2)
    SELECT i.conv_id, i.k + 1 AS k, i.q, i.cost + 2 AS cost, i.audit || 'D' AS audit, i.body FROM i JOIN r ON r.conv_id IS NOT DISTINCT FROM i.conv_id AND r.k = i.k + 1
    UNION ALL SELECT i.conv_id, i.k + 1, g, i.cost + CASE f WHEN 't' THEN 5 ELSE 0 END, i.audit || 'K', i.body || role || ':' || text || chr(10) FROM i JOIN r ON r.conv_id IS NOT DISTINCT FROM i.conv_id AND r.k = i.k + 1
      WHERE f IN ('-', 't') AND i.q || g IN ('0s', '0u', 'su', 'ua', 'au')
    UNION ALL SELECT i.conv_id, i.k + 1, CASE i.q WHEN 'u' THEN 'a' ELSE 'u' END, i.cost + 1 + CASE f WHEN 't' THEN 5 ELSE 0 END, i.audit || 'R', i.body || CASE i.q WHEN 'u' THEN 'assistant:' ELSE 'user:' END || text || chr(10) FROM i JOIN r ON r.conv_id IS NOT DISTINCT FROM i.conv_id AND r.k = i.k + 1
      WHERE f IN ('-', 't')) x) y WHERE best = 1),
z AS (SELECT conv_id, q, cost, audit, body FROM s WHERE k = (SELECT max(k) FROM r WHERE r.conv_id IS NOT DISTINCT FROM s.conv_id)),
w AS (SELECT conv_id, q, cost, audit, body FROM z UNION ALL SELECT conv_id, 'a', cost + 5, audit || 'I', body || 'assistant:' || chr(10) FROM z WHERE q = 'u'
  UNION ALL SELECT conv_id, 'a', cost + 10, audit || 'II', body || 'user:' || chr(10) || 'assistant:' || chr(10) FROM z WHERE q IN ('0', 's', 'a')),
e AS (SELECT * FROM w WHERE q IN ('0', 'a') QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY cost, audit) = 1),
n AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (f = 'b') AS blank, count(*) FILTER (f = 'd') AS duplicate, count(*) FILTER (f = 't') AS truncated,
  count(*) FILTER (gg NOT IN ('su', 'ua', 'au')) AS illegal FROM r GROUP BY conv_id)
SELECT a.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, sha256(CASE WHEN len(coalesce(body, '')) > 0 THEN left(body, len(body) - 1) ELSE '' END) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN n ON n.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN e ON e.conv_id IS NOT DISTINCT FROM a.conv_id
"""

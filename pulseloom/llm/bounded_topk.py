"""Exact top-k by inner product of integer vectors: columnar branch and bound.

Candidates are dealt into blocks, kept dimension by dimension (vertically).  For some queries at a time, inner
products are summed over one group of dimensions after the other, those with most mass first; what the rest can
still add is at most the product of the two remaining lengths, and candidates whose bound falls below the k-th
best score known for every query at hand are dropped from the block.  Every block gives its k best a query, and
the best of these are the result.  Nothing is approximate.

Vectors become floor(scale * x).  Those that are null or hold null or non-finite components take no part, nor do
candidates whose width differs from the query's.  Ties go to the smaller id; rows with the query's own id are no
candidates; rows that repeat another id each count.  Scores beyond 64 bits count as the nearest long.  Empty
tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LARGEST = 9.2e18  # below the largest long
QUERIES, CANDIDATES, AT_ONCE, DIMENSIONS, SEEDS = 1024, 8192, 16, 8, 128


def _best(query_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int):
    """(query, candidate, score) of each query's k best; q is query x dimension, x dimension x candidate, both whole numbers."""
    exact = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * max(len(x), 1) < 2**53
    if not exact:
        q, x = (np.array([[int(v) for v in r] for r in m], object).reshape(m.shape) for m in (q, x))
    mass = (x.astype(float) ** 2).sum(1) if len(x) else np.zeros(0)
    order = np.argsort(-mass, kind="stable")
    q, x = q[:, order], x[order]
    cuts = list(range(0, len(x), DIMENSIONS)) or [0]
    lengths = lambda m, axis: [np.sqrt((np.take(m, range(c, m.shape[axis]), axis).astype(float) ** 2).sum(axis)) for c in [*cuts[1:], m.shape[axis]]]
    rest_q, rest_x = lengths(q, 1), lengths(x, 0)
    seeds = np.argsort(-np.sqrt((x.astype(float) ** 2).sum(0)), kind="stable")[:SEEDS]
    for low in range(0, len(q), AT_ONCE):
        rows = slice(low, low + AT_ONCE)
        own = query_ids[rows, None] == ids[None]
        known = (q[rows] @ x[:, seeds]).astype(float) if len(x) else np.zeros((len(q[rows]), len(seeds)))
        known[own[:, seeds]] = -np.inf
        floor = np.sort(known, 1)[:, -k] if known.shape[1] >= k else np.full(len(known), -np.inf)
        floor = np.minimum(floor, LARGEST)
        live = np.arange(len(ids))
        score = np.zeros((len(known), len(ids)), q.dtype)
        for step, c in enumerate(cuts):
            score = score + q[rows, c : c + DIMENSIONS] @ x[c : c + DIMENSIONS][:, live]
            bound = score.astype(float) + rest_q[step][rows, None] * rest_x[step][None, live]
            bound += np.abs(bound) * 1e-9 + 1e-6
            keep = np.flatnonzero((bound >= floor[:, None]).any(0))
            live, score = live[keep], score[:, keep]
        if not exact:
            score = np.array([[min(max(s, -(2**63)), 2**63 - 1) for s in r] for r in score], object).reshape(score.shape)
        for r, query in enumerate(query_ids[rows]):
            some = np.flatnonzero(~own[r, live])
            first = np.lexsort((ids[live[some]], -score[r, some]))[:k] if exact else sorted(range(len(some)), key=lambda s: (-score[r, some[s]], int(ids[live[some[s]]])))[:k]
            for s in first:
                yield query, ids[live[some[s]]], score[r, some[s]]


def top_k(vectors: DataFrame, queries: Column, k: int = 10, scale: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), id and score of the k best of all rows for each row that `queries` marks."""
    x = F.col(vector_col)
    good = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))
    rows = vectors.where(x.isNotNull() & F.forall(x, good) & F.col(id_col).isNotNull())
    number = lambda v: v.cast("double") * float(scale)
    # floor() gives a long in Spark; whole doubles need none
    whole = F.transform(x, lambda v: F.when(F.abs(number(v)) < 2.0**53, F.floor(number(v)).cast("double")).otherwise(number(v)))
    rows = rows.select(F.col(id_col).cast("long").alias("id"), whole.alias("x"), F.size(x).alias("width"), F.coalesce(queries, F.lit(False)).alias("asks"))
    n, asked = rows.agg(F.count("*"), F.count_if("asks")).first()
    sides = max(1, -(-asked // QUERIES)), max(1, -(-n // CANDIDATES))
    deal = lambda df, own, other, m, o: df.withColumn(own, F.pmod(F.xxhash64("id"), F.lit(m)).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(o - 1))))
    left = deal(rows.where("asks").select("id", "x", "width"), "q", "c", sides[0], sides[1])
    right = deal(rows.select("id", "x", "width"), "c", "q", sides[1], sides[0])
    schema = pa.schema([("query_id", pa.int64()), ("id", pa.int64()), ("score", pa.int64())])

    def block(a: pa.Table, b: pa.Table) -> pa.Table:
        out = []
        if a.num_rows and b.num_rows:
            width = a.column("width")[0].as_py()
            a, b = a.sort_by("id"), b.sort_by("id")
            m = [np.asarray(t.column("x").combine_chunks().flatten(), np.float64).reshape(t.num_rows, width) for t in (a, b)]
            out = [(int(s), int(i), int(v)) for s, i, v in _best(a.column("id").to_numpy(), m[0], b.column("id").to_numpy(), np.ascontiguousarray(m[1].T), k)]
        return pa.table([pa.array(c, pa.int64()) for c in zip(*out, strict=True)] if out else [pa.array([], pa.int64())] * 3, schema=schema)

    keys = ["width", "q", "c"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(block, "query_id long, id long, score long")
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(id_col), "score")

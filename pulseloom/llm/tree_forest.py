"""Near-duplicate vectors by a forest of random-projection trees.

Each tree splits the unit vectors by random directions, again and again, at the median of a sample of the node's
rows; vectors close to a threshold go to both sides.  The first levels are fitted on a sample of SAMPLE vectors, and
nodes that are still large after them on samples of their own rows, SPLIT of each, pass after pass, so leaves keep
their size however large the table is.  A node that hardly parts its rows stays whole.  The vectors of a leaf are
compared exactly, in double precision, in tiles of bounded size.  A pair that meets in several leaves counts in the
first of them alone, which both vectors' lists of leaves tell, so no pairs leave a tile: only each vector's number
of new links, and links enough to join the tile's components.

The number of trees follows from the depth and the spill: a pair at the threshold is missed by all of them with
probability MISSED (by the chance that random directions part it), a closer pair less.

Vectors of a dense region, found around vectors of the sample, that all lie within half the threshold's angle of its
centre are linked with each other without being compared: a ball.  A group of near copies that holds a large share
of all rows so costs a comparison a row with what lies around it, not one a pair.  Equal vectors are joined first
and stand for one.  Vectors of each width have a forest of their own; those of different widths never link.

Vectors that are null, empty or zero, or hold null or non-finite components, link with nothing.  Rows that
repeat an id are vectors of their own, also where these differ: the nodes of all links are different vectors, not ids.  An empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pulseloom.llm.components import connected_components
from pulseloom.llm.tables import scratch, skew_join, stored

SPILL = 0.25  # of the standard deviation, along a direction, of what parts two vectors at the threshold
MISSED = 1e-3
LEAF = 1000  # rows of a leaf, if medians held for all
SPLIT, LEVELS = 512, 5  # sampled rows of a large node, and levels fitted on them
DEEPEST = 9  # levels fitted on the first sample
TILE = 1024
SAMPLE = 20_000
BALLS, DENSE = 64, 50  # balls at most, and sampled rows in one at least
_SEED = 20240302
_DONE = 1 << 55  # a leaf's code: tree, whether it stays whole, and its path as a heap index


def usable(vector: str):
    """Whether a vector has finite components, not all zero."""
    x = F.col(vector)
    good = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))
    return F.coalesce(x.isNotNull() & F.forall(x, good), F.lit(False))


def parted(least: float) -> float:
    """The chance that one split parts a pair at the threshold: the expected gap beyond the spill, by the density at the median."""
    a = 2 * SPILL
    beyond = 2 * (math.exp(-a * a / 2) / math.sqrt(2 * math.pi) - a * math.erfc(a / math.sqrt(2)) / 2)
    return beyond * math.sqrt(max(2 - 2 * least, 1e-6)) / math.sqrt(2 * math.pi)


def trees_for(depth: int, least: float) -> int:
    if not depth:
        return 1
    return min(60, max(2, math.ceil(math.log(MISSED) / math.log1p(-((1 - parted(least)) ** depth)))))


def spill_of(width: int, least: float) -> float:
    return SPILL * math.sqrt(max(2 - 2 * least, 1e-6) / width)


class Tree:
    """Directions and thresholds of a binary tree under one node; the children of k are 2k + 1 and 2k + 2, and a threshold of NaN ends a path."""

    def __init__(self, seed: tuple[int, ...], depth: int, width: int, thresholds: np.ndarray | None = None):
        rng = np.random.default_rng(seed)
        self.directions = rng.standard_normal(((1 << depth) - 1, width))
        self.directions /= np.linalg.norm(self.directions, axis=1, keepdims=True)
        self.thresholds, self.depth = thresholds, depth

    def fit(self, sample: np.ndarray, spill: float) -> Tree:
        self.thresholds = np.full(len(self.directions), np.nan)
        inside = {0: np.arange(len(sample))}
        for k in range(len(self.directions)):
            rows = inside.pop(k, np.zeros(0, np.int64))
            if len(rows) < 8:
                continue
            here = sample[rows] @ self.directions[k]
            at = float(np.median(here))
            if (np.abs(here - at) < spill).mean() > 0.5:
                continue
            self.thresholds[k] = at
            inside[2 * k + 1], inside[2 * k + 2] = rows[here < at], rows[here >= at]
        return self

    def leaves(self, x: np.ndarray, spill: float) -> tuple[np.ndarray, np.ndarray]:
        """(row, path) of every leaf that a row goes to; a path is a heap index from 1."""
        row, path, done = np.arange(len(x)), np.ones(len(x), np.int64), []
        for _ in range(self.depth):
            at = self.thresholds[path - 1]
            ends = np.isnan(at)
            done.append((row[ends], path[ends]))
            row, path, at = row[~ends], path[~ends], at[~ends]
            side = np.einsum("ij,ij->i", x[row], self.directions[path - 1]) - at
            low, high = np.flatnonzero(side < spill), np.flatnonzero(side >= -spill)
            row, path = np.concatenate([row[low], row[high]]), np.concatenate([2 * path[low], 2 * path[high] + 1])
        done.append((row, path))
        return tuple(np.concatenate([d[k] for d in done]) for k in (0, 1))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    flat = np.asarray(column.flatten(), dtype=np.float64)
    x = flat.reshape(-1, width)
    peak = np.abs(x).max(1, keepdims=True)
    x = x / peak  # so that squares neither overflow nor vanish
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _lists(row: np.ndarray, value: np.ndarray, n: int) -> pa.Array:
    order = np.lexsort((value, row))
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(row[order], np.arange(n + 1)), pa.int32()), pa.array(value[order]))


def _centres(sample: np.ndarray, half: float) -> np.ndarray:
    """Centres of dense regions of the sample: vectors with many others within the angle, greedily."""
    free, out = np.ones(len(sample), bool), []
    tried = sample[:2000]
    near = tried @ sample.T >= half
    while len(out) < BALLS:
        size = (near & free[None]).sum(1)
        k = int(size.argmax()) if len(size) else 0
        if not len(size) or size[k] < DENSE:
            break
        out.append(tried[k])
        free &= ~near[k]
    return np.array(out).reshape(-1, sample.shape[1])


def _earlier(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    """Whether rows of two tiles share one of the leaves listed."""
    flat = [np.concatenate(v) if v else np.zeros(0, np.int64) for v in (x, y)]
    every = np.intersect1d(*flat)
    marks = []
    for rows, codes in zip((x, y), flat, strict=True):
        m = np.zeros((len(rows), len(every)), np.float32)
        at = np.minimum(np.searchsorted(every, codes), max(len(every) - 1, 0))
        hit = np.flatnonzero(every[at] == codes) if len(every) else np.zeros(0, np.int64)
        m[np.repeat(np.arange(len(rows)), [len(r) for r in rows])[hit], at[hit]] = 1
        marks.append(m)
    return marks[0] @ marks[1].T > 0


def near_vectors(vectors: DataFrame, least: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Per row: id, n_links (other vectors linked directly), component_id (smallest id within reach), kept."""
    kind = vectors.schema[vector_col].dataType.elementType.simpleString()
    kind = kind if kind in ("float", "double") else "double"
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast(f"array<{kind}>").alias("x"))
    some = usable("x") & F.exists("x", lambda v: v != 0) & F.col("id").isNotNull()
    out = [F.col("id").alias(id_col), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept")]
    with scratch(vectors.sparkSession):
        fit = rows.where(some).withColumn("x", F.transform("x", lambda v: F.when(v == 0, F.lit(0).cast(kind)).otherwise(v)))
        # id is from here on the number of a different vector, fixed as it is written; low is the smallest vec_id that has it
        lone = stored(fit.groupBy("x").agg(F.min("id").alias("low"), F.count("*").alias("weight")).withColumn("id", F.monotonically_increasing_id()), "vectors")
        counts = {r["width"]: r["count"] for r in lone.groupBy(F.size("x").alias("width")).count().collect()}
        if not counts:
            return stored(rows.select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id")).select(*out), "result", outer=True)
        placed = _deep(stored(_first(lone, counts, least, kind), "placed"), least)
        found = stored(_compared(placed, least), "links")
        balls = stored(placed.where("ball >= 0").groupBy("width", "ball").agg(F.min("id").alias("to"), F.sum("weight").alias("size")), "balls")  # BALLS a width at most
        inside = placed.where("ball >= 0").select("id", "weight", "width", "ball").join(F.broadcast(balls), ["width", "ball"])
        edges = found.select(F.col("id").alias("a"), F.col("to").alias("b")).union(inside.select("id", "to"))
        components = connected_components(edges)
        links = found.select("id", "links").union(inside.select("id", F.col("size") - F.col("weight"))).groupBy("id").agg(F.sum("links").alias("links"))
        classes = lone.join(links, "id", "left").join(components.withColumnRenamed("node", "id"), "id", "left")
        classes = stored(classes.select("x", "low", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "id").alias("component")), "classes")
        classes = skew_join(classes.drop("low"), classes.groupBy("component").agg(F.min("low").alias("component_id")), ["component"])
        done = fit.join(classes, "x").select("id", "n_links", "component_id")
        rest = rows.where(~F.coalesce(some, F.lit(False)))
        return stored(done.union(rest.select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))).select(*out), "result", outer=True)


def _first(lone: DataFrame, counts: dict[int, int], least: float, kind: str) -> DataFrame:
    """id, weight, width, x, ball (-1: none) and leaves after the levels fitted on the first sample."""
    models = {}
    half = math.cos(math.acos(least) / 2) + 1e-9
    for width, n in counts.items():
        depth = max(0, math.ceil(math.log2(n / LEAF)))
        if not depth:  # one leaf holds all
            models[width] = [Tree((_SEED,), 0, width, np.zeros(0))], np.zeros((0, width))
            continue
        held = lone.select("x").where((F.size("x") == width) & (F.pmod(F.xxhash64("x"), F.lit(1_000_000)) < int(1_000_000 * min(1.0, SAMPLE / n)) + 1)).limit(2 * SAMPLE).toArrow().column("x").combine_chunks()
        sample = _matrix(held, width)
        sample = sample[np.lexsort(sample.T[:3])]
        sample = sample[np.random.default_rng(_SEED).permutation(len(sample))]
        centres = _centres(sample, half)
        if len(centres):  # trees part what is not in a ball
            inside = (sample @ centres.T >= half).any(1)
            sample = np.concatenate([sample[~inside], centres])
        models[width] = [Tree((_SEED, t), min(depth, DEEPEST), width).fit(sample, spill_of(width, least)) for t in range(trees_for(depth, least))], centres

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for mixed in batches:
            widths = mixed.column("x").value_lengths().to_numpy()
            for width in np.unique(widths).tolist():
                batch = mixed.take(pa.array(np.flatnonzero(widths == width)))
                x, (trees, centres) = _matrix(batch.column("x"), width), models[width]
                found = [(row, path + (t << 56)) for t, tree in enumerate(trees) for row, path in [tree.leaves(x, spill_of(width, least))]]
                row, leaf = (np.concatenate([f[k] for f in found]) for k in (0, 1))
                ball = np.full(len(x), -1)
                if len(centres):
                    near = x @ centres.T
                    ball = np.where(near.max(1) >= half, near.argmax(1), -1)
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("weight"), pa.array(np.full(len(x), width), pa.int32()), batch.column("x"), pa.array(ball, pa.int32()), _lists(row, leaf, len(x))], ["id", "weight", "width", "x", "ball", "leaves"])

    return lone.select("id", "weight", "x").mapInArrow(deal, f"id long, weight long, width int, x array<{kind}>, ball int, leaves array<long>")


def _deep(placed: DataFrame, least: float) -> DataFrame:
    """placed with large leaves split by trees fitted on their own rows, until none is large that can be split."""
    while True:
        each = placed.select("id", "width", "x", "ball", F.explode("leaves").alias("leaf")).where(F.col("leaf").bitwiseAND(_DONE) == 0)
        large = each.where("ball < 0").groupBy("width", "leaf").count().where(F.col("count") > 4 * LEAF)
        large = stored(large, "large")
        if large.isEmpty():
            return placed
        order = F.row_number().over(Window.partitionBy("width", "leaf").orderBy(F.xxhash64("id"), "id"))
        sample = each.where("ball < 0").join(large, ["width", "leaf"]).withColumn("k", order).where(F.col("k") <= SPLIT)

        def tree(group: pa.Table) -> pa.Table:
            width, leaf, count = (group.column(c)[0].as_py() for c in ("width", "leaf", "count"))
            depth = min(LEVELS, math.ceil(math.log2(count / LEAF)))
            x = _matrix(group.sort_by("k").column("x").combine_chunks(), width)
            fitted = Tree((_SEED, leaf), depth, width).fit(x, spill_of(width, least))
            return pa.table({"width": pa.array([width], pa.int32()), "leaf": pa.array([leaf], pa.int64()), "depth": pa.array([depth], pa.int32()), "thresholds": [fitted.thresholds.tolist()]})

        models = stored(sample.groupBy("width", "leaf").applyInArrow(tree, "width int, leaf long, depth int, thresholds array<double>"), "trees")

        def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                leaf, width = batch.column("leaf").to_numpy(), batch.column("width").to_numpy()
                for w, node in sorted(set(zip(width.tolist(), leaf.tolist(), strict=True))):
                    part = batch.take(pa.array(np.flatnonzero((leaf == node) & (width == w))))
                    depth, thresholds = part.column("depth")[0].as_py(), part.column("thresholds")[0].values.to_numpy(zero_copy_only=False)
                    row, path = Tree((_SEED, node), depth, w, thresholds).leaves(_matrix(part.column("x"), w), spill_of(w, least))
                    high, own = node >> 56 << 56, node & (_DONE - 1)
                    level = np.floor(np.log2(path)).astype(np.int64)
                    whole = np.append(np.isnan(thresholds), False)[np.minimum(path - 1, len(thresholds))]
                    new = high + (own << level) + (path - (1 << level)) + whole * _DONE
                    yield pa.RecordBatch.from_arrays([part.column("id"), part.column("leaf"), _lists(row, new, part.num_rows)], ["id", "leaf", "parts"])

        parts = each.join(models, ["width", "leaf"]).select("id", "leaf", "width", "depth", "thresholds", "x").mapInArrow(split, "id long, leaf long, parts array<long>")
        parts = parts.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("leaf", "parts"))).alias("new"))
        joined = placed.join(parts, "id", "left")
        leaves = F.array_sort(F.flatten(F.transform("leaves", lambda k: F.coalesce(F.try_element_at("new", k), F.array(k)))))
        placed = stored(joined.select("id", "weight", "width", "x", "ball", F.when(F.col("new").isNull(), F.col("leaves")).otherwise(leaves).alias("leaves")), "placed")


def _compared(placed: DataFrame, least: float) -> DataFrame:
    """id, links and the smallest id of its component for the vectors of each tile; pairs of one ball are left out."""
    each = placed.withColumn("leaf", F.explode("leaves"))
    # leaves that came out large are cut into chunks, and all pairs of chunks compared but those of the leaf's main ball
    sizes = each.groupBy("width", "leaf", "ball").count()
    chunks = lambda c: F.ceil(F.coalesce(c, F.lit(0)) / F.lit(TILE)).cast("int")
    by = sizes.groupBy("width", "leaf").agg(F.max_by("ball", F.struct(F.when(F.col("ball") >= 0, F.col("count")).otherwise(-1), "ball")).alias("main"), F.sum("count").alias("all"), F.max(F.when(F.col("ball") >= 0, F.col("count"))).alias("most"))
    by = by.where("all > 1").select("width", "leaf", "main", chunks(F.col("most")).alias("balled"), chunks(F.col("all") - F.coalesce("most", F.lit(0))).alias("free"))
    held = each.join(by, ["width", "leaf"])
    core = (F.col("ball") >= 0) & (F.col("ball") == F.col("main"))
    chunk = F.when(core, F.pmod(F.xxhash64("id"), "balled")).otherwise(F.col("balled") + F.pmod(F.xxhash64("id"), "free")).cast("int")
    last = F.col("balled") + F.col("free") - 1
    others = F.when(core, F.when(F.col("free") > 0, F.sequence("balled", last))).otherwise(F.sequence(F.lit(0), last))
    held = held.withColumns({"chunk": chunk, "other": F.explode(others)})
    tiles = held.select("width", "leaf", F.least("chunk", "other").alias("low"), F.greatest("chunk", "other").alias("high"), "chunk", "id", "weight", "x", "ball", F.filter("leaves", lambda k: k < F.col("leaf")).alias("before"))

    def compare(group: pa.Table) -> pa.Table:
        width, low, high = (group.column(c)[0].as_py() for c in ("width", "low", "high"))
        group = group.sort_by("id")
        chunk, ball = group.column("chunk").to_numpy(), group.column("ball").to_numpy()
        x, ids, weight = _matrix(group.column("x").combine_chunks(), width), group.column("id").to_numpy(), group.column("weight").to_numpy()
        a, b = np.flatnonzero(chunk == low), np.flatnonzero(chunk == high)
        # single precision first; what lies near the threshold again in double
        brief = x.astype(np.float32)
        close = brief[a] @ brief[b].T
        margin = 1e-6 + 2.4e-7 * width
        linked = close >= least - margin
        if low == high:
            linked &= a[:, None] < b[None]
        linked &= (ball[a][:, None] < 0) | (ball[a][:, None] != ball[b][None])
        i, j = np.nonzero(linked & (close <= least + margin))
        linked[i, j] = np.einsum("ij,ij->i", x[a[i]], x[b[j]]) >= least
        use_a, use_b = linked.any(1), linked.any(0)
        if not use_a.any():
            return pa.table({"id": pa.array([], pa.int64()), "links": pa.array([], pa.int64()), "to": pa.array([], pa.int64())})
        linked, a, b = linked[np.ix_(use_a, use_b)], a[use_a], b[use_b]
        joined = linked
        before = group.column("before").combine_chunks()
        flat, bounds = np.asarray(before.flatten()), np.concatenate([[0], np.cumsum(before.value_lengths())])
        lists = lambda rows: [flat[bounds[k] : bounds[k + 1]] for k in rows.tolist()]
        linked = linked & ~_earlier(lists(a), lists(b))
        count = np.zeros(len(ids), np.int64)
        np.add.at(count, a, linked @ weight[b])
        np.add.at(count, b, linked.T @ weight[a])
        # a link for each vector to the smallest of its component within the tile
        root = np.arange(len(ids))
        while True:
            least_b = np.where(joined, root[a][:, None], len(ids)).min(0)
            new = root.copy()
            np.minimum.at(new, b, least_b)
            np.minimum.at(new, a, np.where(joined, new[b][None], len(ids)).min(1))
            if (new == root).all():
                break
            root = new
        seen = np.unique(np.concatenate([a, b]))
        return pa.table({"id": ids[seen], "links": count[seen], "to": ids[root[seen]]})

    return tiles.groupBy("width", "leaf", "low", "high").applyInArrow(compare, "id long, links long, to long")

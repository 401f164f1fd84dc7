import numpy as np
import pytest
from pyspark.sql import functions as F

from pulseloom.llm import bounded_topk, tree_forest
from pulseloom.llm.tree_forest import near_vectors
from tests.llm.test_tensored import lowest

NAN, INF = float("nan"), float("inf")


def brute_force(rows, least):
    good = {k: np.array(v, float) for k, v in rows if v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    ids = list(good)
    unit = np.array([good[k] / np.linalg.norm(good[k]) for k in ids])
    linked = unit @ unit.T >= least
    edges = [(ids[i], ids[j]) for i, j in zip(*np.nonzero(np.triu(linked, 1)), strict=True)]
    root = lowest([k for k, _ in rows], edges)
    links = {k: int(linked[i].sum()) - 1 for i, k in enumerate(ids)}
    return sorted((k, links.get(k, 0), root[k], root[k] == k) for k, _ in rows)


@pytest.mark.parametrize("leaf,tile", [(1500, 1024), (40, 16)])
def test_equals_brute_force(spark, monkeypatch, leaf, tile):
    monkeypatch.setattr(tree_forest, "LEAF", leaf)
    monkeypatch.setattr(tree_forest, "TILE", tile)
    rng = np.random.default_rng(4)
    rows = []
    for size in [1] * 200 + [2, 3, 5, 60]:
        base = rng.standard_normal(16)
        rows += [base + 0.02 * rng.standard_normal(16) for _ in range(size)]
    rows += [rows[7] * 2, rows[7], rows[7], rows[250]]
    rows = [(k, [float(np.float32(x)) for x in v]) for k, v in enumerate(rows)]
    rows += [(1000, None), (1001, [0.0] * 16), (1002, [NAN] * 16), (1003, [None] + [1.0] * 15), (1004, [INF] * 16), (1005, [])]
    df = spark.createDataFrame([(k, v, 1) for k, v in rows], "vec_id long, embedding array<float>, n_links int")
    assert sorted(map(tuple, near_vectors(df).collect())) == brute_force(rows, 0.95)


@pytest.mark.parametrize("leaf,tile", [(1500, 1024), (40, 16)])
def test_every_width_is_compared(spark, monkeypatch, leaf, tile):
    monkeypatch.setattr(tree_forest, "LEAF", leaf)
    monkeypatch.setattr(tree_forest, "TILE", tile)
    rng = np.random.default_rng(5)
    rows = []
    for width, groups in ((16, [1] * 150 + [2, 3, 50]), (12, [1] * 80 + [2, 2, 30]), (2, [1, 2])):
        for size in groups:
            base = rng.standard_normal(width)
            rows += [(base + 0.02 * rng.standard_normal(width)).tolist() for _ in range(size)]
    rows.append(rows[-1])
    rows += [[1.0] * 16, [1.0] * 12, [1.0] * 12, [0.0] * 12]
    rows = [(k, v) for k, v in enumerate(rows[i] for i in rng.permutation(len(rows)))]
    want = []
    for width in (16, 12, 2):
        want += brute_force([r for r in rows if len(r[1]) == width], 0.95)
    assert sum(n > 0 for k, n, _, _ in want if len(rows[k][1]) < 16) > 30
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted(map(tuple, near_vectors(df).collect())) == sorted(want)


def test_without_vectors(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert near_vectors(df).count() == 0
    df = spark.createDataFrame([(1, None), (2, [0.0])], "vec_id long, embedding array<float>")
    assert sorted(map(tuple, near_vectors(df).collect())) == [(1, 0, 1, True), (2, 0, 2, True)]


def exact_best(rows, k=10):
    good = [(i, [int(np.floor(1024.0 * float(x))) for x in v]) for i, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for i, q in good:
        if i % 100 == 0:
            found = sorted((-max(min(sum(a * b for a, b in zip(q, v, strict=True)), 2**63 - 1), -(2**63)), j) for j, v in good if j != i and len(v) == len(q))[:k]
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(found)]
    return sorted(out)


@pytest.mark.parametrize("case", ["normal", "ties", "small blocks", "huge", "few"])
def test_top_k_equals_brute_force(spark, monkeypatch, case):
    if case == "small blocks":
        monkeypatch.setattr(bounded_topk, "QUERIES", 2)
        monkeypatch.setattr(bounded_topk, "CANDIDATES", 50)
    rng = np.random.default_rng(9)
    x = rng.standard_normal((7 if case == "few" else 450, 20)).astype(np.float32)
    if case == "ties":
        x = np.round(x)
    if case == "huge":
        x[:20] *= np.float32(1e30)
        x[20:60] *= np.float32(1e6)
    rows = [(k, v.tolist()) for k, v in enumerate(x)]
    rows += [(500, None), (501, [NAN] * 20), (502, [None] * 20), (503, [INF] * 20), (600, [1.0, 2.0]), (601, [1.0, 1.0]), (700, [])]
    df = spark.createDataFrame([(k, v, 0) for k, v in rows], "vec_id long, embedding array<float>, rank int")
    assert sorted(map(tuple, bounded_topk.top_k(df, F.col("vec_id") % 100 == 0).collect())) == exact_best(rows)


def test_top_k_of_nothing(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert bounded_topk.top_k(df, F.col("vec_id") % 100 == 0).count() == 0


def near_pairs(rng, n, width, cosine):
    """n pairs of random directions, each with the cosine given."""
    one = rng.standard_normal((n, width))
    one /= np.linalg.norm(one, axis=1, keepdims=True)
    off = rng.standard_normal((n, width))
    off -= (off * one).sum(1, keepdims=True) * one
    off /= np.linalg.norm(off, axis=1, keepdims=True)
    return np.stack([one, cosine * one + np.sqrt(1 - cosine**2) * off], 1).reshape(-1, width).astype(np.float32)


def test_recall_at_the_threshold_with_several_passes(spark, monkeypatch):
    """4,000 pairs at 0.951 to 0.96, leaves of about 30 rows: two levels on the first sample, then passes over large nodes."""
    monkeypatch.setattr(tree_forest, "LEAF", 30)
    monkeypatch.setattr(tree_forest, "DEEPEST", 2)
    rng = np.random.default_rng(11)
    x = np.concatenate([near_pairs(rng, 1000, 48, c) for c in (0.951, 0.953, 0.956, 0.96)])
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = {r.vec_id: (r.n_links, r.component_id) for r in near_vectors(df).collect()}
    found = sum(got[k] == (1, k) and got[k + 1] == (1, k) for k in range(0, len(x), 2))
    assert found >= 0.99 * 4000 and all(n <= 1 for n, _ in got.values())


def test_a_large_group_of_near_copies_is_a_ball(spark, monkeypatch):
    monkeypatch.setattr(tree_forest, "LEAF", 50)
    monkeypatch.setattr(tree_forest, "TILE", 32)
    rng = np.random.default_rng(12)
    base = rng.standard_normal(16)
    x = np.concatenate([base + 0.01 * rng.standard_normal((300, 16)), base + 0.3 * rng.standard_normal((60, 16)), rng.standard_normal((500, 16))]).astype(np.float32)
    rows = [(k, v.tolist()) for k, v in enumerate(x[rng.permutation(len(x))])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got, want = ({k: (n, c) for k, n, c, _ in t} for t in (map(tuple, near_vectors(df).collect()), brute_force(rows, 0.95)))
    hot = [k for k in want if want[k][0] >= 290]
    assert len(hot) >= 300 and all(got[k][1] == want[k][1] for k in hot)
    missed = sum(want[k][0] - got[k][0] for k in want)
    assert all(got[k][0] <= want[k][0] for k in want) and missed <= 0.001 * sum(n for n, _ in want.values())


def test_more_trees_for_deeper_forests():
    assert tree_forest.trees_for(0, 0.95) == 1 and 4 <= tree_forest.trees_for(6, 0.95) < tree_forest.trees_for(12, 0.95) < 20


@pytest.mark.parametrize("leaf,deepest", [(1500, 9), (5, 1)])
def test_rows_that_repeat_an_id_with_other_vectors(spark, monkeypatch, leaf, deepest):
    monkeypatch.setattr(tree_forest, "LEAF", leaf)
    monkeypatch.setattr(tree_forest, "DEEPEST", deepest)
    rng = np.random.default_rng(6)
    rows = [(1, [1.0, 0, 0, 0]), (1, [0, 1.0, 0, 0]), (2, [1.0, 0.01, 0, 0]), (3, [0, 1.0, 0, 0])]
    rows += [(10 + k % 40, (rng.standard_normal(4) if k % 3 else np.array([0, 0, 1, 0.001 * k])).tolist()) for k in range(160)]
    df = spark.createDataFrame([(k, [float(x) for x in v]) for k, v in rows], "vec_id long, embedding array<double>")
    unit = np.array([np.array(v) / np.linalg.norm(v) for _, v in rows])
    linked = unit @ unit.T >= 0.95
    root = lowest(range(len(rows)), [(i, j) for i, j in zip(*np.nonzero(np.triu(linked, 1)), strict=True)])
    least = {}
    for i, (k, _) in enumerate(rows):
        least[root[i]] = min(k, least.get(root[i], k))
    want = sorted((k, int(linked[i].sum()) - 1, least[root[i]], k == least[root[i]]) for i, (k, _) in enumerate(rows))
    assert sorted(map(tuple, near_vectors(df).collect())) == want

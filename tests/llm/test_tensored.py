import random
import re

import numpy as np
import pytest

from pulseloom.llm.components import connected_components
from pulseloom.llm import tensored
from pulseloom.llm.tensored import near_duplicates, one_of_each


def lowest(nodes, edges):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def brute_force(rows, size, percent):
    sets = {}
    for k, t in rows:
        w = [x.lower() for x in re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode())]
        sets[k] = {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()
    edges = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    root = lowest(sets, edges)
    return {k: (len(sets[k]), root[k], root[k] == k) for k in sets}


@pytest.mark.parametrize("seed", range(3))
def test_equals_brute_force(spark, seed):
    rng = random.Random(seed)
    rows = [(1, None), (2, ""), (3, " \n"), (4, "One"), (5, "one"), (6, "one two"), (7, "ONE\ttwo"), (8, "one É"), (9, "one é")]
    for g in range(12):
        base = [f"w{rng.randrange(400)}" for _ in range(rng.choice([5, 40, 120, 300]))]
        for _ in range(rng.choice([1, 2, 12])):
            w = list(base)
            for _ in range(rng.randrange(1 + len(w) // 25)):
                w[rng.randrange(len(w))] = f"v{rng.randrange(9999)}"
            rows.append((len(rows) + 100, rng.choice([" ", "\n"]).join(w)))
    rng.shuffle(rows)
    size, percent = ((3, 85), (5, 80), (3, 85))[seed]
    df = spark.createDataFrame([(k, t, 5) for k, t in rows], "doc_id long, text string, component_id int")
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_duplicates(df, size, percent).collect()}
    assert got == brute_force(rows, size, percent)


def test_empty_and_repeated(spark, no_documents):
    assert near_duplicates(no_documents).count() == 0
    text = " ".join(map(str, range(9000)))
    got = near_duplicates(spark.createDataFrame([(2, text), (2, text), (3, text + " x"), (4, "x")], "doc_id int, text string")).collect()
    assert sorted((r.doc_id, r.component_id, r.kept) for r in got) == [(2, 2, True), (2, 2, True), (3, 2, False), (4, 4, True)]


def test_components(spark):
    rng = np.random.default_rng(5)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 400, (180, 2))] + [(k, k + 1) for k in range(500, 560)] + [(600, k) for k in range(601, 700)] + [(7, 7)]
    df = spark.createDataFrame([*edges, (None, 3)], "a long, b long")
    got = {r.node: r.component for r in connected_components(df).collect()}
    assert got == lowest({n for a, b in edges if a != b for n in (a, b)}, edges)


def test_pairs_at_the_threshold_of_80_are_linked(spark):
    rows = []
    for k in (409, 669, 3639, 4705, 6270):  # with 16 groups none of these pairs shares a table
        words = [f"w{k}x{i}" for i in range(40)]
        rows += [(2 * k, " ".join(words[:36])), (2 * k + 1, " ".join(words[4:]))]
    got = {r.doc_id: r.component_id for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 1, 80).collect()}
    assert got == {k: k - k % 2 for k, _ in rows}


def thue_morse(n):
    """Two words of n letters that polynomial hashes modulo powers of two cannot tell apart."""
    bits = [bin(k).count("1") % 2 for k in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


def test_rows_of_one_id_rows_without_id_and_words_with_equal_polynomials(spark):
    one, two = thue_morse(1024)
    long, other = (" ".join(f"{c}{k}" for k in range(60)) for c in "xy")
    rows = [(1, one), (2, two), (5, long), (5, other), (5, long), (7, other + " z"), (9, long.upper()), (None, long), (None, other), (None, "alone"), (None, "Alone"), (11, None), (11, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id is None, r.doc_id or 0, r.n_shingles, r.component_id, r.kept) for r in near_duplicates(df, 3, 85).collect()), key=str)
    want = [(1, 1, 1), (2, 1, 2), (5, 58, 5), (5, 58, 5), (5, 58, 5), (7, 59, 5), (9, 58, 5), (None, 58, 5), (None, 58, 5), (None, 1, None), (None, 1, None), (11, 0, 11), (11, 0, 11)]
    assert got == sorted(((k is None, k or 0, n, c, k == c) for k, n, c in want), key=str)
    stay = sorted(map(tuple, one_of_each(df, 3, 85).collect()), key=str)
    alone = [r for r in stay if r[1] in ("alone", "Alone")]
    assert len(alone) == 1 and [r for r in stay if r not in alone] == sorted([(1, one), (2, two), (5, long), (5, other), (11, None), (11, None)], key=str)


def test_exact_sets_have_no_collisions():
    one, two = thue_morse(1024)
    import pyarrow as pa

    text, number = tensored.exact_sets(pa.array([one, two, "a b", "a b c d", "A b C", None, "a", "b c d"]), 3)
    sets = [set(number[text == k].tolist()) for k in range(8)]
    assert not sets[0] & sets[1] and sets[4] < sets[3] and len(sets[3]) == 2 and not sets[5] and not sets[2] & sets[3] and sets[7] < sets[3]


def test_near_misses_of_a_large_bucket(spark, monkeypatch):
    """Chunks by size class and component lose no possible pair; pairs of one component are not compared."""
    monkeypatch.setattr(tensored, "TILE", 7)
    rng = random.Random(3)
    rows = []
    for k in range(150):
        n = rng.choice([20, 40, 44, 1500, 1600])
        rows.append((k, n, " ".join(f"w{i}" for i in range(n - k % 4)) + (f" u{k}" * (k % 5)), 0 if k % 3 else k))
    held = tensored.with_parities(spark.createDataFrame([(k, 0, t) for k, _, t, _ in rows], "row long, n long, text string"), 1)
    sizes = {k: len(set(t.split())) for k, _, t, _ in rows}
    df = held.drop("n").join(spark.createDataFrame([(k, c, sizes[k], b) for k, _, _, c in rows for b in (1, 2)], "row long, component long, n long, bucket long"), "row")
    got = {(r.a, r.b) for r in tensored.near_misses(df, 85).collect()}
    sets = {k: set(t.split()) for k, _, t, _ in rows}
    part = {k: c for k, _, _, c in rows}
    want = {(a, b) for a in sets for b in sets if a < b and part[a] != part[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])}
    assert want <= got and all(part[a] != part[b] for a, b in got) and len(got) < 2 * len(want)


def test_recall_of_tables():
    """Pairs at a similarity of 0.85 or a little more share a table; measured on 20,000."""
    rng = np.random.default_rng(8)
    groups, missed = tensored.groups_for(85), 0
    for _ in range(20):
        sets = []
        for _ in range(1000):
            words = rng.integers(0, 1 << 63, 185, dtype=np.uint64) << np.uint64(1)
            sets += [words[:170], np.concatenate([words[:157], words[170:185]])]  # 157 of 185
        first, second = tensored._keys(sets, groups)
        alike = [(k[::2] == k[1::2]).any(1) for k in (first, second)]
        missed += int((~(alike[0] & alike[1])).sum())
    assert missed <= 20


def test_lots_are_bounded_by_the_copies_in_tiles(spark, monkeypatch):
    """One bucket of many components has a tile for every two chunks; no lot holds many of their rows, and none is lost."""
    monkeypatch.setattr(tensored, "TILE", 8)
    monkeypatch.setattr(tensored, "LOT", 64)
    rows = spark.range(600).selectExpr("id as row", "1 as bucket", "40l as n", "id as component", "array(id) as bits")
    tiles = tensored.tiles_of(rows, 85).groupBy("lot").count().collect()
    chunks = -(-599 // 8)  # of all but the largest component, which is row 0 and a chunk that isn't compared with itself
    assert sum(t["count"] for t in tiles) == 599 * (chunks + 1) + chunks
    assert max(t["count"] for t in tiles) <= 4 * 64
    few = tensored.tiles_of(rows.where("row < 5"), 85).groupBy("lot").count().collect()
    assert [t["count"] for t in few] == [5]


def test_pairs_of_a_hub_are_dealt_to_parts(spark, monkeypatch):
    """A row with most pairs has them in many parts, whose number follows from its load; no pair is lost or doubled."""
    pairs = spark.range(5000).selectExpr("if(id < 4000, 0, id) as a", "id + 10000 as b")
    dealt, many = tensored.dealt(pairs, pairs.selectExpr("a", "1 as load"), 100)
    parts = {r.a: r.parts for r in many.collect()}
    assert parts[0] == 40 and set(parts.values()) == {1, 40}
    got = dealt.collect()
    assert sorted((r.a, r.b) for r in got) == sorted((r.a, r.b) for r in pairs.collect())
    assert dealt.groupBy("a", "part").count().agg({"count": "max"}).first()[0] < 200
    monkeypatch.setattr(tensored, "TASK_PAIRS", 3)
    sets = tensored.with_parities(spark.createDataFrame([(k, 30, " ".join(f"w{i}" for i in range(k % 3 * 10, 30 + k % 3 * 10))) for k in range(40)], "row long, n long, text string"), 1)
    hub = spark.range(1, 40).selectExpr("0l as a", "id as b")
    assert sorted(r.b for r in tensored.possible(hub, sets, 85).collect()) == [k for k in range(1, 40) if k % 3 == 0]


def test_pairs_of_stars_leave_out_what_is_joined(spark, monkeypatch):
    """A group that the first links join lists no pairs of its tables' smallest rows; what is listed is written once, not joined anew by every reader."""
    listed, inner = [], tensored.possible

    def possible(pairs, *rest):
        listed.append((pairs.count(), pairs._jdf.queryExecution().optimizedPlan().toString()))
        return inner(pairs, *rest)

    monkeypatch.setattr(tensored, "possible", possible)
    rows = [(k, " ".join(f"w{i}" if i != 7 * k else f"u{k}" for i in range(300))) for k in range(40)]
    df = spark.createDataFrame([*rows, (90, "quite another text")], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in near_duplicates(df, 3, 85).collect()}
    assert got == dict.fromkeys(range(40), 0) | {90: 90}
    assert [n for n, _ in listed] == [0] and "Join" not in listed[0][1]


def test_stars_list_a_pair_a_key_and_not_a_pair_a_table(spark):
    """A row whose 100 tables have 100 smallest rows meets one row of each of its 10 keys: of the component with most rows there, not the smallest row."""
    firsts, seconds = list(range(10)), list(range(100, 110))
    rows = [(10 * i + j, 40, [i], [100 + j], 1000 if j > 6 else 10 * i + j) for i in range(10) for j in range(10)]
    rows += [(500, 40, firsts, seconds, 500), (501, 90, firsts, seconds, 501), (600, 40, [50], seconds, 600), (601, 40, [50], [200], 600)]
    placed = spark.createDataFrame(rows, "row long, n long, first array<long>, second array<long>, component long")
    got = sorted((r.a, r.b) for r in tensored.stars(placed, 85).collect())
    # keys 0 to 9 each have three rows of component 1000, from 10 * i + 7; row 501 is too large for any, and key 50 lies in one component
    assert got == sorted((10 * i + 7, b) for i in range(10) for b in [500, *range(10 * i, 10 * i + 7)])


def test_groups_about_the_threshold_equal_brute_force(spark):
    """Many copies of one text of which about half of the pairs are linked, so that no row is linked to all."""
    rng = random.Random(11)
    base = [f"w{k}" for k in range(150)]
    rows = []
    for k in range(120):
        words = list(base)
        for _ in range(rng.randrange(1, 8)):
            words[rng.randrange(150)] = f"v{rng.randrange(10**6)}"
        rows.append((k, " ".join(words)))
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85).collect()}
    assert got == brute_force(rows, 3, 85)

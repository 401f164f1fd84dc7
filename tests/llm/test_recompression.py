import random
import re
import time

import numpy as np
import pyarrow as pa
import pytest

from pulseloom.llm.recompression import FILTER, REVEAL, ROUNDS, Slice, _among, _facts, _read_facts, remove_repeats


def brute_force(rows, width):
    """{row number: (n_words, n_removed, kept text)}; rows in order of (doc_id, text)."""
    words = [re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode()) for _, t in rows]
    seen, out = set(), []
    for w in words:
        gone = [False] * len(w)
        for i in range(len(w) - width + 1):
            key = tuple(w[i : i + width])
            if key in seen:
                gone[i : i + width] = [True] * width
            seen.add(key)
        out.append((len(w), sum(gone), b" ".join(x for x, g in zip(w, gone, strict=True) if not g).decode()))
    return out


def check(spark, rows, width=20):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is None, r[1] or ""))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id is not None, r.doc_id or 0, r.n_words, r.n_removed, r.kept_text) for r in remove_repeats(df, width).collect())
    want = sorted((d is not None, d or 0, *x) for (d, _), x in zip(rows, brute_force(rows, width), strict=True))
    assert got == want


@pytest.mark.parametrize("seed", range(6))
def test_equals_brute_force(spark, seed):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range((2, 3, 5, 30, 200, 1000)[seed])]
    passages = [[rng.choice(vocabulary) for _ in range(rng.choice([19, 20, 21, 25, 60]))] for _ in range(5)]
    rows = []
    for k in range(60):
        parts = []
        for _ in range(rng.randrange(5)):
            parts += rng.choice(passages) if rng.random() < 0.5 else [rng.choice(vocabulary)] * rng.choice([1, 1, 2, 25]) if rng.random() < 0.2 else [rng.choice(vocabulary) for _ in range(rng.randrange(40))]
        rows.append((k, rng.choice(["\n", " ", "  \t"]).join(parts)))
    rows += [(100, rows[3][1]), (101, rows[3][1])]
    check(spark, rows)


def test_odd_rows(spark, no_documents):
    long = " ".join(f"x{k % 997}" for k in range(3000))
    check(spark, [(1, None), (2, ""), (3, " \t\n"), (4, "a " * 19), (5, "a " * 20), (6, "a " * 21), (7, long), (8, long), (None, long), (9, "é b　c " * 30), (9, "é b　c " * 30)])
    assert remove_repeats(no_documents).count() == 0


def test_clashing_columns(spark):
    text = " ".join(map(str, range(50)))
    df = spark.createDataFrame([(1, text, "a", 7, 9), (2, text, "b", 8, 9)], "doc_id int, text string, slice string, n_words int, places int")
    got = {r.doc_id: r for r in remove_repeats(df).collect()}
    assert got[1].n_removed == 0 and got[2].n_removed == 50 and got[2].kept_text == "" and got[1].places == 9


def test_words_with_equal_polynomials_differ(spark):
    from tests.llm.test_tensored import thue_morse

    one, two = thue_morse(1024)
    words = [f"w{k}" for k in range(19)]
    check(spark, [(1, " ".join([*words[:9], one, *words[9:]])), (2, " ".join([*words[:9], two, *words[9:]])), (3, " ".join([*words[:9], one, *words[9:]]))])


def table_of(texts):
    return pa.table({"doc_id": pa.array(range(len(texts)), pa.int64()), "text": texts})


def test_symbols_inside_a_window_and_its_name_depend_on_its_words_alone():
    rng = random.Random(4)
    window = [rng.choice("a b c d e f g h".split()) for _ in range(20)]
    texts = []
    for _ in range(200):
        around = [[rng.choice([*"abcdefgh", window[0], window[-1]]) for _ in range(rng.randrange(40))] for _ in range(2)]
        texts.append((len(around[0]), " ".join(around[0] + window + around[1])))
    s = Slice(table_of([t for _, t in texts]), 20)
    s.name()
    starts = s.first[:-1] + [k for k, _ in texts]
    for upto in (0, 2, FILTER, ROUNDS):
        a, b, one, two = s.inside(starts, upto, name=True)
        level = s.levels[upto]
        assert len(set(one)) == len(set(two)) == 1 and len({tuple(level.one[i:j]) for i, j in zip(a, b, strict=True)}) == 1
    every = s.inside(s.starts, ROUNDS, name=True)
    assert len(set(zip(every[2], every[3], strict=True))) == len({tuple(s.codes[k : k + 20]) for k in s.starts})


def test_high_symbols_span_passages():
    rng = random.Random(5)
    s = Slice(table_of([" ".join(f"w{rng.randrange(5000)}" for _ in range(20_000)) for _ in range(5)]), 20)
    s.name()
    spans = [len(s.codes) / len(s.levels[k].one) for k in (FILTER, ROUNDS, *REVEAL)]
    assert spans[0] > 2.8 and spans[1] > 4.5 and spans[2] > 14 and spans[3] > 40


def test_other_words_under_one_name_fail():
    s = Slice(table_of(["a b c d " * 10]), 20)
    s.name()
    s.compare(np.array([[4], [30], [-1], [0]]))
    with pytest.raises(RuntimeError):
        s.compare(np.array([[5], [30], [-1], [0]]))


def test_lookups_of_a_bucket_go_with_its_keys():
    """A bucket of a large corpus has keys of thousands of slices; np.isin for each slice sorts all of `known`, 0.9 s a slice here."""
    rng = np.random.default_rng(7)
    known = np.unique(rng.integers(0, 1 << 32, 1_000_000, dtype=np.uint32))
    keys = [rng.integers(0, 1 << 32, rng.integers(0, 60), dtype=np.uint32) for _ in range(2000)]
    keys[3][:5], keys[7] = known[-5:], known[:40]
    began = time.thread_time()
    found = _among(keys, known)
    assert time.thread_time() - began < 3
    assert [len(f) for f in found] == [len(k) for k in keys]
    assert np.array_equal(np.concatenate(found), np.isin(np.concatenate(keys), known)) and found[3][:5].all() and found[7].all()
    assert not any(f.any() for f in _among(keys, known[:0])) and [len(f) for f in _among([keys[0]], known)] == [len(keys[0])]


@pytest.mark.parametrize("n", [0, 1, 7])
def test_facts_come_back(n):
    facts = np.stack([np.arange(n)[::-1] * 5, np.full(n, 20), np.full(n, -1), np.arange(n) << 40])
    assert np.array_equal(_read_facts(_facts(*facts)), facts)


def test_doc_ids_must_be_integers(spark):
    with pytest.raises(TypeError):
        remove_repeats(spark.createDataFrame([("x", "a b")], "doc_id string, text string"))

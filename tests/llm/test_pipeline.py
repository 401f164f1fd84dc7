import zlib

import numpy as np
import public_tokenizers as P
import pytest

import corpus_pipeline
from pulseloom.llm import toxicity
from pulseloom.llm.byte_tokens import byte_tokens
from pulseloom.llm.tables import stored
from tests.llm.test_recompression import brute_force as repeats
from tests.llm.test_tensored import brute_force as groups

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def outputs(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    found = [docs]
    for name, stage in corpus_pipeline.STAGES:
        found.append(stored(stage(spark, found[-1], DIR), name))
    return found


def test_stages(spark, outputs):
    docs, clean, lone, cut, packed = outputs
    assert all(x.columns == docs.columns for x in (clean, lone, cut))
    texts = lambda df: {r.doc_id: r.text for r in df.collect()}
    scores = toxicity.score(docs, toxicity.fit(docs, spark.read.parquet(f"{DIR}/labels.parquet")))
    assert texts(clean) == {k: t for k, t in texts(docs).items() if k in {r.doc_id for r in scores.where("predicted = 0").collect()}}
    kept = groups(sorted(texts(clean).items()), 5, 80)
    assert texts(lone) == {k: t for k, t in texts(clean).items() if kept[k][2]}
    rows = sorted(texts(lone).items())
    want = {k: (new if removed else t) for (k, t), (_, removed, new) in zip(rows, repeats(rows, 20), strict=True)}
    assert texts(cut) == want
    ids = {k: np.array([*byte_tokens(P.path("byte_bpe_50k.json")).library.encode(t or "", add_special_tokens=False).ids, 0], "<u4") for k, t in want.items()}
    pieces = packed.collect()
    assert sum(r.length for r in pieces) == sum(map(len, ids.values()))
    assert all(r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes()) for r in pieces)


def test_run_equals_the_stages(spark, outputs):
    pieces = lambda df: sorted((r.doc_id, r.start, r.length, r.ids_crc32) for r in df.collect())
    assert pieces(corpus_pipeline.run(spark, DIR)) == pieces(outputs[-1])


def test_stages_take_odd_rows(spark, odd_documents, no_documents):
    odd = odd_documents.drop("start").selectExpr("*", "length(text) as n_chars").unionByName(spark.createDataFrame([(None, "no id", None, None, None)], "doc_id long, text string, lang string, source string, n_chars int"))
    for docs in (odd, no_documents):
        for name, stage in corpus_pipeline.STAGES:
            docs = stored(stage(spark, docs, DIR), name)
        words = {r.doc_id for r in docs.collect()}
        assert not words or None in words


def test_near_duplicates_with_clashing_columns(spark):
    text = "one two three four five six seven eight nine ten"
    rows = [(1, text, "a", 1, b"x", 5), (2, text, "b", 2, b"y", 6), (3, "quite another text that has words of its own", "c", 3, b"z", 7), (3, "quite another text that has words of its own", "c", 3, b"z", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, of string, seen int, __mark binary, _OF0 int")
    kept = corpus_pipeline.STAGES[1][1](spark, docs, DIR)
    assert kept.columns == docs.columns and sorted((r.doc_id, r.of, r.seen, bytes(r["__mark"]), r["_OF0"]) for r in kept.collect()) == [(1, "a", 1, b"x", 5), (3, "c", 3, b"z", 7)]

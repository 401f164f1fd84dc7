import math
import zlib

import numpy as np
from pyspark.sql import functions as F

from pulseloom.llm import toxicity


def test_held_out_accuracy(spark):
    at = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{at}/{t}.parquet") for t in ("documents", "labels"))
    scored = toxicity.score(docs, toxicity.fit(docs, labels))
    rows = scored.join(labels, "doc_id").where("held_out").select("score", "predicted", "toxic").toPandas()
    assert set(scored.where("held_out").select(F.col("doc_id")).toPandas().doc_id) == {r.doc_id for r in docs.select("doc_id").collect() if zlib.crc32(str(r.doc_id).encode()) % 4 == 2}
    assert (rows.predicted[rows.toxic == 1]).mean() > 0.85
    assert (rows.predicted[rows.toxic == 0]).mean() < 0.005
    assert scored.where("score < 0 or score > 1 or score is null").count() == 0


def test_label_model_learns_from_votes_alone():
    """Voters of different quality, one of them three times: accuracies come out, and copies count once."""
    rng = np.random.default_rng(1)
    y = rng.random(6000) < 0.3
    good = [(rng.random(6000) < np.where(y, 0.6, 0.02)) for _ in range(4)]
    noise = rng.random(6000) < 0.1
    votes = np.array([*good, noise, noise, noise]).T.astype(float)
    model, q = toxicity.LabelModel.fit(votes, 0.3)
    assert ((q > 0.5) == y).mean() > 0.93  # two of a hundred rows of class 1 have no good vote
    assert (model.right[:4] > 0.85).all() and (model.right[4:] < 0.6).all()
    assert model.alike[4, 5] > 0.9 > 0.3 > model.alike[0, 1]
    once, thrice = (model.evidence(np.array([[0, 0, 0, 0, *v]], float), 0.3)[0] for v in ((1, 0, 0), (1, 1, 1)))
    assert abs(once - thrice) < 0.2 * abs(once) + 0.05


def test_expectation_maximisation_equals_plain_loops():
    """One round on a few rows, written out voter by voter and pair by pair."""
    rng = np.random.default_rng(2)
    votes, times = (rng.random((12, 4)) < 0.4).astype(float), rng.integers(1, 5, 12).astype(float)
    model, q = toxicity.LabelModel.fit(votes, 0.2, times, balanced=False, rounds=1)
    first = [0.9 if any(r) else toxicity.NEVER for r in votes]
    right = [min(max((sum(t * p * r[j] for t, p, r in zip(times, first, votes, strict=True)) + 0.7) / (sum(t * r[j] for t, r in zip(times, votes, strict=True)) + 1), 0.5), 0.995) for j in range(4)]
    assert np.allclose(model.right, right)
    mean = [[sum(t * c * r[j] for t, c, r in zip(times, part, votes, strict=True)) / sum(t * c for t, c in zip(times, part, strict=True)) for j in range(4)] for part in ([1 - p for p in first], first)]
    off = [[r[j] - (1 - p) * mean[0][j] - p * mean[1][j] for j in range(4)] for p, r in zip(first, votes, strict=True)]
    both = [[sum(t * o[i] * o[j] for t, o in zip(times, off, strict=True)) for j in range(4)] for i in range(4)]
    alike = [[1.0 if i == j else min(max(both[i][j] / (both[i][i] * both[j][j]) ** 0.5, 0), 1) for j in range(4)] for i in range(4)]
    assert np.allclose(model.alike, alike, atol=1e-6)
    own = [math.log(r / (1 - r)) - math.log(0.2 / 0.8) for r in right]
    for row, got in zip(votes, q, strict=True):
        on = [j for j in range(4) if row[j]]
        if not on:
            assert got == toxicity.NEVER
            continue
        weight = np.linalg.inv(np.array([[alike[i][j] + 0.1 * (i == j) for j in on] for i in on])) @ np.array([own[j] * 1.1 for j in on])
        assert math.isclose(got, 1 / (1 + math.exp(-math.log(0.2 / 0.8) - sum(max(x, 0) for x in weight))), rel_tol=1e-5)


def test_contradicting_labels_all_toxic_and_repeated_rows(spark):
    docs = spark.createDataFrame([(k, "vile brute words" if k % 2 else "mild kind words") for k in range(40)] + [(1, "vile brute words")] * 30, "doc_id long, text string")
    both = spark.createDataFrame([(k, k % 2) for k in range(40)] + [(k, 0) for k in range(40)], "doc_id long, toxic int")
    rows = toxicity.score(docs, toxicity.fit(docs, both)).collect()
    assert all(r.predicted == r.doc_id % 2 for r in rows) and len(rows) == 70
    every = spark.createDataFrame([(k, 1) for k in range(40)], "doc_id long, toxic int")
    assert all(r.score == 1 for r in toxicity.score(docs, toxicity.fit(docs, every)).collect())


def test_odd_rows(spark, odd_documents, no_documents):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = toxicity.score(odd_documents, toxicity.fit(odd_documents, none)).collect()
    assert len(rows) == odd_documents.count() and all(r.score < 1e-300 and r.predicted == 0 for r in rows)
    labels = spark.createDataFrame([(k, 1, int(k in (11, 12))) for k in range(16)] + [(None, 1, 1), (2, 1, None)], "doc_id long, quality int, toxic int")
    rows = toxicity.score(odd_documents.withColumn("label", F.lit("x")), toxicity.fit(odd_documents.withColumn("label", F.lit("x")), labels)).collect()
    assert all(0 <= r.score <= 1 for r in rows)
    assert toxicity.score(no_documents, toxicity.fit(no_documents, labels)).count() == 0

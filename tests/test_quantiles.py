"""Exact quantiles, also where one channel holds most rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulseloom.operators import quantiles as Q

PARTS = [0.0, 0.01, 0.1, 0.25, 0.5, 0.75, 0.9, 0.999, 1.0]


@pytest.mark.parametrize("few", [0, 8000])
def test_quantiles_equal_numpy(spark, monkeypatch, few):
    monkeypatch.setattr(Q, "FEW", max(few, 60))
    monkeypatch.setattr(Q, "ACCURACY", 50 if not few else 2000)
    r = np.random.default_rng(1)
    channels = {1: r.normal(5000, 5, 20_000), 2: np.round(r.normal(0, 2, 3000)), 3: [4.0], 4: [7.0, 9.0], 5: np.append(r.normal(0, 1, 500), [1e300, -1e300]), 6: np.full(900, 2.5), None: r.normal(0, 1, 77), 7: r.exponential(1, 14)}
    rows = [(c, float(x)) for c, v in channels.items() for x in v] + [(1, None), (8, None)]
    got = {x.ch: tuple(x)[1:] for x in Q.quantiles(spark.createDataFrame(rows, "ch int, x double"), ["ch"], F.col("x"), PARTS, [f"q{k}" for k in range(len(PARTS))]).collect()}
    assert set(got) == set(channels)
    for c, v in channels.items():
        assert np.allclose(got[c], np.quantile(v, PARTS), rtol=1e-12, atol=1e-12), c


def test_a_hot_channel_is_summed_before_it_moves(spark):
    """No task gets more than the sums of others, and the few values about the median."""
    df = spark.range(400_000).select(F.when(F.col("id") % 10 > 0, 1).otherwise(F.col("id") % 7).cast("int").alias("ch"), F.rand(5).alias("x"))
    found = Q.median(df, ["ch"], F.col("x"))
    want = {r.ch: r.m for r in df.groupBy("ch").agg(F.median("x").alias("m")).collect()}
    assert {r.ch: pytest.approx(r.med, rel=1e-12) for r in found.collect()} == want
    plan = found._jdf.queryExecution().toString()
    assert "percentile_approx" in plan and "median(" not in plan and "percentile(" not in plan

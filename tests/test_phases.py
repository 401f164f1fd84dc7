"""Planted arrival-phase bias is found and taken away."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulseloom.operators import phases


def bias(peak, x):
    return peak * (0.0008 * np.sin(3 * x) + 0.0004 * x)


def spline_at(pieces, t):
    p = next((q for q in pieces if t <= q.x_next), pieces[-1])
    u = t - p.x
    return p.y + u * (p.slope + u * (p.bend + u * p.twist))


@pytest.fixture(scope="module")
def learned(spark):
    r = np.random.default_rng(5)
    rows = []
    for ch, off in ((1, 0.1), (2, -0.2)):
        for peak in (3000.0, 6000.0):
            x = r.uniform(-0.5, 0.5, 1500) + off
            y = peak + bias(peak, x - off) + r.normal(0, 0.4, 1500)
            rows += [(ch, float(a), float(b), peak) for a, b in zip(x, y, strict=True)]
    df = spark.createDataFrame([*rows, (1, None, 3000.0, 0.0), (3, 0.0, 10.0, 0.0)], "ch int, x double, y double, peak double").cache()
    return df, phases.phase_curves(df, ["ch"], "x", "y", [6000.0, 3000.0])


def test_planted_bias_is_found(learned):
    df, model = learned
    found = {r.ch: r.curves for r in model.collect()}
    assert sorted(found) == [1, 2]
    for ch, off in ((1, 0.1), (2, -0.2)):
        assert [c.peak for c in found[ch]] == [3000.0, 6000.0]
        for c in found[ch]:
            assert c.centre == pytest.approx(off, abs=0.03)
            want = [bias(c.peak, t + c.centre - off) - bias(c.peak, c.centre - off) for t in np.linspace(-0.35, 0.35, 9)]
            got = [spline_at(c.pieces, t) - c.zero for t in np.linspace(-0.35, 0.35, 9)]
            assert np.allclose(got, want, rtol=0.2, atol=0.3), (ch, c.peak)  # parts of the range smooth the curve
    fixed = phases.phase_corrected(df.where("ch < 3 and x is not null"), model, ["ch"], "x", "y", "z").groupBy("ch", "peak").agg(F.stddev("y").alias("before"), F.stddev("z").alias("after")).collect()
    assert len(fixed) == 4 and all(r.after < 0.7 * r.before for r in fixed)


def test_between_and_beyond_peaks(learned, spark):
    _, model = learned
    curves = {r.ch: r.curves for r in model.collect()}[1]
    rows = [(1, float(x), float(y)) for x in (-5, -0.3, 0.1, 0.4, 5) for y in (-10, 0, 700, 2999, 3000.5, 4500, 6100, 9000)] + [(9, 0.2, 50.0)]
    got = {(r.ch, r.x, r.y): r.z for r in phases.phase_corrected(spark.createDataFrame(rows, "ch int, x double, y double"), model, ["ch"], "x", "y", "z").collect()}
    assert got[9, 0.2, 50.0] == 50.0
    places = [0.0, *(c.zero for c in curves)]
    for x in (-5, -0.3, 0.1, 0.4, 5):
        for y in (-10, 0, 700, 2999, 3000.5, 4500, 6100, 9000):
            u = np.clip(x - np.interp(y, [c.peak for c in curves], [c.centre for c in curves]), -0.6, 0.6)
            shifts = [0.0, *(c.zero - spline_at(c.pieces, u) for c in curves)]
            k = min(max(int(np.searchsorted(places, y, "right")) - 1, 0), 1)
            t = (y - places[k]) / (places[k + 1] - places[k])
            want = y if y < 0 else y + t * shifts[k + 1] + (1 - t) * shifts[k]
            assert got[1, x, y] == pytest.approx(want, abs=1e-6), (x, y)


def test_no_peaks(spark, learned):
    df, _ = learned
    assert phases.phase_curves(df.limit(0), ["ch"], "x", "y", [1.0]).collect() == []
    with pytest.raises(ValueError):
        phases.phase_curves(df, ["ch"], "x", "y", [])

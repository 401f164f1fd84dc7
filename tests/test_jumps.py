"""Jumps by whole periods, against plain loops over each channel."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulseloom.operators import jumps


def plain(values, good, period, n):
    """The running unwrap of one channel, by corrected values."""
    out, recent = [], []
    for v, g in zip(values, good, strict=True):
        near = np.mean(recent) if recent else v
        out.append(v - period * np.round((v - near) / period))
        if g:
            recent = [*recent, out[-1]][-n:]
    return out


def plain_cut(values, good, period):
    """Values by the period, of one channel."""
    v, g = np.array(values), np.array(good, bool)
    if v.max() - v.min() < period:
        return v
    cut = v % period
    if g.any() and np.ptp(cut[g]) > 0.75 * period:
        cut = (v + period / 4) % period + 0.75 * period
    return cut - cut[0] + v[0]


def channels(seed):
    rng, out = np.random.default_rng(seed), {}
    for ch, size, step in ((1, 700, 9.0), (2, 60, 3.0), (3, 1, 1.0), (None, 40, 5.0), (5, 300, 400.0)):
        level = np.cumsum(rng.normal(0, step, size)) + 3000 + 7 * seed
        out[ch] = ((level + 1000.0 * np.cumsum(rng.choice([0, 0, 0, 1, -2], size))).tolist(), (rng.random(size) < 0.8).tolist())
    out[6] = ([2000.0, 3100.0, 4200.0] * 20, [False] * 60)  # no good value at all
    return out


@pytest.mark.parametrize(("seed", "chunks"), [(0, 16), (1, 3), (2, None)])
def test_running_unwrap_in_ranges_equals_a_loop(spark, seed, chunks):
    """A hot channel over many ranges, channels within one, null channels, bad stretches; extra columns stay."""
    data = channels(seed)
    data[1][1][100:400] = [False] * 300  # whole ranges without a good value
    rows = [(ch, k, v, g, f"t{k}") for ch, (x, good) in data.items() for k, (v, g) in enumerate(zip(x, good, strict=True))]
    df = spark.createDataFrame(rows, "ch int, k int, x double, fine boolean, tag string").orderBy(F.rand(7))
    got = {(r.ch, r.k): (r.y, r.x, r.tag) for r in jumps.unwrap_running(df, ["ch"], ["k"], "x", 1000.0, "y", 3, F.col("fine"), chunks).collect()}
    assert len(got) == len(rows)
    for ch, (x, good) in data.items():
        want = plain(x, good, 1000.0, 3)
        assert [got[ch, k][0] for k in range(len(x))] == pytest.approx(want, abs=1e-6)
    assert all(got[ch, k][1:] == (v, tag) for ch, k, v, _, tag in rows)


def test_running_unwrap_of_odd_values(spark):
    df = spark.createDataFrame([(1, 0, 5.0), (1, 1, None), (1, 2, float("nan")), (1, 3, 1004.0), (1, 4, -2000.0)], "ch int, k int, x double")
    got = [r.y for r in jumps.unwrap_running(df, ["ch"], ["k"], "x", 1000.0, "y", chunks=3).orderBy("k").collect()]
    assert got == [5.0, None, None, 4.0, 0.0]
    assert jumps.unwrap_running(df.where("false"), ["ch"], ["k"], "x", 1000.0, "y").count() == 0


def test_ramp_with_a_jump_in_shuffled_rows(spark):
    ramp = np.arange(40) * 400.0 + 2000
    jumpy = ramp.copy()
    jumpy[10:20] += 2 * 4096
    df = spark.createDataFrame([(1, k, float(v)) for k, v in enumerate(jumpy)], "ch int, k int, x double").orderBy(F.rand(91))
    got = [r.y for r in jumps.unwrap_running(df, ["ch"], ["k"], "x", 4096.0, "y", chunks=5).orderBy("k").collect()]
    assert got == ramp.tolist()


def test_flux_jumps_equal_a_loop(spark):
    data = channels(4)
    data[7] = ([10.0, 990.0, 2005.0, 1995.0, 8.0], [True] * 5)  # about a multiple of the period
    data[8] = ([10.0, 20.0, 700.0], [True] * 3)  # less than a period
    rows = [(ch, k, v, g) for ch, (x, good) in data.items() for k, (v, g) in enumerate(zip(x, good, strict=True))]
    df = spark.createDataFrame([*rows, (7, 99, None, True), (9, 0, None, True)], "ch int, k int, x double, fine boolean")
    got = {(r.ch, r.k): r.y for r in jumps.flux_jumps(df, ["ch"], ["k"], "x", 1000.0, "y", F.col("fine")).collect()}
    assert len(got) == len(rows) + 2 and got[7, 99] is None and got[9, 0] is None
    for ch, (x, good) in data.items():
        assert [got[ch, k] for k in range(len(x))] == pytest.approx(plain_cut(x, good, 1000.0).tolist(), abs=1e-6)

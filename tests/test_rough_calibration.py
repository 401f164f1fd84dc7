"""Peaks, assignments and rough gains against plain enumeration."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulseloom.operators import rough_calibration as R


def height(e, gain=(6.0, -1e-6, -1e-10)):
    c, b, a = gain
    return (-(e * b - 1) - np.sqrt((e * b - 1) ** 2 - 4 * a * e * c * e)) / (2 * a * e)


def plain_chain(h, e, allowed=None):
    """Every ordered combination."""
    best = (np.inf, ())
    h = np.sort(h)
    for at in itertools.combinations(range(len(h)), len(e)):
        if allowed and any(i not in a for i, a in zip(at, allowed, strict=True)):
            continue
        p = h[list(at)]
        off = [e[j - 1] + (e[j + 1] - e[j - 1]) * (p[j] - p[j - 1]) / (p[j + 1] - p[j - 1]) - e[j] for j in range(1, len(e) - 1)]
        best = min(best, (float(np.sqrt(np.mean(np.square(off)))), tuple(p)))
    return best


def peaks_table(spark, by_channel):
    return spark.createDataFrame([(c, float(x), k) for c, h in by_channel.items() for k, x in enumerate(h)], "ch int, height double, rank int")


@pytest.mark.parametrize("k", [3, 4, 5, 6])
def test_any_number_of_lines(spark, k):
    r = np.random.default_rng(k)
    e = np.sort(r.choice(np.arange(1000, 9000, 250), k, replace=False)).astype(float)
    channels = {c: r.permutation(np.round(r.uniform(1000, 50000, n), 3)) for c, n in enumerate([k, k + 1, 10, 13])} | {9: np.arange(k - 1)}
    df = peaks_table(spark, channels)
    df = df.unionByName(df.where("ch = 2").limit(3)).unionByName(spark.createDataFrame([(2, None, 1)], df.schema))  # repeats and nulls
    got = {x.ch: (x.rms, tuple(x.heights)) for x in R.assign_lines(df, ["ch"], e[::-1]).collect()}
    assert sorted(got) == [0, 1, 2, 3]
    allowed = [range(0, 4), *[range(1, 9)] * (k - 2), range(k - 1, 13, 2)]
    some = {x.ch: (x.rms, tuple(x.heights)) for x in R.assign_lines(df, ["ch"], e, allowed).collect()}
    for c, h in channels.items():
        if c in got:
            want = plain_chain(h, e)
            assert got[c][1] == want[1] and got[c][0] == pytest.approx(want[0])
            want = plain_chain(h, e, allowed)
            assert (c in some) == bool(want[1])
            if c in some:
                assert some[c][1] == want[1] and some[c][0] == pytest.approx(want[0])


def test_lines_among_spurious_peaks(spark):
    r = np.random.default_rng(1)
    e = np.arange(1000.0, 9000, 1000)
    true = height(e) + r.standard_normal(8) * 10
    other = height(np.array([100.0, 500, 1500, 1700, 7900, 2200, 2300, 2400, 3300, 3700, 4500])) + r.standard_normal(11) * 10
    df = peaks_table(spark, {1: r.permutation(np.append(true, other))})
    found = R.rough_gain(R.assign_lines(df, ["ch"], e), ["ch"], e).first()
    assert np.allclose(found.heights, true, rtol=1e-3)
    g = lambda x: found.c + found.b * x + found.a * x * x
    assert np.allclose(true / g(true), e, rtol=1e-2) and abs(g(found.zero_gain)) < 1e-6


def test_one_and_two_lines_take_the_most_prominent(spark):
    df = peaks_table(spark, {1: [700.0, 300, 500], 2: [5.0]})
    one, two = ({x.ch: x.heights for x in R.assign_lines(df, ["ch"], e).collect()} for e in ([1.0], [1.0, 2.0]))
    assert one == {1: [700.0], 2: [5.0]} and two == {1: [300.0, 700.0]}
    gain = R.rough_gain(R.assign_lines(df, ["ch"], [1000.0, 2000.0]), ["ch"], [1000.0, 2000.0]).first()
    assert (gain.a, gain.b > 0, gain.zero_gain) == (0.0, True, None)  # a gain that grows has its zero below no height
    assert R.rough_gain(R.assign_lines(df, ["ch"], [1000.0]), ["ch"], [1000.0]).where("ch = 1").first().c == pytest.approx(0.7)
    assert R.assign_lines(df.limit(0), ["ch"], [1.0, 2.0, 3.0]).collect() == []
    with pytest.raises(ValueError):
        R.assign_lines(df, ["ch"], [1.0, 1.0])
    with pytest.raises(ValueError):
        R.assign_lines(df, ["ch"], [1.0, 2.0, 3.0], [[1]])


@pytest.mark.parametrize("k", [4, 5])
def test_all_combinations_by_gain(spark, monkeypatch, k):
    monkeypatch.setattr(R, "LOT", 7)
    r = np.random.default_rng(k)
    e = np.array([1000.0, 2000, 3500, 5000, 7000])[:k]
    channels = {c: np.append(height(e) + r.standard_normal(k), r.uniform(2000, 45000, n)) for c, n in enumerate([0, 3, 6])}
    got = {x.ch: (x.rms, x.heights) for x in R.assign_by_gain(peaks_table(spark, channels), ["ch"], e).collect()}
    for c, h in channels.items():
        best = (np.inf, ())
        for p in itertools.combinations(sorted(h), k):
            p = np.array(p)
            gain = np.polynomial.Polynomial.fit(p, p / e, 2)
            best = min(best, (float(np.sqrt(np.mean((e - p / gain(p)) ** 2))), tuple(p)))
        assert tuple(got[c][1]) == best[1] and got[c][0] == pytest.approx(best[0], abs=1e-6)


def test_three_peaks_give_the_others(spark):
    r = np.random.default_rng(8)
    e = np.array([1000.0, 2500, 3000, 4200, 5000, 6100])
    true = height(e) + r.standard_normal(6)
    spurious = height(np.array([2900.0, 3700, 4500, 1300])) + r.standard_normal(4)
    df = peaks_table(spark, {1: r.permutation(np.append(true, spurious)), 2: np.arange(1.0, 9)})
    got = {x.ch: x for x in R.assign_by_three(df, ["ch"], e).collect()}
    assert np.allclose(got[1].heights, true) and got[1].rms < 10 and 2 not in got


@pytest.mark.parametrize(
    ("y", "tops", "lows"),
    [([0, 1, 0], [1], [0]), ([0, 1, 0, 2], [1], [0, 2]), ([0, 1, 1, 0, 0, 2, 1, 1, 3], [2, 5], [0, 4, 7]), ([3, 2, 1], [], []), ([1, 1, 1], [], []), ([2, 1, 4, 4, 0, 0, 1], [3], [1, 5]), ([0, 1, 2], [], [0])],
)
def test_turning_points(y, tops, lows):
    """A top after the last low is none."""
    a, b = R.turning_points(np.array(y, float))
    assert (a.tolist(), b.tolist()) == ([t for t in tops if t < lows[-1]] if lows else [], lows)


def test_peaks_of_a_spectrum_and_the_whole_step(spark):
    r = np.random.default_rng(2)
    e = np.array([1000.0, 2000, 3000, 4500])
    places = {1: height(e), 2: 1.1 * height(e)}
    rows = [(c, float(x)) for c, p in places.items() for x in np.concatenate([r.normal(p, 20, (400, 4)).ravel(), r.uniform(3000, 30000, 300)])]
    df = spark.createDataFrame([*rows, (1, None), (3, float("nan"))], "ch int, x double")
    found = R.smoothed_peaks(df, ["ch"], "x", 60.0, bins=1 << 12).cache()
    for c in (1, 2):
        x = np.array([v for k, v in rows if k == c])
        edges = np.linspace(x.min() - 180, x.max() + 180, (1 << 12) + 1)
        counts, centre = np.histogram(x, edges)[0], (edges[1:] + edges[:-1]) / 2
        sigma = 60 / np.sqrt(8 * np.log(2))
        kernel = np.exp(-0.5 * ((centre[:, None] - centre[None, :]) / sigma) ** 2) * (edges[1] - edges[0]) / (sigma * np.sqrt(2 * np.pi))
        top = found.where((F.col("ch") == c) & (F.col("rank") <= 4)).orderBy("height").collect()
        smooth = kernel @ counts
        for t in top:
            at = int(np.argmin(abs(centre - t.height)))
            assert t.level == pytest.approx(smooth[at], rel=1e-3) and smooth[at] >= smooth[at - 1 : at + 2].max() * (1 - 1e-9)
        assert np.allclose([t.height for t in top], places[c], atol=20)
    for rule in ("linear", "gain", "three"):
        gain = R.rough_calibration(df, ["ch"], "x", e, 60.0, rule=rule)
        done = R.rough_energies(df, gain, ["ch"], "x").where("ch < 3").groupBy("ch").agg(F.percentile("energy", F.array(F.lit(0.15), F.lit(0.7))).alias("q")).collect()
        assert len(done) == 2 and all(abs(d.q[0] - 1000) < 120 and abs(d.q[1] - 4500) < 1600 for d in done), (rule, done)
        assert {x.ch for x in gain.collect()} == {1, 2}


@pytest.mark.parametrize("allowed", [None, [range(4), range(1, 8), range(0, 14, 2), range(5, 14)]])
def test_lowest_of_lines_that_differ_by_rounding_alone(allowed):
    """Heights in steps of 0.1 fit lines at 1000, 1300, 1900 and 2600 in many places, with errors of 1e-13 between them."""
    e = np.array([1000.0, 1300.0, 1900.0, 2600.0])
    for first in (900.0, 900.1, 900.2, 900.7, 901.3):
        h = np.round(first + 0.1 * np.array([0, 2, 3, 4, 6, 9, 11, 12, 16, 18, 21, 24, 28, 32]), 1)
        tried = []
        for c in itertools.combinations(range(len(h)), 4):
            if allowed is None or all(x in a for x, a in zip(c, allowed, strict=True)):
                off = [e[j - 1] + (e[j + 1] - e[j - 1]) * ((h[c[j]] - h[c[j - 1]]) / (h[c[j + 1]] - h[c[j - 1]])) - e[j] for j in (1, 2)]
                tried.append((round(float(np.sqrt((off[0] ** 2 + off[1] ** 2) / 2)), 9), *h[list(c)]))
        assert tuple(R.best_chain(h, e, allowed)[0]) == min(tried)[1:]

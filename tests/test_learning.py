import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pulseloom.operators import histograms, jumps, learning, pulse_stats


def test_drift_slope(spark):
    rng = np.random.default_rng(1)
    frames = []
    for ch, slope in ((1, 4e-4), (2, -2e-4)):
        i = rng.normal(1000, 30, 6000)
        e = rng.choice([3000.0, 5000.0, 8000.0], 6000) + rng.normal(0, 3, 6000)
        frames.append(pd.DataFrame({"ch": ch, "i": i, "h": e / (1 + slope * (i - np.median(i)))}))
    got = {r.ch: r.slope for r in learning.drift_slope(spark.createDataFrame(pd.concat(frames)), ["ch"], "h", "i").collect()}
    assert abs(got[1] - 4e-4) < 4e-5 and abs(got[2] + 2e-4) < 4e-5


@pytest.mark.parametrize("lags", [1, 5])
def test_optimal_filter_of_white_noise(spark, lags):
    rng = np.random.default_rng(2)
    n, pre = 60, 20
    t = np.clip(np.arange(n) - pre, 0, None)
    shape = np.exp(-t / 20) - np.exp(-t / 3)
    shape /= shape.max()
    pulses = spark.createDataFrame([(1, (1000 * shape + rng.normal(0, 1, n) + 50).tolist()) for _ in range(300)], "ch int, pulse array<double>")
    noise = spark.createDataFrame([(1, rng.normal(0, 1, n).tolist()) for _ in range(3000)], "ch int, pulse array<double>")
    row = learning.optimal_filters(pulses, noise, ["ch"], "pulse", pre, lags).first()
    used = shape[2:-2] if lags == 5 else shape
    flat = used - used.mean()
    assert row.variance == pytest.approx(1 / (flat @ flat), rel=0.1)
    assert abs(sum(row.weights)) < 1e-9
    if lags == 1:
        heights = learning.filtered(pulses, learning.optimal_filters(pulses, noise, ["ch"], "pulse", pre), ["ch"], "pulse", "y").toPandas().y
        assert heights.mean() == pytest.approx(1000, rel=2e-3) and heights.std() < 1.6


def test_gain_polynomial(spark):
    rows = [(c, h, h / (6 + b * h + a * h * h)) for c, n, a, b in ((1, 5, -1e-10, -1e-6), (2, 2, 0, -1e-5), (3, 1, 0, 0)) for h in np.linspace(1000, 9000, n).tolist()]
    for r in learning.gain_polynomial(spark.createDataFrame(rows, "ch int, height double, energy double"), ["ch"]).collect():
        a, b = {1: (-1e-10, -1e-6), 2: (0, -1e-5), 3: (0, 0)}[r.ch]
        assert r.a == pytest.approx(a, abs=1e-14) and r.b == pytest.approx(b, abs=1e-10) and r.c == pytest.approx(6, rel=1e-6)


def test_spline_goes_through_knots_and_on_as_lines(spark):
    x = np.array([0.0, 1.0, 2.5, 4.0])
    y = np.sin(x)
    knots = spark.createDataFrame([(1, a, b) for a, b in zip(x.tolist(), y.tolist(), strict=True)] + [(2, 5.0, 7.0)], "ch int, x double, y double")
    spline = learning.natural_spline(knots, ["ch"])
    at = spark.createDataFrame([(1, float(v)) for v in [*x, -1, -2, 5, 6, 7]] + [(2, 9.0)], "ch int, v double")
    got = {(r.ch, r.v): r.s for r in learning.spline_applied(at, spline, ["ch"], "v", "s").collect()}
    assert all(got[1, a] == pytest.approx(b) for a, b in zip(x, y, strict=True)) and got[2, 9.0] == 7
    assert got[1, -2] - got[1, -1] == pytest.approx(got[1, -1] - got[1, 0])
    assert got[1, 7] - got[1, 6] == pytest.approx(got[1, 6] - got[1, 5])


def test_running_unwrap(spark):
    rng = np.random.default_rng(3)
    true = np.cumsum(rng.normal(0, 5, 500)) + 3000
    jumped = true + 4096 * np.cumsum(rng.choice([0, 0, 0, 0, 1, -1], 500))
    df = spark.createDataFrame([(1, k, float(v)) for k, v in enumerate(jumped)], "ch int, k int, x double")
    got = np.array([r.y for r in jumps.unwrap_running(df, ["ch"], ["k"], "x", 4096.0, "y").orderBy("k").collect()])
    assert np.abs(np.diff(got - true)).max() < 1e-6


def test_entropy_and_q_scale(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(0, 1, 20_000)
    df = spark.createDataFrame(pd.DataFrame({"ch": 1, "x": x}))
    assert learning.laplace_entropy(df, ["ch"], "x", 0.02).first().entropy == pytest.approx(0.5 * np.log(2 * np.pi * np.e), abs=0.03)
    small = x[:101].tolist()
    d = sorted(abs(a - b) for i, a in enumerate(small) for b in small[:i])
    h = 101 // 2 + 1
    got = learning.q_scale(spark.createDataFrame([(1, v) for v in small] + [(2, 5.0), (3, None)], "ch int, x double"), ["ch"], "x").collect()
    assert {r.ch: r.q for r in got} == pytest.approx({1: d[h * (h - 1) // 2 - 1] * 2.2219 * 101 / 102.4, 2: 0.0, 3: 0.0})
    assert learning.q_scale(df, ["ch"], "x").first().q == pytest.approx(1, abs=0.03)


def test_chosen_columns(spark):
    rng = np.random.default_rng(5)
    a = rng.standard_normal((400, 3)) @ np.diag([5, 3, 1])
    x = np.stack([a[:, 0], a[:, 1], a[:, 0] + 0.1 * a[:, 2], a[:, 1] * 0.5, 0.01 * a[:, 2]], 1)
    got = learning.chosen_columns(spark.createDataFrame([(r.tolist(),) for r in x], "v array<double>"), "v", 5, 2)
    assert set(got) in ({0, 1}, {2, 1}, {0, 3}, {2, 3})


def test_time_drift_and_phase(spark):
    rng = np.random.default_rng(6)
    t = np.sort(rng.uniform(0, 1e4, 5000))
    v = 1000 * (1 + 0.02 * np.sin(t / 3000)) + rng.normal(0, 1, 5000)
    out = learning.time_drift(spark.createDataFrame(pd.DataFrame({"ch": 1, "t": t, "v": v})), ["ch"], "t", "v").toPandas()
    assert (out.v * out.gain).std() < 0.3 * v.std()
    phase = rng.uniform(-0.5, 0.5, 6000)
    peak = rng.choice([3000.0, 5000.0], 6000)
    h = peak + 12 * phase + rng.normal(0, 1, 6000)
    out = learning.phase_shift(spark.createDataFrame(pd.DataFrame({"ch": 1, "p": phase, "h": h, "true": peak})), ["ch"], "p", "h", [3000.0, 5000.0]).toPandas()
    assert (out.corrected - out.true).std() < 0.5 * (h - peak).std()


def test_line_fit_and_peaks(spark):
    rng = np.random.default_rng(7)
    x = np.concatenate([rng.normal(5000, 3, 8000), rng.uniform(4950, 5050, 2000)])
    r = learning.line_fits(spark.createDataFrame(pd.DataFrame({"ch": 1, "x": x})), ["ch"], "x", 5000.0, 50.0, 0.5).first()
    assert r.peak == pytest.approx(5000, abs=0.2) and r.fwhm == pytest.approx(3 * 2.3548, rel=0.05) and r.area == pytest.approx(8000, rel=0.05)
    y = np.concatenate([rng.normal(m, 10, n) for m, n in ((7000, 10_000), (4000, 5000), (1000, 1000))])
    hist = histograms.histogram(spark.createDataFrame(pd.DataFrame({"ch": 1, "x": y})).withColumn("x", F.col("x")), "x", 0.0, 10.0, 800, ["ch"])
    got = [r.label for r in learning.prominent_peaks(hist, ["ch"], 2, 3).orderBy(F.desc("prominence")).collect()]
    assert [round(v / 50) * 50 for v in got] == [7000, 4000, 1000]


def test_stream_triggers_cross_chunks(spark):
    x = np.zeros(10_000)
    starts = [50, 200, 300, 1023, 1024 * 2, 5000, 6000, 6233, 9950]
    for s in starts:
        x[s:] += np.exp(-np.arange(10_000 - s) / 50)
    chunks = [(1, k, k * 1024, x[k * 1024 : (k + 1) * 1024].tolist()) for k in range(10)]
    got = pulse_stats.stream_triggers(spark.createDataFrame(chunks, "ch int, chunk long, start long, samples array<double>"), ["ch"], [-1.0, 1.0], 0.01)
    assert sorted(r.trigger for r in got.collect()) == [s - 1 for s in starts]


def test_kink_and_arrival(spark):
    rng = np.random.default_rng(8)
    x = rng.uniform(0, 10, 500)
    y = 3 + np.where(x < 4, 2 * (x - 4), -(x - 4))
    r = pulse_stats.kink_fit(spark.createDataFrame(pd.DataFrame({"ch": 1, "x": x, "y": y})), ["ch"], "x", "y", [2, 3, 4, 5]).first()
    assert (r.place, round(r.level, 6), round(r.left, 6), round(r.right, 6)) == (4, 3, 2, -1)
    t = rng.uniform(-0.5, 0.5, 4000).tolist()
    base, slope = np.r_[np.zeros(5), np.arange(10.0)], np.r_[np.zeros(5), np.ones(10)]
    rows = [(1, (100 + base + slope * v).tolist(), 0.7 + 0.1 * v, 50.0 + k % 7) for k, v in enumerate(t)]
    m = pulse_stats.arrival_model(spark.createDataFrame(rows, "ch int, pulse array<double>, promptness double, size double"), ["ch"], "pulse", 5, "promptness", "size").orderBy("sample").toPandas()
    assert np.allclose(m.level, base, atol=0.05) and np.allclose(m.arrival, slope, atol=0.08)


def test_multi_fits_give_a_gain(spark):
    rng = np.random.default_rng(9)
    lines = {"a": 1000.0, "b": 1500.0, "c": 2200.0}
    x = np.concatenate([rng.normal(e * 1.002, 2, 3000) for e in lines.values()])
    fits = learning.multi_fits(spark.createDataFrame(pd.DataFrame({"ch": 1, "x": x})), ["ch"], "x", lines, 30.0, 0.5)
    assert fits.count() == 3
    g = learning.gain_polynomial(fits.select("ch", F.col("peak").alias("height"), "energy"), ["ch"]).first()
    assert g.c + g.b * 1500 + g.a * 1500**2 == pytest.approx(1.002, abs=2e-4)


def test_best_combination_takes_every_channel_and_height(spark):
    from itertools import combinations

    from pulseloom.plans import catalogue

    at = "/root/testdata/sf0.01"
    held = spark.read.parquet(f"{at}/part.parquet").toPandas().groupby("p_size").p_retailprice
    want = {c: min((abs(1000 + (b - a) / (d - a) * 900 - 1300), a, b, d) for a, b, d in combinations(sorted(set(h)), 3)) for c, h in held}
    got = {r.p_size: (r.h0, r.h1, r.h2) for r in catalogue.QUERIES["combinatoric_assignment_all"](spark, at).collect()}
    assert got == {c: w[1:] for c, w in want.items()} and set(got) == set(range(1, 51))
    # more heights than a block, the best among the lowest; and too few
    rng = np.random.default_rng(10)
    heights = np.unique(np.round(rng.uniform(900, 1000, 150), 3)).tolist()
    rows = [(1, h) for h in heights] + [(2, 5.0), (2, 6.0), (2, 6.0), (3, None)]
    got = pulse_stats.best_combination([1000.0, 1300.0, 1900.0], spark.createDataFrame(rows, "ch int, height double"), ["ch"]).collect()
    best = min((abs(1000 + (b - a) / (d - a) * 900 - 1300), a, b, d) for a, b, d in combinations(heights, 3))
    assert [(r.ch, r.rms, r.h0, r.h1, r.h2) for r in got] == [(1, *best)]

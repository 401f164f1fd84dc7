"""Entropies against integrals and double sums, corrections against plain searches."""

import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulseloom.operators import entropies as E


def density(x, grid, w):
    return np.exp(-np.abs(np.subtract.outer(grid, x)) / w).sum(1) / (2 * w * len(x))


def plain(p, q, w):
    """The integral by Gauss-Legendre between all values."""
    cuts = np.unique(np.concatenate([p, q]))
    cuts = np.concatenate([cuts[0] - np.array([40.0, 20, 10, 5, 2]) * w, cuts, cuts[-1] + np.array([2.0, 5, 10, 20, 40]) * w])
    cuts = np.unique(np.concatenate([np.linspace(a, b, max(2, int((b - a) / w) + 2)) for a, b in zip(cuts, cuts[1:], strict=False)]))
    u, weight = np.polynomial.legendre.leggauss(12)
    grid = (cuts[:-1, None] + cuts[1:, None]) / 2 + (cuts[1:] - cuts[:-1])[:, None] / 2 * u
    one = density(p, grid.ravel(), w)
    f = np.where(one > 0, one * np.log(np.maximum(density(q, grid.ravel(), w), 5e-324)), 0.0)
    return -float((f.reshape(grid.shape) @ weight * (cuts[1:] - cuts[:-1]) / 2).sum())


def frame(spark, by_channel):
    return spark.createDataFrame([(c, float(v)) for c, x in by_channel.items() for v in x], "ch int, x double")


@pytest.mark.parametrize("w", [0.05, 1.0, 30.0])
def test_exact_entropies(spark, w):
    r = np.random.default_rng(1)
    p = {1: r.normal(0, 3, 200), 2: np.round(r.normal(5, 2, 150)), 3: np.array([4.0]), 4: np.concatenate([r.normal(-40, 1, 20), r.normal(60, 1, 20)]), 5: np.array([1.0, 1.0])}
    q = {1: r.normal(1, 2, 170), 2: np.round(r.normal(4, 3, 90)), 3: np.array([4.0, 6.0]), 4: r.normal(0, 30, 50), 6: np.array([1.0])}
    a, b = frame(spark, p).unionByName(spark.createDataFrame([(1, None), (1, float("nan")), (7, None)], "ch int, x double")), frame(spark, q)
    own = {x.ch: x.entropy for x in E.entropy(a, ["ch"], "x", w).collect()}
    cross = {x.ch: x.entropy for x in E.cross_entropy(a, b, ["ch"], "x", w).collect()}
    assert sorted(own) == [1, 2, 3, 4, 5] and sorted(cross) == [1, 2, 3, 4]
    assert own[3] == pytest.approx(1 + np.log(2 * w)) == own[5]
    for c in own:
        assert own[c] == pytest.approx(plain(p[c], p[c], w), abs=2e-6), c
    for c in cross:
        if w > 0.05 or c < 4:
            assert cross[c] == pytest.approx(plain(p[c], q[c], w), rel=1e-6, abs=2e-6), c
    if w == 1.0:
        kl = {x.ch: x.divergence for x in E.divergence(a, b, ["ch"], "x", w).collect()}
        assert all(kl[c] == pytest.approx(cross[c] - own[c]) and kl[c] >= 0 for c in cross)


def test_entropies_of_far_and_no_values(spark):
    far = frame(spark, {1: [0.0, 1e9], 2: [0.0]})
    got = {x.ch: x.entropy for x in E.entropy(far, ["ch"], "x", 1.0).collect()}
    assert got[1] == pytest.approx(1 + np.log(4)) and got[2] == pytest.approx(1 + np.log(2))
    assert E.cross_entropy(far, frame(spark, {1: [5e8], 2: [3.0]}), ["ch"], "x", 1.0).where("ch = 1").first().entropy == np.inf
    assert E.entropy(far.limit(0), ["ch"], "x", 1.0).collect() == []
    with pytest.raises(ValueError):
        E.entropy(far, ["ch"], "x", 0.0)


def search(f, a, b, tolerance=1.48e-8):
    s = E.brent(a, b, tolerance)
    n, x = 1, next(s)
    try:
        while True:
            x = s.send(f(x))
            n += 1
    except StopIteration as end:
        return (*end.value, n)


def test_brent_finds_minima():
    for f, want in ((lambda x: (x - 0.3) ** 2, 0.3), (lambda x: np.cosh(x + 2), -2), (lambda x: abs(x - 5) ** 1.5, 5), (lambda x: x**4 - x, 0.25 ** (1 / 3))):
        x, value, n = search(f, 0, 0.001)
        assert x == pytest.approx(want, abs=1e-3 if value == 0 else 2e-5) and value <= f(want) + 1e-9 and n < 90


def test_drift_by_entropy(spark):
    """Planted slopes are found, and are where a plain search over NumPy histograms ends."""
    r = np.random.default_rng(42)
    rows, plain_slopes = [], {}
    for ch, slope in ((1, 0.01), (2, -0.004)):
        a, true = r.standard_normal(4000) + 100, r.choice([100.0, 160.0, 190.0], 4000) + r.standard_normal(4000)
        b = true / (1 + slope * (a - 100))
        rows += [(ch, float(x), float(y)) for x, y in zip(a, b, strict=True)]
        off, top = np.median(a), 1.25 * np.percentile(b, 99)
        n = int(2 ** np.ceil(np.log2(np.clip(int(top / 0.2 + 0.5), 1024, 32768))))
        k = np.arange(n)
        kernel = np.exp(-0.5 * (np.minimum(k, n - k) * top / n / 0.5) ** 2)

        def cost(s, a=a, b=b, off=off, top=top, n=n, kernel=kernel):
            h = np.fft.irfft(np.fft.rfft(kernel / kernel.sum()) * np.fft.rfft(np.histogram(b * (1 + s * (a - off)), n, (0, top))[0]), n)
            h = h[h > 0]
            return -(h * np.log(h)).sum()

        plain_slopes[ch] = (slope, search(cost, 0, 0.001)[0], off)
    df = spark.createDataFrame([*rows, (1, None, 3.0), (3, 1.0, None)], "ch int, a double, b double")
    got = {x.ch: x for x in E.drift_by_entropy(df, ["ch"], "b", "a").collect()}
    assert sorted(got) == [1, 2]
    for ch, (slope, plain_slope, off) in plain_slopes.items():
        assert got[ch].slope == pytest.approx(slope, abs=1e-3) and got[ch].offset == pytest.approx(off)
        assert got[ch].slope == pytest.approx(plain_slope, abs=1e-7)


def test_legendre_series(spark):
    c = [0.3, -0.2, 0.05, 0.4, -0.1]
    got = spark.createDataFrame([(float(t),) for t in np.linspace(-1, 1, 9)], "t double").select("t", E.legendre(F.col("t"), F.array(*map(F.lit, c))).alias("y")).collect()
    assert all(x.y == pytest.approx(np.polynomial.legendre.legval(x.t, [0, *c])) for x in got)
    assert spark.range(1).select(E.legendre(F.lit(0.4), F.array().cast("array<double>")).alias("y")).first().y == 0


def test_time_drift_by_entropy(spark):
    """Planted gains are found; times outside change nothing."""
    r = np.random.default_rng(3)
    start = datetime.datetime(2024, 1, 1, tzinfo=datetime.UTC)
    truth, rows = {1: [0.004, -0.002], 2: [-0.003]}, []
    for ch, c in truth.items():
        n = 6000
        t = np.sort(r.uniform(0, 3000 * len(c), n))
        t[0], t[-1] = 0, 3000 * len(c)
        h = r.choice([1000.0, 1500.0, 2200.0], n) + 0.3 * r.standard_normal(n)
        h /= 1 + np.polynomial.legendre.legval(2 * t / t[-1] - 1, [0, *c])
        rows += [(ch, start + datetime.timedelta(seconds=float(a)), float(b)) for a, b in zip(t, h, strict=True)]
    df = spark.createDataFrame(rows, "ch int, at timestamp, h double")
    model = E.time_drift_by_entropy(df, ["ch"], "at", "h", 1.0)
    got = {x.ch: x for x in model.collect()}
    for ch, c in truth.items():
        assert len(got[ch].coefficients) == {1: 3, 2: 1}[ch] and got[ch].after < got[ch].before
        assert np.allclose(got[ch].coefficients, [*c, 0.0][: len(got[ch].coefficients)], atol=1e-4), got[ch].coefficients
    later = df.withColumn("at", F.col("at") + F.expr("interval 10 days"))
    assert E.time_drift_corrected(later, model, ["ch"], "at", "h", "new").where("new <> h").count() == 0
    fixed = E.time_drift_corrected(df, model, ["ch"], "at", "h", "new")
    width = {(x.ch, x.k): x.s for x in fixed.withColumn("k", F.when(F.col("new") < 1200, 1).when(F.col("new") < 1800, 2).otherwise(3)).groupBy("ch", "k").agg(F.stddev("new").alias("s")).collect()}
    assert all(s < 0.45 for s in width.values())
    assert E.time_drift_by_entropy(df.limit(0), ["ch"], "at", "h", 1.0).collect() == []

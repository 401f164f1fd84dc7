"""Anchor calibrations against plain NumPy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulseloom.operators import calibration as C

ENERGY = np.linspace(3000, 6000, 10)
HEIGHT = ENERGY**0.8
OUT = {"linear": lambda h, y: y, "linear_plus_zero": lambda h, y: y, "loglog": lambda h, y: np.exp(y), "gain": lambda h, y: h / y, "invgain": lambda h, y: h * y, "loggain": lambda h, y: h * np.exp(-y)}
PLANE = {"linear": lambda h, e: (h, e), "linear_plus_zero": lambda h, e: (np.append(h[0] / 1000, h), np.append(e[0] / 1000, e)), "loglog": lambda h, e: (np.log(h), np.log(e)), "gain": lambda h, e: (h, h / e), "invgain": lambda h, e: (h, e / h), "loggain": lambda h, e: (h, np.log(h / e))}


def plain_spline(x, y):
    """All cubics' coefficients from one system: values, equal slopes and bends at inner knots, no bend at the ends."""
    n = len(x) - 1
    a, b = np.zeros((4 * n, 4 * n)), np.zeros(4 * n)
    row = 0
    for k in range(n):
        d = x[k + 1] - x[k]
        a[row, 4 * k], b[row] = 1, y[k]
        a[row + 1, 4 * k : 4 * k + 4], b[row + 1] = [1, d, d**2, d**3], y[k + 1]
        row += 2
        if k < n - 1:
            a[row, 4 * k + 1 : 4 * k + 4], a[row, 4 * k + 5] = [1, 2 * d, 3 * d**2], -1
            a[row + 1, 4 * k + 2 : 4 * k + 4], a[row + 1, 4 * k + 6] = [2, 6 * d], -2
            row += 2
    a[row, 2], a[row + 1, 4 * n - 2 : 4 * n] = 2, [2, 6 * (x[n] - x[n - 1])]
    c = np.linalg.solve(a, b).reshape(n, 4)

    def at(t):
        if t <= x[0]:
            return c[0, 0] + c[0, 1] * (t - x[0])
        if t >= x[-1]:
            d = x[-1] - x[-2]
            return y[-1] + (c[-1, 1] + 2 * c[-1, 2] * d + 3 * c[-1, 3] * d**2) * (t - x[-1])
        k = np.searchsorted(x, t, "right") - 1
        return np.polyval(c[k, ::-1], t - x[k])

    return at


def plain_energy(kind, h, e, t):
    x, y = PLANE[kind](np.asarray(h, float), np.asarray(e, float))
    return OUT[kind](t, plain_spline(x, y)(np.log(t) if kind == "loglog" else t))


def table(spark, rows, schema="ch int, height double, energy double"):
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="module")
def anchors(spark):
    rows = [(1, float(h), float(e)) for h, e in zip(HEIGHT, ENERGY, strict=True)]
    rows += [(2, float(h), float(e)) for h, e in ((500, 1000), (800, 1700), (2000, 5000))]
    rows += [(3, 500.0, 1000.0), (3, 900.0, 2000.0)]
    return table(spark, rows[::-1] + [(1, None, 7.0), (4, 5.0, None)])


def spread(spark, fitted, heights):
    points = spark.createDataFrame([(float(h),) for h in heights], "t double")
    return fitted.join(points, F.lit(True), "inner")


def test_curves_through_anchors(spark, anchors):
    fitted = C.curves(anchors, ["ch"], C.KINDS).cache()
    assert fitted.count() == 18 and fitted.where("problem is not null").count() == 0
    by = {1: (HEIGHT, ENERGY), 2: ([500, 800, 2000], [1000, 1700, 5000]), 3: ([500, 900], [1000, 2000])}
    step = 1e-3
    got = spread(spark, fitted, [1, 250, 500, 650, 777, 800, 905, 2000, 3000]).select("ch", "kind", "t", C.energy_of(F.col("t")).alias("e"), C.slope_of(F.col("t")).alias("s"), C.uncertainty_of(F.col("t")).alias("u")).collect()
    assert len(got) == 18 * 9
    for r in got:
        h, e = by[r.ch]
        f = lambda t, r=r, h=h, e=e: plain_energy(r.kind, h, e, t)
        assert r.e == pytest.approx(f(r.t), rel=1e-9) and r.u == 0
        assert r.s == pytest.approx((f(r.t + step) - f(r.t - step)) / (2 * step), rel=1e-4, abs=1e-6), (r.ch, r.kind, r.t)
    at = anchors.where("height is not null and energy is not null").join(fitted, "ch")
    assert at.where(F.abs(C.energy_of(F.col("height")) - F.col("energy")) > 1e-8 * F.col("energy")).count() == 0


def test_heights_of_energies(spark, anchors):
    fitted = C.curves(anchors.where("ch < 3"), ["ch"], C.KINDS)
    heights = [400, 500, 600, 604.3, 800, 1000, 1051, 1300]
    back = spread(spark, fitted, heights).withColumn("e", C.energy_of(F.col("t"))).select("ch", "kind", "t", C.height_of(F.col("e")).alias("b"), C.height_of(F.lit(-1e9)).alias("none")).collect()
    for r in back:
        assert r.b == pytest.approx(r.t, rel=1e-9), r
        assert r.none is None
    rising = {(r.ch, r.kind): r.up for r in fitted.select("ch", "kind", C.rises().alias("up")).collect()}
    assert all(v for (ch, kind), v in rising.items() if ch == 1)
    e = np.array([277.0, 392.0, 525.0, 705.0, 851.0, 930.0])
    h = e * 10 / (1 + e / 2500)
    turned = np.append(h[:5], h[5] * (h[5] / h[4]) ** -0.85)
    two = table(spark, [(k, float(a), float(b)) for k, v in ((1, h), (2, turned)) for a, b in zip(v, e, strict=True)])
    assert {r.ch: r.up for r in C.curves(two, ["ch"], ["gain"]).select("ch", C.rises().alias("up")).collect()} == {1: True, 2: False}


def test_conversions_near_a_power_law(spark, anchors):
    fitted = C.curves(anchors.where("ch = 1"), ["ch"])
    energies = np.linspace(3500, 5500, 10)
    rows = spread(spark, fitted, energies**0.8).withColumn("e", F.pow("t", F.lit(1.25))).select("e", "t", C.energy_of(F.col("t")).alias("got"), C.height_of(F.col("e")).alias("back")).collect()
    assert all(abs(r.got - r.e) < 0.1 and abs(r.back - r.t) < 0.1 for r in rows)


def test_one_anchor(spark):
    fitted = C.curves(table(spark, [(1, 500.0, 1000.0)]), ["ch"], ["loglog", "linear"], power=1.25)
    got = {(r.kind, r.t): r.e for r in spread(spark, fitted, [250, 500, 4000]).select("kind", "t", C.energy_of(F.col("t")).alias("e")).collect()}
    for t in (250.0, 500.0, 4000.0):
        assert got["loglog", t] == pytest.approx(1000 * (t / 500) ** (1 / 1.25))
        assert got["linear", t] == pytest.approx(2 * t)


def test_bad_anchors_leave_no_curve(spark, anchors):
    bad = table(spark, [(7, 3000.0, 6000.0), (7, 6000.0, 3000.0), (8, 1.0, 2.0), (9, 5.0, 1.0), (9, 5.0, 2.0), (10, -1.0, 1.0), (10, 5.0, 2.0)])
    got = {r.ch: (r.problem, r.e) for r in C.curves(bad, ["ch"], ["gain"]).withColumn("e", C.energy_of(F.lit(10.0))).collect()}
    assert got[7][1] is None and "rise" in got[7][0] and got[8][0] is None and "rise" in got[9][0] and "positive" in got[10][0]
    few = C.curves(bad.where("ch = 8"), ["ch"], ["gain"], approximate=True).first()
    assert "few" in few.problem and few.pieces is None
    assert C.curves(bad.limit(0), ["ch"]).collect() == []
    out = C.calibrated(table(spark, [(1, 600.0, 0.0), (7, 600.0, 0.0), (99, 1.0, 0.0)]), C.curves(anchors.unionByName(bad), ["ch"]), ["ch"], "height", "out").select("ch", "out").collect()
    assert {r.ch: r.out is None for r in out} == {1: False, 7: True, 99: True}
    with pytest.raises(ValueError):
        C.curves(bad, ["ch"], ["cubic"])


def test_approximate_curves(spark):
    r = np.random.default_rng(3)
    e = np.linspace(3000, 6000, 12)
    h = e * (1 + 0.001 * r.standard_normal(12))
    rows = [(1, float(a), float(b), float(0.001 * b), float(0.0001 * b)) for a, b in zip(h, e, strict=True)]
    fitted = C.curves(table(spark, rows, "ch int, height double, energy double, height_err double, energy_err double"), ["ch"], C.KINDS, approximate=True).cache()
    at = spread(spark, fitted, np.linspace(3000, 6000, 101)).select("kind", "t", C.energy_of(F.col("t")).alias("e"), C.uncertainty_of(F.col("t")).alias("u")).collect()
    for kind in C.KINDS:
        mine = [x for x in at if x.kind == kind]
        assert np.mean([x.u for x in mine]) > 0.2 * np.mean(0.001 * e), kind
        assert np.abs([x.e - x.t for x in mine]).max() < 30
    neg = spread(spark, fitted, [-10000, -1000, 0, 9000]).where("kind <> 'loglog'").select(C.energy_of(F.col("t")).alias("e")).collect()
    assert all(x.e is not None and np.isfinite(x.e) for x in neg)
    # the variance's pieces are the process's own variance, and its mean the best linear predictor
    x, y, err = np.array([0.5, 1, 2.5, 3, 5]), np.array([1.0, 1.2, 3.1, 3.0, 4.5]), np.full(5, 0.1)
    p = C._Process(x, y, err)
    for t in (-2.0, 0.1, 0.7, 2.0, 4.4, 5.0, 9.0):
        piece = next(q for q in p.errors() if t <= q["x_next"])
        assert np.polyval(piece["c"][::-1], (t - piece["x"]) / piece["width"]) == pytest.approx(float(p.variance(np.array([t]))[0]), rel=1e-6)
    cov = p.sigma**2 * p.kernel(x[:, None], x[None, :]) + 1e8 * (1 + x[:, None] * x[None, :])  # a line of unknown size
    mean = cov @ np.linalg.solve(cov + np.diag(err**2), y)
    assert np.allclose(p.fitted, mean, atol=1e-4)
    assert all(p.likelihood(p.sigma) >= p.likelihood(p.sigma * f) - 1e-9 for f in (0.5, 0.9, 0.99, 1.01, 1.1, 2))


def test_leave_one_out(spark, anchors):
    got = C.leave_one_out(anchors.where("ch < 3"), ["ch"], ["linear", "gain", "loglog"]).collect()
    assert len(got) == 3 * 13
    h2, e2 = np.array([500.0, 800, 2000]), np.array([1000.0, 1700, 5000])
    for r in got:
        h, e = (HEIGHT, ENERGY) if r.ch == 1 else (h2, e2)
        k = int(np.argmin(abs(e - r.energy)))
        assert r.error == pytest.approx(plain_energy(r.kind, np.delete(h, k), np.delete(e, k), h[k]) - e[k], rel=1e-6, abs=1e-6)


def test_anchors_added_and_taken_away(spark):
    a = C.anchors_table(table(spark, [(1, 10.0, 100.0, "A"), (1, 20.0, 200.0, "B"), (2, 11.0, 100.0, "A"), (2, 30.0, 300.0, "")], "ch int, height double, energy double, name string"), ["ch"])
    assert a.where("ch = 1 and name = 'A'").select("height_err", "energy_err").first() == (0.01, 0.1)
    new = table(spark, [(1, 12.0, 150.0, "A"), (1, 21.0, 200.005, ""), (2, 40.0, 400.0, "A2"), (3, 1.0, 2.0, "N")], "ch int, height double, energy double, name string")
    both = C.with_anchors(a, new, ["ch"])
    assert sorted((r.ch, r.height, r.name) for r in both.collect()) == [(1, 12.0, "A"), (1, 21.0, ""), (2, 11.0, "A"), (2, 30.0, ""), (2, 40.0, "A2"), (3, 1.0, "N")]
    assert both.where("ch = 3").select("height_err", "energy_err").first() == (0.001, 0.01)
    with pytest.raises(ValueError):
        C.with_anchors(a, new, ["ch"], replace=False)
    left = lambda **k: sorted((r.ch, r.name) for r in C.without_anchors(both, **k).collect())
    assert left(prefix="A") == [(1, ""), (2, ""), (3, "N")]
    assert left(names=["A"]) == [(1, ""), (2, ""), (2, "A2"), (3, "N")]
    assert left(energy=299.0, within=2.0) == [(1, ""), (1, "A"), (2, "A"), (2, "A2"), (3, "N")]

"""Filters of all kinds on planted pulses, decays and arrival times."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulseloom.functions import pulses as P
from pulseloom.operators import filters
from pulseloom.plans.channels import Channels
from pulseloom.plans.recipe import Recipe, Step

N, PRE, DT = 64, 16, 1e-3


def shape(late=0.0):
    t = np.arange(N) - PRE - late
    return np.where(t > 0, np.exp(-np.maximum(t, 0) / 12) - np.exp(-np.maximum(t, 0) / 2.5), 0.0)


@pytest.fixture(scope="module")
def data(spark):
    """Pulses of channel 1 and 2 with coloured noise, and noise records."""
    r = np.random.default_rng(1)
    rows = []
    for ch in (1, 2):
        for k in range(500):
            noise = np.convolve(r.normal(0, 2, N + 8), [1, 0.7, 0.3], "same")[4:-4]
            size = 1000 * ch * r.uniform(0.95, 1.05) if k % 2 else 0.0
            rows.append((ch, k, size, [float(x) for x in 500 + noise + size * shape()]))
    return spark.createDataFrame(rows, "ch int, k int, size double, pulse array<double>").cache()


@pytest.fixture(scope="module")
def table(data):
    kinds = ["five_lag", "one_lag", "noexp", "fourier", "arrival"]
    made = filters.filter_table(data.where("k % 2 = 1"), data.where("k % 2 = 0"), ["ch"], "pulse", PRE, kinds, dt=DT, decays=[0.012]).cache()
    return made, {(r.ch, r.kind): r for r in made.collect()}


def test_filters_measure_heights_and_are_blind(table, data):
    made, rows = table
    assert len(rows) == 10
    for (ch, kind), f in rows.items():
        w = np.array(f.weights)
        assert len(w) == (N if kind in ("one_lag", "arrival") else N - 4)
        assert abs(w.sum()) < 1e-6 * np.abs(w).sum() and f.peak == pytest.approx(1000 * ch * shape().max(), rel=0.02)
        if kind == "noexp":
            tail = np.exp(-np.arange(N) * DT / 0.012)
            assert all(abs(tail[k : k + len(w)] @ w) < 1e-9 for k in range(5))  # a decay shifted is a decay
            assert abs(tail[2:-2] @ np.array(rows[ch, "five_lag"].weights)) > 1e-3
    for ch in (1, 2):
        assert rows[ch, "five_lag"].variance <= rows[ch, "noexp"].variance
        assert rows[ch, "one_lag"].variance <= rows[ch, "arrival"].variance * (1 + 1e-9)
        assert rows[ch, "fourier"].variance == pytest.approx(rows[ch, "five_lag"].variance, rel=0.5)
        assert rows[ch, "one_lag"].resolution == pytest.approx(rows[ch, "one_lag"].peak / np.sqrt(8 * np.log(2) * rows[ch, "one_lag"].variance))
    spread = filters.filtered(data.where("k % 2 = 0"), made.where("kind = 'one_lag'"), ["ch"], "pulse", "y", "at").groupBy("ch").agg(F.variance("y").alias("v")).collect()
    assert all(s.v == pytest.approx(rows[s.ch, "one_lag"].variance, rel=0.3) for s in spread)


@pytest.mark.parametrize("kind", ["five_lag", "one_lag", "noexp", "fourier", "arrival"])
def test_records_filtered_in_the_jvm(table, data, kind):
    made, rows = table
    got = filters.filtered(data.where("k % 2 = 1"), made.where(F.col("kind") == kind), ["ch"], "pulse", "y", "at").select("ch", "size", "pulse", "y", "at").collect()
    off = [r.y / (r.size * shape().max()) - 1 for r in got]
    assert len(got) == 500 and abs(np.mean(off)) < 0.02 and np.std(off) < 0.02
    for r in got[:20]:
        w = np.array(rows[r.ch, kind].weights)
        if kind in ("one_lag", "arrival"):
            assert r.y == pytest.approx(w @ np.array(r.pulse))
        else:
            assert r.y == pytest.approx(filters.five_lag_peak(np.array(r.pulse), w)) and abs(r.at) < 1


def test_arrival_filter_sees_shifts_and_heights_stay(spark, table):
    made, rows = table
    late = [-0.3, 0.0, 0.3]
    df = spark.createDataFrame([(1, t, [float(x) for x in 500 + 1000 * shape(t)]) for t in late], "ch int, late double, pulse array<double>")
    got = {r.late: r for r in filters.filtered(df, made.where("kind = 'arrival'"), ["ch"], "pulse", "y", "at").collect()}
    one = {r.late: r for r in filters.filtered(df, made.where("kind = 'one_lag'"), ["ch"], "pulse", "y", "at").collect()}
    assert got[-0.3].at < got[0.0].at - 0.1 < got[0.3].at - 0.2
    assert abs(got[0.3].y / got[-0.3].y - 1) < 0.02 and all(r.at is None for r in one.values())
    models, r = np.stack([shape(), np.gradient(shape()), np.ones(N), np.exp(-np.arange(N) / 9)]), 0.5 ** np.arange(N)
    solved = filters.blind_filters(models, r)
    assert np.allclose(solved @ models.T, np.eye(4), atol=1e-9)
    cov = r[np.abs(np.subtract.outer(np.arange(N), np.arange(N)))]
    for w in np.random.default_rng(2).normal(0, 1, (5, N)):  # what keeps the outputs only adds noise
        w -= np.linalg.lstsq(models.T, w, rcond=None)[0] @ models
        assert (solved[0] + 0.1 * w) @ cov @ (solved[0] + 0.1 * w) > solved[0] @ cov @ solved[0]
    base = np.array(rows[1, "arrival"].baseline_weights)
    assert base @ np.full(N, 7.0) == pytest.approx(7.0)


def test_limits_cuts_and_records_to_be_blind_to(data):
    pulses, noise = data.where("k % 2 = 1 and ch = 1"), data.where("k % 2 = 0 and ch = 1")
    make = lambda *kinds, **k: filters.filter_table(pulses, noise, ["ch"], "pulse", PRE, kinds, dt=DT, **k).first()
    for kind in ("five_lag", "one_lag", "fourier", "arrival"):
        w = np.array(make(kind, f_max=100.0).weights)
        power = np.abs(np.fft.rfft(w)) ** 2
        assert power[np.fft.rfftfreq(len(w), DT) > 101].sum() < 1e-12 * power.sum(), kind
    assert make("one_lag", f_3db=60.0).variance != make("one_lag").variance
    w = np.array(make("five_lag", cut_pre=5, cut_post=9).weights)
    assert len(w) == N - 4 and (w[:5] == 0).all() and (w[-9:] == 0).all() and abs(w.sum()) < 1e-9
    wave = np.sin(np.arange(N - 4) / 3)
    assert abs(np.array(make("noexp", blind=[wave.tolist()]).weights) @ wave) < 1e-9
    assert filters.filter_table(pulses, noise.limit(0), ["ch"], "pulse", PRE).collect() == []
    for bad in ({"kinds": ["six_lag"]}, {"kinds": ["noexp"]}, {"kinds": ["noexp"], "decays": [0.0]}, {"cut_pre": -1}):
        with pytest.raises(ValueError):
            filters.filter_table(pulses, noise, ["ch"], "pulse", PRE, **bad)


def test_filters_in_recipes(data, spark, tmp_path):
    steps = [Step.named(f"filter_{kind}", ["pulse"], [f"{kind}_y", f"{kind}_at"], pulse="pulse", pre=PRE, noise="size = 0", output=f"{kind}_y", place=f"{kind}_at", dt=DT, decays=[0.012]) for kind in ("five_lag", "arrival")]
    ch = Channels(data, key="ch")
    for s in steps:
        ch = ch.with_step(s)
    want = ch.df.select("ch", "k", "five_lag_y", "five_lag_at", "arrival_y", "arrival_at").orderBy("ch", "k").collect()
    assert all(r.five_lag_y is not None for r in want)
    ch.recipe.save(str(tmp_path / "r"))
    again = Recipe.load(spark, str(tmp_path / "r")).replay(data).select("ch", "k", "five_lag_y", "five_lag_at", "arrival_y", "arrival_at").orderBy("ch", "k").collect()
    assert len(again) == len(want) and all(list(a)[:2] == list(b)[:2] and list(a)[2:] == pytest.approx(list(b)[2:], rel=1e-6, abs=1e-9) for a, b in zip(again, want, strict=True))


def test_five_lag_of_straight_outputs_has_no_vertex(spark):
    """Whole numbers on a line have no curvature at all; rounding errors as curvature gave heights of 7e18."""
    pulses = [[a + b * k for k in range(5)] for a in range(-40, 40, 7) for b in (1, 3, 11, 101)]
    rows = spark.createDataFrame([(p,) for p in pulses], "pulse array<int>")
    for y, x in (P.five_lag(F.col("pulse"), [3.0]), [filters.five_lag(F.col("pulse"), F.array(F.lit(3.0)))[k] for k in ("height", "place")]):
        assert set(map(tuple, rows.select(y, x).collect())) == {(None, None)}


def test_rounded_as_duckdb(spark):
    import duckdb

    from pulseloom.plans.catalogue import _rounded

    x = [s * (k * 7919 + 0.5) / 1e6 for k in range(3000) for s in (1, -1)] + [0.0, 7.3e18, -2.5e-7, None]
    got = [r[0] for r in spark.createDataFrame(enumerate(x), "k int, x double").orderBy("k").select(_rounded(F.col("x"), 6)).collect()]
    assert got == [r[0] for r in duckdb.execute("SELECT round(x, 6) FROM (SELECT unnest(?::DOUBLE[]) AS x)", [x]).fetchall()]

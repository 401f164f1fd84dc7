"""Streams in chunks against the same data whole."""

import numpy as np
import pytest

from pulseloom.operators import streams as S


def chunks(spark, by_channel, sizes):
    rows = []
    for c, x in by_channel.items():
        at = k = 0
        while at < len(x):
            n = sizes[k % len(sizes)]
            rows.append((c, k, at, [int(v) for v in x[at : at + n]]))
            at, k = at + n, k + 1
    return spark.createDataFrame(rows[::-1], "ch int, chunk long, start long, samples array<smallint>")


def plain_triggers(x, w, threshold):
    """Peaks of all outputs but the last, each the first since an output below zero."""
    y = np.array([np.dot(x[k : k + len(w)], w) for k in range(len(x) - len(w))], float)
    out, last_peak = [], -1
    for p in range(1, len(y) - 1):
        if y[p] > threshold and y[p] >= y[p + 1] and y[p] > y[p - 1]:
            if (y[max(last_peak, 0) + 1 : p] < 0).any():
                out.append(p + 1)
                last_peak = p
    return out


@pytest.mark.parametrize("sizes", [[1000], [7], [3, 5, 4], [2], [64]])
def test_triggers_as_in_one_piece(spark, sizes):
    r = np.random.default_rng(2)
    data = {c: np.clip(np.cumsum(r.normal(0, 3, 400)) * 0.2 + r.normal(0, 4, 400), -90, 90).round() for c in range(4)}
    data |= {4: np.zeros(50), 5: np.arange(5.0), 6: np.array([1.0]), 7: np.repeat([0, 9, 9, -9, 9], 20)}
    for w in ([-1.0, 1.0], [0.5, 1.0, -0.25, -1.0], [1.0]):
        got = {c: [] for c in data}
        for row in S.peak_triggers(chunks(spark, data, sizes), ["ch"], w, 2.5).collect():
            got[row.ch].append(row.trigger)
        assert {c: sorted(t) for c, t in got.items()} == {c: plain_triggers(x, w, 2.5) for c, x in data.items()}
    with pytest.raises(ValueError):
        S.peak_triggers(chunks(spark, data, sizes), ["ch"], [1.0], 0.0)


def test_a_hole_ends_the_outputs_not_the_state(spark):
    x = np.array([0, -5, -5, 0, 0, 0, 0, 0, 9, 0, 0, 9, 0, 0])
    whole = chunks(spark, {1: x}, [4])
    assert [r.trigger for r in S.peak_triggers(whole, ["ch"], [1.0], 5.0).collect()] == [9]
    assert [r.trigger for r in S.peak_triggers(whole.where("chunk <> 1"), ["ch"], [1.0], 5.0).collect()] == [12]  # whether 9 was a peak can't be told
    halo = {r.chunk: r.halo for r in S.with_halo(whole.where("chunk <> 1"), ["ch"], 6).collect()}
    assert halo == {0: [], 2: [0, 0], 3: []}
    assert {r.chunk: r.halo for r in S.with_halo(whole, ["ch"], 6).collect()}[0] == [0, 0, 0, 0, 9, 0]
    assert S.peak_triggers(whole.limit(0), ["ch"], [1.0], 5.0).collect() == []


@pytest.mark.parametrize("sizes", [[1000], [7], [13, 5, 8]])
def test_correlations_across_borders(spark, sizes):
    r = np.random.default_rng(3)
    data = {c: np.round(np.convolve(r.normal(0, 20, 503), [1, 0.5, 0.25], "same") + 30 * c) for c in range(3)}
    data[2][100:104] += 4000
    stream = chunks(spark, data, sizes)
    got = {(x.ch, x.lag): x.value for x in S.continuous_correlation(stream, ["ch"], 12).collect()}
    for c, x in data.items():
        z = x - x.mean()
        for k in range(12):
            assert got[c, k] == pytest.approx((z[: len(z) - k] * z[k:]).sum() / len(z), rel=1e-9, abs=1e-6)
    found = {(x.ch, x.lag): x.value for x in S.block_correlation(stream, ["ch"], 4, 1000.0).collect()}
    for c, x in data.items():
        cut = x[: len(x) // 60 * 60].reshape(-1, 60)
        cut = cut - cut.mean(1, keepdims=True)
        cut = cut[np.abs(cut).max(1) <= 1000]
        assert len(cut) == (8 if c < 2 else 7)
        for k in range(4):
            assert found[c, k] == pytest.approx((cut[:, : 60 - k] * cut[:, k:]).sum() / len(cut) / 60, rel=1e-9, abs=1e-6)


def test_continuity(spark):
    rows = [(1, k, 64 * k) for k in range(30)] + [(2, k, 64 * k + (k > 17)) for k in range(30)] + [(3, 5, 0)] + [(4, k, 64 * k) for k in (1, 2)] + [(1, None, 5)]
    df = spark.createDataFrame(rows, "ch int, row_idx long, subframecount long")
    for slot in (1, 6, 1 << 16):
        got = {r.ch: (r.largest_gap, r.continuous) for r in S.continuity(df, ["ch"], "row_idx", "subframecount", 64, slot).collect()}
        assert got == {1: (64, True), 2: (65, False), 3: (None, False), 4: (64, True)}

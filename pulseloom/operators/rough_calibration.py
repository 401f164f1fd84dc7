"""Rough calibration: which peaks of a channel's spectrum are which known lines.

Peaks are maxima of a blurred fine histogram, counted as an aggregate.  Lines are given to peaks by one of three rules, for any number
of lines; then a polynomial gain through the assigned peaks turns heights into energies.  A channel has some tens of peaks, which
travel as one array; channels are independent rows.

* `assign_lines`: energies should be locally linear in height.  The misfit is a sum over neighbouring triples, so the best of all
  ordered combinations is found exactly by dynamic programming over pairs, in the cube of the number of peaks.
* `assign_by_gain`: energies should follow a quadratic gain.  This is no sum of local terms, so all combinations are tried; they are
  dealt to tasks by their first two members.
* `assign_by_three`: three lines fix a gain, nearest peaks give the others, the first good one or the best wins.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulseloom.functions import pulses as P
from pulseloom.operators.learning import gain_polynomial
from pulseloom.operators.quantiles import median

#: Bins of the fine histogram, which reaches MARGIN widths beyond the lowest and highest height.
BINS, MARGIN = 1 << 17, 3
#: Digits to which the rms of equal combinations agrees.
DIGITS = 9
#: Combinations that are scored together.
LOT = 4096
#: The height at which a rough gain must still be positive, and that at which a linear gain must keep a part of its size.
FAR, KEPT_AT = 1e5, 3e4


def _kinds(df: DataFrame, by: Sequence[str]) -> str:
    return "".join(f"`{c}` {df.schema[c].dataType.simpleString()}, " for c in by)


def turning_points(y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of maxima and minima in turn, the last place of a flat one; a maximum has a minimum on either side."""
    step = np.diff(y)
    moves = np.flatnonzero(step)
    up = step[moves] > 0
    before = np.concatenate([[False], up[:-1]]) if len(up) else up
    tops, lows = moves[~up & before], moves[up & ~before]
    return (tops[:-1], lows) if len(tops) and tops[-1] > lows[-1] else (tops, lows)


def blurred(counts: np.ndarray, fwhm: float) -> np.ndarray:
    """Counts convolved with a Gaussian, round the ends; fwhm in bins."""
    sigma = fwhm / np.sqrt(8 * np.log(2))
    return np.fft.irfft(np.fft.rfft(counts) * np.exp(-0.5 * (2 * np.pi * sigma * np.fft.rfftfreq(len(counts))) ** 2), len(counts))


def smoothed_peaks(df: DataFrame, by: Sequence[str], column: str, fwhm: float, bins: int = BINS) -> DataFrame:
    """by, height, level, prominence, rank: maxima of each channel's blurred spectrum, rank 1 the most prominent.

    Prominence is the level less the mean of the levels of the minima before and after.  Nulls and NaN count for nothing.
    """
    x = F.col(column).cast("double")
    rows = df.select(*by, x.alias("_x")).where("_x is not null and not isnan(_x)")
    span = rows.groupBy(*by).agg((F.min("_x") - MARGIN * fwhm).alias("_low"), ((F.max("_x") - F.min("_x") + 2 * MARGIN * fwhm) / bins).alias("_step"))
    at = F.least(F.floor((F.col("_x") - F.col("_low")) / F.col("_step")), F.lit(bins - 1)).cast("int")
    counts = rows.join(span, list(by)).groupBy(*by, "_low", "_step", at.alias("_bin")).agg(F.count("*").alias("_n"))

    def find(pdf: pd.DataFrame) -> pd.DataFrame:
        low, step = float(pdf["_low"].iloc[0]), float(pdf["_step"].iloc[0])
        y = blurred(np.bincount(pdf["_bin"], pdf["_n"], bins), fwhm / step)
        tops, lows = turning_points(y)
        out = pd.DataFrame({"height": low + (tops + 0.5) * step, "level": y[tops], "prominence": y[tops] - (y[lows[: len(tops)]] + y[lows[1 : len(tops) + 1]]) / 2})
        out = out.sort_values(["prominence", "height"], ascending=[False, True]).assign(rank=np.arange(1, len(out) + 1, dtype=np.int32))
        for c in by:
            out.insert(0, c, pdf[c].iloc[0])
        return out[[*by, "height", "level", "prominence", "rank"]]

    return counts.groupBy(*by).applyInPandas(find, _kinds(df, by) + "height double, level double, prominence double, rank int")


def _sorted_lines(lines: Sequence[float]) -> np.ndarray:
    out = np.sort(np.array(lines, float))
    if not len(out) or (np.diff(out) == 0).any():
        raise ValueError("lines must be some different energies")
    return out


def _heights(peaks: DataFrame, by: Sequence[str], n: int) -> DataFrame:
    """by, _h: each channel's different heights, ascending, where there are enough."""
    known = peaks.where(F.col("height").isNotNull()).groupBy(*by).agg(F.array_sort(F.collect_set(F.col("height").cast("double"))).alias("_h"))
    return known.where(F.size("_h") >= n)


def _mapped(df: DataFrame, by: Sequence[str], solve, extra: Sequence[str] = ()) -> DataFrame:
    """by, heights, rms for rows with _h; solve(heights, ...) gives (heights, rms), or None for no row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [solve(np.array(h, float), *more) for h, *more in zip(batch.column("_h").to_pylist(), *(batch.column(c).to_pylist() for c in extra), strict=True)]
            on = pa.array([f is not None for f in found], pa.bool_())
            keys = pa.RecordBatch.from_arrays([batch.column(c) for c in by], list(by)).filter(on)
            found = [f for f in found if f is not None]
            yield pa.RecordBatch.from_arrays([*keys.columns, pa.array([list(map(float, f[0])) for f in found], pa.list_(pa.float64())), pa.array([float(f[1]) for f in found], pa.float64())], [*by, "heights", "rms"])

    return df.select(*by, "_h", *extra).mapInArrow(run, _kinds(df, by) + "heights array<double>, rms double")


def best_chain(h: np.ndarray, e: np.ndarray, allowed: Sequence[Sequence[int]] | None = None) -> tuple[np.ndarray, float] | None:
    """The heights, ascending, whose energies are most nearly linear between every second neighbour; the lowest among those whose rms agrees to DIGITS.

    costs[j][a, b] is the least misfit of all lines from one on, if that line (j + 1) has height b and the one before has a.
    """
    n, k = len(h), len(e)
    able = np.ones((k, n), bool)
    if allowed is not None:
        able[:] = [np.isin(np.arange(n), list(a)) for a in allowed]
    cost = np.where(able[k - 1], 0.0, np.inf) * np.ones((n, 1))
    cost[np.tril_indices(n)] = np.inf
    costs = [cost]
    with np.errstate(divide="ignore", invalid="ignore"):
        for j in range(k - 2, 0, -1):
            now = np.full((n, n), np.inf)
            for b in np.flatnonzero(able[j][: n - 1]).tolist():
                if b:
                    now[:b, b] = _chained(h, e, j, h[:b, None], b, costs[0]).min(1)
            costs.insert(0, now)
    costs[0][~able[0]] = np.inf
    least = costs[0].min()
    if not np.isfinite(least):
        return None
    rounded = lambda s: np.floor(np.sqrt(s / (k - 2)) * 10.0**DIGITS + 0.5)
    at = np.argwhere(rounded(costs[0]) == rounded(least))[0].tolist()
    misfits: list[float] = []
    for j in range(1, k - 1):
        total = _chained(h, e, j, h[at[-2]], at[-1], costs[j])
        for before in reversed(misfits):  # added in the order of the search above, so that the same sums come out
            total = before + total
        step = int(np.flatnonzero(rounded(total) == rounded(least))[0])
        off = _off(h, e, j, h[at[-2]], at[-1])[step]
        misfits.append(off * off)
        at.append(at[-1] + 1 + step)
    return h[at], float(np.sqrt(total[step] / (k - 2)))


def _off(h: np.ndarray, e: np.ndarray, j: int, low: np.ndarray, b: int) -> np.ndarray:
    """Energy of height b, where the heights low and all above b have the lines before and after, less that of line j."""
    return e[j - 1] + (e[j + 1] - e[j - 1]) * ((h[b] - low) / (h[b + 1 :] - low)) - e[j]


def _chained(h: np.ndarray, e: np.ndarray, j: int, low: np.ndarray, b: int, cost: np.ndarray) -> np.ndarray:
    off = _off(h, e, j, low, b)
    return off * off + cost[b, b + 1 :]


def assign_lines(peaks: DataFrame, by: Sequence[str], lines: Sequence[float], allowed: Sequence[Sequence[int]] | None = None) -> DataFrame:
    """by, heights, rms: the heights of each channel's peaks that belong to the lines, both ascending.

    peaks: by, height, and for one or two lines rank: these take the best-ranked peaks (without rank, the lowest).
    allowed: for each line the places, from 0 for the lowest height, that it may have.  Channels with fewer heights than lines, or
    without an allowed combination, have no row; heights that repeat count once.
    """
    e = _sorted_lines(lines)
    if allowed is not None and len(allowed) != len(e):
        raise ValueError("there must be as many lists of places as lines")
    if len(e) > 2:
        return _mapped(_heights(peaks, by, len(e)), by, lambda h: best_chain(h, e, allowed))
    rank = F.col("rank").cast("double") if "rank" in peaks.columns else F.col("height").cast("double")
    each = peaks.where(F.col("height").isNotNull()).groupBy(*by, F.col("height").cast("double").alias("height")).agg(F.min(rank).alias("rank"))
    first = each.groupBy(*by).agg(F.slice(F.array_sort(F.collect_list(F.struct("rank", "height"))), 1, len(e)).alias("_r")).where(F.size("_r") == len(e))
    return first.select(*by, F.array_sort(F.col("_r.height")).alias("heights"), F.lit(0.0).alias("rms"))


def _gain_misfits(h: np.ndarray, e: np.ndarray) -> np.ndarray:
    """Root mean square of energies less heights over their quadratic gain, for rows of heights."""
    mid, half = (h[:, :1] + h[:, -1:]) / 2, (h[:, -1:] - h[:, :1]) / 2
    u = (h - mid) / half
    base = np.stack([np.ones_like(u), u, u * u], -1)
    gram = np.einsum("mki,mkj->mij", base, base)
    fit = np.linalg.solve(gram, np.einsum("mki,mk->mi", base, h / e)[..., None])
    with np.errstate(divide="ignore", invalid="ignore"):
        off = e - h / (base @ fit)[..., 0]
    return np.sqrt(np.nan_to_num((off * off).mean(1), nan=np.inf, posinf=np.inf))


def assign_by_gain(peaks: DataFrame, by: Sequence[str], lines: Sequence[float]) -> DataFrame:
    """by, heights, rms: the combination of each channel's heights whose quadratic gain leaves the least energy misfit; the lowest among equals.

    Three lines or more; with three every combination fits, and the lowest heights win.  The work is that of all combinations.
    """
    e = _sorted_lines(lines)
    k = len(e)
    if k < 3:
        raise ValueError("a quadratic gain takes three lines")
    ready = _heights(peaks, by, k)
    pairs = F.flatten(F.transform(F.sequence(F.lit(0), F.size("_h") - k), lambda i: F.transform(F.sequence(i + 1, F.size("_h") - (k - 1)), lambda j: F.struct(i.alias("i"), j.alias("j")))))
    dealt = ready.withColumn("_p", F.explode(pairs)).select(*by, "_h", "_p.i", "_p.j").repartition(*by, "i", "j")

    def solve(h: np.ndarray, i: int, j: int) -> tuple[np.ndarray, float]:
        best = (np.inf, h[[i, j, *range(j + 1, j + k - 1)]])
        rest = itertools.combinations(range(j + 1, len(h)), k - 2)
        while lot := list(itertools.islice(rest, LOT)):
            rows = h[np.column_stack([np.full((len(lot), 2), (i, j)), np.array(lot, int).reshape(len(lot), k - 2)])]
            rms = np.round(_gain_misfits(rows, e), 9)
            m = int(rms.argmin())
            if rms[m] < best[0]:
                best = (rms[m], rows[m])
        return best[1], best[0]

    scored = _mapped(dealt, by, solve, ["i", "j"])
    return scored.groupBy(*by).agg(F.min(F.struct("rms", "heights")).alias("_b")).select(*by, "_b.heights", "_b.rms")


def _three(h: np.ndarray, e: np.ndarray, within: float, kept: float, enough: float) -> tuple[np.ndarray, float] | None:
    """See assign_by_three."""
    found = []
    for (e0, e1), (p0, p1) in itertools.product(itertools.combinations(e, 2), itertools.combinations(h, 2)):
        slope = (p1 / e1 - p0 / e0) / (p1 - p0)
        start = p0 / e0 - p0 * slope
        if slope < 0 and 1 + KEPT_AT * slope / start > kept:
            for e2, p2 in itertools.product(e[e > e1], h[h > p1]):
                off = p2 / (start + slope * p2) - e2
                if abs(off / e2) < within:
                    found.append((abs(off), (p0, p1, p2), (e0, e1, e2)))
    best = None
    for _, ps, es in sorted(found):
        p, g = np.array(ps), np.array(ps) / np.array(es)
        a, b, c = np.polyfit(p, g, 2)
        if b > 0 or c + b * FAR + a * FAR**2 < 0 or b * b < 4 * a * c:
            continue
        with np.errstate(invalid="ignore", divide="ignore"):
            t = e * b - 1
            guess = (-t - np.sqrt(t * t - 4 * a * e * c * e)) / (2 * a * e)
        if not np.isfinite(guess).all():
            continue
        near = h[np.abs(h[:, None] - guess).argmin(0)]
        if len(np.unique(near)) < len(e):
            continue
        a, b, c = np.polyfit(near, near / e, 2)
        if c + b * FAR + a * FAR**2 < 0 or b * b < 4 * a * c:
            continue
        rms = float(np.sqrt(np.mean((e - near / np.polyval([a, b, c], near)) ** 2)))
        if best is None or rms < best[1]:
            best = (near, rms)
            if rms < enough:
                break
    return best


def assign_by_three(peaks: DataFrame, by: Sequence[str], lines: Sequence[float], within: float = 0.1, kept: float = 0.25, enough: float = 10.0) -> DataFrame:
    """by, heights, rms by gains through three lines, tried from the smallest error of the third; the first with an rms under `enough`, or the best.

    Two lines give a falling linear gain that keeps a part `kept` of itself at KEPT_AT, a third must lie within a relative error of it.
    The quadratic gain through the three, and that through all lines once they have the nearest peaks, must have real roots and be positive at FAR.
    Channels where none does have no row.
    """
    e = _sorted_lines(lines)
    return _mapped(_heights(peaks, by, len(e)), by, lambda h: _three(h, e, within, kept, enough))


def rough_gain(assigned: DataFrame, by: Sequence[str], lines: Sequence[float]) -> DataFrame:
    """by, heights, rms, a, b, c, zero_gain: the gain c + b * height + a * height ** 2 through assigned heights, a line or a constant for two or one.

    zero_gain: the height where the gain falls to zero, null where it never does above no height; complex roots count by their real part.
    """
    e = _sorted_lines(lines)
    rows = assigned.select(*by, F.posexplode("heights").alias("_k", "height")).withColumn("energy", F.get(F.array(*map(F.lit, e.tolist())), F.col("_k")))
    gain = gain_polynomial(rows, by)
    a, b, c = (F.col(k) for k in "abc")
    root = F.sqrt(F.greatest(b * b - 4 * a * c, F.lit(0.0)))
    low, high = F.least((-b - root) / (2 * a), (-b + root) / (2 * a)), F.greatest((-b - root) / (2 * a), (-b + root) / (2 * a))
    zero = F.when(a == 0, F.try_divide(-c, b)).otherwise(F.when(low > 0, low).otherwise(high))
    return assigned.join(gain, list(by)).withColumn("zero_gain", F.when(zero > 0, zero))


def rough_calibration(df: DataFrame, by: Sequence[str], column: str, lines: Sequence[float], fwhm: float, extra: int = 3, allowed: Sequence[Sequence[int]] | None = None, rule: str = "linear", **settings: float) -> DataFrame:
    """One row a channel: the gain that its own most prominent peaks give, as many as lines and `extra` more.

    rule: "linear", "gain" or "three".  below: zero_gain where it lies above the channel's median, else null: heights from there on have no energy.
    """
    if rule not in ("linear", "gain", "three"):
        raise ValueError(f"no such rule: {rule}")
    peaks = smoothed_peaks(df, by, column, fwhm).where(F.col("rank") <= len(lines) + extra)
    ways = {"linear": lambda: assign_lines(peaks, by, lines, allowed), "gain": lambda: assign_by_gain(peaks, by, lines), "three": lambda: assign_by_three(peaks, by, lines, **settings)}
    gain = rough_gain(ways[rule](), by, lines)
    middle = median(df, by, F.col(column), "_m")
    return gain.join(middle, list(by)).withColumn("below", F.when(F.col("zero_gain") > F.col("_m"), F.col("zero_gain"))).drop("_m")


def rough_energies(df: DataFrame, gain: DataFrame, by: Sequence[str], column: str, output: str = "energy") -> DataFrame:
    """df with energies; null in channels without a calibration."""
    params = gain.select(*by, F.struct("a", "b", "c").alias("_gain"))
    g: Column = F.col("_gain")
    return df.join(params, list(by), "left").withColumn(output, P.quadratic_gain_energy(F.col(column).cast("double"), g["a"], g["b"], g["c"])).drop("_gain")

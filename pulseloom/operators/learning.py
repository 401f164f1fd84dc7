"""Learned parameters: one row a channel, found by grouped Spark jobs; applied by a join on the channel.

Scans over the records are aggregates; what is solved per channel afterwards is small (a filter's length, a histogram,
a handful of peaks).
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulseloom.functions import pulses as P


def drift_slope(df: DataFrame, by: Sequence[str], height: str, indicator: str, reach: float = 1e-3, bins: int = 1024, grid: int = 21, rounds: int = 4) -> DataFrame:
    """by, slope, offset: the slope of height * (1 + slope * (indicator - offset)) with the least histogram entropy.

    Each round tries a grid of slopes around the best one so far: records are counted into slope x bin, map-side
    first, so a round shuffles at most channels * grid * bins counts.  The histogram covers 0 to 1.25 times the 99th
    percentile of the channel.
    """
    h, i = F.col(height).cast("double"), F.col(indicator).cast("double")
    facts = df.groupBy(*by).agg(F.median(i).alias("offset"), (1.25 * F.percentile(h, F.lit(0.99))).alias("_top"))
    best = facts.withColumn("slope", F.lit(0.0))
    for r in range(rounds):
        step = 2 * reach / (grid - 1)
        tried = F.transform(F.sequence(F.lit(0), F.lit(grid - 1)), lambda k: F.col("slope") + (k - (grid - 1) // 2) * F.lit(step))
        rows = df.join(best, list(by)).withColumn("_try", F.explode(tried))
        at = F.floor(P.drift_corrected(h, i, F.col("_try"), F.col("offset")) / F.col("_top") * bins)
        counts = rows.withColumn("_bin", at).where(f"_bin >= 0 and _bin < {bins}").groupBy(*by, "_try", "_bin").agg(F.count("*").alias("_n"))
        scored = counts.groupBy(*by, "_try").agg((F.log(F.sum("_n")) - F.sum(F.col("_n") * F.log("_n")) / F.sum("_n")).alias("_e"))
        slopes = scored.groupBy(*by).agg(F.min_by("_try", F.struct("_e", F.abs("_try"))).alias("slope"))
        best = facts.join(slopes, list(by))
        reach = step
    return best.select(*by, "slope", "offset")


def _toeplitz_solve(first: np.ndarray, sides: np.ndarray) -> np.ndarray:
    n = len(first)
    return np.linalg.solve(first[np.abs(np.subtract.outer(np.arange(n), np.arange(n)))], sides)


def optimal_filters(pulses: DataFrame, noise: DataFrame, by: Sequence[str], pulse: str, pre: int, lags: int = 1, f_3db: float | None = None, dt: float = 1.0) -> DataFrame:
    """by, weights, variance, resolution: the filter that gives the pulse height with the least noise, blind to a constant.

    The average pulse and the noise autocorrelation come from aggregates over all records; each channel's two short
    rows are then solved together.  lags 5: four samples shorter, scaled so that the parabola over five shifts peaks
    at the pulse height; lags 1: scaled to the height itself.  f_3db: a low-pass on the weights, for samples dt apart.
    """
    from pulseloom.operators.pulse_stats import autocorrelation, average_pulse

    n = pulses.select(F.size(pulse).alias("n")).agg(F.max("n")).first()[0] or 0
    packed = lambda df, k, v: df.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct(k, v))), lambda p: p[v]).alias(v))
    shapes = packed(average_pulse(pulses, by, pulse, pre), "sample", "level")
    correlated = packed(autocorrelation(noise, by, pulse, n), "lag", "value")

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for row in pdf.to_dict("records"):
            signal, r = np.array(row["level"], float), np.array(row["value"], float)
            signal[:pre] = 0
            peak = np.abs(signal).max() or 1.0
            signal = signal / peak
            used = signal[2:-2] if lags == 5 else signal
            m = len(used)
            model = np.stack([used, np.ones(m)])
            white = _toeplitz_solve(r[:m] if r[0] else np.eye(1, m)[0], model.T)
            weights = np.linalg.solve(model @ white, white.T)[0]
            if f_3db is not None:
                weights = np.fft.irfft(np.fft.rfft(weights) / (1 + (np.fft.rfftfreq(m, dt) / f_3db) ** 2), m)
            if lags == 5:
                c = np.array([signal[k : k + m] @ weights for k in range(5)])
                p0, p1, p2 = (np.array(p) @ c / 70 for p in P.PARABOLA)
                weights = weights / (p0 - p1**2 / (4 * p2))
            else:
                weights = weights / (used @ weights)
            variance = float(np.correlate(weights, weights, "full")[m - 1 :] @ (r[:m] * np.where(np.arange(m), 2, 1)))
            out.append({**{k: row[k] for k in by}, "weights": weights.tolist(), "variance": variance, "resolution": float(peak / np.sqrt(8 * np.log(2) * variance)) if variance > 0 else None})
        return pd.DataFrame(out)

    keys = ", ".join(f"{k} {pulses.schema[k].dataType.simpleString()}" for k in by)
    return shapes.join(correlated, list(by)).groupBy(*by).applyInPandas(solve, f"{keys}, weights array<double>, variance double, resolution double")


def filter_value(pulse: str, weights: str = "weights") -> Column:
    """The product of a record with the weights beside it."""
    return F.aggregate(F.zip_with(F.col(pulse), F.col(weights), lambda x, w: x.cast("double") * w), F.lit(0.0), lambda s, x: s + x)


def filtered(pulses: DataFrame, filters: DataFrame, by: Sequence[str], pulse: str, output: str) -> DataFrame:
    """pulses with the one-lag output of each channel's own filter."""
    return pulses.join(filters.select(*by, "weights"), list(by)).withColumn(output, filter_value(pulse)).drop("weights")


def gain_polynomial(assigned: DataFrame, by: Sequence[str]) -> DataFrame:
    """by, a, b, c of height / energy = c + b * height + a * height ** 2, by least squares over (height, energy) rows.

    With two rows a line, with one a constant.  Sums are aggregates; the three equations are solved by Cramer's rule.
    """
    x, y = F.col("height").cast("double"), (F.col("height") / F.col("energy")).cast("double")
    s = {f"s{k}": F.sum(F.pow(x - F.col("_m"), F.lit(float(k)))) for k in range(5)} | {f"t{k}": F.sum(F.pow(x - F.col("_m"), F.lit(float(k))) * y) for k in range(3)}
    centred = assigned.join(assigned.groupBy(*by).agg(F.avg("height").alias("_m")), list(by))
    sums = centred.groupBy(*by).agg(F.first("_m").alias("m"), *(v.alias(k) for k, v in s.items()))
    c = lambda k: F.col(k)
    det3 = lambda m: m[0] * (m[4] * m[8] - m[5] * m[7]) - m[1] * (m[3] * m[8] - m[5] * m[6]) + m[2] * (m[3] * m[7] - m[4] * m[6])
    base = [c(f"s{i + j}") for i in range(3) for j in range(3)]
    swap = lambda k: [c(f"t{i}") if j == k else c(f"s{i + j}") for i in range(3) for j in range(3)]
    d = det3(base)
    line = c("s0") * c("s2") - c("s1") * c("s1")
    three, two = c("s0") >= 3, c("s0") == 2
    k2 = F.when(three, F.try_divide(det3(swap(2)), d)).otherwise(0.0)
    k1 = F.when(three, F.try_divide(det3(swap(1)), d)).when(two, F.try_divide(c("s0") * c("t1") - c("s1") * c("t0"), line)).otherwise(0.0)
    k0 = F.when(three, F.try_divide(det3(swap(0)), d)).when(two, F.try_divide(c("t0") * c("s2") - c("s1") * c("t1"), line)).otherwise(c("t0") / c("s0"))
    fitted = sums.select(*by, "m", k0.alias("k0"), k1.alias("k1"), k2.alias("k2"))
    return fitted.select(*by, F.col("k2").alias("a"), (c("k1") - 2 * c("k2") * c("m")).alias("b"), (c("k0") - c("k1") * c("m") + c("k2") * c("m") * c("m")).alias("c"))


def natural_spline(knots: DataFrame, by: Sequence[str]) -> DataFrame:
    """by, place and the cubic of every interval of the natural spline through (x, y) rows: x, y, slope, bend, twist, x_next.

    The spline goes on as a line on either side: the first and last rows hold these lines.  A channel's knots are few.
    """

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("x").drop_duplicates("x")
        x, y = pdf.x.to_numpy(float), pdf.y.to_numpy(float)
        n = len(x)
        if n == 1:
            rows = [(x[0], y[0], 0.0, 0.0, 0.0, np.inf)]
        else:
            h, s = np.diff(x), np.diff(y) / np.diff(x)
            m = np.zeros(n)
            if n > 2:
                a = np.diag(2 * (h[:-1] + h[1:])) + np.diag(h[1:-1], 1) + np.diag(h[1:-1], -1)
                m[1:-1] = np.linalg.solve(a, 6 * np.diff(s))
            slope = s - h * (2 * m[:-1] + m[1:]) / 6
            end = s[-1] + h[-1] * (m[-2] + 2 * m[-1]) / 6
            rows = [(x[k], y[k], slope[k], m[k] / 2, (m[k + 1] - m[k]) / (6 * h[k]), x[k + 1]) for k in range(n - 1)] + [(x[-1], y[-1], end, 0.0, 0.0, np.inf)]
            rows.insert(0, (x[0], y[0], slope[0], 0.0, 0.0, x[0]))
        out = pd.DataFrame(rows, columns=["x", "y", "slope", "bend", "twist", "x_next"])
        return out.assign(place=np.arange(len(out)), **{k: pdf[k].iloc[0] for k in by})[[*by, "place", "x", "y", "slope", "bend", "twist", "x_next"]]

    keys = ", ".join(f"{k} {knots.schema[k].dataType.simpleString()}" for k in by)
    return knots.select(*by, "x", "y").groupBy(*by).applyInPandas(fit, f"{keys}, place int, x double, y double, slope double, bend double, twist double, x_next double")


def spline_applied(df: DataFrame, spline: DataFrame, by: Sequence[str], column: str, output: str) -> DataFrame:
    """df with the spline's value at a column: each channel's intervals travel as one array, and the right one is picked by position."""
    pieces = spline.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("place", "x", "y", "slope", "bend", "twist", "x_next"))).alias("_p"))
    x = F.col(column).cast("double")
    piece = F.coalesce(F.get(F.filter("_p", lambda p: x < p["x_next"]), F.lit(0)), F.element_at("_p", -1))
    u = x - F.col("_q.x")
    value = F.col("_q.y") + u * (F.col("_q.slope") + u * (F.col("_q.bend") + u * F.col("_q.twist")))
    return df.join(pieces, list(by)).withColumn("_q", piece).withColumn(output, value).drop("_p", "_q")


def laplace_entropy(df: DataFrame, by: Sequence[str], column: str, width: float, bins_a_width: int = 20) -> DataFrame:
    """by, entropy of values blurred by a two-sided exponential, from binned counts.

    Counts come from an aggregate; the blur is a convolution over the channel's own histogram.
    """
    step = width / bins_a_width
    counts = df.where(F.col(column).isNotNull()).groupBy(*by, F.floor(F.col(column) / step).alias("bin")).agg(F.count("*").alias("n"))

    def blur(pdf: pd.DataFrame) -> pd.DataFrame:
        pad = 20 * bins_a_width
        at = pdf["bin"].to_numpy() - pdf["bin"].min() + pad
        h = np.bincount(at, pdf["n"], at.max() + pad + 1)
        kernel = np.exp(-np.abs(np.arange(-pad, pad + 1)) / bins_a_width)
        size = 1 << int(len(h) + len(kernel)).bit_length()
        p = np.fft.irfft(np.fft.rfft(h, size) * np.fft.rfft(kernel, size), size)[: len(h) + len(kernel) - 1]
        p = np.clip(p / p.sum() / step, 0, None)
        p = p[p > 1e-300]
        return pd.DataFrame([{**{k: pdf[k].iloc[0] for k in by}, "entropy": float(-(p * np.log(p)).sum() * step)}])

    keys = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in by)
    return counts.groupBy(*by).applyInPandas(blur, f"{keys}, entropy double")


# The consistency factor of the Q estimator of scale, and its corrections for 2 to 9 values and beyond.
Q_NORMAL = 2.2219
Q_FEW = (0.0, 0.0, 0.399, 0.994, 0.512, 0.844, 0.611, 0.857, 0.669, 0.872)
Q_ODD, Q_EVEN = 1.4, 3.8


def q_normal(distance: float, n: int) -> float:
    return distance * Q_NORMAL * (Q_FEW[n] if n < len(Q_FEW) else n / (n + (Q_ODD if n % 2 else Q_EVEN)))


def q_scale(df: DataFrame, by: Sequence[str], column: str, rounds: int = 60) -> DataFrame:
    """by, q: the k-th smallest distance between two values, k = h (h - 1) / 2 with h = n / 2 + 1, without listing distances,
    times what makes it the standard deviation of normal values.

    Bisection on the distance; each step counts closer pairs by one search a value over the sorted channel.
    """

    def find(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.sort(pdf[column].dropna().to_numpy(float))
        n = len(x)
        h = n // 2 + 1
        k, low, high = h * (h - 1) // 2, 0.0, float(x[-1] - x[0]) if n else 0.0
        closer = lambda d: int((np.searchsorted(x, x + d, "right") - np.arange(n) - 1).sum())
        if n < 2 or closer(0.0) >= k:
            high = 0.0
        for _ in range(rounds if high else 0):
            mid = (low + high) / 2
            low, high = (low, mid) if closer(mid) >= k else (mid, high)
        if high:  # the distance itself, which the bisection only approaches
            high = float((x[np.searchsorted(x, x + high * (1 + 1e-12), "right") - 1] - x).max())
        return pd.DataFrame([{**{b: pdf[b].iloc[0] for b in by}, "q": q_normal(high, n)}])

    keys = ", ".join(f"{b} {df.schema[b].dataType.simpleString()}" for b in by)
    return df.select(*by, column).groupBy(*by).applyInPandas(find, f"{keys}, q double")


def chosen_columns(df: DataFrame, array: str, n: int, k: int) -> list[int]:
    """Places of k of an array's n columns that explain the others best, picked one by one.

    The Gram matrix is one aggregate over all rows (n * n numbers, n being an array's length); the choice is made on it.
    """
    pairs = df.select(F.posexplode(array).alias("i", "x"), array).select("i", "x", F.posexplode(array).alias("j", "y"))
    gram = np.zeros((n, n))
    for r in pairs.groupBy("i", "j").agg(F.sum(F.col("x").cast("double") * F.col("y").cast("double")).alias("s")).collect():
        gram[r.i, r.j] = r.s
    chosen: list[int] = []
    for _ in range(k):
        left = gram.diagonal().copy()
        gain = np.where(left > 1e-9 * (left.max() or 1), (gram**2).sum(0) / np.where(left > 0, left, 1), -1)
        gain[chosen] = -1
        best = int(gain.argmax())
        chosen.append(best)
        gram = gram - np.outer(gram[:, best], gram[best]) / gram[best, best]
    return chosen


def time_drift(df: DataFrame, by: Sequence[str], time: str, column: str, parts: int = 10) -> DataFrame:
    """df with gain: the channel's median over the median of its part of the time range, joined smoothly by a spline."""
    span = df.groupBy(*by).agg(F.min(time).cast("double").alias("_a"), F.max(time).cast("double").alias("_b"), F.median(column).alias("_m"))
    part = F.least(F.floor((F.col(time).cast("double") - F.col("_a")) / F.greatest(F.col("_b") - F.col("_a"), F.lit(1e-300)) * parts), F.lit(parts - 1))
    knots = df.join(span, list(by)).withColumn("_k", part).groupBy(*by, "_k").agg(F.avg(F.col(time).cast("double")).alias("x"), (F.first("_m") / F.median(column)).alias("y"))
    timed = df.withColumn("_t", F.col(time).cast("double"))
    return spline_applied(timed, natural_spline(knots, by), by, "_t", "gain").drop("_t")


def phase_shift(df: DataFrame, by: Sequence[str], phase: str, height: str, peaks: Sequence[float], within: float = 0.012, parts: int = 6) -> DataFrame:
    """df with corrected: the height less the shift of its nearest peak's records at this phase.

    Shifts are medians by channel, peak and part of the phase range, joined by splines; the median over phases is taken off.
    """
    nearest = F.array_min(F.transform(F.array(*map(F.lit, peaks)), lambda p: F.struct(F.abs(F.col(height) - p).alias("d"), p.alias("p"))))["p"]
    placed = df.withColumn("_peak", nearest)
    close = placed.where(F.abs(F.col(height) - F.col("_peak")) < within * float(np.mean(peaks)))
    spread = close.groupBy(*by, "_peak").agg(F.percentile(phase, F.lit(0.03)).alias("_a"), F.percentile(phase, F.lit(0.97)).alias("_b"), F.median(height).alias("_m"))
    part = F.greatest(F.lit(0), F.least(F.floor((F.col(phase) - F.col("_a")) / F.greatest(F.col("_b") - F.col("_a"), F.lit(1e-300)) * parts), F.lit(parts - 1)))
    knots = close.join(spread, [*by, "_peak"]).withColumn("_k", part).groupBy(*by, "_peak", "_k").agg(F.median(phase).alias("x"), (F.median(height) - F.first("_m")).alias("y"))
    keys = [*by, "_peak"]
    return spline_applied(placed, natural_spline(knots, keys), keys, phase, "_shift").withColumn("corrected", F.col(height) - F.col("_shift")).drop("_peak", "_shift")


def line_fits(df: DataFrame, by: Sequence[str], column: str, centre: float, half: float, step: float, rounds: int = 60) -> DataFrame:
    """by, peak, fwhm, area, background: a Gaussian on a constant, by maximum Poisson likelihood over the channel's histogram.

    Counting is an aggregate; each channel's bins are then fitted by damped Newton steps.
    """
    n = int(round(2 * half / step))
    low = centre - half
    at = F.floor((F.col(column) - low) / step).cast("int")
    counts = df.withColumn("bin", at).where(f"bin >= 0 and bin < {n}").groupBy(*by, "bin").agg(F.count("*").alias("n"))

    def model(p: np.ndarray, x: np.ndarray) -> np.ndarray:
        return np.exp(p[2]) * step / np.sqrt(2 * np.pi) / np.exp(p[1]) * np.exp(-0.5 * ((x - p[0]) / np.exp(p[1])) ** 2) + np.exp(p[3])

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        x, y = low + (np.arange(n) + 0.5) * step, np.bincount(pdf["bin"], pdf["n"], n)
        ground = max(float(np.percentile(y, 20)), 1 / n)
        over = np.clip(y - ground, 0, None)
        mid = float((x * over).sum() / max(over.sum(), 1e-9)) if over.sum() else centre
        sigma = max(float(np.sqrt((over * (x - mid) ** 2).sum() / max(over.sum(), 1e-9))) / 2, step)
        p = np.array([x[int(y.argmax())], np.log(sigma), np.log(max(over.sum(), 1.0)), np.log(ground)])
        loss = lambda q: float((model(q, x) - y * np.log(np.clip(model(q, x), 1e-300, None))).sum())
        damp, now = 1e-2, loss(p)
        for _ in range(rounds):
            m = np.clip(model(p, x), 1e-300, None)
            d = np.eye(4) * np.array([sigma * 1e-4, 1e-5, 1e-5, 1e-5])
            jac = np.stack([(model(p + e, x) - model(p - e, x)) / (2 * e.sum()) for e in d], 1)
            slope, curve = jac.T @ (1 - y / m), jac.T @ (jac / m[:, None])
            move = np.linalg.solve(curve + damp * np.diag(np.diag(curve) + 1e-12), slope)
            new = loss(p - move)
            p, now, damp = (p - move, new, damp / 3) if new <= now else (p, now, damp * 5)
        return pd.DataFrame([{**{k: pdf[k].iloc[0] for k in by}, "peak": float(p[0]), "fwhm": float(np.exp(p[1]) * np.sqrt(8 * np.log(2))), "area": float(np.exp(p[2])), "background": float(np.exp(p[3]))}])

    keys = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in by)
    return counts.groupBy(*by).applyInPandas(fit, f"{keys}, peak double, fwhm double, area double, background double")


def prominent_peaks(hist: DataFrame, by: Sequence[str], smooth: int, most: int) -> DataFrame:
    """by, bin, label, prominence: the `most` most prominent maxima of each channel's histogram after a moving mean of 2 * smooth + 1 bins."""
    w = Window.partitionBy(*by).orderBy("bin")
    s = hist.withColumn("_s", F.avg("n_rows").over(w.rowsBetween(-smooth, smooth)))
    s = s.withColumns({"_l": F.lag("_s").over(w), "_r": F.lead("_s").over(w)}).withColumn("_up", F.col("_s") > F.coalesce("_l", F.lit(-1.0)))
    turn = F.when((F.col("_s") > F.coalesce("_l", F.lit(-1.0))) & (F.col("_s") >= F.coalesce("_r", F.lit(-1.0))), 1).when((F.col("_s") <= F.coalesce("_l", F.lit(1e300))) & (F.col("_s") < F.coalesce("_r", F.lit(1e300))), -1)
    s = s.withColumn("_turn", turn)
    low = F.when(F.col("_turn") == -1, F.col("_s"))
    before = F.last(low, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    after = F.first(low, ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))
    peaks = s.withColumns({"_b": before, "_a": after}).where("_turn = 1").withColumn("prominence", F.col("_s") - (F.coalesce("_b", "_a", F.lit(0.0)) + F.coalesce("_a", "_b", F.lit(0.0))) / 2)
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("prominence"), "bin"))
    return peaks.withColumn("_k", rank).where(F.col("_k") <= most).select(*by, "bin", "label", "prominence")


def multi_fits(df: DataFrame, by: Sequence[str], column: str, lines: dict[str, float], half: float, step: float) -> DataFrame:
    """line_fits() around several named lines, one row a line and channel, with the line's energy."""
    out = None
    for name, energy in sorted(lines.items(), key=lambda e: e[1]):
        one = line_fits(df, by, column, energy, half, step).withColumns({"line": F.lit(name), "energy": F.lit(float(energy))})
        out = one if out is None else out.unionByName(one)
    return out

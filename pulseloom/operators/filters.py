"""Optimal filters of several kinds, each channel's from its own average pulse and noise.

The average pulse, its change with arrival time, and the noise's correlation or spectrum are aggregates over all records.
What is solved per channel is one system of the record's length with several right-hand sides:

    five_lag    pulse height from a parabola through the output at five shifts; blind to a constant
    one_lag     pulse height from the output at one shift; blind to a constant
    noexp       five_lag, blind also to decays of given times (the tails of earlier pulses), or to any given records
    fourier     five_lag from the noise's power spectrum, as if records went round
    arrival     height, arrival time and baseline together: three filters of one shift, each blind to what the others measure

Weights can be limited in frequency (f_max: none above; f_3db: one pole), and left at zero at either end of the record.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulseloom.functions import pulses as P
from pulseloom.operators.pulse_stats import autocorrelation, average_pulse, periodogram

KINDS = ("five_lag", "one_lag", "noexp", "fourier", "arrival")
#: Samples that five shifts take from either end.
EDGE = 2


def _limited(weights: np.ndarray, dt: float, f_max: float | None, f_3db: float | None) -> np.ndarray:
    """Rows of weights without what lies above f_max, and less by one pole at f_3db."""
    n = weights.shape[-1]
    f, spectrum = np.fft.rfftfreq(n, dt), np.fft.rfft(weights)
    if f_max is not None:
        spectrum = np.where(f > f_max, 0, spectrum)
    if f_3db is not None:
        spectrum = spectrum / (1 + (f / f_3db) ** 2)
    return np.fft.irfft(spectrum, n) if f_max is not None or f_3db is not None else weights


def _toeplitz(r: np.ndarray, n: int) -> np.ndarray:
    return r[np.abs(np.subtract.outer(np.arange(n), np.arange(n)))]


def blind_filters(models: np.ndarray, r: np.ndarray) -> np.ndarray:
    """A filter for each row of models, with the least noise, whose output is 1 for that row and 0 for the others."""
    white = np.linalg.solve(_toeplitz(r, models.shape[1]), models.T)
    return np.linalg.solve(models @ white, white.T)


def five_lag_peak(signal: np.ndarray, weights: np.ndarray) -> float:
    """The vertex of the parabola through the output at five shifts."""
    c = np.array([signal[k : k + len(weights)] @ weights for k in range(2 * EDGE + 1)])
    p0, p1, p2 = (np.array(p) @ c / 70 for p in P.PARABOLA)
    return float(p0 - p1**2 / (4 * p2))


def _one(kind: str, level: np.ndarray, arrival: np.ndarray, r: np.ndarray, psd: np.ndarray | None, pre: int, dt: float, f_max: float | None, f_3db: float | None, cut_pre: int, cut_post: int, decays: Sequence[float], blind: Sequence[Sequence[float]]) -> dict:
    keep = slice(cut_pre, len(level) - cut_post)
    signal = level - level[cut_pre : max(pre - 1, cut_pre + 1)].mean()
    signal[:pre] = 0
    low, high = signal[keep].min(), signal[keep].max()
    peak = low if -low > high else high
    signal, change = (signal / peak)[keep], (arrival / peak)[keep]
    used = signal[EDGE:-EDGE] if kind in ("five_lag", "noexp", "fourier") else signal
    n = len(used)
    r = r[:n] if r[0] > 0 else np.eye(1, n)[0]
    second = third = None
    if kind == "fourier":
        # the spectrum of as many samples as are used: its correlation without the longest lags
        whole = np.fft.irfft(psd, len(level))
        half = n // 2 + 1
        short = np.concatenate([whole[:half], whole[1 : n - half + 1][::-1]])
        spectrum = np.fft.rfft(used) / np.abs(np.fft.rfft(short))
        spectrum[0] = 0
        weights = _limited(np.fft.irfft(spectrum, n), dt, f_max, f_3db)
    else:
        models = [used, np.ones(n)]
        if kind == "arrival":
            models.insert(1, change)
        if kind == "noexp":
            models += [np.exp(-np.arange(n) * dt / t) for t in decays] + [np.asarray(b, float) for b in blind]
        solved = _limited(blind_filters(np.array(models), r), dt, f_max, f_3db)
        weights = solved[0]
        if kind == "arrival":
            second, third = solved[1], solved[2]
    if kind in ("five_lag", "noexp", "fourier"):
        weights = weights / five_lag_peak(signal, weights)
    elif kind == "one_lag":
        weights = weights / (signal @ weights)
    variance = float(weights @ _toeplitz(r, n) @ weights)
    padded = lambda w: None if w is None else np.pad(w, (cut_pre, cut_post)).tolist()
    return {"weights": padded(weights), "arrival_weights": padded(second), "baseline_weights": padded(third), "peak": float(peak), "variance": variance, "resolution": float(abs(peak) / np.sqrt(8 * np.log(2) * variance)) if variance > 0 else None}


def filter_table(
    pulses: DataFrame, noise: DataFrame, by: Sequence[str], pulse: str, pre: int, kinds: Sequence[str] = ("five_lag",), dt: float = 1.0, f_max: float | None = None, f_3db: float | None = None, cut_pre: int = 0, cut_post: int = 0, decays: Sequence[float] = (), blind: Sequence[Sequence[float]] = (), arrival: DataFrame | None = None
) -> DataFrame:
    """by, kind, weights, arrival_weights, baseline_weights, peak, variance, resolution: one row a channel and kind.

    Outputs are in units of the average pulse's peak; variance is that of the output from noise alone, resolution the peak over its full width at
    half maximum.  arrival: by, sample, arrival, the change of a record with arrival time (pulse_stats.arrival_model gives one); without it
    the average pulse's own slope.  Channels without pulses or noise have no row.
    """
    if unknown := set(kinds) - set(KINDS):
        raise ValueError(f"no such filters: {sorted(unknown)}")
    if min(cut_pre, cut_post) < 0 or "noexp" in kinds and not decays and not blind:
        raise ValueError("cuts can't be negative, and noexp needs decays or records to be blind to")
    if any(t <= 0 for t in decays):
        raise ValueError("decay times must be positive")
    n = pulses.select(F.size(pulse).alias("n")).agg(F.max("n")).first()[0] or 0
    packed = lambda df, k, v: df.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct(k, v))), lambda p: p[v]).alias(f"_{v}"))
    table = packed(average_pulse(pulses, by, pulse, pre), "sample", "level").join(packed(autocorrelation(noise, by, pulse, n), "lag", "value"), list(by))
    if "fourier" in kinds:
        table = table.join(packed(periodogram(noise, by, pulse, n, dt), "k", "psd"), list(by), "left")
    if arrival is not None and "arrival" in kinds:
        table = table.join(packed(arrival, "sample", "arrival"), list(by), "left")

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for row in pdf.to_dict("records"):
            level, r = np.array(row["_level"], float), np.array(row["_value"], float)
            change = np.array(row["_arrival"], float) if row.get("_arrival") is not None else -np.gradient(level)
            psd = np.array(row["_psd"], float) if row.get("_psd") is not None else None
            for kind in kinds:
                if kind != "fourier" or psd is not None:
                    out.append({k: row[k] for k in by} | {"kind": kind} | _one(kind, level, change, r, psd, pre, dt, f_max, f_3db, cut_pre, cut_post, decays, blind))
        return pd.DataFrame(out, columns=[*by, "kind", "weights", "arrival_weights", "baseline_weights", "peak", "variance", "resolution"])

    keys = "".join(f"`{k}` {pulses.schema[k].dataType.simpleString()}, " for k in by)
    return table.groupBy(*by).applyInPandas(solve, f"{keys}kind string, weights array<double>, arrival_weights array<double>, baseline_weights array<double>, peak double, variance double, resolution double")


def dot(pulse: Column, weights: Column) -> Column:
    return F.aggregate(F.zip_with(pulse, weights, lambda x, w: x.cast("double") * w), F.lit(0.0), lambda s, x: s + x)


def five_lag(pulse: Column, weights: Column) -> Column:
    """(height, place) of the vertex through the output of weights, four samples shorter than the record, at five shifts."""
    lags = F.transform(F.sequence(F.lit(0), F.lit(2 * EDGE)), lambda k: dot(F.slice(pulse, k + 1, F.size(weights)), weights))
    fit = lambda c: [sum(float(w) * F.get(c, F.lit(k)) for k, w in enumerate(row) if w) / 70.0 for row in P.PARABOLA]

    def vertex(c: Column) -> Column:
        p0, p1, p2 = fit(c)
        return F.struct((p0 - F.try_divide(p1 * p1, 4 * p2)).alias("height"), (-F.try_divide(p1, 2 * p2)).alias("place"))

    return F.get(F.transform(F.array(lags), vertex), F.lit(0))


def filtered(pulses: DataFrame, filters: DataFrame, by: Sequence[str], pulse: str, output: str, place: str) -> DataFrame:
    """pulses with the height and place (or arrival time) that their channel's filter gives, for filters of one kind."""
    one = filters.select(*by, F.struct("kind", "weights", "arrival_weights").alias("_filter"))
    f, x = F.col("_filter"), F.col(pulse)
    height = dot(x, f["weights"])
    single = F.struct(height.alias("height"), F.when(f["kind"] == "arrival", F.try_divide(dot(x, f["arrival_weights"]), height)).alias("place"))
    both = F.when(f["kind"].isin("one_lag", "arrival"), single).otherwise(five_lag(x, f["weights"]))
    return pulses.join(one, list(by)).withColumn("_y", both).withColumns({output: F.col("_y.height"), place: F.col("_y.place")}).drop("_filter", "_y")

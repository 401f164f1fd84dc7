"""Array kernels over pulse records as Column expressions; all stay in the JVM.

A record is an array of samples; `pre` is the number of samples before the trigger.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double"))


def dot(a: Column, weights: Sequence[float]) -> Column:
    """Sum of products with fixed weights of the same length."""
    return F.aggregate(F.zip_with(a, F.array(*[F.lit(float(w)) for w in weights]), lambda x, w: x.cast("double") * w), F.lit(0.0), lambda s, x: s + x)


def mean_of(a: Column) -> Column:
    return F.try_divide(total(a), F.size(a))


def baseline(pulse: Column, pre: int, ignore: int = 0) -> tuple[Column, Column]:
    """Mean and rms of the samples before the trigger, without the last `ignore`."""
    part = F.slice(pulse, 1, pre - ignore)
    mean = mean_of(part)
    square = F.aggregate(part, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")) / (pre - ignore)
    return mean, F.sqrt(F.greatest(square - mean * mean, F.lit(0.0)))


def peak_index(pulse: Column) -> Column:
    """Place (from 0) of the first maximum."""
    return (F.array_position(pulse, F.array_max(pulse)) - 1).cast("int")


def excursion(pulse: Column) -> Column:
    return F.array_max(pulse) - F.array_min(pulse)


def summary(pulse: Column, pre: int, ignore: int = 0, jump: float = 4.3) -> dict[str, Column]:
    """The per-record quantities, by name.

    The prompt window is the six samples from the second after the trigger, one earlier if the last sample before
    the trigger already stands more than `jump` rms above the baseline.
    """
    mean, rms = baseline(pulse, pre, ignore)
    peak = F.array_max(pulse).cast("double")
    early = F.element_at(pulse, pre) - mean > jump * rms
    after = F.slice(pulse, pre, F.size(pulse))
    n = F.size(pulse) - pre + 1
    average = total(after) / n - mean
    square = F.aggregate(after, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")) / n
    above = peak - F.floor(mean + 0.5)
    rises = mean < peak
    prompt = total(F.when(early, F.slice(pulse, pre + 2, 6)).otherwise(F.slice(pulse, pre + 3, 6))) / 6
    return {
        "pretrig_mean": mean,
        "pretrig_rms": rms,
        "peak_index": F.when(rises, peak_index(pulse)).otherwise(0),
        "peak_value": F.when(rises, above).otherwise(0.0),
        "min_value": F.array_min(pulse).cast("double"),
        "shift1": early.cast("int"),
        "pulse_average": average,
        "pulse_rms": F.sqrt(F.greatest(square - 2 * mean * average - mean * mean, F.lit(0.0))),
        "promptness": F.when(rises, F.try_divide(prompt - mean, above)).otherwise(0.0),
    }


def first_above(pulse: Column, pre: int, level: Column) -> Column:
    """Place (from 0) of the first sample from the trigger on that exceeds a level; null if none does."""
    places = F.filter(F.sequence(F.lit(pre), F.size(pulse) - 1), lambda k: F.get(pulse, k) > level)
    return F.get(places, F.lit(0))


def rise_time(pulse: Column, pre: int, timebase: float) -> Column:
    """Time from 10 % to 90 % of the peak, scaled to the whole rise; one timebase where it can't be told."""
    mean, _ = baseline(pulse, pre)
    peak = F.array_max(pulse) - F.floor(mean + 0.5)
    low = first_above(pulse, pre, F.floor(0.1 * peak + mean))
    high = first_above(pulse, pre, F.floor(0.9 * peak + mean)) - 1
    step = F.get(pulse, high) - F.get(pulse, low)
    return F.when((step > 0) & (high >= low), timebase * (high - low) * peak / step).otherwise(timebase)


def steepest(pulse: Column, start: int) -> Column:
    """0.1 times the largest smoothed slope (the smaller of two, two samples apart) from sample start + 6 on."""
    slope = lambda k: 2 * F.get(pulse, k) + F.get(pulse, k - 1) - F.get(pulse, k - 3) - 2 * F.get(pulse, k - 4)
    both = F.transform(F.sequence(F.lit(start + 6), F.size(pulse) - 1), lambda k: F.least(slope(k), slope(k - 2)))
    return 0.1 * F.array_max(both)


#: Least-squares parabola through five points at -2 .. 2, its constant, linear and square coefficients times 70.
PARABOLA = ((-6, 24, 34, 24, -6), (-14, -7, 0, 7, 14), (10, -5, -10, -5, 10))


def five_lag(pulse: Column, weights: Sequence[float]) -> tuple[Column, Column]:
    """(height, place) of the vertex through the filter's output at five shifts; weights are four samples shorter than the pulse."""
    lags = [dot(F.slice(pulse, k + 1, len(weights)), weights) for k in range(5)]
    # divided last: where samples and weights are whole numbers, sums are exact, and no curvature is exactly 0
    p0, p1, p2 = (sum(float(w) * lag for w, lag in zip(row, lags, strict=True) if w) / 70.0 for row in PARABOLA)
    return p0 - F.try_divide(p1 * p1, 4 * p2), -F.try_divide(p1, 2 * p2)


def one_lag(pulse: Column, weights: Sequence[float]) -> Column:
    return dot(pulse, weights)


def height_and_arrival(pulse: Column, height: Sequence[float], arrival: Sequence[float]) -> tuple[Column, Column]:
    """Filtered height, and arrival time as the ratio of a second filter to it."""
    y = dot(pulse, height)
    return y, F.try_divide(dot(pulse, arrival), y)


def shifted(pulse: Column, shift: Column) -> Column:
    """The record moved later by a number of samples, between samples linearly; the first or last sample fills in."""
    n = F.size(pulse)
    whole, part = F.floor(shift), shift - F.floor(shift)
    at = lambda k: F.get(pulse, F.greatest(F.lit(0), F.least(k, n - 1)).cast("int")).cast("double")
    return F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.rint(at(k - whole) * (1 - part) + at(k - whole - 1) * part))


def categorize(conditions: dict[str, Column], fallback: str = "fallback") -> Column:
    """The name of the last condition that holds."""
    out = F.lit(fallback)
    for name, condition in conditions.items():
        out = F.when(F.coalesce(condition, F.lit(False)), F.lit(name)).otherwise(out)
    return out


def quadratic_gain_energy(height: Column, a: float, b: float, c: float) -> Column:
    """Energy = height / (c + b * height + a * height ** 2)."""
    return F.try_divide(height, c + b * height + a * height * height)


def quadratic_gain_height(energy: Column, a: float, b: float, c: float) -> Column:
    """The height of an energy: the root of the quadratic that goes to c * energy for small energies."""
    p, q, r = a * energy, b * energy - 1, c * energy
    root = F.sqrt(F.greatest(q * q - 4 * p * r, F.lit(0.0)))
    return F.when(p == 0, F.try_divide(r, -q)).otherwise(F.try_divide(-q - root, 2 * p))


def drift_corrected(height: Column, indicator: Column, slope: Column | float, offset: Column | float) -> Column:
    return height * (1 + slope * (indicator - offset))


def voigt_fwhm(gauss: Column, lorentz: Column) -> Column:
    """Full width at half maximum of a Voigt profile from both widths, good to 0.02 %."""
    return 0.5346 * lorentz + F.sqrt(0.2166 * lorentz * lorentz + gauss * gauss)


def channel_number(path: Column) -> Column:
    found = F.regexp_extract(path, r"_chan(\d+)\..*$", 1)
    return F.when(found != "", found.cast("long"))

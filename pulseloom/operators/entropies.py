"""Entropies of blurred distributions, and corrections that make them least.

`cross_entropy` is exact for the two-sided exponential kernel: between neighbouring values each density is a falling plus a
rising exponential, whose integrals are known, and whose sizes are sums over all values to the left and to the right.  Such
sums decay, so values are cut into slots of SLOT widths: sums run within a slot, and what a slot passes on to the next is a
number.  A channel so is as many tasks' work as it has slots, and only its slots (not its values) are followed one by one.

`minimised` looks for the least entropy of all channels at the same time: every step asks one candidate of each channel
that is not done, and answers all by one aggregate over the records.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Generator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from pulseloom.functions import pulses as P
from pulseloom.operators.learning import laplace_entropy
from pulseloom.operators.quantiles import median, quantiles

#: Widths of a slot; gaps between values beyond FAR widths count as endless.
SLOT, FAR = 16.0, 600.0
GOLDEN = (1 + 5**0.5) / 2


def _log(x: Column) -> Column:
    return F.when(x > 0, F.log(x)).otherwise(float("-inf"))


def _tail(p: Column, q: Column) -> Column:
    """Integral of p * exp(-t) * log(q * exp(-t)) over t from 0 on."""
    return F.when(p > 0, p * (_log(q) - 1)).otherwise(0.0)


def _between(p: tuple[Column, Column], q: tuple[Column, Column], g: Column) -> Column:
    """Integral of p log q over t from 0 to g, where each is a pair (falls, rises) of the sizes at 0 of exp(-t) and exp(t).

    With A the integral of p it is A log q - A + 2 (rises_p falls_q + falls_p rises_q) times the integral of 1 / q.
    """
    (a, b), (c, d) = p, q
    at = lambda f, r, t: (f * F.exp(-t), r * F.exp(t))
    a1, b1 = at(a, b, g)
    c1, d1 = at(c, d, g)
    one_over = F.when((c > 0) & (d > 0), (F.atan(F.sqrt(d1 / c1)) - F.atan(F.sqrt(d / c))) / F.sqrt(c * d)).when(d > 0, (1 - F.exp(-g)) / d).otherwise((F.exp(g) - 1) / c)
    whole = (b1 - a1) * (F.log(c1 + d1) - 1) - (b - a) * (F.log(c + d) - 1) + 2 * (b * c + a * d) * one_over
    return F.when((c <= 0) & (d <= 0), float("-inf")).otherwise(whole)


def _carried(slots: DataFrame, by: Sequence[str]) -> DataFrame:
    """by, slot and what slots before and after send to it: sizes seen at its begin (l_p, l_q) and end (r_p, r_q), and their nearest values."""

    def carry(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("slot").reset_index(drop=True)
        slot = pdf["slot"].to_numpy()
        fade = np.exp(-SLOT * (np.diff(slot) - 1.0))
        out = pdf[[*by, "slot"]].assign(before=pdf["last"].shift(1), after=pdf["first"].shift(-1))
        for side, total, order in (("l", "e", range(1, len(pdf))), ("r", "b", range(len(pdf) - 2, -1, -1))):
            for kind in "pq":
                sent, v = pdf[f"{total}_{kind}"].to_numpy(float), np.zeros(len(pdf))
                for k in order:
                    last = k - 1 if side == "l" else k + 1
                    v[k] = (v[last] * np.exp(-SLOT) + sent[last]) * fade[min(k, last)]
                out[f"{side}_{kind}"] = v
        return out

    keys = "".join(f"`{k}` {slots.schema[k].dataType.simpleString()}, " for k in by)
    return slots.groupBy(*by).applyInPandas(carry, f"{keys}slot long, before double, after double, l_p double, l_q double, r_p double, r_q double")


def cross_entropy(p: DataFrame, q: DataFrame, by: Sequence[str], column: str, width: float) -> DataFrame:
    """by, entropy: minus the integral of P log Q, P and Q being the values of p and q blurred by exp(-|x| / width).

    Channels that only one of the two has, or without finite values, have no row.  Densities smaller than any number count
    as 0: where P has values more than some 600 widths from all of Q's the entropy is infinite.
    """
    if width <= 0:
        raise ValueError("the width must be positive")
    x = F.col(column).cast("double")
    some = lambda df, a, b: df.select(*by, x.alias("_v"), F.lit(a).alias("p"), F.lit(b).alias("q")).where("_v is not null and not isnan(_v) and abs(_v) < double('infinity')")
    values = some(p, 1, 0).unionByName(some(q, 0, 1)).groupBy(*by, "_v").agg(F.sum("p").alias("p"), F.sum("q").alias("q"))
    y = F.col("_v") / width
    values = values.select(*by, y.alias("y"), F.floor(y / SLOT).alias("slot"), (y - SLOT * F.floor(y / SLOT)).alias("u"), "p", "q")
    from_begin, to_end = F.exp(-F.col("u")), F.exp(F.col("u") - SLOT)
    slots = values.groupBy(*by, "slot").agg(F.min("y").alias("first"), F.max("y").alias("last"), *(F.sum(F.col(k) * (to_end if side == "e" else from_begin)).alias(f"{side}_{k}") for side in "eb" for k in "pq"))
    w = Window.partitionBy(*by, "slot").orderBy("y")
    left = lambda k: F.sum(F.col(k) * F.exp("u")).over(w.rowsBetween(Window.unboundedPreceding, 0)) * from_begin
    right = lambda k: F.coalesce(F.sum(F.col(k) * from_begin).over(w.rowsBetween(1, Window.unboundedFollowing)), F.lit(0.0)) * F.exp("u")
    placed = values.select(*by, "slot", "y", "u", "p", "q", F.lag("y").over(w).alias("_b"), F.lead("y").over(w).alias("_a"), left("p").alias("fp"), left("q").alias("fq"), right("p").alias("rp"), right("q").alias("rq"))
    joined = placed.join(_carried(slots, by), [*by, "slot"])
    falls, rises = (lambda k: F.col(f"f{k}") + F.col(f"l_{k}") * from_begin), (lambda k: F.col(f"r{k}") + F.col(f"r_{k}") * to_end)
    both = joined.select(*by, "p", "q", "y", (F.col("y") - F.coalesce("_b", "before")).alias("back"), (F.coalesce("_a", "after") - F.col("y")).alias("gap"), *(f(k).alias(n) for f, n, k in ((falls, "fp", "p"), (falls, "fq", "q"), (rises, "rp", "p"), (rises, "rq", "q"))))
    c = F.col
    ends_after, ends_before = F.coalesce(c("gap") > FAR, F.lit(True)), F.coalesce(c("back") > FAR, F.lit(True))
    # log densities differ from log sizes by a constant, which counts with all of P
    part = F.when(ends_after, _tail(c("fp"), c("fq"))).otherwise(_between((c("fp"), c("rp")), (c("fq"), c("rq")), F.when(ends_after, 0.0).otherwise(c("gap"))))
    part += F.when(ends_before, _tail(c("rp") + c("p"), c("rq") + c("q"))).otherwise(0.0)
    sums = both.groupBy(*by).agg(F.sum(part).alias("_s"), F.sum("p").alias("_p"), F.sum("q").alias("_q")).where("_p > 0 and _q > 0")
    return sums.select(*by, (F.log(2 * width * F.col("_q")) - F.col("_s") / (2 * F.col("_p"))).alias("entropy"))


def entropy(df: DataFrame, by: Sequence[str], column: str, width: float) -> DataFrame:
    """by, entropy of the values blurred by exp(-|x| / width), exactly."""
    return cross_entropy(df, df, by, column, width)


def divergence(p: DataFrame, q: DataFrame, by: Sequence[str], column: str, width: float) -> DataFrame:
    """by, divergence: of P from Q, the cross entropy less P's own."""
    cross, own = cross_entropy(p, q, by, column, width), entropy(p, by, column, width).withColumnRenamed("entropy", "_own")
    return cross.join(own, list(by)).select(*by, (F.col("entropy") - F.col("_own")).alias("divergence"))


def brent(a: float, b: float, tolerance: float = 1.48e-8, most: int = 200) -> Generator[float, float, tuple[float, float]]:
    """Brent's search for a minimum, as a dialogue: yields places, is sent their values, returns (place, value).

    From a and b it goes downhill in growing steps until the value rises again.  Then parabolas through the three best places,
    or golden sections where these don't shrink, close in, down to a relative tolerance.
    """
    fa = yield a
    fb = yield b
    if fa < fb:
        a, b, fa, fb = b, a, fb, fa
    c = b + GOLDEN * (b - a)
    fc = yield c
    while fc < fb and abs(c) < 1e12:
        a, b, fa, fb = b, c, fb, fc
        c = b + GOLDEN * (b - a)
        fc = yield c
    low, high = min(a, c), max(a, c)
    best, second, third = (fb, b), (fb, b), (fb, b)
    step = before = 0.0
    for _ in range(most):
        x = best[1]
        mid, near = (low + high) / 2, tolerance * abs(x) + 1e-11
        if abs(x - mid) <= 2 * near - (high - low) / 2:
            break
        parabola = None
        if abs(before) > near:
            r, q = (x - second[1]) * (best[0] - third[0]), (x - third[1]) * (best[0] - second[0])
            top, bottom = (x - third[1]) * q - (x - second[1]) * r, 2 * (q - r)
            if bottom and low < x - top / bottom < high and abs(top / bottom) < abs(before) / 2:
                parabola = -top / bottom
        if parabola is None:
            before = (low if x >= mid else high) - x
            step = before * (2 - GOLDEN)
        else:
            before, step = step, parabola
            if min(x + step - low, high - x - step) < 2 * near:
                step = near if x < mid else -near
        u = x + (step if abs(step) >= near else math.copysign(near, step))
        fu = yield u
        if fu <= best[0]:
            low, high = (low, x) if u < x else (x, high)
            best, second, third = (fu, u), best, second
        else:
            low, high = (u, high) if u < x else (low, u)
            if fu <= second[0] or second[1] == x:
                second, third = (fu, u), second
            elif fu <= third[0] or third[1] in (x, second[1]):
                third = (fu, u)
    return best[1], best[0]


def minimised(searches: dict[tuple, Generator], evaluate: Callable[[dict[tuple, float]], dict[tuple, float]]) -> dict[tuple, tuple[float, float]]:
    """Runs one search a channel to its end; evaluate answers the places of all channels that are still searching, at once.

    What is on the driver is a few numbers a channel.
    """
    asked, found = {k: next(s) for k, s in searches.items()}, {}
    while asked:
        values, now = evaluate(asked), {}
        for key in asked:
            try:
                now[key] = searches[key].send(values.get(key, float("inf")))
            except StopIteration as end:
                found[key] = end.value
        asked = now
    return found


def _keyed(df: DataFrame, by: Sequence[str], value: str) -> dict[tuple, float]:
    return {tuple(r[c] for c in by): r[value] for r in df.collect()}


def _rows(df: DataFrame, by: Sequence[str], values: dict[tuple, object], name: str, kind: str) -> DataFrame:
    keys = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in by)
    return df.sparkSession.createDataFrame([(*k, v) for k, v in values.items()], f"{keys}, `{name}` {kind}")


def smoothed_entropy(df: DataFrame, by: Sequence[str], column: str, top: str, sigma: float) -> DataFrame:
    """by, entropy: minus the sum of h log h over the channel's histogram from 0 to `top`, blurred by a Gaussian.

    The histogram has bins of 0.4 sigma, but 1,024 at least and 32,768 at most, and a power of two of them; it is blurred round its ends.
    """
    size = F.greatest(F.lit(1024), F.least(F.lit(32768), F.floor(F.col(top) / (0.4 * sigma) + 0.5)))
    n = F.pow(F.lit(2.0), F.ceil(F.log2(size.cast("double")))).cast("int")
    x = F.col(column) / F.col(top)
    bins = df.select(*by, F.col(top).alias("_top"), n.alias("_n"), F.when((x >= 0) & (x <= 1), F.least(F.floor(x * n), n - 1)).cast("int").alias("_bin"))
    counts = bins.where("_bin is not null").groupBy(*by, "_top", "_n", "_bin").agg(F.count("*").alias("_count"))

    def blur(pdf: pd.DataFrame) -> pd.DataFrame:
        n, top = int(pdf["_n"].iloc[0]), float(pdf["_top"].iloc[0])
        k = np.arange(n)
        kernel = np.exp(-0.5 * (np.minimum(k, n - k) * (top / n) / sigma) ** 2)
        h = np.fft.irfft(np.fft.rfft(kernel / kernel.sum()) * np.fft.rfft(np.bincount(pdf["_bin"], pdf["_count"], n)), n)
        h = h[h > 0]
        return pd.DataFrame([{**{c: pdf[c].iloc[0] for c in by}, "entropy": float(-(h * np.log(h)).sum())}])

    keys = "".join(f"`{c}` {df.schema[c].dataType.simpleString()}, " for c in by)
    return counts.groupBy(*by).applyInPandas(blur, f"{keys}entropy double")


def drift_by_entropy(df: DataFrame, by: Sequence[str], height: str, indicator: str, limit: float | None = None, sigma: float = 0.5, first: float = 0.001) -> DataFrame:
    """by, slope, offset, entropy: the slope of height * (1 + slope * (indicator - offset)) with the least entropy of the blurred spectrum.

    offset is the indicator's median; the spectrum goes from 0 to `limit`, or to 1.25 times the channel's 99th percentile.  Apply it with
    functions.pulses.drift_corrected.  Rows with nulls count for nothing.
    """
    rows = df.select(*by, F.col(height).cast("double").alias("_h"), F.col(indicator).cast("double").alias("_i")).where("_h is not null and _i is not null")
    top = F.lit(float(limit)) if limit is not None else 1.25 * F.col("_q")
    facts = median(rows, by, F.col("_i"), "offset").join(quantiles(rows, by, F.col("_h"), [0.99], ["_q"]), list(by)).select(*by, "offset", top.alias("_top")).where("_top > 0")
    ready = rows.join(facts, list(by)).select(*by, "_h", (F.col("_i") - F.col("offset")).alias("_i"), "_top").persist(StorageLevel.MEMORY_AND_DISK)
    try:

        def evaluate(asked: dict[tuple, float]) -> dict[tuple, float]:
            tried = ready.join(_rows(ready, by, asked, "_s", "double"), list(by)).withColumn("_c", F.col("_h") * (1 + F.col("_i") * F.col("_s")))
            return _keyed(smoothed_entropy(tried, by, "_c", "_top", sigma), by, "entropy")

        found = minimised({k: brent(0.0, first) for k in _keyed(facts, by, "offset")}, evaluate)
        slopes = _rows(df, by, {k: list(v) for k, v in found.items()}, "_f", "array<double>")
        return slopes.join(facts, list(by)).select(*by, F.col("_f")[0].alias("slope"), "offset", F.col("_f")[1].alias("entropy"))
    finally:
        ready.unpersist()


def legendre(t: Column, coefficients: Column) -> Column:
    """Sum of coefficients[k] times the Legendre polynomial of degree k + 1 at t, from the highest degree down."""
    start = F.struct(F.lit(0.0).alias("b"), F.lit(0.0).alias("b2"), F.size(coefficients).cast("double").alias("k"))
    step = lambda s, c: F.struct((c + (2 * s["k"] + 1) / (s["k"] + 1) * t * s["b"] - (s["k"] + 1) / (s["k"] + 2) * s["b2"]).alias("b"), s["b"].alias("b2"), (s["k"] - 1).alias("k"))
    return F.aggregate(F.reverse(coefficients), start, step, lambda s: t * s["b"] - 0.5 * s["b2"])


def time_drift_by_entropy(
    df: DataFrame, by: Sequence[str], time: str, height: str, width: float, degrees: int | None = None, seconds_a_degree: float = 2000, rows_a_degree: int = 2000, most: int = 20, limits: tuple[float, float] | None = None, first: float = 0.001, tolerance: float = 1e-5
) -> DataFrame:
    """by, since, until, coefficients, before, after: a gain that is a Legendre series in time, one term after the other, each with the least entropy.

    A channel has as many degrees as its seconds and rows allow (one at least, `most` at most), or `degrees`.  Entropies are of heights between
    `limits` (0 and 1.25 times the 99th percentile), blurred by exp(-|x| / width); before and after are those without and with the series.  A
    series that doesn't lower the entropy is replaced by none.  All channels search together; all rows count in every step.
    """
    rows = df.select(*by, F.col(time).cast("timestamp").cast("double").alias("_t") if dict(df.dtypes)[time].startswith("timestamp") else F.col(time).cast("double").alias("_t"), F.col(height).cast("double").alias("_h")).where("_h is not null and _t is not null")
    if limits is None:
        top = quantiles(rows, by, F.col("_h"), [0.99], ["_q"]).select(*by, (1.25 * F.col("_q")).alias("_top"))
        rows = rows.join(top, list(by)).where("_h > 0 and _h < _top").drop("_top")
    else:
        rows = rows.where((F.col("_h") > limits[0]) & (F.col("_h") < limits[1]))
    spans = rows.groupBy(*by).agg(F.min("_t").alias("since"), F.max("_t").alias("until"), F.count("*").alias("_n"))
    u = F.coalesce(F.try_divide(2 * (F.col("_t") - F.col("since")), F.col("until") - F.col("since")) - 1, F.lit(0.0))
    ready = rows.join(spans, list(by)).select(*by, "_h", u.alias("_u")).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        each = {tuple(r[c] for c in by): (r["since"], r["until"], r["_n"]) for r in spans.collect()}
        allowed = {k: degrees if degrees is not None else max(1, min(int((b - a) / seconds_a_degree), n // rows_a_degree, most)) for k, (a, b, n) in each.items()}
        series: dict[tuple, list[float]] = {k: [] for k in each}

        def entropies(tried: dict[tuple, list[float]]) -> dict[tuple, float]:
            model = ready.join(_rows(ready, by, tried, "_c", "array<double>"), list(by))
            corrected = model.withColumn("_x", F.col("_h") * (1 + legendre(F.col("_u"), F.col("_c"))))
            return _keyed(laplace_entropy(corrected, by, "_x", width), by, "entropy")

        for degree in range(1, max(allowed.values(), default=0) + 1):
            going = [k for k in series if allowed[k] >= degree]
            found = minimised({k: brent(-first, first, tolerance) for k in going}, lambda asked: entropies({k: [*series[k], x] for k, x in asked.items()}))
            for k, (x, _) in found.items():
                series[k] = [*series[k], x]
        before, after = entropies({k: [0.0] for k in series}) if series else {}, entropies(series) if series else {}
        out = {k: (*each[k][:2], series[k] if after[k] <= before[k] else [0.0] * len(series[k]), before[k], min(after[k], before[k])) for k in series}
        keys = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in by)
        return df.sparkSession.createDataFrame([(*k, *v) for k, v in out.items()], f"{keys}, since double, until double, coefficients array<double>, before double, after double")
    finally:
        ready.unpersist()


def time_drift_corrected(df: DataFrame, model: DataFrame, by: Sequence[str], time: str, height: str, output: str) -> DataFrame:
    """df with heights by their channel's series; times outside those it was learned from, and channels without one, change nothing."""
    series = model.select(*by, F.struct("since", "until", "coefficients").alias("_model"))
    t = F.col(time).cast("timestamp").cast("double") if dict(df.dtypes)[time].startswith("timestamp") else F.col(time).cast("double")
    m = F.col("_model")
    u = F.try_divide(2 * (t - m["since"]), m["until"] - m["since"]) - 1
    gain = F.when((u >= -1) & (u <= 1), legendre(u, m["coefficients"])).otherwise(0.0)
    return df.join(series, list(by), "left").withColumn(output, F.col(height).cast("double") * (1 + gain)).drop("_model")

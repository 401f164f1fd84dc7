"""Aggregates over pulse records: average pulses, noise spectra and correlations, robust statistics, calibrations."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulseloom.functions import pulses as P
from pulseloom.operators.quantiles import median, quantiles

BLOCK = 64  # lowest heights whose combinations one row scores


def average_pulse(df: DataFrame, by: Sequence[str], pulse: str, pre: int) -> DataFrame:
    """by, sample, level: mean record less its mean before the trigger.  Samples are summed map-side; no record is shuffled."""
    mean, _ = P.baseline(F.col(pulse), pre)
    lines = df.select(*by, mean.alias("_m"), F.posexplode(pulse).alias("sample", "_x"))
    return lines.groupBy(*by, "sample").agg((F.avg(F.col("_x").cast("double")) - F.avg("_m")).alias("level"))


def typical_peak(df: DataFrame, by: Sequence[str], pulse: str) -> DataFrame:
    return median(df, by, P.peak_index(F.col(pulse)), "_m").select(*by, F.floor("_m").cast("int").alias("peak_index"))


def quiet_records(df: DataFrame, by: Sequence[str], pulse: str, n_sigma: float = 5.0) -> DataFrame:
    """Records whose range stays within median + n_sigma * smad of their channel's."""
    from pulseloom.operators.cuts import spread

    ranged = df.withColumn("_range", P.excursion(F.col(pulse)).cast("double"))
    return ranged.join(spread(ranged, by, "_range"), list(by)).where(F.col("_range") <= F.col("med") + n_sigma * F.col("smad")).drop("_range", "med", "smad")


def _batch_sums(df: DataFrame, by: Sequence[str], pulse: str, f: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """by, k, total, n: sums of what f makes of records, as (row x k, which rows count).

    Records are transformed a batch at a time where they are read, and a batch leaves one row a channel; records with
    null samples, or none, are left out.
    """
    records = df.select(*by, F.col(pulse).cast("array<double>").alias("_x")).where(F.forall("_x", lambda x: x.isNotNull()) & (F.size("_x") > 0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.select(list(by)).to_pandas()
            code = keys.groupby(list(by), dropna=False, sort=False).ngroup().to_numpy()
            first = pd.Series(code).drop_duplicates().index.to_numpy()
            size = batch.column("_x").value_lengths().to_numpy()
            for length in np.unique(size).tolist():
                rows = np.flatnonzero(size == length)
                values, counts = f(np.asarray(batch.column("_x").take(pa.array(rows)).flatten()).reshape(len(rows), length))
                own = code[rows[counts]]
                sums, n = np.zeros((len(first), values.shape[1])), np.bincount(own, minlength=len(first))
                np.add.at(sums, own, values[counts])
                here = pa.array(np.flatnonzero(n))
                part = batch.select(list(by)).take(pa.array(first)).take(here)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(here) + 1) * values.shape[1], pa.int32()), pa.array(sums[n > 0].ravel()))
                yield pa.RecordBatch.from_arrays([*part.columns, lists, pa.array(n[n > 0], pa.int64())], [*by, "_s", "_n"])

    kinds = "".join(f"{k} {df.schema[k].dataType.simpleString()}, " for k in by)
    parts = records.mapInArrow(run, f"{kinds}_s array<double>, _n long")
    return parts.select(*by, F.posexplode("_s").alias("k", "_v"), "_n").groupBy(*by, "k").agg(F.sum("_v").alias("total"), F.sum("_n").alias("n"))


def autocorrelation(df: DataFrame, by: Sequence[str], pulse: str, lags: int, most: float = math.inf) -> DataFrame:
    """by, lag, value: mean over records of the biased autocorrelation of each record less its mean; records that stray beyond `most` are left out."""

    def correlate(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        y, n = x - x.mean(1, keepdims=True), x.shape[1]
        power = np.abs(np.fft.rfft(y, 2 * n)) ** 2
        each = np.zeros((len(y), lags))
        each[:, : min(lags, n)] = np.fft.irfft(power, 2 * n)[:, : min(lags, n)] / n
        return each, np.abs(y).max(1) <= most

    return _batch_sums(df, by, pulse, correlate).select(*by, F.col("k").alias("lag"), (F.col("total") / F.col("n")).alias("value"))


def periodogram(df: DataFrame, by: Sequence[str], pulse: str, n: int, dt: float) -> DataFrame:
    """by, k, frequency, psd: mean one-sided power spectral density of the records of n samples."""
    spectra = _batch_sums(df.where(F.size(pulse) == n), by, pulse, lambda x: (np.abs(np.fft.rfft(x)) ** 2, np.ones(len(x), bool)))
    edge = (F.col("k") == 0) | (F.col("k") * 2 == n)
    return spectra.select(*by, "k", (F.col("k") / (n * dt)).alias("frequency"), (F.col("total") / F.col("n") * dt / n * F.when(edge, 1.0).otherwise(2.0)).alias("psd"))


def log_rebinned(psd: DataFrame, by: Sequence[str], per_decade: int) -> DataFrame:
    """Geometric-mean frequency and mean density in logarithmic bins; frequency 0 is left out."""
    binned = psd.where("frequency > 0").withColumn("decade_bin", F.floor(F.log10("frequency") * per_decade).cast("long"))
    return binned.groupBy(*by, "decade_bin").agg(F.exp(F.avg(F.log("frequency"))).alias("frequency"), F.avg("psd").alias("psd"))


def robust(df: DataFrame, by: Sequence[str], column: str) -> DataFrame:
    """by, trimean, mad (normalised), rms and the smallest positive value."""
    from pulseloom.operators.cuts import spread

    x = F.col(column).cast("double")
    quartiles = quantiles(df, by, x, [0.25, 0.5, 0.75], ["_a", "_b", "_c"])
    one = df.groupBy(*by).agg(F.sqrt(F.avg(x * x)).alias("rms"), F.min(F.when(x > 0, x)).alias("least_positive"))
    return one.join(spread(df, by, column), list(by)).join(quartiles, list(by)).select(*by, ((F.col("_a") + 2 * F.col("_b") + F.col("_c")) / 4).alias("trimean"), (F.col("smad") / 1.4826 / 0.674480).alias("mad"), "rms", "least_positive")


def shortest_half(df: DataFrame, by: Sequence[str], column: str) -> DataFrame:
    """by, shorth: the least range that holds half of the values (n / 2 + 1 of them)."""
    w = Window.partitionBy(*by).orderBy("_x")
    n = F.count("*").over(Window.partitionBy(*by))
    placed = df.select(*by, F.col(column).cast("double").alias("_x")).where("_x is not null").withColumns({"_k": F.row_number().over(w), "_n": n})
    other = placed.select(*by, (F.col("_k") - F.floor(F.col("_n") / 2)).alias("_k"), F.col("_x").alias("_y"))
    return placed.join(other, [*by, "_k"]).groupBy(*by).agg(F.min(F.col("_y") - F.col("_x")).alias("shorth"))


def high_median(df: DataFrame, by: Sequence[str], column: str, weight: str) -> DataFrame:
    """by, high_median: the least value at which the weights up to it exceed half of all."""
    grouped = df.groupBy(*by, F.col(column).cast("double").alias("_x")).agg(F.sum(F.col(weight).cast("double")).alias("_w"))
    all_ = Window.partitionBy(*by)
    sums = grouped.withColumns({"_c": F.sum("_w").over(all_.orderBy("_x").rowsBetween(Window.unboundedPreceding, 0)), "_t": F.sum("_w").over(all_)})
    return sums.where(2 * F.col("_c") > F.col("_t")).groupBy(*by).agg(F.min("_x").alias("high_median"))


def weighted_mean_step(df: DataFrame, by: Sequence[str], column: str, centre: DataFrame, k: float, kind: str = "bisquare") -> DataFrame:
    """One step of an iteratively reweighted mean: by, value.  centre: by, value."""
    x = F.col(column).cast("double")
    off = (x - F.col("_centre")) / k
    weight = F.pow(F.greatest(1 - off * off, F.lit(0.0)), 2.0) if kind == "bisquare" else F.when(F.abs(off) <= 1, 1.0).otherwise(F.try_divide(F.lit(1.0), F.abs(off)))
    return df.join(centre.withColumnRenamed("value", "_centre"), list(by)).withColumn("_w", weight).groupBy(*by).agg(F.try_divide(F.sum(F.col("_w") * x), F.sum("_w")).alias("value"))


def weighted_mean(df: DataFrame, by: Sequence[str], column: str, k: float, kind: str = "bisquare", steps: int = 10) -> DataFrame:
    """The iteratively reweighted mean, from the median; each step is one aggregate over the same rows."""
    centre = median(df, by, F.col(column), "value")
    for _ in range(steps):
        centre = weighted_mean_step(df, by, column, centre, k, kind)
    return centre


def kink_at(df: DataFrame, by: Sequence[str], x: str, y: str, k: float) -> DataFrame:
    """by, level, left, right: least-squares fit of two lines that meet at x = k, from conditional sums."""
    u, v = F.col(x).cast("double") - k, F.col(y).cast("double")
    low, high = F.when(u < 0, u).otherwise(0.0), F.when(u >= 0, u).otherwise(0.0)
    sums = df.groupBy(*by).agg(F.count("*").cast("double").alias("n"), *(F.sum(e).alias(c) for c, e in (("i", low), ("j", high), ("ii", low * low), ("jj", high * high), ("y", v), ("iy", low * v), ("jy", high * v))))
    det = F.col("n") * F.col("ii") * F.col("jj") - F.col("i") ** 2 * F.col("jj") - F.col("j") ** 2 * F.col("ii")
    level = F.try_divide(F.col("y") * F.col("ii") * F.col("jj") - F.col("i") * F.col("iy") * F.col("jj") - F.col("j") * F.col("jy") * F.col("ii"), det)
    fitted = sums.withColumn("level", level)
    return fitted.select(*by, "level", F.try_divide(F.col("iy") - F.col("i") * F.col("level"), F.col("ii")).alias("left"), F.try_divide(F.col("jy") - F.col("j") * F.col("level"), F.col("jj")).alias("right"))


def ranked_assignments(lines: DataFrame, peaks: DataFrame, curvature: float = 30_000.0, within: float = 0.1) -> DataFrame:
    """Ways to give three peak heights to three line energies by a falling linear gain; rank 1 has the least relative error.

    lines (energy) and peaks (height) are short lists; pairs come from range joins between them.  Each list is one partition, as
    tasks of such joins are the product of their partitions.  Where a gain is exactly zero there is no energy, and so no assignment.
    """
    e = lambda k: lines.select(F.col("energy").alias(f"e{k}")).coalesce(1)
    p = lambda k: peaks.select(F.col("height").alias(f"p{k}")).coalesce(1)
    pairs = e(0).join(e(1), F.col("e0") < F.col("e1")).join(p(0).join(p(1), F.col("p0") < F.col("p1")))
    g0, g1 = F.col("p0") / F.col("e0"), F.col("p1") / F.col("e1")
    pairs = pairs.withColumn("slope", (g1 - g0) / (F.col("p1") - F.col("p0"))).withColumn("gain", g0 - F.col("p0") * F.col("slope"))
    pairs = pairs.where((F.col("slope") < 0) & (1 + F.try_divide(curvature * F.col("slope"), F.col("gain")) > 0.25))
    full = pairs.join(e(2), F.col("e1") < F.col("e2")).join(p(2), F.col("p1") < F.col("p2"))
    error = F.try_divide(F.col("p2"), F.col("gain") + F.col("slope") * F.col("p2")) - F.col("e2")
    full = full.withColumn("error", error).where(F.abs(F.col("error") / F.col("e2")) < within)
    best = Window.orderBy(F.round(F.abs(F.col("error") / F.col("e2")), 9), "e0", "p0", "e1", "p1", "e2", "p2")  # as few rows as short lists give
    return full.withColumn("rank", F.row_number().over(best)).select("e0", "p0", "e1", "p1", "e2", "p2", "error", "rank")


def best_combination(lines: Sequence[float], peaks: DataFrame, by: Sequence[str]) -> DataFrame:
    """by, h0, h1, h2, rms: the three of each channel's peak heights whose middle one lies best on the line through the outer ones.

    All heights of a channel are tried.  For given outer heights the guess rises with the middle one, so only the heights
    about the ideal place are scored: the work goes with the square of a channel's heights, and is dealt out by the
    lowest height in blocks.  Channels with fewer than three heights have no row.
    """
    known = peaks.where(F.col("height").isNotNull()).dropna(subset=list(by))
    sorted_ = known.groupBy(*by).agg(F.array_sort(F.collect_set(F.col("height").cast("double"))).alias("_h")).where(F.size("_h") > 2)
    blocks = sorted_.withColumn("_i", F.explode(F.sequence(F.lit(0), F.size("_h") - 3, F.lit(BLOCK)))).repartition(*by, "_i")
    low, middle, high = (float(x) for x in lines)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for h, first in zip(batch.column("_h"), batch.column("_i").to_pylist(), strict=True):
                h, tried = h.values.to_numpy(), []
                for i in range(first, min(first + BLOCK, len(h) - 2)):
                    k = np.arange(i + 2, len(h))
                    ideal = np.searchsorted(h, h[i] + (middle - low) / (high - low) * (h[k] - h[i]))
                    # two on either side, as the ideal place is rounded
                    j = np.clip(ideal + np.arange(-2, 2)[:, None], i + 1, k - 1)
                    rms = np.abs(low + (h[j] - h[i]) / (h[k] - h[i]) * (high - low) - middle)
                    at = np.flatnonzero(rms == rms.min())
                    tried += [(rms.flat[x], h[i], h[j].flat[x], h[k[x % len(k)]]) for x in at]
                found.append(min(tried))
            best = np.array(found).reshape(-1, 4)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in by), *(pa.array(best[:, c]) for c in (1, 2, 3, 0))], [*by, "h0", "h1", "h2", "rms"])

    kinds = ", ".join(f"`{c}` {peaks.schema[c].dataType.simpleString()}" for c in by)
    scored = blocks.mapInArrow(run, f"{kinds}, h0 double, h1 double, h2 double, rms double")
    best = F.min(F.struct("rms", "h0", "h1", "h2")).alias("_b")
    return scored.groupBy(*by).agg(best).select(*by, "_b.h0", "_b.h1", "_b.h2", "_b.rms")


def transmission(layers: DataFrame, by: Sequence[str]) -> DataFrame:
    """by, transmission: exp of minus the sum of attenuation * density * thickness over layers."""
    return layers.groupBy(*by).agg(F.exp(-F.sum(F.col("attenuation") * F.col("density") * F.col("thickness"))).alias("transmission"))


def cut_out(stream: DataFrame, triggers: DataFrame, by: Sequence[str], before: int, after: int) -> DataFrame:
    """by, trigger, pulse: samples around each trigger of a continuous stream kept in chunks (by, chunk, start, samples of equal number).

    A record lies in one chunk or two; triggers are sent to both by chunk number, and the parts put together.
    """
    size = stream.agg(F.max(F.size("samples"))).first()[0] or 1
    spans = triggers.select(*by, F.col("trigger"), (F.col("trigger") - before).alias("_a"), (F.col("trigger") + after).alias("_b"))
    parts = spans.withColumn("chunk", F.explode(F.sequence(F.floor(F.col("_a") / size), F.floor((F.col("_b") - 1) / size)))).join(stream, [*by, "chunk"])
    low, high = F.greatest(F.col("_a"), F.col("start")), F.least(F.col("_b"), F.col("start") + F.size("samples"))
    piece = F.slice("samples", (low - F.col("start") + 1).cast("int"), (high - low).cast("int"))
    joined = parts.where(high > low).groupBy(*by, "trigger").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("chunk", piece.alias("s")))), lambda p: p["s"])).alias("pulse"))
    return joined.where(F.size("pulse") == before + after)


def kink_fit(df: DataFrame, by: Sequence[str], x: str, y: str, places: Sequence[float]) -> DataFrame:
    """by, place, level, left, right, misfit: the best of several places for two lines to meet, by one pass over the rows."""
    tried = df.withColumn("_k", F.explode(F.array(*[F.lit(float(k)) for k in places]))).withColumn("_u", F.col(x).cast("double") - F.col("_k"))
    fits = kink_at(tried, [*by, "_k"], "_u", y, 0.0)
    slope = F.when(F.col("_u") < 0, F.coalesce("left", F.lit(0.0))).otherwise(F.coalesce("right", F.lit(0.0)))
    off = F.col(y).cast("double") - F.col("level") - slope * F.col("_u")
    scored = tried.join(fits, [*by, "_k"]).groupBy(*by, "_k").agg(F.sum(off * off).alias("misfit"), *(F.first(c).alias(c) for c in ("level", "left", "right")))
    best = F.row_number().over(Window.partitionBy(*by).orderBy(F.col("misfit").asc_nulls_last(), "_k"))
    return scored.withColumn("_rn", best).where("_rn = 1").select(*by, F.col("_k").alias("place"), "level", "left", "right", "misfit")


def arrival_model(df: DataFrame, by: Sequence[str], pulse: str, pre: int, promptness: str, size: str) -> DataFrame:
    """by, sample, level, arrival: each sample's value and its slope against arrival time, by least squares over records.

    Arrival time is promptness less its line against pulse size, mapped by a parabola that sends its 10 %, 50 % and 90 %
    points to -0.4, 0 and 0.4; records beyond 0.45 are left out.
    """
    line = df.groupBy(*by).agg(F.regr_slope(promptness, size).alias("_s"), F.regr_intercept(promptness, size).alias("_i"))
    flat = df.join(line, list(by)).withColumn("_p", F.col(promptness) - F.col("_i") - F.col("_s") * F.col(size))
    points = flat.groupBy(*by).agg(F.percentile("_p", F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9))).alias("_q"))
    a, m, b = (F.col("_q")[k] for k in range(3))
    v = F.col("_p")
    mapped = -0.4 * F.try_divide((v - m) * (v - b), (a - m) * (a - b)) + 0.4 * F.try_divide((v - a) * (v - m), (b - a) * (b - m))
    mean, _ = P.baseline(F.col(pulse), pre)
    timed = flat.join(points, list(by)).withColumn("_t", mapped).where("abs(_t) < 0.45")
    lines = timed.select(*by, "_t", mean.alias("_m"), F.posexplode(pulse).alias("sample", "_x")).withColumn("_y", F.col("_x").cast("double") - F.col("_m"))
    return lines.groupBy(*by, "sample").agg(F.regr_intercept("_y", "_t").alias("level"), F.regr_slope("_y", "_t").alias("arrival"))


def stream_triggers(stream: DataFrame, by: Sequence[str], weights: Sequence[float], threshold: float) -> DataFrame:
    """by, trigger: where a filter's output over a continuous stream first exceeds the threshold after being negative.

    Chunks (by, chunk, start, samples) get the first samples of the next one, so filters cross their ends; of the output
    only crossings leave a chunk, and the re-arming rule runs over these.
    """
    m = len(weights)
    w = Window.partitionBy(*by).orderBy("chunk")
    whole = F.concat("samples", F.coalesce(F.slice(F.lead("samples").over(w), 1, m), F.slice("samples", 1, 0)))
    y = F.transform(F.sequence(F.lit(0), F.size("_s") - m), lambda k: P.dot(F.slice("_s", k + 1, F.lit(m)), weights))
    out = stream.withColumn("_s", whole).where(F.size("_s") >= m).withColumn("_y", y)
    over, below = lambda v: v > threshold, lambda v: v < 0
    before = lambda k, f: F.when(k == 0, F.lit(False)).otherwise(F.coalesce(f(F.get("_y", k - 1)), F.lit(False)))
    places = F.sequence(F.lit(0), F.size("_y") - 1)
    kept = F.filter(places, lambda k: (over(F.get("_y", k)) & ~before(k, over)) | (below(F.get("_y", k)) & ~before(k, below)))
    events = out.select(*by, "start", F.explode(F.transform(kept, lambda k: F.struct(k.alias("k"), F.get("_y", k).alias("v")))).alias("e")).select(*by, (F.col("start") + F.col("e.k")).alias("trigger"), F.col("e.v").alias("_v")).distinct()
    from pulseloom.operators.temporal import armed_triggers

    return armed_triggers(events, by, ["trigger"], "_v", threshold).select(*by, "trigger")

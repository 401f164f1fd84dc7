"""Continuous data in chunks: by, chunk (numbered from 0 without holes), start (number of the first sample) and samples.

What looks beyond a chunk's end gets the first samples of the chunks that follow, sent by an equi-join on the chunk's number,
so a stream is as many tasks' work as it has chunks, however long it is.  What depends on all that came before is folded to a
few values a chunk, and only these are followed in order.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulseloom.operators.pulse_stats import autocorrelation

#: Blocks of a correlation are so many times as long as its lags.
BLOCK = 15


def with_halo(stream: DataFrame, by: Sequence[str], n: int) -> DataFrame:
    """stream with halo: the n samples after each chunk, or as many as there are without a hole."""
    size = F.size("samples")
    heads = stream.select(*by, "chunk", "start", F.slice("samples", 1, n).alias("h"), size.alias("size"))
    # a chunk shorter than n passes its head on to earlier ones too, as many as the shortest may need
    least = stream.agg(F.min(size)).first()[0] or 1
    sent = heads.withColumn("_k", F.explode(F.sequence(F.lit(1), F.lit(-(-n // max(least, 1))))))
    near = sent.select(*by, (F.col("chunk") - F.col("_k")).alias("chunk"), F.struct("_k", "start", "h", "size").alias("_h"))
    gathered = near.groupBy(*by, "chunk").agg(F.array_sort(F.collect_list("_h")).alias("_h"))
    first = F.struct((F.col("start") + size).alias("at"), F.slice("samples", 1, 0).alias("x"))
    whole = F.aggregate(F.coalesce("_h", F.array()), first, lambda s, h: F.when(h["start"] == s["at"], F.struct((h["start"] + h["size"]).alias("at"), F.concat(s["x"], h["h"]).alias("x"))).otherwise(F.struct(F.lit(-1).cast("long").alias("at"), s["x"].alias("x"))), lambda s: F.slice(s["x"], 1, n))
    return stream.join(gathered, [*by, "chunk"], "left").withColumn("halo", whole).drop("_h")


def _kinds(df: DataFrame, by: Sequence[str]) -> str:
    return "".join(f"`{c}` {df.schema[c].dataType.simpleString()}, " for c in by)


def peak_triggers(stream: DataFrame, by: Sequence[str], weights: Sequence[float], threshold: float) -> DataFrame:
    """by, trigger: the sample after each peak of a filter's output above the threshold, if the output was negative since the last such peak.

    Output k is the weighted sum of the samples from k on; a peak exceeds the output before it and is not below that after it.
    The last output of a stream is not used.  Each chunk finds its own peaks, and says what state it leaves: armed if a negative
    output came last, disarmed if a peak did, as it was if it has neither.  Only its first peak, where nothing negative came before it,
    depends on the state that the chunk was entered in, which is that left by the last one that says.
    """
    if threshold <= 0:
        raise ValueError("the threshold must be positive")
    w, m = np.array(weights, float), len(weights)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sure, maybe, leaves = [], [], []
            for start, own, halo in zip(batch.column("start").to_pylist(), batch.column("samples"), batch.column("halo"), strict=True):
                x = np.concatenate([own.values.to_numpy(zero_copy_only=False), halo.values.to_numpy(zero_copy_only=False)]).astype(float)
                y = np.convolve(x, w[::-1], "valid") if len(x) >= m else np.zeros(0)
                y = y[: min(len(own) + 2, max(len(x) - m, 0))]  # peaks at places 1 to the number of samples
                b = y[1:-1]
                peaks = np.flatnonzero((b > threshold) & (b >= y[2:]) & (b > y[:-2])) + 1
                below = np.flatnonzero(b < 0) + 1
                since = np.searchsorted(below, peaks)
                good = np.diff(since, prepend=0) > 0
                sure.append((start + peaks[good] + 1).tolist())
                maybe.append(int(start + peaks[0] + 1) if len(peaks) and not good[0] else None)
                last = [a[-1] if len(a) else -1 for a in (below, peaks)]
                leaves.append(None if last == [-1, -1] else bool(last[0] > last[1]))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in [*by, "chunk"]), pa.array(sure, pa.list_(pa.int64())), pa.array(maybe, pa.int64()), pa.array(leaves, pa.bool_())], [*by, "chunk", "sure", "maybe", "leaves"])

    ready = with_halo(stream.where("samples is not null"), by, m + 2).select(*by, F.col("chunk").cast("long").alias("chunk"), F.col("start").cast("long").alias("start"), "samples", "halo")
    found = ready.mapInArrow(find, _kinds(stream, by) + "chunk long, sure array<long>, maybe long, leaves boolean")
    before = Window.partitionBy(*by).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)  # a row a chunk
    armed = F.coalesce(F.last("leaves", ignorenulls=True).over(before), F.lit(False))
    all_ = F.when(armed & F.col("maybe").isNotNull(), F.concat(F.array("maybe"), "sure")).otherwise(F.col("sure"))
    return found.select(*by, all_.alias("_t")).select(*by, F.explode("_t").alias("trigger"))


def blocks(stream: DataFrame, by: Sequence[str], size: int) -> DataFrame:
    """by, block, samples: the stream cut anew into blocks of `size` samples from its begin; a last one that isn't full is left out."""
    n = F.size("samples")
    spans = stream.where(n > 0).withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / size), F.floor((F.col("start") + n - 1) / size))))
    low, high = F.greatest(F.col("start"), F.col("block") * size), F.least(F.col("start") + n, (F.col("block") + 1) * size)
    pieces = spans.select(*by, "block", F.struct(low.alias("at"), F.slice("samples", (low - F.col("start") + 1).cast("int"), (high - low).cast("int")).alias("x")).alias("_p"))
    joined = pieces.groupBy(*by, "block").agg(F.flatten(F.transform(F.array_sort(F.collect_list("_p")), lambda p: p["x"])).alias("samples"))
    return joined.where(F.size("samples") == size)


def block_correlation(stream: DataFrame, by: Sequence[str], lags: int, most: float = 1000.0) -> DataFrame:
    """by, lag, value: the mean of the correlations of blocks of BLOCK * lags samples, each less its own mean; blocks that stray beyond `most` are left out."""
    return autocorrelation(blocks(stream, by, BLOCK * lags), by, "samples", lags, most)


def continuous_correlation(stream: DataFrame, by: Sequence[str], lags: int) -> DataFrame:
    """by, lag, value: sum over the whole stream of x[t] * x[t + lag], x being samples less the stream's mean, over their number; across all chunks' borders."""
    total = F.aggregate("samples", F.lit(0.0), lambda s, x: s + x.cast("double"))
    means = stream.groupBy(*by).agg((F.sum(total) / F.sum(F.size("samples"))).alias("_m"), F.sum(F.size("samples")).alias("_n"))
    ready = with_halo(stream, by, lags - 1).join(means, list(by)).select(*by, "_m", "_n", "samples", "halo")

    def correlate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = []
            for mean, own, halo in zip(batch.column("_m").to_pylist(), batch.column("samples"), batch.column("halo"), strict=True):
                x = own.values.to_numpy(zero_copy_only=False).astype(float) - mean
                longer = np.concatenate([x, halo.values.to_numpy(zero_copy_only=False).astype(float) - mean])
                size = 1 << int(len(longer) + lags).bit_length()
                s = np.fft.irfft(np.conj(np.fft.rfft(x, size)) * np.fft.rfft(longer, size), size)[:lags]
                sums.append(np.pad(s, (0, lags - len(s))))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in [*by, "_n"]), pa.array([s.tolist() for s in sums], pa.list_(pa.float64()))], [*by, "_n", "_s"])

    parts = ready.mapInArrow(correlate, _kinds(stream, by) + "_n long, _s array<double>")
    return parts.select(*by, "_n", F.posexplode("_s").alias("lag", "_v")).groupBy(*by, "_n", "lag").agg(F.sum("_v").alias("_t")).select(*by, "lag", (F.col("_t") / F.col("_n")).alias("value"))


def continuity(df: DataFrame, by: Sequence[str], order: str, count: str, expected: Column | float, slot: int = 1 << 16) -> DataFrame:
    """by, largest_gap, continuous: whether the count never rises by more than expected from one record to the next.

    A single record is not continuous.  `order` numbers a channel's records; runs of `slot` of them are compared apart, and then only their ends.
    """
    rows = df.select(*by, F.col(order).cast("long").alias("_o"), F.col(count).alias("_c"), (F.lit(expected) if isinstance(expected, (int, float)) else expected).alias("_e")).where("_o is not null and _c is not null").withColumn("_k", F.floor(F.col("_o") / slot))
    w = Window.partitionBy(*by, "_k").orderBy("_o")
    inside = rows.withColumn("_d", F.col("_c") - F.lag("_c").over(w)).groupBy(*by, "_k").agg(F.max("_d").alias("_d"), F.min_by("_c", "_o").alias("_first"), F.max_by("_c", "_o").alias("_last"), F.max("_e").alias("_e"))
    ends = Window.partitionBy(*by).orderBy("_k")
    border = inside.withColumn("_b", F.col("_first") - F.lag("_last").over(ends))
    gaps = border.groupBy(*by).agg(F.greatest(F.max("_d"), F.max("_b")).alias("largest_gap"), F.max("_e").alias("_e"))
    return gaps.select(*by, "largest_gap", F.coalesce(F.col("largest_gap") <= F.col("_e"), F.lit(False)).alias("continuous"))

"""Arrival-phase correction: heights near known peaks are shifted, phase by phase, to where their joint entropy is least.

For every peak of every channel the range of phases is cut into parts.  Each part's heights are shifted against all others
by what makes the blurred distribution's entropy least, twice, the second time from heights that the first curve has
corrected.  All parts of all peaks of all channels search at the same time, one aggregate a step.

The shifts' natural splines over phase are the curves of the peaks.  A record is corrected by the curves of the peaks
below and above its height, linearly between them, from no correction at no height; beyond the last peak in proportion.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from pulseloom.operators.calibration import _let, _piece, _value
from pulseloom.operators.entropies import _keyed, brent, minimised
from pulseloom.operators.learning import laplace_entropy, natural_spline, spline_applied
from pulseloom.operators.quantiles import median, quantiles

#: How far from a peak heights count, as a part of the peaks' mean; phases that count; outer parts of phases; rows of a part, and least and most parts.
NEAR, WIDEST, OUTER, ROWS, LEAST, MOST = 0.012, 2.0, (0.03, 0.97), 300, 3, 12
#: First steps and tolerances of the two rounds, the kernel's width as a part of the highest peak, and how far phases are corrected.
ROUNDS, KERNEL, CLIP = ((0.003, 3e-4), (0.002, 1e-4)), 1e-3, 0.6


def _frame(df: DataFrame, keys: Sequence[str], values: dict[tuple, float], name: str) -> DataFrame:
    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keys)
    return df.sparkSession.createDataFrame([(*k, float(v)) for k, v in values.items()], f"{kinds}, `{name}` double")


def phase_curves(df: DataFrame, by: Sequence[str], phase: str, height: str, peaks: Sequence[float], width: float | None = None) -> DataFrame:
    """by, curves: an array, by rising peak, of peak, centre (the median phase near it), zero (the curve at the centre) and pieces (its cubics).

    width: of the two-sided exponential that blurs heights, a thousandth of the highest peak by default.  Peaks without rows near
    them have no curve; channels without any have no row.
    """
    peaks = sorted(float(p) for p in peaks)
    if not peaks:
        raise ValueError("there are no peaks")
    width = peaks[-1] * KERNEL if width is None else width
    reach = NEAR * sum(peaks) / len(peaks)
    x, y = F.col(phase).cast("double"), F.col(height).cast("double")
    near = F.filter(F.array(*map(F.lit, peaks)), lambda p: F.abs(y - p) < reach)
    rows = df.where(x.isNotNull() & y.isNotNull() & (F.abs(x) < WIDEST)).select(*by, x.alias("_x"), y.alias("_y"), F.explode(near).alias("_peak"))
    keys = [*by, "_peak"]
    facts = quantiles(rows, keys, F.col("_x"), [OUTER[0], 0.5, OUTER[1]], ["_low", "_mid", "_high"]).join(rows.groupBy(*keys).agg(F.greatest(F.lit(LEAST), F.least(F.lit(MOST), F.floor(F.count("*") / ROWS))).cast("int").alias("_n")), keys)
    u = F.coalesce(F.try_divide(F.col("_x") - F.col("_low"), F.col("_high") - F.col("_low")), F.lit(0.0))
    part = F.when((u >= -1) & (u < 2), F.greatest(F.lit(0), F.least(F.floor(u * F.col("_n")), F.col("_n") - 1)).cast("int"))
    ready = rows.join(facts, keys).select(*keys, "_x", "_y", part.alias("_part")).persist(StorageLevel.MEMORY_AND_DISK)
    held = [ready]
    try:
        knots = median(ready.where("_part is not null"), [*keys, "_part"], F.col("_x"), "x")
        known = _keyed(knots, [*keys, "_part"], "x")
        shifts = dict.fromkeys(known, 0.0)
        for step, tolerance in ROUNDS:
            now = held[-1]

            def evaluate(asked: dict[tuple, float], now: DataFrame = now) -> dict[tuple, float]:
                tried = _frame(now, [*keys, "_part"], asked, "_s").withColumnRenamed("_part", "_tried")
                moved = now.join(tried, keys).withColumn("_z", F.when(F.col("_part") == F.col("_tried"), F.col("_y") + F.col("_s")).otherwise(F.col("_y")))
                return _keyed(laplace_entropy(moved, [*keys, "_tried"], "_z", width), [*keys, "_tried"], "entropy")

            found = minimised({k: brent(-step, step, tolerance) for k in shifts}, evaluate)
            # the first round's shifts are taken about their mean
            groups: dict[tuple, list[float]] = {}
            for k, (s, _) in found.items():
                groups.setdefault(k[:-1], []).append(s)
            first = now is ready
            shifts = {k: shifts[k] + s - (sum(groups[k[:-1]]) / len(groups[k[:-1]]) if first else 0.0) for k, (s, _) in found.items()}
            table = knots.join(_frame(ready, [*keys, "_part"], shifts, "y"), [*keys, "_part"])
            if first:
                better = spline_applied(ready, natural_spline(table.select(*keys, "x", "y"), keys), keys, "_x", "_c")
                held.append(better.select(*keys, "_x", (F.col("_y") + F.col("_c")).alias("_y"), "_part").persist(StorageLevel.MEMORY_AND_DISK))
        curve = table.join(facts.select(*keys, "_mid"), keys).select(*keys, (F.col("x") - F.col("_mid")).alias("x"), (F.col("_peak") - F.col("y")).alias("y"))
        pieces = natural_spline(curve, keys).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("place", "x", "y", "slope", "bend", "twist", "x_next"))).alias("pieces"))
        zero = _let(_piece(F.col("pieces"), F.lit(0.0)), lambda p: _value(p, F.lit(0.0) - p["x"]))
        each = pieces.join(facts.select(*keys, "_mid"), keys).select(*by, F.struct(F.col("_peak").alias("peak"), F.col("_mid").alias("centre"), zero.alias("zero"), "pieces").alias("_c"))
        out = each.groupBy(*by).agg(F.array_sort(F.collect_list("_c")).alias("curves"))
        return df.sparkSession.createDataFrame(out.collect(), out.schema)  # a few numbers a channel and peak
    finally:
        for h in held:
            h.unpersist()


def corrected(height: Column, phase: Column, curves: Column) -> Column:
    """The height as it would be at its peak's median phase.

    Phases count from the median phase at their height, which is joined linearly between peaks and stays beyond them, and by CLIP at most.
    """
    h, n = height.cast("double"), F.size(curves)

    def between(z: Column, v: Column, at: Column) -> Column:
        """v at a place, linear between the places z, and constant beyond."""
        k = F.greatest(F.lit(0), F.least(F.size(F.filter(z, lambda x: x <= at)) - 1, F.size(z) - 2))
        part = F.least(F.greatest(F.coalesce(F.try_divide(at - F.get(z, k), F.get(z, k + 1) - F.get(z, k)), F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
        return F.when(F.size(z) == 1, F.get(v, F.lit(0))).otherwise(F.get(v, k) * (1 - part) + F.get(v, k + 1) * part)

    centre = between(curves["peak"], curves["centre"], h)
    u = F.greatest(F.lit(-CLIP), F.least(F.lit(CLIP), phase.cast("double") - centre))

    def apply(t: Column) -> Column:
        shifts = F.concat(F.array(F.lit(0.0)), F.transform(curves, lambda c: _let(_piece(c["pieces"], t), lambda p: c["zero"] - _value(p, t - p["x"]))))
        places = F.concat(F.array(F.lit(0.0)), curves["zero"])
        return _let(F.struct(shifts.alias("s"), places.alias("z")), mix)

    def mix(q: Column) -> Column:
        k = F.least(F.size(F.filter(q["z"], lambda z: z <= h)) - 1, n - 1)
        part = (h - F.get(q["z"], k)) / (F.get(q["z"], k + 1) - F.get(q["z"], k))
        return F.when(h < 0, h).otherwise(h + part * F.get(q["s"], k + 1) + (1 - part) * F.get(q["s"], k))

    return F.when(curves.isNull() | (n == 0), h).otherwise(_let(u, apply))


def phase_corrected(df: DataFrame, model: DataFrame, by: Sequence[str], phase: str, height: str, output: str) -> DataFrame:
    """df with corrected heights; channels without curves keep theirs."""
    return df.join(model.select(*by, F.col("curves").alias("_curves")), list(by), "left").withColumn(output, corrected(F.col(height), F.col(phase), F.col("_curves"))).drop("_curves")

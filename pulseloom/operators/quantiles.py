"""Exact quantiles per channel that no task has to see the whole channel for.

A first aggregate finds, by mergeable sketches, two values that surely lie on either side of a quantile.  A second
one counts what lies below and above, and lists the values between, which are some thousandths of the channel, each once
with its count; only these are put in order.  Both aggregates sum before they shuffle, so a channel that holds most rows is
no more work for one task than any other.  Channels of few rows are listed whole.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A sketch's ranks are good to one part in ACCURACY; channels of up to FEW rows need none.
ACCURACY, FEW = 2000, 8000


def quantiles(df: DataFrame, by: Sequence[str], x: Column, parts: Sequence[float], names: Sequence[str]) -> DataFrame:
    """by and one column a part, as percentile() gives them: between two values linearly.  Nulls count for nothing; NaN is the largest."""
    rows = df.select(*by, x.cast("double").alias("_x")).where("_x is not null")
    slack, places = 3 / ACCURACY, range(len(parts))
    bounds = [b for p in parts for b in (max(p - slack, 0.0), min(p + slack, 1.0))]
    sketch = rows.groupBy(*by).agg(F.count("*").alias("_n"), F.percentile_approx("_x", F.array(*map(F.lit, bounds)), ACCURACY).alias("_b"))
    few = F.col("_n") <= FEW
    sides = F.array(
        *[
            F.struct(F.lit(k).alias("k"), F.when(few, 0).when(F.col("_x") < F.col("_b")[2 * k], -1).when(F.col("_x") > F.col("_b")[2 * k + 1], 1).otherwise(0).alias("side"))
            for k in places
        ]
    )
    on = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in by]
    split = rows.alias("l").join(sketch.alias("r"), on).select(*[F.col(f"l.{c}").alias(c) for c in by], "_x", "_n", "_b")
    each = split.select(*by, "_n", "_x", F.explode(sides).alias("_s")).select(*by, "_n", "_x", "_s.*")
    # of what lies outside only the nearest value is wanted
    inside = F.when(F.col("side") == 0, F.col("_x"))
    counts = each.groupBy(*by, "_n", "k", "side", inside.alias("_v")).agg(F.count("*").alias("_c"), F.min("_x").alias("_low"), F.max("_x").alias("_high"))
    counts = counts.withColumn("_v", F.when(F.col("side") < 0, F.col("_high")).when(F.col("side") > 0, F.col("_low")).otherwise(F.col("_v")))
    order = Window.partitionBy(*by, "k").orderBy("side", "_v").rowsBetween(Window.unboundedPreceding, 0)
    placed = counts.withColumn("_end", F.sum("_c").over(order))
    at = (F.col("_n") - 1) * F.get(F.array(*[F.lit(float(p)) for p in parts]), F.col("k"))
    held = lambda rank: F.max(F.when((F.col("_end") - F.col("_c") <= rank) & (rank < F.col("_end")), F.col("_v")))
    found = placed.withColumn("_at", at).groupBy(*by, "k", "_at").agg(held(F.floor("_at")).alias("_a"), held(F.ceil("_at")).alias("_b"))
    value = F.when(F.floor("_at") == F.ceil("_at"), F.col("_a")).otherwise((F.ceil("_at") - F.col("_at")) * F.col("_a") + (F.col("_at") - F.floor("_at")) * F.col("_b"))
    done = found.select(*by, "k", value.alias("_q"))
    return done.groupBy(*by).agg(*[F.max(F.when(F.col("k") == k, F.col("_q"))).alias(name) for k, name in zip(places, names, strict=True)])


def median(df: DataFrame, by: Sequence[str], x: Column, name: str = "med") -> DataFrame:
    return quantiles(df, by, x, [0.5], [name])

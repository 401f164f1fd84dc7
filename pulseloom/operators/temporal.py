"""As-of joins, and other operators that follow the order of records in a channel.

As-of joins stack both sides and carry the nearest right-hand row along with a window, one sort per channel.  A
channel's rows lie in one task there.  A hot channel can be split by passing `slot` (a width in units of the order
column): windows then work within slots, and what a slot needs from its neighbours comes from a small table of
each slot's first and last right-hand rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def asof(left: DataFrame, right: DataFrame, by: Sequence[str], on: str, value: str, how: str = "backward", tie: Sequence[str] = (), slot: float | None = None) -> DataFrame:
    """left with `value` of the latest right row at or before (backward), or the earliest at or after (forward).

    tie: right-hand columns that order equal times; the last of them wins backward, the first forward.
    """
    back = how == "backward"
    names = left.columns
    held = F.struct(F.col(on).alias("t"), F.col(value).alias("v"))
    stacked = left.select("*", F.lit(None).cast(right.select(held.alias("h")).schema["h"].dataType).alias("_h"), F.lit(1 if back else 0).alias("_side"), *(F.lit(None).cast(right.schema[t].dataType).alias(f"_t_{t}") for t in tie))
    other = right.select(*by, on, held.alias("_h"), F.lit(0 if back else 1).alias("_side"), *(F.col(t).alias(f"_t_{t}") for t in tie))
    both = stacked.unionByName(other, allowMissingColumns=True)
    order = [on, "_side", *(f"_t_{t}" for t in tie)]
    carry = (F.last if back else F.first)("_h", ignorenulls=True)
    if slot is None:
        w = Window.partitionBy(*by).orderBy(*order)
        frame = w.rowsBetween(Window.unboundedPreceding, 0) if back else w.rowsBetween(0, Window.unboundedFollowing)
        found = both.withColumn("_found", carry.over(frame))
    else:
        place = lambda c: F.floor((c.cast("timestamp").cast("double") if dict(left.dtypes)[on].startswith("timestamp") else c.cast("double")) / slot)
        both = both.withColumn("_slot", place(F.col(on)))
        ends = both.where(F.col("_h").isNotNull()).groupBy(*by, "_slot").agg((F.max_by if back else F.min_by)("_h", F.struct(*order)).alias("_end"))
        slots = both.select(*by, "_slot").distinct().join(ends, [*by, "_slot"], "left")
        s = Window.partitionBy(*by).orderBy("_slot")
        near = slots.select(*by, "_slot", (F.last if back else F.first)("_end", ignorenulls=True).over(s.rowsBetween(Window.unboundedPreceding, -1) if back else s.rowsBetween(1, Window.unboundedFollowing)).alias("_near"))
        w = Window.partitionBy(*by, "_slot").orderBy(*order)
        frame = w.rowsBetween(Window.unboundedPreceding, 0) if back else w.rowsBetween(0, Window.unboundedFollowing)
        found = both.withColumn("_found", carry.over(frame)).join(near, [*by, "_slot"], "left").withColumn("_found", F.coalesce("_found", "_near"))
    return found.where(F.col("_side") == (1 if back else 0)).select(*names, F.col("_found.t").alias(f"{value}_at"), F.col("_found.v").alias(value))


def around(left: DataFrame, right: DataFrame, by: Sequence[str], on: str, value: str, slot: float | None = None) -> DataFrame:
    """left with _before and _after, structs (t, v) of the right rows at or before and at or after each row, by one sort."""
    held = F.struct(F.col(on).alias("t"), F.col(value).alias("v"))
    kind = right.select(held.alias("h")).schema["h"].dataType
    mine = left.select("*", F.lit(None).cast(kind).alias("_h"), F.lit(1).alias("_side"))
    both = mine.unionByName(right.select(*by, on, held.alias("_h"), F.lit(0).alias("_side")), allowMissingColumns=True)
    place = F.floor((F.col(on).cast("timestamp").cast("double") if dict(left.dtypes)[on].startswith("timestamp") else F.col(on).cast("double")) / (slot or 1.0))
    keys = [*by, "_slot"] if slot else list(by)
    both = both.withColumn("_slot", place) if slot else both
    w = Window.partitionBy(*keys).orderBy(on, "_side")
    past, future = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    found = both.withColumns({"_before": F.last("_h", ignorenulls=True).over(past), "_after": F.first("_h", ignorenulls=True).over(future)}).where("_side = 1").drop("_h", "_side")
    if slot:
        rows = both.where(F.col("_h").isNotNull())
        ends = rows.groupBy(*keys).agg(F.max_by("_h", on).alias("_last"), F.min_by("_h", on).alias("_first"))
        slots = both.select(*keys).distinct().join(ends, keys, "left")
        s = Window.partitionBy(*by).orderBy("_slot")
        near = slots.select(*keys, F.last("_last", ignorenulls=True).over(s.rowsBetween(Window.unboundedPreceding, -1)).alias("_low"), F.first("_first", ignorenulls=True).over(s.rowsBetween(1, Window.unboundedFollowing)).alias("_high"))
        found = found.join(near, keys, "left").withColumns({"_before": F.coalesce("_before", "_low"), "_after": F.coalesce("_after", "_high")}).drop("_low", "_high", "_slot")
    # at equal times right rows stand first, so the row before is the one after too
    return found.withColumn("_after", F.when(F.col("_before.t") == F.col(on), F.col("_before")).otherwise(F.col("_after")))


def trigger_distances(df: DataFrame, triggers: DataFrame, by: Sequence[str], on: str, tick_ms: float, slot: float | None = None) -> DataFrame:
    """df with ms since the last trigger, until the next one, and the nearer of both (negative: until the next)."""
    out = around(df, triggers, by, on, on, slot)
    since, until = F.col(on) - F.col("_before.t"), F.col("_after.t") - F.col(on)
    out = out.withColumns({"ms_since": since * tick_ms, "ms_until": until * tick_ms})
    return out.withColumn("ms_nearest", F.when(since < until, F.col("ms_since")).otherwise(-F.col("ms_until"))).drop("_before", "_after")


def asof_nearest(left: DataFrame, right: DataFrame, by: Sequence[str], on: str, value: str, slot: float | None = None) -> DataFrame:
    """left with `value` and its place of the nearest right row; ties go to the earlier one."""
    out = around(left, right, by, on, value, slot)
    earlier = F.col("_after").isNull() | (F.col(on) - F.col("_before.t") <= F.col("_after.t") - F.col(on))
    near = F.when(earlier, F.col("_before")).otherwise(F.col("_after"))
    return out.withColumn("_near", near).select(*left.columns, F.col("_near.t").alias(f"{value}_at"), F.col("_near.v").alias(value))


def monotonic(df: DataFrame, by: Sequence[str], order: Sequence[str], column: str) -> DataFrame:
    """The column as its running maximum."""
    return df.withColumn(column, F.max(column).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))


def unwrapped(x: Column, period, by: Sequence[str], order: Sequence[str]) -> tuple[Column, Column]:
    """(x modulo the period, the step to add at each row): steps of at least half a period are undone.  Their running sum is the correction."""
    m = F.pmod(x, period)
    step = m - F.lag(m).over(Window.partitionBy(*by).orderBy(*order))
    half = period / 2
    near = F.pmod(step + half, period) - half
    near = F.when((near == -half) & (step > 0), half).otherwise(near)
    return m, F.when(step.isNull() | (F.abs(step) < half), F.lit(0)).otherwise(near - step)


def unwrap(df: DataFrame, column: str, period: Column, by: Sequence[str], order: Sequence[str], output: str) -> DataFrame:
    """Undoes jumps by whole periods between successive records."""
    m, step = unwrapped(F.col(column), period, by, order)
    running = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumns({"_m": m, "_s": step}).withColumn(output, F.col("_m") + F.sum("_s").over(running)).drop("_m", "_s")


def quiet_windows(df: DataFrame, by: Sequence[str], on: str, dead: int, length: int, most: int) -> DataFrame:
    """Starts of windows of `length` between records, `dead` after each; the first `most` of each channel."""
    w = Window.partitionBy(*by).orderBy(on)
    gaps = df.select(*by, F.col(on).alias("_t"), F.lead(on).over(w).alias("_n"))
    fit = F.floor((F.col("_n") - F.col("_t") - dead) / length).cast("int")
    starts = gaps.withColumn("_k", fit).where("_k >= 1").select(*by, F.explode(F.transform(F.sequence(F.lit(0), F.col("_k") - 1), lambda k: F.col("_t") + dead + k * length)).alias("start"))
    ranked = starts.withColumn("_rn", F.row_number().over(Window.partitionBy(*by).orderBy("start")))
    return ranked.where(F.col("_rn") <= most).drop("_rn")


def armed_triggers(df: DataFrame, by: Sequence[str], order: Sequence[str], column: str, threshold: float) -> DataFrame:
    """Records that cross the threshold while armed: a crossing disarms, a value below zero arms again.

    A record triggers if it is the first above the threshold since the last one below zero, so two windows do it.
    """
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    epochs = df.withColumn("_epoch", F.sum((F.col(column) < 0).cast("int")).over(w))
    first = Window.partitionBy(*by, "_epoch").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    over = F.col(column) > threshold
    return epochs.withColumn("_n", F.sum(over.cast("int")).over(first)).where(over & (F.col("_n") == 1)).drop("_epoch", "_n")


def concat_states(parts: Sequence[DataFrame]) -> DataFrame:
    """The parts one after the other, numbered in concat_state."""
    out = parts[0].withColumn("concat_state", F.lit(0))
    for k, part in enumerate(parts[1:], 1):
        out = out.unionByName(part.withColumn("concat_state", F.lit(k)))
    return out

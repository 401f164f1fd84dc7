"""Jumps by whole periods in a channel's baseline, undone.

`flux_jumps` takes values by the period and needs a few aggregates a channel.  `unwrap_running` follows the records: each
value depends on the corrected ones before it, so rows are cut into ranges of (channel, order), and a range is followed from
the state that the one before it leaves.  A state is the last few good values, and how many periods each was moved by beyond
the last; what is common to them is a number that adds up from range to range.  At first no range knows the state that it
is entered in.  Ranges whose guess turns out wrong are followed again; the states soon cease to depend on what was
guessed, so mostly one more round is all, and never are there more rounds than ranges.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulseloom.session import shared_folder

STATE, STATE_ARROW = "array<struct<v:double,k:bigint>>", pa.list_(pa.struct([("v", pa.float64()), ("k", pa.int64())]))


def _same(keys: Sequence[str], left: str, right: str) -> Column:
    return reduce(Column.__and__, [F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}")) for c in keys])


def flux_jumps(df: DataFrame, by: Sequence[str], order: Sequence[str], column: str, period: float, output: str, good: Column | None = None) -> DataFrame:
    """df with output: values modulo the period, and moved so that the channel's first one stays; good values only decide where to cut.

    Where the good values then span more than three quarters of a period they lie about a multiple of it, and are cut a quarter
    below instead.  Channels that span less than a period stay as they are.  Null values stay null and count for nothing.
    """
    x, one = F.col(column).cast("double"), float(period)
    cut, lower = lambda v: F.pmod(v, F.lit(one)), lambda v: F.pmod(v + one / 4, F.lit(one)) + 0.75 * one
    kept = F.when(x.isNotNull() & (F.lit(True) if good is None else F.coalesce(good, F.lit(False))), cut(x))
    first = F.min_by(x, F.when(x.isNotNull(), F.struct(*order, x))).alias("_first")
    facts = df.groupBy(*by).agg((F.max(x) - F.min(x)).alias("_range"), F.coalesce(F.max(kept) - F.min(kept), F.lit(0.0)).alias("_span"), first)
    rows = df.alias("l").join(facts.alias("r"), _same(by, "l", "r")).select("l.*", "_range", "_span", "_first")
    moved = lambda v: F.when(F.col("_span") > 0.75 * one, lower(v)).otherwise(cut(v))
    done = F.when(F.col("_range") >= one, moved(x) - moved(F.col("_first")) + F.col("_first")).otherwise(x)
    return rows.withColumn(output, done).drop("_range", "_span", "_first")


def multiples(values: Sequence[float | None], good: Sequence[bool], period: float, n: int, recent: Sequence[tuple[float, int]]) -> tuple[list[int | None], list[tuple[float, int]]]:
    """(periods to take off each value, the last n good values with theirs), entered with `recent`; None for values that are no finite number."""
    recent, out = list(recent), []
    for v, g in zip(values, good, strict=True):
        if v is None or not math.isfinite(v):
            out.append(None)
            continue
        last, near = recent[-1][1] if recent else 0, 0.0
        for a, k in recent:
            near += a - period * (k - last)
        out.append(last + round((v - near / len(recent)) / period) if recent else 0)
        if g:
            recent = [*recent, (v, out[-1])][-n:]
    return out, recent


def unwrap_running(df: DataFrame, by: Sequence[str], order: Sequence[str], column: str, period: float, output: str, n: int = 3, good: Column | None = None, chunks: int | None = None) -> DataFrame:
    """df with output: each value less the periods that take it nearest to the mean of the last n good ones, as corrected.

    Rows before a channel's first good value stay as they are; values that are null or not finite give null and count as bad.
    Rows equal in `order` are followed by value.  Without `chunks` Spark chooses how many ranges to cut by their size.  The cut rows are written to
    the folder in spark.checkpoint.dir, and the result reads them from there.
    """
    keys, of, columns, folder = [*by, "_chunk"], float(period), df.columns, f"{shared_folder(df.sparkSession)}/unwrap-{uuid.uuid4().hex}"

    def stored(rows: DataFrame, name: str) -> DataFrame:
        rows.write.parquet(f"{folder}/{name}")
        return df.sparkSession.read.schema(rows.schema).parquet(f"{folder}/{name}")

    ends = [*by, *(c for c in order if c not in by)]
    cut = df.withColumns({"_x": F.col(column).cast("double"), "_good": F.lit(True) if good is None else F.coalesce(good, F.lit(False))})
    cut = cut.repartitionByRange(chunks, *ends) if chunks else cut.repartitionByRange(*ends)
    rows = stored(cut.withColumn("_chunk", F.spark_partition_id()), "rows")
    brief = rows.select(*dict.fromkeys([*keys, *order]), "_x", "_good")
    sorting = [(c, "ascending") for c in [*order, "_x", "_good"]]

    def followed(part: pa.Table, states: pa.Table | None) -> tuple[pa.Table, list[int | None], list[dict], list[tuple[float, int]] | None]:
        part = part.sort_by(sorting)
        enter = states.column("enter")[0].as_py() if states is not None and states.num_rows else []
        x, fine = part.column("_x").to_pylist(), part.column("_good").to_pylist()
        out, recent = multiples(x, fine, of, n, [(s["v"], s["k"]) for s in enter])
        said = any(g and v is not None for g, v in zip(fine, out, strict=True))
        return part, out, enter, recent if said else None

    def leaving(part: pa.Table, states: pa.Table | None = None) -> pa.Table:
        part, _, enter, recent = followed(part, states)
        last = recent[-1][1] if recent else 0
        left = None if recent is None else [{"v": v, "k": k - last} for v, k in recent]
        found = {"enter": pa.array([enter], STATE_ARROW), "leave": pa.array([left], STATE_ARROW), "periods": pa.array([last], pa.int64())}
        return pa.table({**{c: part.column(c).slice(0, 1) for c in keys}, **found})

    kinds = "".join(f"`{c}` {rows.schema[c].dataType.simpleString()}, " for c in keys)
    schema = f"{kinds}enter {STATE}, leave {STATE}, periods long"
    before = Window.partitionBy(*by).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    entered = F.coalesce(F.last("leave", ignorenulls=True).over(before), F.expr(f"cast(array() as {STATE})"))
    runs, turn = stored(brief.groupBy(*keys).applyInArrow(lambda part: leaving(part), schema), "states-0"), 0
    while True:
        wanted = runs.withColumn("_want", entered).withColumn("_due", ~F.col("_want").eqNullSafe(F.col("enter")))
        due = wanted.where("_due").select(*keys, F.col("_want").alias("enter"))
        if due.isEmpty():
            break
        turn += 1
        again = brief.alias("l").join(due.alias("r"), _same(keys, "l", "r"), "left_semi").groupBy(*keys).cogroup(due.groupBy(*keys)).applyInArrow(leaving, schema)
        runs = stored(wanted.where("not _due").select(runs.columns).unionByName(again), f"states-{turn}")
    placed = runs.select(*keys, "enter", F.coalesce(F.sum("periods").over(before), F.lit(0)).alias("periods"))

    def finish(part: pa.Table, states: pa.Table) -> pa.Table:
        part, out, _, _ = followed(part, states)
        base = states.column("periods")[0].as_py()
        flat = [None if k is None else v - of * (base + k) for v, k in zip(part.column("_x").to_pylist(), out, strict=True)]
        return part.select(columns).append_column(output, pa.array(flat, pa.float64()))

    return rows.groupBy(*keys).cogroup(placed.groupBy(*keys)).applyInArrow(finish, df.select("*").schema.add(output, "double"))

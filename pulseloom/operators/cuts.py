"""Row selections: standing filters, outlier-resistant cuts, heads and tails.

A cut is learned as an aggregate per channel (one row of limits each) and applied by a join on the channel and a
comparison.  The limits table has as many rows as there are channels; Spark broadcasts it if that is small.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulseloom.operators.quantiles import median

SIGMA_PER_MAD = 1.4826


def good(df: DataFrame, good_expr: Column, use_expr: Column | None = None) -> DataFrame:
    """Rows that pass; a null condition doesn't."""
    return df.where(good_expr if use_expr is None else good_expr & use_expr)


def bad(df: DataFrame, good_expr: Column, use_expr: Column | None = None) -> DataFrame:
    """Rows that fail; a null condition neither passes nor fails."""
    return df.where(~good_expr if use_expr is None else ~good_expr & use_expr)


def spread(df: DataFrame, by: Sequence[str], column: str) -> DataFrame:
    """by, med and smad (scaled median absolute deviation) of a column, exact, from aggregates that split large channels."""
    x = F.col(column).cast("double")
    med = median(df, by, x)
    off = df.select(*by, x.alias("_x")).join(med, list(by))
    deviation = median(off, by, F.abs(F.col("_x") - F.col("med")), "_mad")
    return med.join(deviation, list(by)).select(*by, "med", (F.col("_mad") * SIGMA_PER_MAD).alias("smad"))


def _limits(df: DataFrame, by: Sequence[str], column: str, low: Column | None, high: Column, strict: bool) -> DataFrame:
    x = F.col(column).cast("double")
    keep = x < high if strict else x <= high
    return df.join(spread(df, by, column), list(by)).where(keep if low is None else keep & (x >= low)).drop("med", "smad")


def cut_above(df: DataFrame, by: Sequence[str], column: str, n_sigma: float) -> DataFrame:
    """x < median + n_sigma * smad."""
    return _limits(df, by, column, None, F.col("med") + n_sigma * F.col("smad"), True)


def cut_positive(df: DataFrame, by: Sequence[str], column: str, n_sigma: float) -> DataFrame:
    """0 <= x <= median + n_sigma * smad."""
    return _limits(df, by, column, F.lit(0.0), F.col("med") + n_sigma * F.col("smad"), False)


def cut_around(df: DataFrame, by: Sequence[str], column: str, n_sigma: float) -> DataFrame:
    """median - n_sigma * smad <= x <= median + n_sigma * smad."""
    return _limits(df, by, column, F.col("med") - n_sigma * F.col("smad"), F.col("med") + n_sigma * F.col("smad"), False)


def cut_range(df: DataFrame, by: Sequence[str], column: str, down: float, up: float) -> DataFrame:
    """median - down <= x <= median + up."""
    return _limits(df, by, column, F.col("med") - down, F.col("med") + up, False)


def head(df: DataFrame, by: Sequence[str], order: Sequence[str], n: int) -> DataFrame:
    """First n rows of each channel; n < 0: all but the last -n."""
    w = Window.partitionBy(*by)
    if n >= 0:
        return df.withColumn("_rn", F.row_number().over(w.orderBy(*order))).where(F.col("_rn") <= n).drop("_rn")
    return df.withColumn("_rn", F.row_number().over(w.orderBy(*[F.desc(c) for c in order]))).where(F.col("_rn") > -n).drop("_rn")


def tail(df: DataFrame, by: Sequence[str], order: Sequence[str], n: int) -> DataFrame:
    """Last n rows of each channel; n < 0: all but the first -n."""
    w = Window.partitionBy(*by)
    if n >= 0:
        return df.withColumn("_rn", F.row_number().over(w.orderBy(*[F.desc(c) for c in order]))).where(F.col("_rn") <= n).drop("_rn")
    return df.withColumn("_rn", F.row_number().over(w.orderBy(*order))).where(F.col("_rn") > -n).drop("_rn")


def every_nth(df: DataFrame, by: Sequence[str], order: Sequence[str], n: int, skip: int = 0) -> DataFrame:
    """Rows skip, skip + n, ... of each channel."""
    row = F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1
    return df.withColumn("_rn", row).where((F.col("_rn") >= skip) & ((F.col("_rn") - skip) % n == 0)).drop("_rn")


def sample(df: DataFrame, by: Sequence[str], n: int, seed: int) -> DataFrame:
    """n rows of each channel, drawn without replacement."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*by).orderBy(F.rand(seed)))).where(F.col("_rn") <= n).drop("_rn")


def without(df: DataFrame, channels: DataFrame, by: Sequence[str]) -> DataFrame:
    """Rows of channels that are not listed."""
    return df.join(channels.select(*by), list(by), "left_anti")


def among(df: DataFrame, channels: DataFrame, by: Sequence[str]) -> DataFrame:
    """Rows of channels that are listed."""
    return df.join(channels.select(*by), list(by), "left_semi")

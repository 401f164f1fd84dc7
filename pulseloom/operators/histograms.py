"""Histograms over uniform bins, as grouped counts; empty bins are listed with 0."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bin_of(x: Column, low: float, step: float, n: int, right_closed: bool = True) -> Column:
    """Bin number 0 .. n - 1, null outside.  Right-closed bins (the first holds low too), or left-closed (the last holds the top too)."""
    at = (x.cast("double") - low) / step
    k = F.when(at == 0, 0).otherwise(F.ceil(at) - 1) if right_closed else F.when(at == n, n - 1).otherwise(F.floor(at))
    return F.when((at >= 0) & (at <= n), k.cast("int"))


def label_of(k: Column, low: float, step: float, upper_edge: bool = True) -> Column:
    """What names a bin: its upper edge, or its centre."""
    return low + (k + (1.0 if upper_edge else 0.5)) * step


def histogram(df: DataFrame, column: str, low: float, step: float, n: int, by: Sequence[str] = (), right_closed: bool = True, upper_edge: bool = True) -> DataFrame:
    """by, bin, label, n_rows of every bin of every group."""
    at = F.coalesce(bin_of(F.col(column), low, step, n, right_closed), F.lit(-1))  # a group without rows in range is listed too
    counted = df.groupBy(*by, at.alias("bin")).agg(F.count("*").alias("n_rows"))
    listed = counted.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("bin", "n_rows"))).alias("_n"))
    bins = listed.select(*by, "_n", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("bin"))
    return bins.select(*by, "bin", label_of(F.col("bin"), low, step, upper_edge).alias("label"), F.coalesce(F.try_element_at("_n", F.col("bin")), F.lit(0)).cast("long").alias("n_rows"))


def entropy(df: DataFrame, column: str, low: float, step: float, n: int, by: Sequence[str]) -> DataFrame:
    """Shannon entropy (nats) of each group's histogram."""
    h = histogram(df, column, low, step, n, by).where("n_rows > 0")
    totals = h.groupBy(*by).agg(F.sum("n_rows").alias("total"), F.sum(F.col("n_rows") * F.log("n_rows")).alias("s"))
    return totals.select(*by, (F.log("total") - F.col("s") / F.col("total")).alias("entropy"))


def local_maxima(hist: DataFrame, by: Sequence[str], least: int = 1) -> DataFrame:
    """Bins higher than both neighbours."""
    from pyspark.sql import Window

    w = Window.partitionBy(*by).orderBy("bin")
    sides = hist.withColumns({"_l": F.lag("n_rows").over(w), "_r": F.lead("n_rows").over(w)})
    return sides.where((F.col("n_rows") > F.col("_l")) & (F.col("n_rows") > F.col("_r")) & (F.col("n_rows") >= least)).drop("_l", "_r")

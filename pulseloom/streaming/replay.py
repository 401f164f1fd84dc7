"""Recipes and counts over streams of records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulseloom.operators.histograms import bin_of
from pulseloom.plans.recipe import Recipe


def replay(stream: DataFrame, recipe: Recipe) -> DataFrame:
    """A recipe on a stream: its parameters are static tables, so each step is a stream-static join and columns."""
    return recipe.replay(stream)


def windowed_histogram(stream: DataFrame, time: str, column: str, low: float, step: float, n: int, window: str, late: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Counts by time window, channel and bin; rows later than `late` are left out."""
    timed = stream.withColumn("_t", F.col(time).cast("timestamp")).withWatermark("_t", late).withColumn("bin", bin_of(F.col(column), low, step, n)).where("bin is not null")
    counts = timed.groupBy(F.window("_t", window).alias("_w"), *by, "bin").agg(F.count("*").alias("n_rows"))
    return counts.select(F.col("_w.start").alias("since"), *by, "bin", "n_rows")

"""Recipes: ordered steps that learn parameters per channel and then add columns, recorded so as to be replayed.

A step names its inputs and outputs, learns a table of parameters (one row a channel) from the rows that pass the
standing filter, and applies it by a join on the channel and column expressions.  Conditions and expressions are
SQL text, so a recipe is plain JSON beside its parameter tables, and the same recipe runs on batch or streaming input.
Columns that exist already stay as they are when a step is applied again.

A step may instead name one of OPERATIONS with its arguments: record summary, filter, drift correction, gain
calibration, categories, or jump repair.  Those are recorded, saved, trimmed and replayed like any other.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pulseloom.functions import pulses as P
from pulseloom.operators import filters, learning, temporal

#: What a step may learn about a column, as SQL aggregates.
LEARNS = {"median": "median({0})", "mean": "avg({0})", "low": "min({0})", "high": "max({0})", "count": "count({0})"}


@dataclass(frozen=True)
class Operation:
    """learn(df, by, args): parameters, one row a channel; make(df, by, args): df, joined with these, with the new columns."""

    make: Callable[[DataFrame, Sequence[str], dict], DataFrame]
    learn: Callable[[DataFrame, Sequence[str], dict], DataFrame] | None = None


def _filters(df: DataFrame, by: Sequence[str], a: dict) -> DataFrame:
    """Optimal filters from good records, and noise from the records for which a["noise"] holds."""
    return learning.optimal_filters(df.where(f"not ({a['noise']})"), df.where(a["noise"]), by, a["pulse"], a["pre"])


def _of_kind(kind: str) -> Operation:
    """A step that learns filters of one kind and applies them; args as filter_table takes them, with noise as a condition."""

    def learn(df: DataFrame, by: Sequence[str], a: dict) -> DataFrame:
        more = {k: v for k, v in a.items() if k in ("dt", "f_max", "f_3db", "cut_pre", "cut_post", "decays", "blind") and (kind == "noexp" or k not in ("decays", "blind"))}
        made = filters.filter_table(df.where(f"not ({a['noise']})"), df.where(a["noise"]), by, a["pulse"], a["pre"], [kind], **more)
        return made.select(*by, "weights", "arrival_weights")

    def make(df: DataFrame, by: Sequence[str], a: dict) -> DataFrame:
        x, w = F.col(a["pulse"]), F.col("weights")
        if kind in ("one_lag", "arrival"):
            height = filters.dot(x, w)
            found = F.struct(height.alias("height"), F.try_divide(filters.dot(x, F.col("arrival_weights")), height).alias("place"))
        else:
            found = filters.five_lag(x, w)
        return df.withColumn("_y", found).withColumns({a["output"]: F.col("_y.height"), a["place"]: F.col("_y.place")}).drop("_y")

    return Operation(make, learn)


def _summarized(df: DataFrame, by: Sequence[str], a: dict) -> DataFrame:
    found: dict[str, Column] = P.summary(F.col(a["pulse"]), a["pre"], a.get("ignore", 0))
    return df.withColumns({name: found[quantity] for name, quantity in a["columns"].items()})


#: Operations by name, with the arguments each takes.
OPERATIONS = {
    # pulse, pre, ignore; columns: output -> quantity
    "summary": Operation(_summarized),
    # pulse, pre, noise (condition), output
    "filter": Operation(lambda df, by, a: df.withColumn(a["output"], learning.filter_value(a["pulse"])), _filters),
    # pulse, pre, noise (condition), output, place, and filter_table's options
    **{f"filter_{kind}": _of_kind(kind) for kind in filters.KINDS},
    # height, indicator, output
    "drift": Operation(lambda df, by, a: df.withColumn(a["output"], P.drift_corrected(F.col(a["height"]), F.col(a["indicator"]), F.col("slope"), F.col("offset"))), lambda df, by, a: learning.drift_slope(df, by, a["height"], a["indicator"])),
    # height, a, b, c, output
    "gain": Operation(lambda df, by, a: df.withColumn(a["output"], P.quadratic_gain_energy(F.col(a["height"]), a["a"], a["b"], a["c"]))),
    # conditions: name -> SQL; output
    "categorize": Operation(lambda df, by, a: df.withColumn(a["output"], P.categorize({k: F.expr(v) for k, v in a["conditions"].items()}))),
    # column, period, order, output
    "unwrap": Operation(lambda df, by, a: temporal.unwrap(df, a["column"], F.lit(a["period"]), by, a["order"], a["output"])),
}


@dataclass(frozen=True)
class Step:
    """outputs: name -> SQL expression over inputs and learned names; learns: name -> (kind, column); or an operation and its args."""

    outputs: dict[str, str]
    inputs: tuple[str, ...]
    learns: dict[str, tuple[str, str]] = field(default_factory=dict)
    good: str = "true"
    use: str = "true"
    operation: str = ""
    args: dict = field(default_factory=dict)

    @classmethod
    def named(cls, operation: str, inputs: Sequence[str], outputs: Sequence[str], use: str = "true", **args) -> Step:
        """A step that runs one of OPERATIONS."""
        if operation not in OPERATIONS:
            raise ValueError(f"no operation {operation}")
        return cls(dict.fromkeys(outputs, operation), tuple(inputs), use=use, operation=operation, args=args)

    @property
    def has_params(self) -> bool:
        return bool(self.learns) or bool(self.operation and OPERATIONS[self.operation].learn)

    def learn(self, df: DataFrame, by: Sequence[str]) -> DataFrame | None:
        if self.operation:
            learn = OPERATIONS[self.operation].learn
            return learn(df.where(f"({self.good}) and ({self.use})"), by, self.args) if learn else None
        if not self.learns:
            return None
        return df.where(f"({self.good}) and ({self.use})").groupBy(*by).agg(*(F.expr(LEARNS[kind].format(column)).alias(name) for name, (kind, column) in self.learns.items()))

    def apply(self, df: DataFrame, by: Sequence[str], params: DataFrame | None = None) -> DataFrame:
        new = {name: None if self.operation else F.expr(e) for name, e in self.outputs.items() if name not in df.columns}
        if not new:
            return df
        if self.operation:
            joined = df if params is None else df.join(params, list(by), "left")
            made = OPERATIONS[self.operation].make(joined, by, self.args)
            return made.select(*df.columns, *self.outputs)
        if params is not None:
            df = df.join(params, list(by), "left")
        return df.withColumns(new).drop(*self.learns)


@dataclass(frozen=True)
class Recipe:
    by: tuple[str, ...]
    steps: tuple[Step, ...] = ()
    params: tuple[DataFrame | None, ...] = ()

    def then(self, df: DataFrame, step: Step) -> tuple[DataFrame, Recipe]:
        """df with the step learned and applied, and the longer recipe."""
        learned = step.learn(df, self.by)
        return step.apply(df, self.by, learned), replace(self, steps=(*self.steps, step), params=(*self.params, learned))

    def replay(self, df: DataFrame) -> DataFrame:
        """All steps on new data, with the parameters learned before."""
        for step, params in zip(self.steps, self.params, strict=True):
            df = step.apply(df, self.by, params)
        return df

    def trimmed(self, required: Sequence[str]) -> Recipe:
        """Without steps that nothing required depends on."""
        need, kept = set(required), []
        for k in range(len(self.steps) - 1, -1, -1):
            step = self.steps[k]
            if need & set(step.outputs):
                kept.append(k)
                need |= set(step.inputs) | {column for _, column in step.learns.values()}
        if not kept:
            raise ValueError("no step makes any of the required columns")
        kept = kept[::-1]
        return replace(self, steps=tuple(self.steps[k] for k in kept), params=tuple(self.params[k] for k in kept))

    def save(self, path: str, overwrite: bool = False) -> None:
        """Writes step definitions and parameter tables under a folder, through Spark."""
        mode = "overwrite" if overwrite else "errorifexists"
        spark = SparkSession.active()
        text = json.dumps({"by": self.by, "steps": [asdict(s) for s in self.steps]})
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode(mode).text(f"{path}/recipe")
        for k, params in enumerate(self.params):
            if params is not None:
                params.write.mode(mode).parquet(f"{path}/params-{k}")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Recipe:
        raw = json.loads(spark.read.text(f"{path}/recipe").first()[0])
        steps = tuple(Step(s["outputs"], tuple(s["inputs"]), {k: tuple(v) for k, v in s["learns"].items()}, s["good"], s["use"], s.get("operation", ""), s.get("args", {})) for s in raw["steps"])
        return cls(tuple(raw["by"]), steps, tuple(spark.read.parquet(f"{path}/params-{k}") if s.has_params else None for k, s in enumerate(steps)))

"""Channels: one long table keyed by channel, with a standing filter, bad channels and a recipe."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulseloom.plans.recipe import Recipe, Step

BAD = "error string, message string"
#: Folders that write_by_channel deals channels to.
FOLDERS = 64


@dataclass(frozen=True)
class Channels:
    """Immutable; every method returns a new value over a lazy plan."""

    df: DataFrame
    key: str = "ch_num"
    good_expr: str = "true"
    recipe: Recipe | None = None
    bad: DataFrame | None = None
    noise: DataFrame | None = None

    @classmethod
    def from_folder(cls, spark: SparkSession, pulses: str, noise: str | None = None, include: list[int] | None = None, exclude: list[int] | None = None, limit: int | None = None, **options: str) -> Channels:
        """Channels of the pulse files of a folder; with a noise folder those that both have, and their noise records beside them.

        options: of the data source, e.g. max_pulses or pulses="false".
        """
        from pulseloom.sources import pulse_source as S

        S.register(spark)
        if noise is None:
            files = S.find_files(spark, pulses, include=include, exclude=exclude).select("ch_num")
            chosen = files.orderBy("ch_num").limit(limit) if limit is not None else files
        else:
            chosen = S.pair_files(spark, pulses, noise, include=include, exclude=exclude, limit=limit).select("ch_num")
        numbers = sorted(r.ch_num for r in chosen.distinct().collect())  # channel numbers, as many as there are sensors

        def records(folder: str) -> DataFrame:
            read = spark.read.format("pulses").options(path=folder, include=",".join(map(str, numbers)), **options)
            return read.load() if numbers else read.load().limit(0)

        return cls(records(pulses), noise=None if noise is None else records(noise))

    @classmethod
    def from_pairs(cls, spark: SparkSession, pairs: Sequence[tuple[str, str]], **options: str) -> Channels:
        """Channels of (pulse file, noise file) pairs; a noise path may be empty, and a channel may have one pair only."""
        from pulseloom.sources import pulse_source as S

        S.register(spark)

        def records(paths: list[str]) -> DataFrame | None:
            out = None
            for path in paths:
                one = spark.read.format("pulses").options(path=path, **options).load()
                out = one if out is None else out.unionByName(one)
            return out

        pulses, noise = records([p for p, _ in pairs]), records([n for _, n in pairs if n])
        if pulses is None:
            raise ValueError("there are no pairs")
        twice = pulses.groupBy("ch_num").agg(F.countDistinct("path").alias("n")).where("n > 1").first()
        if twice:
            raise ValueError(f"channel {twice['ch_num']} has {twice['n']} pulse files")
        return cls(pulses, noise=noise)

    def with_good_expr(self, condition: str, replace_old: bool = False) -> Channels:
        return replace(self, good_expr=condition if replace_old or self.good_expr == "true" else f"({self.good_expr}) and ({condition})")

    def with_columns(self, **columns: str) -> Channels:
        return replace(self, df=self.df.withColumns({k: F.expr(v) for k, v in columns.items()}))

    def with_step(self, step: Step) -> Channels:
        df, recipe = (self.recipe or Recipe((self.key,))).then(self.df, replace(step, good=self.good_expr))
        return replace(self, df=df, recipe=recipe)

    def replay(self, recipe: Recipe) -> Channels:
        """A recipe learned elsewhere; its last filter stands from then on."""
        return replace(self, df=recipe.replay(self.df), recipe=recipe, good_expr=recipe.steps[-1].good if recipe.steps else self.good_expr)

    def set_bad(self, channels: Sequence[int], message: str) -> Channels:
        more = self.df.sparkSession.createDataFrame([(int(c), "set_bad", message) for c in channels], f"{self.key} long, {BAD}")
        return replace(self, bad=more if self.bad is None else self.bad.unionByName(more))

    def all_good(self, exclude: Sequence[str] = ("pulse",)) -> DataFrame:
        """Good rows of all channels that aren't bad."""
        df = self.df if self.bad is None else self.df.join(self.bad.select(self.key).distinct(), self.key, "left_anti")
        return df.where(self.good_expr).drop(*exclude)

    def map(self, f: Callable, schema: str) -> tuple[DataFrame, DataFrame]:
        """f on every channel's rows (pandas in and out), and a table of channels in which it failed.

        A failure marks its channel and leaves the others alone.  A channel's rows go to one task.
        """
        import pandas as pd

        key, names = self.key, [c.strip().split()[0] for c in schema.split(",")]

        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            try:
                out = f(pdf).assign(error=None, message=None)
            except Exception as e:  # noqa: BLE001
                out = pd.DataFrame({n: [None] for n in names}).assign(error=type(e).__name__, message=str(e))
            return out.assign(**{key: pdf[key].iloc[0]})[[key, *[n for n in names if n != key], "error", "message"]]

        kind = self.df.schema[key].dataType.simpleString()
        rest = ", ".join(c for c in schema.split(",") if c.strip().split()[0] != key)
        done = self.all_good(()).groupBy(key).applyInPandas(run, f"{key} {kind}, {rest}, {BAD}")
        return done.where("error is null").drop("error", "message"), done.where("error is not null").select(key, "error", "message")

    def concat(self, other: Channels) -> Channels:
        """Channels that both have, numbered in concat_state."""
        mine, theirs = (a.df.join(b.df.select(self.key).distinct(), self.key, "left_semi") for a, b in ((self, other), (other, self)))
        state = F.coalesce(F.col("concat_state"), F.lit(0)) if "concat_state" in mine.columns else F.lit(0)
        mine = mine.withColumn("concat_state", state)
        last = mine.agg(F.max("concat_state")).first()[0] or 0
        return replace(self, df=mine.unionByName(theirs.drop("concat_state").withColumn("concat_state", F.lit(last + 1))), recipe=None)

    def with_more_channels(self, other: Channels) -> Channels:
        """Other channels besides these; of a channel that both have, the other's rows, noise and mark as bad take the place of these.

        The standing filter and the recipe stay.
        """
        newer = other.df.select(F.col(other.key).alias(self.key)).distinct()

        def merged(mine: DataFrame | None, more: DataFrame | None) -> DataFrame | None:
            old = None if mine is None else mine.join(newer, self.key, "left_anti")
            more = None if more is None else more.withColumnRenamed(other.key, self.key)
            return more if old is None else old if more is None else old.unionByName(more, allowMissingColumns=True)

        return replace(self, df=merged(self.df, other.df), bad=merged(self.bad, other.bad), noise=merged(self.noise, other.noise))

    def with_mapped(self, column: str, f: Callable, output: str, kind: str = "double") -> Channels:
        """A column that f makes of another, a batch of records at a time: f gets an array, of rows and samples if the column
        holds arrays of one length, and returns as many values or rows.  Nulls are left out of what f gets, and stay null.
        """
        return replace(self, df=mapped(self.df, column, f, output, kind))

    def save(self, path: str, overwrite: bool = False) -> None:
        """Rows without pulses, partitioned by channel; the filter, bad channels and recipe beside them."""
        mode = "overwrite" if overwrite else "errorifexists"
        self.df.drop("pulse").write.mode(mode).partitionBy(self.key).parquet(f"{path}/rows")
        spark = self.df.sparkSession
        facts = spark.createDataFrame([(self.key, self.df.schema[self.key].dataType.simpleString(), self.good_expr, self.recipe is not None)], "key string, kind string, good string, recipe boolean")
        facts.coalesce(1).write.mode(mode).json(f"{path}/channels")
        bad = self.bad if self.bad is not None else spark.createDataFrame([], f"{self.key} long, {BAD}")
        bad.coalesce(1).write.mode(mode).parquet(f"{path}/bad")
        if self.recipe:
            self.recipe.save(f"{path}/recipe", overwrite)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Channels:
        """What save() wrote."""
        facts = spark.read.json(f"{path}/channels").first()
        rows = spark.read.parquet(f"{path}/rows")
        bad = spark.read.parquet(f"{path}/bad")
        return cls(rows.withColumn(facts.key, F.col(facts.key).cast(facts.kind)), facts.key, facts.good, Recipe.load(spark, f"{path}/recipe") if facts.recipe else None, None if bad.isEmpty() else bad)


def write_by_channel(df: DataFrame, key: str, path: str, folders: int = FOLDERS) -> None:
    """Rows as Parquet, each channel whole in one of `folders` folders (channel_folder), in ascending order in each file.

    Files go with the bytes of rows and not with the number of channels, as a folder for each channel would; a filter on the
    channel skips row groups by their bounds.  A folder that holds most rows is split into several files.
    """
    dealt = df.withColumn("channel_folder", F.pmod(F.xxhash64(key), F.lit(folders)).cast("int"))
    dealt.hint("rebalance", "channel_folder").sortWithinPartitions("channel_folder", key).write.partitionBy("channel_folder").parquet(path)


def mapped(df: DataFrame, column: str, f: Callable, output: str, kind: str = "double") -> DataFrame:
    """See Channels.with_mapped."""
    import numpy as np
    import pandas as pd

    def run(x: pd.Series) -> pd.Series:
        some = np.flatnonzero(x.notna())
        out: list = [None] * len(x)
        if len(some):
            kept = x.iloc[some]
            found = f(np.stack(kept.to_list()) if isinstance(kept.iloc[0], (list, np.ndarray)) else kept.to_numpy())
            if len(found) != len(kept):
                raise ValueError(f"{len(found)} results for {len(kept)} records")
            for k, value in zip(some.tolist(), found, strict=True):
                out[k] = value
        return pd.Series(out, index=x.index)

    run.__annotations__ = {"x": pd.Series, "return": pd.Series}
    return df.withColumn(output, F.pandas_udf(run, kind)(F.col(column)))


def combined(named: dict[str, DataFrame], label: str = "source", same: Sequence[str] = ()) -> DataFrame:
    """Tables one under the other, with a column that says which is which.

    same: columns, like the number of samples or the sample time, that must have one value in all of them.
    """
    for column in same:
        values = {name: sorted(map(str, (r[0] for r in df.select(column).distinct().limit(2).collect()))) for name, df in named.items()}
        if len({v for vs in values.values() for v in vs}) > 1:
            raise ValueError(f"{column} differs: {values}")
    parts = [df.withColumn(label, F.lit(name)) for name, df in named.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out

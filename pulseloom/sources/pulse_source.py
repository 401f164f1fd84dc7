"""Pulse files as a Spark data source: files read in parts, and growing files read as streams.

    register(spark)
    spark.read.format("pulses").option("path", folder).load()
    spark.readStream.format("pulses").option("path", folder).load()

A part is a range of records of one file, so a file's size has no bound and a channel's records are read by as many tasks as
they fill.  A stream's offset is the number of whole records of every file; a record that is still being written waits, and
files that appear later are taken up.  Filters on ch_num and row_idx choose files and parts before anything is read, where the
session has spark.sql.python.filterPushdown.enabled.

Paths are local or of any store that Arrow's file systems reach (s3, gs, hdfs, abfs); all executors must reach them.

Options: path (a file or folder), suffix (".ljh"), recursive, include and exclude (channel numbers, with commas), first_pulse and
max_pulses (of every file), pulses ("false" leaves samples out), posix_usec ("true" adds the raw time in microseconds), records
(of a part; by default what fills PART bytes).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from pulseloom.functions import pulses as P
from pulseloom.sources.pulse_files import BATCH, LJH_SCHEMA, ljh_batch, ljh_header, ljh_layout

#: Bytes of a part, about, and of what is read at a time.
PART, READ = 64 << 20, 8 << 20
#: Bytes in which a header must end.
HEAD = 1 << 16
#: Files whose headers are read at the same time.
AT_ONCE = 16


def _place(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    if path.startswith("file:"):
        return pyarrow.fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return pyarrow.fs.FileSystem.from_uri(path) if "://" in path else (pyarrow.fs.LocalFileSystem(), path)


def _numbers(text: str) -> set[int]:
    return {int(x) for x in text.split(",") if x.strip()}


def _channel(path: str) -> int | None:
    found = re.search(r"_chan(\d+)\.[^/]*$", path)
    return int(found[1]) if found else None


@dataclass(frozen=True)
class _File:
    path: str
    size: int
    head: int
    dtype: np.dtype
    facts: tuple[tuple[str, object], ...]

    @property
    def records(self) -> int:
        return (self.size - self.head) // self.dtype.itemsize

    @property
    def channel(self) -> int:
        return dict(self.facts)["channel"]


@dataclass
class _Part(InputPartition):
    file: _File
    low: int
    high: int


class _Files:
    """The files that the options name."""

    def __init__(self, options):
        if not options.get("path"):
            raise ValueError("the option path must name a file or folder")
        self.path, self.suffix = options["path"], options.get("suffix", ".ljh")
        self.recursive = options.get("recursive", "false").lower() == "true"
        self.include, self.exclude = _numbers(options.get("include", "")), _numbers(options.get("exclude", ""))
        if both := self.include & self.exclude:
            raise ValueError(f"channels {sorted(both)} are both included and excluded")
        self.first, self.most = int(options.get("first_pulse", "0")), int(options["max_pulses"]) if options.get("max_pulses") else None
        self.pulses, self.usec = options.get("pulses", "true").lower() == "true", options.get("posix_usec", "false").lower() == "true"
        self.step = int(options.get("records", "0"))
        self.known: dict[str, _File] = {}

    def _header(self, info: pyarrow.fs.FileInfo) -> _File | None:
        if old := self.known.get(info.path):
            return _File(old.path, info.size, old.head, old.dtype, old.facts)
        store, _ = _place(self.path)
        try:
            with store.open_input_file(info.path) as f:
                fields, head = ljh_header(f.read(HEAD))
            dtype, facts = ljh_layout(fields)
        except ValueError as e:
            raise ValueError(f"{info.path}: {e}") from e
        self.known[info.path] = file = _File(info.path, info.size, head, dtype, tuple(facts.items()))
        return file

    def list(self, growing: bool = False) -> list[_File]:
        """growing: files too short to hold their header are left for later."""
        store, path = _place(self.path)
        info = store.get_file_info(path)
        if info.type == pyarrow.fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        infos = [info] if info.is_file else [i for i in store.get_file_info(pyarrow.fs.FileSelector(path, recursive=self.recursive)) if i.is_file and i.path.endswith(self.suffix)]
        wanted = [i for i in infos if (not self.include or _channel(i.path) in self.include) and _channel(i.path) not in self.exclude]

        def header(i: pyarrow.fs.FileInfo) -> _File | None:
            try:
                return self._header(i)
            except ValueError:
                if growing and i.size < HEAD:
                    return None
                raise

        with ThreadPoolExecutor(AT_ONCE) as pool:
            return [f for f in pool.map(header, sorted(wanted, key=lambda i: i.path)) if f]

    def parts(self, file: _File, low: int, high: int) -> list[_Part]:
        high = min(high, file.records) if self.most is None else min(high, file.records, self.first + self.most)
        step = self.step or max(1, PART // file.dtype.itemsize)
        return [_Part(file, k, min(k + step, high)) for k in range(max(low, self.first), high, step)]

    def read(self, part: _Part) -> Iterator[pa.RecordBatch]:
        file, facts = part.file, dict(part.file.facts)
        store, _ = _place(self.path)
        size = file.dtype.itemsize
        at_once = max(1, min(BATCH, READ // size))
        with store.open_input_file(file.path) as f:
            for low in range(part.low, part.high, at_once):
                n = min(at_once, part.high - low)
                raw = f.read_at(n * size, file.head + low * size)
                if len(raw) < n * size:
                    raise OSError(f"{file.path} has become shorter while it was read")
                batch = ljh_batch(file.path, np.frombuffer(raw, file.dtype), low, facts, self.pulses)
                if not self.pulses:
                    batch = batch.drop_columns(["pulse"])
                yield batch.append_column("posix_usec", batch.column("timestamp").cast(pa.int64())) if self.usec else batch


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.files = _Files(options)
        self.filters: list[Filter] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Filters on whole numbers choose files and parts; Spark applies all of them again."""
        for f in filters:
            if getattr(f, "attribute", None) in (("ch_num",), ("row_idx",)):
                self.filters.append(f)
            yield f

    def partitions(self) -> list[_Part]:
        parts = []
        for file in self.files.list():
            low, high, here = 0, file.records, True
            for f in self.filters:
                if f.attribute == ("ch_num",):
                    here &= {EqualTo: lambda f, c: c == f.value, In: lambda f, c: c in f.value}.get(type(f), lambda *_: True)(f, file.channel)
                elif isinstance(f, EqualTo):
                    low, high = max(low, f.value), min(high, f.value + 1)
                elif isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                    low = max(low, f.value + isinstance(f, GreaterThan))
                elif isinstance(f, (LessThan, LessThanOrEqual)):
                    high = min(high, f.value + isinstance(f, LessThanOrEqual))
            parts += self.files.parts(file, low, high) if here else []
        return parts

    def read(self, partition: _Part | None) -> Iterator[pa.RecordBatch]:
        # without parts Spark asks for one read of none
        return self.files.read(partition) if isinstance(partition, _Part) else iter(())


class _StreamReader(DataSourceStreamReader):
    def __init__(self, options):
        self.files = _Files(options)

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return {f.path: f.records for f in self.files.list(growing=True)}

    def partitions(self, start: dict, end: dict) -> list[_Part]:
        now = {f.path: f for f in self.files.list(growing=True)}
        return [p for path, n in end.items() if path in now for p in self.files.parts(now[path], start.get(path, 0), n)]

    def read(self, partition: _Part) -> Iterator[pa.RecordBatch]:
        return self.files.read(partition)


class PulseSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "pulses"

    def schema(self) -> str:
        files = _Files(self.options)
        return (LJH_SCHEMA if files.pulses else LJH_SCHEMA.replace(", pulse array<int>", "")) + (", posix_usec long" if files.usec else "")

    def reader(self, schema) -> _Reader:
        return _Reader(self.options)

    def streamReader(self, schema) -> _StreamReader:
        return _StreamReader(self.options)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PulseSource)


def find_files(spark: SparkSession, folder: str, suffix: str = ".ljh", recursive: bool = False, include: list[int] | None = None, exclude: list[int] | None = None) -> DataFrame:
    """path, ch_num of the files of a folder whose names tell a channel; Spark lists them, contents stay unread."""
    if both := set(include or ()) & set(exclude or ()):
        raise ValueError(f"channels {sorted(both)} are both included and excluded")
    found = spark.read.format("binaryFile").option("pathGlobFilter", f"*{suffix}").option("recursiveFileLookup", str(recursive).lower()).load(folder)
    named = found.select("path", P.channel_number(F.col("path")).alias("ch_num")).where("ch_num is not null")
    if include is not None:
        named = named.where(F.col("ch_num").isin(list(include)))
    return named.where(~F.col("ch_num").isin(list(exclude))) if exclude else named


def pair_files(spark: SparkSession, pulses: str, noise: str, suffix: str = ".ljh", include: list[int] | None = None, exclude: list[int] | None = None, limit: int | None = None) -> DataFrame:
    """ch_num, pulse_path, noise_path of the channels that both folders have, the first `limit` of them.

    A channel with two files in one folder is an error.
    """
    sides = {}
    for side, folder in (("pulse", pulses), ("noise", noise)):
        files = find_files(spark, folder, suffix, False, include, exclude)
        if twice := files.groupBy("ch_num").count().where("count > 1").first():
            raise ValueError(f"channel {twice['ch_num']} has {twice['count']} files in {folder}")
        sides[side] = files.withColumnRenamed("path", f"{side}_path")
    pairs = sides["pulse"].join(sides["noise"], "ch_num")
    return pairs if limit is None else pairs.orderBy("ch_num").limit(limit)


def sibling(path: Column, ending: str) -> Column:
    """The file beside a channel's file that belongs to its run: ending is "experiment_state.txt" or "external_trigger.bin"."""
    return F.regexp_replace(path, r"_chan[^/]*$", f"_{ending}")

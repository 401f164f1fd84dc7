"""Readers of pulse files as DataFrames, through Spark's binaryFile source, so from any store that Spark reads.

Whole files are rows of that source, which limits one file to 2 GB; larger ones must be split where they are taken.
Records are decoded with numpy in the task that holds the file, and go out in batches.  A last record that is cut
off is left out.  Files that can't be read as what they should be raise an error that names them.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BATCH = 2048
#: Record layouts of the format's versions, before the samples.
LJH_HEADS = {
    "2.2.0": [("subframecount", "<i8"), ("posix_usec", "<i8")],
    "2.1.0": [("us4", "u1"), ("unused", "u1"), ("ms", "<u4")],
    "2.0.0": [("unused", "<u2"), ("ms", "<u4")],
}
LJH_SCHEMA = "path string, ch_num long, row_idx long, timestamp timestamp, subframecount long, pulse array<int>"
HEADER_SCHEMA = "path string, ch_num long, version string, timebase double, n_samples int, n_presamples int, subframediv int, attrs map<string,string>"


#: Writers whose files count presamples right have this in their version; other files have three more.
EXACT_PRESAMPLES, MORE_PRESAMPLES = "DASTARD", 3


def ljh_header(raw: bytes) -> tuple[dict[str, str], int]:
    """(fields, bytes of the header); lines are "name: value" up to the end mark."""
    fields, at = {}, 0
    for _ in range(100):
        end = raw.find(b"\n", at)
        if end < 0:
            break
        line, at = raw[at:end].decode("latin-1").strip(), end + 1
        if line.lower() == "#end of header":
            return fields, at
        name, colon, value = line.partition(":")
        if colon:
            fields.setdefault(name.strip(), value.strip())
    raise ValueError("the header has no end mark")


def _number(fields: dict[str, str], name: str, default: float = -1) -> float:
    try:
        return float(fields[name])
    except (KeyError, ValueError):
        return default


def ljh_layout(fields: dict[str, str]) -> tuple[np.dtype, dict]:
    """Record dtype, and version, samples, presamples and so on."""
    version = fields.get("Save File Format Version", "2.0.0")
    parts = tuple(int(x) for x in version.split(".")[:2])
    if parts < (2, 0):
        raise ValueError(f"version {version} can't be read")
    n = int(_number(fields, "Total Samples"))
    kind = "2.2.0" if parts >= (2, 2) else "2.1.0" if parts == (2, 1) else "2.0.0"
    pre = int(_number(fields, "Presamples"))
    if EXACT_PRESAMPLES not in fields.get("Software Version", ""):
        pre += MORE_PRESAMPLES
    div = int(_number(fields, "Subframe divisions"))
    if div < 0:
        div = int(_number(fields, "Number of rows"))
    facts = {"version": version, "timebase": _number(fields, "Timebase"), "n_samples": n, "n_presamples": pre, "subframediv": div, "channel": int(_number(fields, "Channel")), "offset": _number(fields, "Timestamp offset (s)", 0.0)}
    return np.dtype([*LJH_HEADS[kind], ("pulse", "<u2", (n,))]), facts


def _files(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content")


def _per_file(files: DataFrame, decode, schema: str) -> DataFrame:
    def run(batches):
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                try:
                    yield from decode(path, content.as_buffer())
                except Exception as e:
                    raise ValueError(f"{path}: {e}") from e

    return files.mapInArrow(run, schema)


def _lists(x: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(np.ascontiguousarray(x).ravel(), kind))


def ljh_batch(path: str, r: np.ndarray, first: int, facts: dict, keep_pulses: bool) -> pa.RecordBatch:
    """Records of one file, the first of them being number `first`, as a batch of LJH_SCHEMA."""
    names = r.dtype.names
    if "posix_usec" in names:
        us, frames = r["posix_usec"].astype(np.int64), pa.array(r["subframecount"].astype(np.int64))
    else:
        us = r["ms"].astype(np.int64) * 1000 + int(facts["offset"] * 1e6) + (r["us4"].astype(np.int64) * 4 if "us4" in names else 0)
        frames = pa.nulls(len(r), pa.int64())
    pulse = _lists(r["pulse"].astype(np.int32), pa.int32()) if keep_pulses else pa.nulls(len(r), pa.list_(pa.int32()))
    n = pa.array(np.arange(first, first + len(r)), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array([path] * len(r), pa.string()), pa.array([facts["channel"]] * len(r), pa.int64()), n, pa.array(us, pa.timestamp("us", "UTC")), frames, pulse], ["path", "ch_num", "row_idx", "timestamp", "subframecount", "pulse"])


def read_ljh(spark: SparkSession, path: str | list[str], keep_pulses: bool = True) -> DataFrame:
    """Records of files, in file order by row_idx; older versions have no subframecount.

    A file is read whole by one task; sources.pulse_source reads large files in parts, and growing ones as streams.
    """

    def decode(path: str, raw) -> Iterator[pa.RecordBatch]:
        fields, size = ljh_header(bytes(raw[: 1 << 16]))
        dtype, facts = ljh_layout(fields)
        records = np.frombuffer(raw, dtype, (len(raw) - size) // dtype.itemsize, size)
        for low in range(0, len(records), BATCH):
            yield ljh_batch(path, records[low : low + BATCH], low, facts, keep_pulses)

    return _per_file(_files(spark, path), decode, LJH_SCHEMA)


def read_ljh_headers(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """One row a file."""

    def decode(path: str, raw) -> Iterator[pa.RecordBatch]:
        fields, _ = ljh_header(bytes(raw[: 1 << 16]))
        _, f = ljh_layout(fields)
        yield pa.RecordBatch.from_pylist(
            [{"path": path, "ch_num": f["channel"], "version": f["version"], "timebase": f["timebase"], "n_samples": f["n_samples"], "n_presamples": f["n_presamples"], "subframediv": f["subframediv"], "attrs": list(fields.items())}],
            pa.schema([("path", pa.string()), ("ch_num", pa.int64()), ("version", pa.string()), ("timebase", pa.float64()), ("n_samples", pa.int32()), ("n_presamples", pa.int32()), ("subframediv", pa.int32()), ("attrs", pa.map_(pa.string(), pa.string()))]),
        )

    return _per_file(_files(spark, path), decode, HEADER_SCHEMA)


def off_layout(version: str, n_basis: int) -> np.dtype:
    """The record of pre-filtered files; 0.3 and later has the pretrigger slope."""
    slope = [("pretriggerDelta", "<f4")] if tuple(int(x) for x in version.split(".")[:2]) >= (0, 3) else []
    heads = [("recordSamples", "<i4"), ("recordPreSamples", "<i4"), ("framecount", "<i8"), ("unixnano", "<i8"), ("pretriggerMean", "<f4"), *slope, ("residualStdDev", "<f4"), ("pulseMean", "<f4"), ("derivativeLike", "<f4"), ("filtValue", "<f4")]
    return np.dtype([*heads, *([("extraCoefs", "<f4", (n_basis - 3,))] if n_basis > 3 else [])])


def read_off(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Records of pre-filtered files: a JSON header, matrices if they are stored as binary, then fixed records."""

    def decode(path: str, raw) -> Iterator[pa.RecordBatch]:
        data = bytes(raw)
        end = data.index(b"}\n") + 2
        while True:
            try:
                header = json.loads(data[:end])
                break
            except json.JSONDecodeError:
                end = data.index(b"}\n", end) + 2
        info, n = header["ModelInfo"], header["NumberOfBases"]
        if "RowMajorFloat64ValuesBase64" not in info["Projectors"]:
            end += 8 * sum(info[k]["Rows"] * info[k]["Cols"] for k in ("Projectors", "Basis"))
        dtype = off_layout(header["FileFormatVersion"], n)
        records = np.frombuffer(data, dtype, (len(data) - end) // dtype.itemsize, end)
        for low in range(0, len(records), BATCH):
            r = records[low : low + BATCH]
            have = lambda name: pa.array(r[name].astype(np.float32)) if name in dtype.names else pa.nulls(len(r), pa.float32())  # noqa: B023, E731
            coefs = _lists(r["extraCoefs"].astype(np.float32), pa.float32()) if n > 3 else pa.nulls(len(r), pa.list_(pa.float32()))
            names = ["pretriggerMean", "pretriggerDelta", "residualStdDev", "pulseMean", "derivativeLike", "filtValue"]
            yield pa.RecordBatch.from_arrays(
                [pa.array([path] * len(r)), pa.array(np.arange(low, low + len(r)), pa.int64()), pa.array(r["framecount"].astype(np.int64)), pa.array(r["unixnano"].astype(np.int64) // 1000, pa.timestamp("us", "UTC")), *map(have, names), coefs],
                ["path", "row_idx", "framecount", "timestamp", *names, "extraCoefs"],
            )

    floats = ", ".join(f"{k} float" for k in ("pretriggerMean", "pretriggerDelta", "residualStdDev", "pulseMean", "derivativeLike", "filtValue"))
    return _per_file(_files(spark, path), decode, f"path string, row_idx long, framecount long, timestamp timestamp, {floats}, extraCoefs array<float>")


#: The packed header of continuous acquisition files.
CONTINUOUS_HEADER = np.dtype([("format", "<u4"), ("schema", "<u4"), ("sample_rate_hz", "<f8"), ("data_reduction_factor", "<i2"), ("voltage_scale", "<f8"), ("acquisition_flags", "<u2"), ("start_time", "<u8", (2,)), ("stop_time", "<u8", (2,)), ("number_of_samples", "<u8")])


def read_continuous(spark: SparkSession, path: str | list[str], chunk: int = 65_536) -> DataFrame:
    """Continuous 16-bit samples in chunks: path, chunk, start, samples, rate and scale."""

    def decode(path: str, raw) -> Iterator[pa.RecordBatch]:
        head = np.frombuffer(raw, CONTINUOUS_HEADER, 1)[0]
        size = CONTINUOUS_HEADER.itemsize
        x = np.frombuffer(raw, "<i2", (len(raw) - size) // 2, size)
        for k, low in enumerate(range(0, len(x), chunk)):
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([k], pa.int64()), pa.array([low], pa.int64()), pa.array([x[low : low + chunk]], pa.list_(pa.int16())), pa.array([float(head["sample_rate_hz"])]), pa.array([float(head["voltage_scale"])])], ["path", "chunk", "start", "samples", "sample_rate_hz", "voltage_scale"])

    return _per_file(_files(spark, path), decode, "path string, chunk long, start long, samples array<smallint>, sample_rate_hz double, voltage_scale double")


def read_states(spark: SparkSession, path: str) -> DataFrame:
    """Experiment states: timestamp, state_label."""
    rows = spark.read.schema("unixnano long, state_label string").option("header", True).option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True).csv(path)
    return rows.select(F.expr("timestamp_micros(unixnano div 1000)").alias("timestamp"), F.trim("state_label").alias("state_label"))


def read_triggers(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """External triggers: one line of text, then counts."""

    def decode(path: str, raw) -> Iterator[pa.RecordBatch]:
        data = bytes(raw)
        at = data.index(b"\n") + 1
        x = np.frombuffer(data, "<i8", (len(data) - at) // 8, at)
        yield pa.RecordBatch.from_arrays([pa.array([path] * len(x)), pa.array(x, pa.int64())], ["path", "subframecount"])

    return _per_file(_files(spark, path), decode, "path string, subframecount long")


def read_npy(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Pulses of arrays (samples x pulses; of three dimensions the first plane)."""

    def decode(path: str, raw) -> Iterator[pa.RecordBatch]:
        import io

        x = np.load(io.BytesIO(bytes(raw)), allow_pickle=False)
        x = (x[:, :, 0] if x.ndim == 3 else x).T.astype(np.float64)
        for low in range(0, len(x), BATCH):
            part = x[low : low + BATCH]
            yield pa.RecordBatch.from_arrays([pa.array([path] * len(part)), pa.array(np.arange(low, low + len(part)), pa.int64()), _lists(part, pa.float64())], ["path", "row_idx", "pulse"])

    return _per_file(_files(spark, path), decode, "path string, row_idx long, pulse array<double>")

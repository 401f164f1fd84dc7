"""The data source: parts, filters, streams and folders."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulseloom.plans.channels import Channels
from pulseloom.sources import pulse_files, pulse_source

N = 8
DTYPE = np.dtype([("subframecount", "<i8"), ("posix_usec", "<i8"), ("pulse", "<u2", (N,))])


def header(channel, n=N):
    lines = ["#LJH Memorial File Format", "Save File Format Version: 2.2.1", "Software Version: DASTARD 1", f"Channel: {channel}", "Timebase: 1e-5", f"Total Samples: {n}", "Presamples: 3", "Subframe divisions: 64", "#End of Header"]
    return ("\n".join(lines) + "\n").encode()


def records(channel, low, high):
    out = np.zeros(high - low, DTYPE)
    k = np.arange(low, high)
    out["subframecount"], out["posix_usec"] = k * N * 64, 1_700_000_000_000_000 + k * 100
    out["pulse"] = (1000 * channel + k[:, None] + np.arange(N)) % 65536
    return out.tobytes()


def write(path, channel, n, more=b""):
    path.parent.mkdir(exist_ok=True, parents=True)
    path.write_bytes(header(channel) + records(channel, 0, n) + more)


@pytest.fixture
def folder(tmp_path):
    for c, n in ((1, 100), (3, 0), (12, 57)):
        write(tmp_path / "run1" / f"run1_chan{c}.ljh", c, n, b"cut off")
    (tmp_path / "run1" / "run1_chan1.off").write_bytes(b"no pulse file")
    return tmp_path / "run1"


def load(spark, path, **options):
    pulse_source.register(spark)
    return spark.read.format("pulses").options(path=str(path), **options).load()


def test_parts_hold_all_records_once(spark, folder):
    df = load(spark, folder, records="9")
    assert df.rdd.getNumPartitions() == 12 + 7
    key = ["path", "row_idx"]
    want = pulse_files.read_ljh(spark, str(folder / "*.ljh")).withColumn("path", F.regexp_replace("path", "^file:", "")).orderBy(key).collect()
    assert df.orderBy(key).collect() == want and len(want) == 157
    one = load(spark, f"file://{folder}/run1_chan12.ljh", first_pulse="50", max_pulses="5", pulses="false", posix_usec="true")
    assert one.columns == ["path", "ch_num", "row_idx", "timestamp", "subframecount", "posix_usec"]
    assert [(r.row_idx, r.posix_usec) for r in one.orderBy("row_idx").collect()] == [(k, 1_700_000_000_000_000 + 100 * k) for k in range(50, 55)]
    assert one.where(F.unix_micros("timestamp") != F.col("posix_usec")).count() == 0
    assert load(spark, folder, include="3").collect() == [] and load(spark, folder, exclude="1,3").count() == 57


def test_filters_choose_parts(spark, folder):
    df = load(spark, folder, records="10")
    assert df.where("ch_num = 12 and row_idx >= 40").rdd.getNumPartitions() == 2
    assert sorted(r.row_idx for r in df.where("ch_num in (1, 7) and row_idx > 90 and row_idx <= 95").collect()) == [91, 92, 93, 94, 95]
    assert df.where("row_idx = 56").count() == 2 and df.where("ch_num = 99").count() == 0


def test_mistakes_are_named(spark, folder):
    (folder / "run1_chan5.ljh").write_bytes(b"nothing like it")
    with pytest.raises(Exception, match="run1_chan5"):
        load(spark, folder).count()
    with pytest.raises(Exception, match="nowhere"):
        load(spark, folder / "nowhere").count()
    with pytest.raises(Exception, match="both included"):
        load(spark, folder, include="1", exclude="1").count()


def test_files_larger_than_two_gigabytes(spark, tmp_path):
    n = 100_000
    path = tmp_path / "big_chan7.ljh"
    with open(path, "wb") as f:
        f.write(header(7, n))
        f.truncate(len(header(7, n)) + 3_300_000_000)  # holes: takes no disk
    df = load(spark, path, pulses="false")
    assert df.rdd.getNumPartitions() > 40
    assert df.agg(F.count("*"), F.max("row_idx")).first() == (3_300_000_000 // (2 * n + 16), 3_300_000_000 // (2 * n + 16) - 1)


def test_growing_files_as_a_stream(spark, tmp_path):
    at, out, check = tmp_path / "live", str(tmp_path / "out"), str(tmp_path / "check")
    write(at / "live_chan1.ljh", 1, 10)
    pulse_source.register(spark)

    def run():
        stream = spark.readStream.format("pulses").options(path=str(at)).load()
        q = stream.select("ch_num", "row_idx", "pulse").writeStream.format("parquet").option("path", out).option("checkpointLocation", check).trigger(once=True).start()
        q.awaitTermination(120)
        return sorted((r.ch_num, r.row_idx) for r in spark.read.parquet(out).collect())

    assert run() == [(1, k) for k in range(10)]
    half = records(1, 14, 15)[:11]
    with open(at / "live_chan1.ljh", "ab") as f:
        f.write(records(1, 10, 14) + half)
    write(at / "live_chan2.ljh", 2, 3)
    (at / "live_chan4.ljh").write_bytes(header(4)[:40])  # its header is still being written
    assert run() == [(1, k) for k in range(14)] + [(2, k) for k in range(3)]
    with open(at / "live_chan1.ljh", "ab") as f:
        f.write(records(1, 14, 15)[11:])
    (at / "live_chan4.ljh").write_bytes(header(4) + records(4, 0, 2))
    assert run() == [(1, k) for k in range(15)] + [(2, k) for k in range(3)] + [(4, 0), (4, 1)]
    last = spark.read.parquet(out).where("ch_num = 1 and row_idx = 14").first()
    assert last.pulse == [1014 + k for k in range(N)]


def test_folders_and_pairs(spark, folder, tmp_path):
    for c in (1, 12, 13):
        write(tmp_path / "noise" / f"n_chan{c}.ljh", c, 5)
    os.makedirs(folder / "deeper")
    write(folder / "deeper" / "run1_chan44.ljh", 44, 2)
    files = lambda *a, **k: sorted(r.ch_num for r in pulse_source.find_files(spark, str(folder), *a, **k).collect())
    assert files() == [1, 3, 12] and files(recursive=True) == [1, 3, 12, 44] and files(".off") == [1]
    assert files(include=[1, 99]) == [1] and files(exclude=[3]) == [1, 12]
    with pytest.raises(ValueError):
        files(include=[1], exclude=[1])
    pairs = pulse_source.pair_files(spark, str(folder), str(tmp_path / "noise")).orderBy("ch_num").collect()
    assert [(p.ch_num, os.path.basename(p.pulse_path), os.path.basename(p.noise_path)) for p in pairs] == [(c, f"run1_chan{c}.ljh", f"n_chan{c}.ljh") for c in (1, 12)]
    assert pulse_source.pair_files(spark, str(folder), str(tmp_path / "noise"), limit=1).count() == 1
    both = Channels.from_folder(spark, str(folder), str(tmp_path / "noise"), exclude=[1])
    assert both.df.count() == 57 and both.noise.count() == 5 and {r.ch_num for r in both.noise.collect()} == {12}
    assert Channels.from_folder(spark, str(folder), limit=1).df.select("ch_num").distinct().collect()[0].ch_num == 1
    assert Channels.from_folder(spark, str(folder), include=[77]).df.count() == 0
    by_hand = Channels.from_pairs(spark, [(str(folder / "run1_chan1.ljh"), str(tmp_path / "noise" / "n_chan1.ljh")), (str(folder / "run1_chan12.ljh"), "")])
    assert by_hand.df.count() == 157 and by_hand.noise.count() == 5 and by_hand.with_good_expr("ch_num = 1").all_good().count() == 100
    write(folder / "again_chan1.ljh", 1, 1)
    with pytest.raises(ValueError, match="channel 1"):
        pulse_source.pair_files(spark, str(folder), str(tmp_path / "noise"))
    with pytest.raises(ValueError, match="channel 1"):
        Channels.from_pairs(spark, [(str(folder / f), "") for f in ("run1_chan1.ljh", "again_chan1.ljh")])
    names = spark.createDataFrame([("/d/_chan/20_chan3.ljh",)], "p string").select(pulse_source.sibling(F.col("p"), "experiment_state.txt").alias("a"), pulse_source.sibling(F.col("p"), "external_trigger.bin").alias("b")).first()
    assert names == ("/d/_chan/20_experiment_state.txt", "/d/_chan/20_external_trigger.bin")

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulseloom.functions import pulses as P
from pulseloom.operators import pulse_stats, temporal
from pulseloom.plans.channels import Channels, combined
from pulseloom.plans.recipe import Recipe, Step
from pulseloom.sources import pulse_files
from pulseloom.streaming.replay import replay, windowed_histogram


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame([(k % 3, k, float(k % 7), float(k)) for k in range(60)], "ch_num long, row_idx long, a double, b double")


def steps():
    return [
        Step({"drift": "b * (1 + 0.1 * (a - off))"}, ("a", "b"), {"off": ("median", "a")}),
        Step({"twice": "2 * drift"}, ("drift",)),
        Step({"unused": "a + 1"}, ("a",)),
    ]


def test_recipe_replays_saves_and_trims(spark, rows, tmp_path):
    ch = Channels(rows).with_good_expr("a > 0")
    for s in steps():
        ch = ch.with_step(s)
    want = ch.df.select("ch_num", "row_idx", "twice", "unused").orderBy("row_idx").collect()
    assert ch.recipe.replay(rows).select("ch_num", "row_idx", "twice", "unused").orderBy("row_idx").collect() == want
    ch.recipe.save(str(tmp_path / "r"))
    again = Recipe.load(spark, str(tmp_path / "r"))
    assert Channels(rows).replay(again).df.select("ch_num", "row_idx", "twice", "unused").orderBy("row_idx").collect() == want
    assert [list(s.outputs) for s in ch.recipe.trimmed(["twice"]).steps] == [["drift"], ["twice"]]
    with pytest.raises(ValueError):
        ch.recipe.trimmed(["nothing"])
    once = again.replay(again.replay(rows))
    assert once.count() == 60 and once.columns.count("twice") == 1


def test_channels(spark, rows):
    ch = Channels(rows).set_bad([1], "noisy")
    assert {r.ch_num for r in ch.all_good().select("ch_num").distinct().collect()} == {0, 2}

    def f(pdf):
        if pdf.ch_num.iloc[0] == 2:
            raise RuntimeError("broken")
        return pdf.groupby("ch_num", as_index=False).agg(total=("b", "sum"))[["total"]]

    done, failed = Channels(rows).map(f, "total double")
    assert {r.ch_num: r.total for r in done.collect()} == {c: sum(k for k in range(60) if k % 3 == c) for c in (0, 1)}
    assert [(r.ch_num, r.error) for r in failed.collect()] == [(2, "RuntimeError")]
    both = Channels(rows).concat(Channels(rows.where("ch_num < 2"))).concat(Channels(rows.where("ch_num = 0")))
    assert {(r.ch_num, r.concat_state): r["count"] for r in both.df.groupBy("ch_num", "concat_state").count().collect()} == {(0, 0): 20, (0, 1): 20, (0, 2): 20}
    assert combined({"x": rows, "y": rows}).groupBy("source").count().count() == 2


def test_jumps_and_windows(spark):
    ramp = 400.0 * np.arange(40) + 2000
    ramp[10:20] += 2 * 4096
    df = spark.createDataFrame([(1, int(k), float(x)) for k, x in enumerate(ramp)], "ch_num int, k int, x double").orderBy(F.rand(1))
    got = [r.flat for r in temporal.unwrap(df, "x", F.lit(4096.0), ["ch_num"], ["k"], "flat").orderBy("k").collect()]
    assert got == (400.0 * np.arange(40) + 2000).tolist()
    saw = spark.createDataFrame([(1, k, k % 50 + 725.0) for k in range(500)], "ch_num int, k int, x double")
    flat = [r.flat for r in temporal.unwrap(saw, "x", F.lit(50.0), ["ch_num"], ["k"], "flat").orderBy("k").collect()]
    assert set(np.diff(flat)) == {1.0}


def test_resampled(spark):
    pulse = spark.range(1).select(F.array(*[F.lit(float(x)) for x in range(0, 100, 10)]).alias("p"))
    for shift, want in ((0.0, range(0, 100, 10)), (1.0, [0, *range(0, 90, 10)]), (-2.0, [*range(20, 100, 10), 90, 90]), (0.5, [0, *range(5, 95, 10)])):
        assert pulse.select(P.shifted(F.col("p"), F.lit(shift)).alias("s")).first().s == list(map(float, want))


def header(version, n, pre, software, extra=()):
    lines = [f"Save File Format Version: {version}", f"Software Version: {software}", "Channel: 7", "Timebase: 1e-05", f"Total Samples: {n}", f"Presamples: {pre}", "Timestamp offset (s): 100.5", "Note: a: b", *extra, "#End of Header"]
    return ("\r\n".join(lines) + "\r\n").encode()


@pytest.mark.parametrize("version", ["2.2.1", "2.1.0", "2.0.0"])
def test_ljh(spark, tmp_path, version):
    rng = np.random.default_rng(1)
    dtype = np.dtype([*pulse_files.LJH_HEADS["2.2.0" if version > "2.2" else version], ("pulse", "<u2", (20,))])
    records = np.zeros(101, dtype)
    records["pulse"] = rng.integers(1000, 60000, (101, 20))
    records[records.dtype.names[-2]] = np.arange(101) * 1000
    (tmp_path / "x_chan7.ljh").write_bytes(header(version, 20, 5, "Other", ["Subframe divisions: 64"]) + records.tobytes() + b"cut off")
    got = pulse_files.read_ljh(spark, str(tmp_path)).orderBy("row_idx").collect()
    assert len(got) == 101 and got[3].ch_num == 7 and got[3].pulse == records["pulse"][3].tolist()
    h = pulse_files.read_ljh_headers(spark, str(tmp_path)).first()
    assert (h.n_samples, h.n_presamples, h.subframediv, h.attrs["Note"]) == (20, 8, 64, "a: b")
    (tmp_path / "bad.ljh").write_bytes(b"nothing")
    with pytest.raises(Exception, match="bad.ljh"):
        pulse_files.read_ljh(spark, str(tmp_path / "bad.ljh")).collect()


def test_other_files(spark, tmp_path):
    x = (np.arange(1000) % 300).astype("<i2")
    head = np.zeros(1, pulse_files.CONTINUOUS_HEADER)
    head["sample_rate_hz"], head["number_of_samples"] = 1e5, 1000
    (tmp_path / "c.bin").write_bytes(head.tobytes() + x.tobytes())
    chunks = pulse_files.read_continuous(spark, str(tmp_path / "c.bin"), 300).orderBy("chunk").collect()
    assert sum((c.samples for c in chunks), []) == x.tolist() and chunks[0].sample_rate_hz == 1e5
    (tmp_path / "t.bin").write_bytes(b"# text\n" + np.array([5, 9], "<i8").tobytes())
    assert [r.subframecount for r in pulse_files.read_triggers(spark, str(tmp_path / "t.bin")).collect()] == [5, 9]
    (tmp_path / "s.txt").write_text("# unixnano, state label\n1700000000000000999, START\n1700000001000000000,A \n")
    assert [(r.state_label, r.us) for r in pulse_files.read_states(spark, str(tmp_path / "s.txt")).selectExpr("state_label", "unix_micros(timestamp) us").collect()] == [("START", 1700000000000000), ("A", 1700000001000000)]
    a = np.random.default_rng(2).integers(0, 99, (6, 10))
    np.save(tmp_path / "p.npy", a)
    assert [r.pulse for r in pulse_files.read_npy(spark, str(tmp_path / "p.npy")).orderBy("row_idx").collect()] == a.T.astype(float).tolist()
    dtype = pulse_files.off_layout("0.3.0", 5)
    records = np.zeros(4, dtype)
    records["filtValue"], records["extraCoefs"] = [1, 2, 3, 4], np.arange(8).reshape(4, 2)
    info = {k: {"Rows": 5, "Cols": 2} for k in ("Projectors", "Basis")}
    text = __import__("json").dumps({"FileFormatVersion": "0.3.0", "NumberOfBases": 5, "ModelInfo": info}, indent=1) + "\n"
    (tmp_path / "o.off").write_bytes(text.encode() + bytes(160) + records.tobytes())
    got = pulse_files.read_off(spark, str(tmp_path / "o.off")).orderBy("row_idx").collect()
    assert [r.filtValue for r in got] == [1, 2, 3, 4] and got[2].extraCoefs == [4, 5]


def test_streams(spark, rows, tmp_path):
    timed = rows.withColumn("ts", F.timestamp_seconds(F.col("row_idx") * 60))
    timed.write.parquet(str(tmp_path / "in"))
    _, recipe = Recipe(("ch_num",)).then(rows, steps()[0])
    stream = replay(spark.readStream.schema(timed.schema).parquet(str(tmp_path / "in")), recipe)
    q = stream.writeStream.format("memory").queryName("replayed").trigger(availableNow=True).start()
    q.awaitTermination(60)
    want = recipe.replay(rows).select("row_idx", "drift").orderBy("row_idx").collect()
    assert spark.table("replayed").select("row_idx", "drift").orderBy("row_idx").collect() == want
    counts = windowed_histogram(spark.readStream.schema(timed.schema).parquet(str(tmp_path / "in")), "ts", "a", 0.0, 1.0, 7, "10 minutes", "5 minutes", ("ch_num",))
    q = counts.writeStream.format("memory").queryName("counted").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.table("counted").agg(F.sum("n_rows")).first()[0] == 60


def test_operations_are_recorded_saved_trimmed_and_replayed(spark, tmp_path):
    rng = np.random.default_rng(3)
    shape = np.concatenate([np.zeros(16), 600 * np.exp(-np.arange(48) / 12)])
    rows = []
    for k in range(400):
        size, base = (0.0 if k // 2 % 4 == 0 else 1.0 + 0.5 * (k % 2)), rng.normal(0, 4)
        pulse = 1000 + base + size * shape * (1 + 2e-4 * base) + rng.normal(0, 2, 64)
        rows.append((k % 2, k, [int(x) for x in pulse], k // 2 % 4 == 0))
    df = spark.createDataFrame(rows, "ch_num int, row_idx int, pulse array<int>, is_noise boolean")
    ch = Channels(df)
    for step in (
        Step.named("summary", ["pulse"], ["base", "top"], pulse="pulse", pre=16, columns={"base": "pretrig_mean", "top": "peak_value"}),
        Step.named("filter", ["pulse", "is_noise"], ["height"], pulse="pulse", pre=16, noise="is_noise", output="height"),
        Step.named("drift", ["height", "base"], ["steady"], use="not is_noise", height="height", indicator="base", output="steady"),
        Step.named("gain", ["steady"], ["energy"], height="steady", a=0.0, b=0.0, c=2.0, output="energy"),
        Step.named("categorize", ["top"], ["kind"], conditions={"pulse": "top > 100"}, output="kind"),
        Step.named("unwrap", ["row_idx", "ch_num"], ["flat"], column="row_idx", period=100.0, order=["row_idx"], output="flat"),
    ):
        ch = ch.with_step(step)
    want = ch.df.orderBy("row_idx").collect()
    pulses = [r for r in want if r.kind == "pulse"]
    assert len(pulses) == 300 and all(r.energy == pytest.approx(r.steady / 2) for r in pulses)
    spread = {k: np.std([r[k] for r in pulses if r.row_idx % 2]) / np.mean([r[k] for r in pulses if r.row_idx % 2]) for k in ("top", "height", "steady")}
    assert spread["height"] < spread["top"] and spread["steady"] <= spread["height"] * 1.01
    ch.set_bad([1], "x").with_good_expr("top > 0").save(str(tmp_path / "c"))
    again = Channels.load(spark, str(tmp_path / "c"))
    assert again.good_expr == "top > 0" and again.all_good().select("ch_num").distinct().collect() == [(0,)] and again.df.count() == 400
    replayed = again.recipe.replay(df).orderBy("row_idx").collect()
    assert [r.asDict() for r in replayed] == [r.asDict() for r in want]
    assert [s.operation for s in again.recipe.trimmed(["energy"]).steps] == ["summary", "filter", "drift", "gain"]
    ch.with_step(Step({"more": "2 * energy"}, ("energy",))).save(str(tmp_path / "c"), overwrite=True)
    assert len(Channels.load(spark, str(tmp_path / "c")).recipe.steps) == 7
    with pytest.raises(ValueError):
        Step.named("nothing", [], [])


@pytest.mark.parametrize("slot", [None, 7.0])
def test_around_finds_both_neighbours(spark, slot):
    rng = np.random.default_rng(4)
    left = sorted({(int(c), int(t)) for c, t in rng.integers(0, [3, 100], (80, 2))})
    right = sorted({(int(c), int(t)) for c, t in rng.integers(0, [2, 100], (15, 2))})
    got = temporal.asof_nearest(spark.createDataFrame(left, "ch int, t int"), spark.createDataFrame([(*r, r[1] * 10) for r in right], "ch int, t int, v int"), ["ch"], "t", "v", slot).collect()
    for r in got:
        times = [t for c, t in right if c == r.ch]
        best = min(times, key=lambda t: (abs(t - r.t), t)) if times else None
        assert (r.v_at, r.v) == (best, None if best is None else best * 10)


def test_batch_spectra_equal_the_definition(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(0, 5, (30, 20)).round(3)
    df = spark.createDataFrame([(k % 3, v.tolist()) for k, v in enumerate(x)] + [(0, [1.0, 2.0]), (1, None), (2, [None] * 20), (None, x[0].tolist())], "ch int, y array<double>")
    got = {(r.ch, r.k): r.psd for r in pulse_stats.periodogram(df, ["ch"], "y", 20, 0.5).collect()}
    for c in range(3):
        power = (np.abs(np.fft.fft(x[c::3]))[:, :11] ** 2).mean(0) * 0.5 / 20 * np.where(np.isin(np.arange(11), (0, 10)), 1, 2)
        assert [got[c, k] for k in range(11)] == pytest.approx(power)
    assert (None, 3) in got
    lags = {(r.ch, r.lag): r.value for r in pulse_stats.autocorrelation(df.where("size(y) = 20"), ["ch"], "y", 4).collect()}
    flat = x - x.mean(1, keepdims=True)
    assert all(lags[c, k] == pytest.approx(np.mean([f[: 20 - k] @ f[k:] / 20 for f in flat[c::3]])) for c in range(3) for k in range(4))


def test_more_channels_take_the_place_of_older_ones(spark, rows):
    old = Channels(rows, noise=rows.where("row_idx < 6")).set_bad([0, 1], "old")
    new = Channels(rows.where("ch_num > 0 and row_idx < 30").withColumn("a", F.lit(-1.0)).withColumn("more", F.lit(1)), noise=rows.where("ch_num = 1 and row_idx < 3")).set_bad([2], "new")
    both = old.with_more_channels(new)
    assert {(r.ch_num, r.n, r.low) for r in both.df.groupBy("ch_num").agg(F.count("*").alias("n"), F.min("a").alias("low")).collect()} == {(0, 20, 0.0), (1, 10, -1.0), (2, 10, -1.0)}
    assert {(r.ch_num, r.message) for r in both.bad.collect()} == {(0, "old"), (2, "new")} and both.df.where("more is null").count() == 20
    assert {r.ch_num: r["count"] for r in both.noise.groupBy("ch_num").count().collect()} == {0: 2, 1: 1}


def test_mapped_columns(spark, rows):
    found = Channels(rows.withColumn("pulse", F.when(F.col("row_idx") % 5 > 0, F.array("a", "b")))).with_mapped("pulse", lambda x: x.sum(1), "total").with_mapped("b", lambda x: x + 1, "next").df
    assert all((r.total is None) == (r.row_idx % 5 == 0) and (r.total is None or r.total == r.a + r.b) and r.next == r.b + 1 for r in found.collect())
    arrays = Channels(rows.withColumn("pulse", F.array("a", "b"))).with_mapped("pulse", lambda x: x[:, ::-1], "turned", "array<double>").df
    assert all(r.turned == [r.b, r.a] for r in arrays.collect())
    with pytest.raises(Exception, match="1 results"):
        Channels(rows.coalesce(1)).with_mapped("b", lambda x: x[:1], "few").df.collect()


def test_combined_tables_agree(spark, rows):
    one, two = rows.withColumn("n_samples", F.lit(64)), rows.withColumn("n_samples", F.lit(65))
    assert combined({"x": one, "y": one}, same=["n_samples"]).count() == 120
    with pytest.raises(ValueError, match="n_samples differs"):
        combined({"x": one, "y": two}, same=["n_samples"])


def test_round_trip_by_channel_makes_few_files(spark, tmp_path):
    """One folder a channel would be 1,501 files here, and 90,000 for as many channels."""
    from pulseloom.plans import catalogue
    from pulseloom.plans.channels import FOLDERS

    made = [(k % 1500, k, k / 8) for k in range(6000)] + [(7, k, 0.5) for k in range(6000, 9000)] + [(None, 9000, 1.0), (8, 9001, None)]
    spark.createDataFrame(made, "user_id long, event_id long, value double").write.parquet(f"{tmp_path}/events.parquet")
    back = catalogue.QUERIES["partitioned_round_trip"](spark, str(tmp_path))
    assert sorted(map(tuple, back.collect()), key=repr) == sorted(made, key=repr)
    assert len(back.inputFiles()) <= FOLDERS
    folder = F.regexp_extract(F.input_file_name(), "channel_folder=(\\d+)", 1)
    assert back.select("user_id", folder.alias("f")).distinct().groupBy("user_id").count().where("count > 1").isEmpty()


def test_assignments_where_a_gain_falls_to_zero(spark):
    """The gain through (1000, 2500) and (1400, 3000) is exactly zero at 6000, the next peak: no energy, and no division by zero."""
    lines = spark.createDataFrame([(x,) for x in (1000.0, 1400.0, 1900.0)], "energy double")
    heights = [2500.0, 3000.0, 3100.0, 6000.0]
    found = pulse_stats.ranked_assignments(lines, spark.createDataFrame([(x,) for x in heights], "height double"), 1.0, 0.5)
    got = {(r.p0, r.p1, r.p2): r.error for r in found.collect()}
    want = {}
    for a, b, c in [(a, b, c) for a in heights for b in heights for c in heights if a < b < c]:
        slope = (b / 1400 - a / 1000) / (b - a)
        gain = a / 1000 - a * slope
        if slope < 0 and 1 + slope / gain > 0.25 and gain + slope * c and abs(c / (gain + slope * c) / 1900 - 1) < 0.5:
            want[a, b, c] = c / (gain + slope * c) - 1900
    assert got == pytest.approx(want) and want and (2500.0, 3000.0, 6000.0) not in got

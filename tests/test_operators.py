"""Literal cases of the recording operators."""

from pyspark.sql import functions as F

from pulselake import dims
from pulselake.functions import header, times
from pulselake.functions.ordered import with_previous, with_running_sum
from pulselake.operators import annotations as ann
from pulselake.operators import beats
from pulselake.operators import segments as seg
from pulselake.operators import signals as sig


def signal(spark, values, name="pval", kind="double"):
    return spark.createDataFrame([("r", 0, i, v) for i, v in enumerate(values)], f"record string, ch int, sample long, {name} {kind}")


def test_blocks_give_what_one_window_gives(spark):
    df = spark.range(500).select((F.col("id") % 3).alias("k"), (F.col("id") * 7 % 500).alias("o"), F.col("id").alias("v"))
    got = with_previous(df, "k", "o", F.expr("o div 37"), name="p")
    want = df.selectExpr("*", "lag(o) over (partition by k order by o) as p")
    assert got.select("k", "o", "v", "p").exceptAll(want.select("k", "o", "v", "p")).count() == 0
    got = with_running_sum(df, "k", "o", F.expr("o div 37"), F.col("v"))
    want = df.selectExpr("*", "sum(v) over (partition by k order by o) as running")
    assert got.select("k", "o", "running").exceptAll(want.select("k", "o", "running")).count() == 0


def test_peaks(spark):
    s = signal(spark, [float(v) for v in (4, 6, 6, 6, 3, 5, 1, 1, 7, 7, 9, 2, 8, 8)])
    assert sorted((r.sample, r.kind) for r in sig.hard_peaks(s).collect()) == [(4, -1), (5, 1), (10, 1), (11, -1)]
    assert sorted((r.sample, r.kind) for r in sig.soft_peaks(s).collect()) == [(2, 1), (6, -1)]
    assert sig.hard_peaks(s.limit(0)).collect() == []
    moved = sig.shift_peaks(s, s.where("sample in (3, 9, 13)"), 3)
    assert {(r.peak, r.sample) for r in moved.collect()} == {(3, 1), (9, 10), (13, 10)}


def test_blocks_of_long_channels_overlap(spark):
    s = spark.range(300).select(F.lit("r").alias("record"), F.lit(0).alias("ch"), F.col("id").alias("sample"), (F.col("id") * 37 % 11).cast("double").alias("pval"))
    whole = {r.sample: r.smooth for r in sig.moving_average(s, 5).collect()}
    parts = sig.with_margins(s, 5, block=16)
    assert parts.where("_own").count() == 300
    w = sig._neighbourhood(2, 2)
    got = {r.sample: r.smooth for r in parts.withColumn("smooth", F.sum("pval").over(w) / 5).where("_own").collect()}
    assert got == whole


def test_calibration_round_trip(spark):
    s = signal(spark, [-0.5, 0.25, None, 1.75, -2.0])
    gain = sig.fit_gain(s, -2048, 2047).first()
    digital = sig.to_digital(s, gain.adc_gain, gain.baseline, -2048)
    assert {r.sample: r.dval for r in digital.collect()}[2] == -2048
    back = sig.to_physical(digital.withColumnRenamed("pval", "was"), gain.adc_gain, gain.baseline, -2048)
    for r in back.collect():
        assert (r.pval is None) == (r.was is None) and (r.was is None or abs(r.pval - r.was) <= 1 / gain.adc_gain)
    flat = sig.fit_gain(signal(spark, [0.0, 0.0]), -2048, 2047).first()
    assert (flat.adc_gain, flat.baseline) == (1.0, 1)
    high = sig.fit_gain(signal(spark, [1e10, 1e10 + 1]), -32768, 32767).first()
    assert high.baseline == -2147483648
    halves = sig.to_digital(signal(spark, [0.5, 1.5, 2.5, -0.5]), 1.0, 0, -99)
    assert [r.dval for r in halves.orderBy("sample").collect()] == [0, 2, 2, 0]


def test_signal_ranges(spark):
    rows = [("r", i, 1, False) for i in range(15)]
    placed = seg.offsets(spark.createDataFrame(rows, "record string, seg_no long, seg_len long, is_gap boolean"))
    chans = spark.createDataFrame([("r", i, s) for i in range(15) for s in (["I", "II"] if i < 5 else ["I", "III"])], "record string, seg_no long, sig_name string")
    got = {(r.sig_name, r.start, r.end) for r in seg.signal_ranges(placed, chans).collect()}
    assert got == {("I", 0, 15), ("II", 0, 5), ("III", 5, 15)}
    assert [(r.start, r.end) for r in seg.combined_ranges(placed, chans, ["I", "III"]).collect()] == [(5, 15)]
    assert seg.combined_ranges(placed, chans, ["II", "III"]).collect() == []
    need = seg.required_segments(placed, F.lit(3), F.lit(6))
    assert sorted(r.seg_no for r in need.collect()) == [3, 4, 5]


def test_heart_rate_steps(spark):
    a = spark.createDataFrame([("r", s, i) for i, s in enumerate((100, 460, 820, 1000))] + [("one", 5, 0)], "record string, sample long, ann_no long")
    got = sorted((r.start_sample, r.end_sample, round(r.hr, 6)) for r in ann.hr_steps(a, 360.0).collect())
    assert got == [(461, 820, 60.0), (821, 1000, 60.0)]


def test_merge_methods(spark):
    a = spark.createDataFrame([("r", s, s) for s in (1, 5, 9)], "record string, sample long, ann_no long")
    b = spark.createDataFrame([("r", s, s) for s in (5, 6, 20)], "record string, sample long, ann_no long")
    got = {m: sorted((r.sample, r.source) for r in ann.merge(a, b, m, 5, 10).collect()) for m in ("combine", "delete", "replace1", "replace2")}
    assert got == {"combine": [(5, 1), (5, 2), (6, 2), (9, 1)], "delete": [(1, 1), (20, 2)], "replace1": [(5, 1), (9, 1), (20, 2)], "replace2": [(1, 1), (5, 2), (6, 2)]}


def test_matching(spark):
    r = spark.createDataFrame([("r", s) for s in (100, 200, 300, 400)], "record string, sample long")
    t = spark.createDataFrame([("r", s) for s in (98, 105, 210, 500)], "record string, sample long")
    assert {(x.ref_sample, x.test_sample) for x in beats.match_nearest(r, t, 20).collect()} == {(100, 98), (200, 210)}
    s = beats.match_statistics(r, t, 20).first()
    assert (s.tp, s.fp, s.fn, s.sensitivity, s.positive_predictivity) == (2, 2, 2, 0.5, 0.5)


def test_header_lines(spark):
    lines = spark.createDataFrame([("100 2 360 650000 0:0:0 0/0/0",), ("w/3 2 62.4725/999.56(5) 10",), ("a 0",)], "line string")
    got = {r.record: r for r in header.parse_record_line(lines).collect()}
    assert (got["100"].n_sig, got["100"].fs, got["100"].sig_len) == (2, 360.0, 650000)
    assert (got["w"].n_seg, got["w"].fs, got["w"].counter_freq, got["w"].base_counter) == (3, 62.4725, 999.56, 5.0)
    assert (got["a"].fs, got["a"].sig_len) == (250.0, None)
    signals = spark.createDataFrame([("100.dat 212x2:3+24 200(1024)/mV 11 1024 995 -22131 0 MLII lead, long",), ("x.dat 16",), ("~ 0 0 1 5",)], "line string")
    got = {r.file_name: r for r in header.parse_signal_line(signals).collect()}
    r = got["100.dat"]
    assert (r.fmt, r.spf, r.skew, r.byte_offset, r.adc_gain, r.baseline, r.units, r.adc_res, r.checksum, r.sig_name) == ("212", 2, 3, 24, 200.0, 1024, "mV", 11, -22131, "MLII lead, long")
    assert (got["x.dat"].adc_gain, got["x.dat"].baseline, got["x.dat"].units) == (200.0, 0, "mV") and got["~"].adc_gain == 200.0


def test_times(spark):
    df = spark.createDataFrame([("5.5",), ("1:02",), ("10:00:00.25",), ("s77",), ("e",)], "t string").where("t not in ('s77', 'e')")
    assert {r.t: r.m for r in df.select("t", times.clock_micros(F.col("t")).alias("m")).collect()} == {"5.5": 5_500_000, "1:02": 62_000_000, "10:00:00.25": 36_000_250_000}
    one = spark.createDataFrame([("s77",)], "t string").select(times.parse_time(F.col("t"), 360.0).alias("n")).first()
    assert one.n == 77


def test_labels(spark):
    labels = dims.ann_labels(spark)
    assert labels.count() == 40 and labels.where("is_qrs").count() == 20
    custom = spark.createDataFrame([(1, "v", "mine"), (45, "z", "new")], "label_store int, symbol string, description string")
    got = {r.label_store: r.symbol for r in ann.overlay_labels(labels, custom).collect()}
    assert got[1] == "v" and got[45] == "z" and got[2] == "L" and len(got) == 41

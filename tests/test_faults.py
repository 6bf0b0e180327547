"""Cases that went wrong once: notes, odd words, time zones, malformed times, skewed tails, flat channels."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from pulselake.functions import times
from pulselake.operators import annotations as ann
from pulselake.operators import signals as sig
from pulselake.sources import annotations as ann_files
from pulselake.sources import signals

SCHEMA = "record string, ann_no long, sample long, label_store int, subtype int, chan int, num int, aux_note string"


def test_notes_of_all_lengths(spark, tmp_path):
    rows = [("r", i, 10 * i, 22, 0, 0, 0, "é" * n) for i, n in enumerate((1, 2, 254, 255))]
    ann_files.write_annotations(spark.createDataFrame(rows, SCHEMA), str(tmp_path), "atr")
    assert [tuple(r) for r in ann_files.read_annotations(spark, f"{tmp_path}/r.atr").orderBy("ann_no").collect()] == rows
    for note, rule in (("x" * 256, "note_length"), ("x" * 300, "note_length"), ("привет", "note_letters")):
        bad = spark.createDataFrame([("bad", 7, 5, 22, 0, 0, 0, note)], SCHEMA)
        with pytest.raises(ValueError, match=f"record bad, annotation 7: {rule}"):
            ann_files.write_annotations(bad, str(tmp_path), "atr")
        with pytest.raises(Exception, match="record bad, annotation 7"):
            ann_files.encode_parts(bad).collect()
        assert [r.rule for r in ann.violations(bad.withColumn("symbol", F.lit("N"))).collect()] == [rule]


def test_fields_that_change_over_blocks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK", 1000)
    monkeypatch.setattr(ann_files.block_of, "__defaults__", ("sample", 1000))
    rows = [("r", i, 137 * i + (5_000_000_000 if i > 30 else 0), 1 + i % 40, i % 7 - 3, i // 9 % 3, i // 4 % 2, "n" * (i % 5)) for i in range(60)]
    rows += [("s", 0, 0, 1, 0, 2, 1, "")]
    ann_files.write_annotations(spark.createDataFrame(rows, SCHEMA).repartition(3), str(tmp_path), "atr")
    assert sorted(tuple(r) for r in ann_files.read_annotations(spark, f"{tmp_path}/*.atr").collect()) == rows


def test_words_without_an_annotation():
    sub, aux = bytes((5, ann_files.SUB << 2)), bytes((3, ann_files.AUX << 2)) + b"abc\0"
    beat = bytes((7, 1 << 2))
    assert list(ann_files.decode(sub + aux + beat + aux + b"\0\0")) == [(7, 1, 0, 0, 0, "abc")]
    whole = beat + aux + beat
    for n in range(len(whole)):
        assert len(list(ann_files.decode(whole[:n]))) == (n >= 2)


def test_times_that_say_nothing(spark):
    texts = ["abc", "", "1:2:3:4", "x:5", "1:y", ":", "[abc 01/01/2001]", "[00:00:01 45/01/2001]", "s5x", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r.n for r in df.select(times.parse_time(F.col("t"), 100.0, 7, F.lit(0)).alias("n")).collect()] == [None] * len(texts)
    good = spark.createDataFrame([("1:02:03.5",), ("2:03",), (" 7 ",), (".25",)], "t string")
    assert [r.n for r in good.select(times.clock_micros(F.col("t")).alias("n")).collect()] == [3_723_500_000, 123_000_000, 7_000_000, 250_000]


@pytest.mark.parametrize("name", ["p10_times", "p11_moved_time", "p12_time_triples", "s1_headers"])
def test_times_don_t_depend_on_the_session_s_zone(spark, name):
    found = []
    for zone in ("UTC", "America/New_York", "Asia/Kolkata"):
        spark.conf.set("spark.sql.session.timeZone", zone)
        try:
            out = __spark_entry__.queries()[name](spark, "/root/testdata/sf0.001")
            found.append(sorted(str(tuple(r)) for r in out.select([F.col(c).cast("string") for c in out.columns]).collect()))
        finally:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert found[0] == found[1] == found[2] and found[0]


def test_skewed_channels_end_with_missing_samples(spark, tmp_path):
    chs = spark.createDataFrame([("r", c, "r.dat", "16", 1, s, 200.0, 0) for c, s in ((0, 0), (1, 3))], "record string, ch int, file_name string, fmt string, spf int, skew int, adc_gain double, baseline int")
    samples = spark.createDataFrame([("r", c, f, 0, f, 10 * f + c) for f in range(10) for c in (0, 1)], "record string, ch int, frame long, sub int, sample long, dval long")
    signals.write_signals(samples, chs, str(tmp_path))
    got = {(r.ch, r.frame): (r.dval, r.pval) for r in signals.read_signals(spark, f"{tmp_path}/*.dat", chs, physical=True, block_frames=6).collect()}
    assert len(got) == 20
    assert [got[1, f] for f in range(10)] == [(10 * f + 31, (10 * f + 31) / 200) for f in range(7)] + [(-32768, None)] * 3
    whole = sig.remove_skew(samples.where("ch = 1"), 3, -32768)
    assert {r.sample: r.dval for r in whole.collect()} == {f: got[1, f][0] for f in range(10)}
    some = signals.read_signals(spark, f"{tmp_path}/*.dat", chs, 6, 9, numbers=[1], block_frames=6)
    assert sorted((r.frame, r.dval) for r in some.collect()) == [(6, 91), (7, -32768), (8, -32768)]


def test_a_flat_channel_has_no_peaks(spark):
    rows = [("flat", 0, i, 5.0) for i in range(30)] + [("hill", 0, i, float(-abs(i - 9))) for i in range(30)]
    df = spark.createDataFrame(rows, "record string, ch int, sample long, pval double")
    assert [tuple(r) for r in sig.local_peaks(df, 4).collect()] == [("hill", 0, 9, 0.0)]


def test_names_of_records_and_files(spark):
    good_records, bad_records = ["100", "a-b_C", "-"], ["", "a b", "a.b", "é", "a/b"]
    good_files, bad_files = ["a.dat", "100_1.dat", "ab", "a-b.d_1", "-.x", "a-1"], ["", "a", "a.", ".dat", "a.b.c", "a b.dat", "a.d-t", "ab-", "~"]
    df = spark.createDataFrame([(n,) for n in good_records + bad_records], "record string")
    assert {r.record for r in sig.record_violations(df).collect()} == set(bad_records)
    fields = "record long, ch int, file_name string, fmt string, spf int, skew int, byte_offset long, adc_gain double, baseline int, units string, adc_res int, block_size int, sig_name string"
    files = spark.createDataFrame([(i, 0, n, "16", 1, 0, 0, 1.0, 0, "mV", 1, 0, "x") for i, n in enumerate([*good_files, *bad_files, None])], fields)
    from pulselake import dims

    assert {r.record for r in sig.channel_violations(files, dims.dat_formats(spark)).where("rule = 'file_name'").collect()} == set(range(len(good_files), len(good_files) + len(bad_files)))


def test_frequency_notes(spark):
    texts = ["## time resolution: 360", "## time resolution:250.5 ", "## time resolution: x", "time resolution: 1"]
    rows = [(f"r{i}", 0, 0, 22, t) for i, t in enumerate(texts)]
    rates = ann.definitions(spark.createDataFrame(rows, "record string, ann_no long, sample long, label_store int, aux_note string"))[0]
    assert {(r.record, r.fs) for r in rates.collect()} == {("r0", 360.0), ("r1", 250.5)}

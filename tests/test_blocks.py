"""Long records over many blocks, null keys, and files in odd forms."""

import random
import struct

import pytest
from pyspark.sql import functions as F

from pulselake.functions import header, ordered, times
from pulselake.operators import annotations as ann
from pulselake.operators import segments as seg
from pulselake.operators import signals as sig
from pulselake.sources import annotations as ann_files
from pulselake.sources import headers, registry, signals


def test_blocks_give_what_a_whole_window_does(spark):
    rng = random.Random(1)
    rows = [(rng.choice([1, 1, 1, 2, None]), rng.choice([None, *range(0, 5000, 7)]), i, rng.choice([None, i])) for i in range(1200)]
    df = spark.createDataFrame(rows, "k long, s long, i long, v long")
    block = F.expr("s div 100")
    out = ordered.with_previous(df, "k", "s", block, ["i"], value="i")
    out = ordered.with_running_sum(out, "k", "s", block, F.col("i"), ["i"])
    out = ordered.with_known(out, "k", "s", block, F.col("v"), ["i"], "last")
    out = ordered.with_known(out, "k", "s", block, F.col("v"), ["i"], "next", ahead=True)
    got = {r.i: (r.previous, r.running, r["last"], r["next"]) for r in out.collect()}
    want = {}
    for k in (1, 2, None):
        own = sorted((r for r in rows if r[0] == k), key=lambda r: (r[1] is not None, r[1] or 0, r[2]))
        total = 0
        for n, r in enumerate(own):
            total += r[2]
            want[r[2]] = (own[n - 1][2] if n else None, total, next((x[3] for x in own[n::-1] if x[3] is not None), None), next((x[3] for x in own[n:] if x[3] is not None), None))
    assert got == want


def test_one_long_record(spark):
    beats = [(1, i * 40_000 + i % 7, i, "N") for i in range(600)]  # over five blocks
    assert beats[-1][1] > 5 * ann.BLOCK
    df = spark.createDataFrame(beats, "record long, sample long, ann_no long, symbol string")
    rr = {r.sample: r.rr for r in ann.rr_intervals(df, 360.0).collect()}
    assert rr == {b[1]: b[1] - a[1] for a, b in zip(beats, beats[1:])}
    lengths = spark.createDataFrame([(1, beats[-1][1] + 500)], "record long, sig_len long")
    steps = sorted((r.start_sample, r.end_sample) for r in ann.hr_steps(df, 360.0, lengths).collect())
    assert len(steps) == 598 and steps[-1] == (beats[-2][1] + 1, beats[-1][1] + 499)


def test_gaps_and_plateaus_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(sig, "BLOCK", 4)
    values = [None, 1.0, None, None, None, None, None, None, None, 9.0, 3.0, 3.0, 3.0, 3.0, 3.0, 3.0, 5.0, None]
    df = spark.createDataFrame([(None, 0, i, v) for i, v in enumerate(values)], "record long, ch int, sample long, pval double")
    got = [r.pval for r in sig.interpolate(df).orderBy("sample").collect()]
    assert got == [None, 1, 2, 3, 4, 5, 6, 7, 8, 9, 3, 3, 3, 3, 3, 3, 5, 5]
    assert [(r.sample, r.kind) for r in sig.soft_peaks(df.where("sample between 9 and 16")).collect()] == [(12, -1)]


def test_peaks_keep_their_distance(spark, monkeypatch):
    monkeypatch.setattr(sig, "BLOCK", 16)
    rng = random.Random(3)
    places = sorted(rng.sample(range(300), 90))
    taken = []
    for p in places:
        if not taken or p - taken[-1] >= 5:
            taken.append(p)
    df = spark.createDataFrame([(1, 0, p) for p in places], "record long, ch int, sample long")
    assert sorted(r.sample for r in sig.separated_peaks(df, 5).collect()) == taken


def test_overlaps_over_buckets(spark, monkeypatch):
    monkeypatch.setattr(seg, "BUCKET", 8)
    rng = random.Random(4)

    def ranges():
        cuts = sorted(rng.sample(range(200), 40))
        return [(1, a, b) for a, b in zip(cuts[::2], cuts[1::2])]

    one, two = ranges(), ranges()
    frames = [spark.createDataFrame(r, "record long, start long, end long") for r in (one, two)]
    want = sorted((1, max(a, c), min(b, d)) for _, a, b in one for _, c, d in two if max(a, c) < min(b, d))
    assert sorted(map(tuple, seg.overlaps(*frames).collect())) == want


def test_refusals(spark):
    df = spark.createDataFrame([(1, 0, 0, 40_000)], "record long, ch int, sample long, dval long")
    with pytest.raises(Exception, match="doesn't fit 16 bits"):
        sig.convert_type(df, 16).collect()
    records = spark.createDataFrame([("m", 1, 360.0, 11)], "record string, n_sig int, fs double, sig_len long")
    segments = spark.createDataFrame([("m", 0, "a", 10)], "record string, seg_no int, seg_name string, seg_len long")
    with pytest.raises(Exception, match="add up"):
        headers.multi_header_text(records, segments).collect()
    bad = spark.createDataFrame([(1, 5, 0, 99, "N")], "record long, sample long, ann_no long, label_store int, symbol string")
    with pytest.raises(ValueError, match="label_range"):
        ann_files.write_annotations(bad, "/nowhere", "atr")
    with pytest.raises(ValueError):
        signals.scan_plan(df, df, 5, 4)


def test_sources_have_names():
    r = registry.Registry()
    r.add(registry.Source("a", registry.LOCAL, "/data"))
    assert r.path("a", "x", "y.hea") == "/data/x/y.hea"
    for bad in (("b", registry.LOCAL, "data"), ("b", registry.WEB, "https://"), ("b", "other", "/x")):
        with pytest.raises(ValueError):
            registry.Source(*bad)
    with pytest.raises(ValueError):
        r.add(registry.Source("a", registry.LOCAL, "/other"))
    r.set_index("https://example.org/db/")
    assert r.index_root == "https://example.org/db"
    r.remove("a")
    r.reset()
    assert r.sources == {} and r.index_root is None


def test_optional_header_fields(spark):
    lines = spark.createDataFrame([(1, "x/3 2 250.5/10(7) 900 9:08:07.5 02/03/2004"), (2, "y 1")], "i int, line string")
    got = {r.i: r for r in header.parse_record_line(lines).collect()}
    assert (got[1].record, got[1].n_seg, got[1].fs, got[1].counter_freq, got[1].base_counter, got[1].sig_len) == ("x", 3, 250.5, 10.0, 7.0, 900)
    assert (got[2].record, got[2].n_seg, got[2].fs, got[2].sig_len, got[2].base_date) == ("y", None, 250.0, None, None)
    row = spark.createDataFrame([("a.dat", "16", 2, 3, 200.0, 5, "mV", 12, 0, 1, 2, "lead I", 64)], "f string, fmt string, spf int, skew int, g double, b int, u string, r int, z int, i int, c int, n string, o long")
    line = row.select(header.signal_line(*[F.col(c) for c in ("f", "fmt", "spf", "skew", "g", "b", "u", "r", "z", "i", "c", "n")], byte_offset=F.col("o")).alias("line"))
    back = header.parse_signal_line(line).first()
    assert (back.fmt, back.spf, back.skew, back.byte_offset, back.adc_gain, back.baseline, back.sig_name) == ("16", 2, 3, 64, 200.0, 5, "lead I")
    t = spark.range(1).select(times.parse_time(F.lit("[00:00:02 01/01/1970]"), 100.0, 7, F.lit(0)).alias("a"), times.parse_time(F.lit("e"), 100.0, 7).alias("b")).first()
    assert (t.a, t.b) == (200, 7)


def test_files_with_differences_offsets_and_eight_bits(spark, tmp_path):
    (tmp_path / "d.dat").write_bytes(b"\0" * 5 + bytes([3, 254, 1, 1, 250, 0]))
    schema = "record string, ch int, file_name string, fmt string, spf int, byte_offset long, init_value int"
    chs = spark.createDataFrame([("d", 0, "d.dat", "8", 1, 5, 10), ("d", 1, "d.dat", "8", 1, 5, 20)], schema)
    got = signals.read_signals(spark, f"{tmp_path}/*.dat", chs, 1, block_frames=6)
    assert sorted((r.ch, r.frame, r.dval) for r in got.collect()) == [(0, 1, 14), (0, 2, 8), (1, 1, 19), (1, 2, 19)]
    data = bytes([128, 0, 255, 130])
    (tmp_path / "w.wav").write_bytes(struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 40, b"WAVE", b"fmt ", 16, 1, 2, 100, 200, 2, 8, b"data", 4) + data)
    got = signals.read_wav(spark, f"{tmp_path}/*.wav")
    assert sorted((r.frame, r.ch, r.dval) for r in got.collect()) == [(0, 0, 0), (0, 1, -128), (1, 0, 127), (1, 1, 2)]


def test_notes_of_edf_files(spark, tmp_path):
    def text(x, n):
        return str(x).encode().ljust(n)

    notes = b"+0\x14\x14\0+0.5\x1525\x14Apnea\x14\0".ljust(40, b"\0")
    fields = [(16, ["II", "EDF Annotations"]), (80, ["", ""]), (8, ["uV", ""]), (8, [-100, -1]), (8, [100, 1]), (8, [-2048, -32768]), (8, [2047, 32767]), (80, ["", ""]), (8, [3, 20]), (32, ["", ""])]
    head = text(0, 8) + text("", 160) + b"01.01.8500.00.00" + text(768, 8) + text("EDF+C", 44) + text(2, 8) + text(1, 8) + text(2, 4) + b"".join(text(v, w) for w, vs in fields for v in vs)
    block = struct.pack("<3h", 1, -2, 3) + notes
    (tmp_path / "e.edf").write_bytes(head + block + struct.pack("<3h", 4, 5, 6) + b"+1\x14\x14\0".ljust(40, b"\0"))
    assert sorted((r.sample, r.dval) for r in signals.read_edf(spark, f"{tmp_path}/*.edf").collect()) == list(enumerate([1, -2, 3, 4, 5, 6]))
    assert [tuple(r) for r in signals.read_edf_annotations(spark, f"{tmp_path}/*.edf").collect()] == [("e", 0, 0.5, 25.0, "Apnea")]

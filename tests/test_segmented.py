"""Records of segments, from files to samples."""

import pytest

from pulselake.sources import headers, segmented, signals
from pulselake.sources.files import listed


def written(spark, folder):
    """Record v (variable layout): a (both signals), gap, b (only V, twice as many samples a frame), a again.
    Record f (fixed layout): a, c."""
    seg = [("v", 0, "lay", 0, False), ("v", 1, "a", 20, False), ("v", 2, None, 15, True), ("v", 3, "b", 12, False), ("v", 4, "a", 20, False), ("f", 0, "a", 20, False), ("f", 1, "c", 7, False)]
    segments = spark.createDataFrame(seg, "record string, seg_no long, seg_name string, seg_len long, is_gap boolean")
    rows = [("lay", 0, "~", "0", 1, 200.0, "II"), ("lay", 1, "~", "0", 1, 200.0, "V"), ("a", 0, "a.dat", "16", 1, 200.0, "II"), ("a", 1, "a.dat", "16", 1, 100.0, "V"), ("b", 0, "b.dat", "212", 1, 50.0, "V"), ("c", 0, "c.dat", "16", 1, 200.0, "II"), ("c", 1, "c2.dat", "16", 1, 200.0, "other")]
    channels = spark.createDataFrame([(r, c, f, t, s, 0, 0, g, 10, "mV", 12, 0, 0, 0, n) for r, c, f, t, s, g, n in rows], "record string, ch int, file_name string, fmt string, spf int, skew int, byte_offset long, adc_gain double, baseline int, units string, adc_res int, adc_zero int, init_value int, checksum int, sig_name string")
    values = {("a", c): [100 * c + i for i in range(20)] for c in (0, 1)} | {("b", 0): [-i for i in range(12)]} | {("c", c): [500 + 50 * c + i for i in range(7)] for c in (0, 1)}
    samples = spark.createDataFrame([(r, c, i, 0, i, v) for (r, c), own in values.items() for i, v in enumerate(own)], "record string, ch int, frame long, sub int, sample long, dval long")
    records = spark.createDataFrame([("v", 2, 250.0), ("f", 2, 250.0)], "record string, n_sig int, fs double")
    segmented.write_segments(records, segments, channels, samples, folder)
    none = [None] * 20
    want = {("v", "II"): values["a", 0] + none[:15] + none[:12] + values["a", 0], ("v", "V"): values["a", 1] + none[:15] + values["b", 0] + values["a", 1]}
    want |= {("f", "II"): values["a", 0] + values["c", 0], ("f", "V"): values["a", 1] + values["c", 1]}
    return want


@pytest.mark.parametrize(("start", "end", "names"), [(0, None, None), (5, 50, ["V", "II"]), (25, 30, None), (19, 48, ["V"]), (60, 90, None), (200, 300, None)])
def test_ranges_of_segments(spark, tmp_path, start, end, names):
    want = written(spark, str(tmp_path))
    tables = headers.read_headers(spark, f"{tmp_path}/*.hea")
    got = segmented.read_segments(spark, f"{tmp_path}/*.dat", *tables, start, end, names, block_frames=6).collect()
    order = names or ["II", "V"]
    stop = 10**6 if end is None else end
    expected = {(r, order.index(n), f): v for (r, n), own in want.items() if n in order for f, v in enumerate(own) if start <= f < stop}
    assert len(got) == len(expected) and {(r.record, r.ch, r.frame): r.dval for r in got} == expected
    gains = {("v", "II"): lambda f: 200, ("v", "V"): lambda f: 50 if 35 <= f < 47 else 100, ("f", "II"): lambda f: 200, ("f", "V"): lambda f: 100 if f < 20 else 200}
    assert all(r.pval == (None if r.dval is None else (r.dval - 10) / gains[r.record, order[r.ch]](r.frame)) for r in got)
    bare = segmented.read_segments(spark, f"{tmp_path}/*.dat", *tables, start, end, names, fill=False)
    assert bare.count() == sum(v is not None for v in expected.values())


def test_only_the_bytes_of_the_range_are_planned(spark, tmp_path):
    written(spark, str(tmp_path))
    tables, files = headers.read_headers(spark, f"{tmp_path}/*.hea"), listed(spark, f"{tmp_path}/*.dat")

    def planned(*args):
        return sorted((r.as_record, r.path.rsplit("/", 1)[1], r.n_bytes) for r in segmented.segment_plan(files, *tables, *args).collect())

    assert planned(36, 40, ["V"]) == [("v", "b.dat", 9)]  # of five frames, in pairs of three bytes
    assert planned(22, 30) == [("f", "c.dat", 14), ("f", "c2.dat", 14)]
    assert planned(22, 30, ["V"]) == [("f", "c2.dat", 14)]
    assert sum(n for *_, n in planned(0, 6)) * 3 < sum(n for *_, n in planned(0, 20))
    assert planned(500, 600) == []


def test_written_headers_say_the_lengths(spark, tmp_path):
    written(spark, str(tmp_path))
    records, channels, segments = headers.read_headers(spark, f"{tmp_path}/*.hea")
    assert {r.record: (r.n_seg, r.sig_len, r.layout) for r in records.where("n_seg is not null").collect()} == {"v": (5, 67, "variable"), "f": (2, 27, "fixed")}
    assert segments.count() == 7 and channels.where("record = 'b'").first().sig_name == "V"
    assert signals.scan_plan(listed(spark, f"{tmp_path}/*.dat"), channels).count() == 4

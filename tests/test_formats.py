"""Data sources: results, and the bytes that conditions leave to read."""

import pytest
from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, In, IsNotNull, LessThan, StringStartsWith

from pulselake.sources import annotations as ann_files
from pulselake.sources import formats, headers


@pytest.fixture
def folder(spark, tmp_path):
    rows = [("a", 0, "a.dat", "212", 1, 0, "II"), ("a", 1, "a.dat", "212", 2, 2, "V one"), ("a", 2, "a2.dat", "16", 1, 0, "ABP"), ("b", 0, "b.dat", "24", 1, 0, "II"), ("c", 0, "c.dat", "8", 1, 0, "II")]
    channels = spark.createDataFrame([(r, c, f, t, s, k, 0, 200.0, 5, "mV", 12, 0, 0, 0, n) for r, c, f, t, s, k, n in rows], "record string, ch int, file_name string, fmt string, spf int, skew int, byte_offset long, adc_gain double, baseline int, units string, adc_res int, adc_zero int, init_value int, checksum int, sig_name string")
    data = [(r, c, f, s, f, (f * 7 + c * 31 + s) % 300 - 100 if r != "c" else 1) for r, c, _, _, spf, _, _ in rows for f in range(50) for s in range(spf)]
    samples = spark.createDataFrame(data, "record string, ch int, frame long, sub int, sample long, dval long")
    headers.write_record(spark.createDataFrame([("a", 3, 100.0, 0), ("b", 1, 100.0, 0), ("c", 1, 100.0, 0)], "record string, n_sig int, fs double, sig_len int"), channels, samples, str(tmp_path))
    want = {(r, c, f, s): v for r, c, f, s, _, v in data if r != "c"}
    skewed = {k: want.get(("a", 1, k[2] + 2, k[3]), -2048) for k in want if k[:2] == ("a", 1)}
    first = 1  # the header's first value, from which differences go on
    return str(tmp_path), want | skewed | {("c", 0, f, 0): first + f + 1 for f in range(50)}


def planned(path, *filters):
    reader = formats.SignalReader({"path": path, "blockFrames": 12})
    left = list(reader.pushFilters(list(filters)))
    return sorted((r["path"].rsplit("/", 1)[1], r["from_byte"], r["n_bytes"]) for p in reader.partitions() for r in p.rows), left


def test_conditions_say_what_is_read(folder):
    path, _ = folder
    everything, _ = planned(path)
    assert sum(n for *_, n in everything) == 225 + 100 + 150 + 50
    frame, one = ("frame",), EqualTo(("record",), "b")
    assert planned(path, one, GreaterThanOrEqual(frame, 20), LessThan(frame, 30), IsNotNull(frame)) == ([("b.dat", 18 * 3, 36)], [])
    assert planned(path, EqualTo(("sig_name",), "ABP"), EqualTo(frame, 49)) == ([("a2.dat", 96, 4)], [])
    assert planned(path, In(("ch",), (2, 5)))[0] == [("a2.dat", 24 * i, 24 if i < 4 else 4) for i in range(5)]
    assert planned(path, one, EqualTo(("record",), "a"))[0] == [] and planned(path, one, GreaterThanOrEqual(frame, 50))[0] == []
    other = StringStartsWith(("record",), "a")
    assert planned(path, other)[1] == [other]
    half, _ = planned(path, LessThan(frame, 24))
    assert sum(n for *_, n in half) * 2 < sum(n for *_, n in everything) + 60


def test_rows_of_conditions(spark, folder):
    path, want = folder
    formats.register(spark)
    df = spark.read.format("waveform").option("blockFrames", 12).load(path)
    conditions = {"true": lambda r, c, f: True, "frame between 7 and 25": lambda r, c, f: 7 <= f <= 25, "record = 'a' and sig_name = 'V one'": lambda r, c, f: (r, c) == ("a", 1), "ch in (0, 2) and frame >= 45 and frame <> 47": lambda r, c, f: c in (0, 2) and f >= 45 and f != 47, "record = 'c' and frame > 10": lambda r, c, f: r == "c" and f > 10, "frame > 60": lambda r, c, f: False, "record like 'b%'": lambda r, c, f: r == "b"}
    for text, rule in conditions.items():
        got = {(r.record, r.ch, r.frame, r["sub"]): r.dval for r in df.where(text).collect()}
        assert got == {k: v for k, v in want.items() if rule(*k[:3])}, text
    assert df.where("record = 'a' and ch = 1 and frame = 49").select("pval").distinct().collect()[0][0] is None
    assert df.where("record = 'a' and ch = 0 and frame = 3").first().pval == (want["a", 0, 3, 0] - 5) / 200


def test_annotations(spark, tmp_path):
    rows = [(r, i, 100 * i, 1 + i, 0, 0, 0, "") for r in "ab" for i in range(20)]
    ann_files.write_annotations(spark.createDataFrame(rows, "record string, ann_no long, sample long, label_store int, subtype int, chan int, num int, aux_note string"), str(tmp_path), "qrs")
    formats.register(spark)
    df = spark.read.format("waveform_annotations").option("extension", "qrs").load(str(tmp_path))
    assert sorted(map(tuple, df.collect())) == rows
    assert sorted(map(tuple, df.where("record = 'b' and sample >= 300 and sample < 500").collect())) == [r for r in rows if r[0] == "b" and 300 <= r[2] < 500]
    reader = formats.AnnotationReader({"path": str(tmp_path), "extension": "qrs"})
    reader.pushFilters([EqualTo(("record",), "b")])
    assert [r["record"] for p in reader.partitions() for r in p.rows] == ["b"]
    assert formats.AnnotationReader({"path": str(tmp_path)}).partitions()[0].rows == []

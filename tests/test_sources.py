"""Files written and read again, and streams."""

from pyspark.sql import functions as F

from pulselake.sources import annotations as ann_files
from pulselake.sources import headers, signals, tables
from pulselake.streaming import live


def test_signal_file_by_bytes(spark):
    channels = spark.createDataFrame([("r", 0, "r.dat", "80", 1, 0), ("r", 1, "r.dat", "80", 1, 0)], "record string, ch int, file_name string, fmt string, spf int, byte_offset long")
    data = bytes(v + 128 for pair in zip((-20, -19, -16, -12), (-19, -16, -13, -11)) for v in pair)
    files = spark.createDataFrame([("r.dat", data)], "file_name string, content binary")
    got = signals.decode_files(files, channels)
    by_ch = {c: [r.dval for r in got.where(F.col("ch") == c).orderBy("sample").collect()] for c in (0, 1)}
    assert by_ch == {0: [-20, -19, -16, -12], 1: [-19, -16, -13, -11]}
    again = signals.encode_files(got, channels, "80").first()
    assert bytes(again.content) == data


def test_signal_formats_round_trip(spark):
    for fmt in ("16", "24", "32", "61", "160", "212", "310", "311"):
        channels = spark.createDataFrame([("r", 0, "r.dat", fmt, 2, 0), ("r", 1, "r.dat", fmt, 1, 0)], "record string, ch int, file_name string, fmt string, spf int, byte_offset long")
        rows = [("r", c, f, s, (f * 37 + c * 11 + s * 5) % 900 - 450) for f in range(20) for c, s in ((0, 0), (0, 1), (1, 0))]
        samples = spark.createDataFrame(rows, "record string, ch int, frame long, sub int, dval long")
        files = signals.encode_files(samples, channels, fmt)
        got = signals.decode_files(files, channels)
        assert sorted(tuple(r) for r in got.select("record", "ch", "frame", "sub", "dval").collect()) == sorted(rows), fmt


def test_headers_are_read(spark, tmp_path):
    (tmp_path / "a.hea").write_text("# first\na 2 360 1000 10:00:00\na.dat 212 200(1024)/mV 11 1024 995 -22131 0 MLII\n\na.dat 212 200/mV 11 1024 1011 20052 0 V5\n# 69 M\n")
    (tmp_path / "m.hea").write_text("m/3 2 360 30\nlay 0\ns1 10\n~ 20\n")
    records, channels, segments = headers.read_headers(spark, f"{tmp_path}/*.hea")
    got = {r.record: r for r in records.collect()}
    assert got["a"].sig_len == 1000 and got["a"].comments == ["first", "69 M"] and got["m"].n_seg == 3 and got["m"].layout == "variable"
    assert [(r.ch, r.sig_name, r.checksum, r.baseline) for r in channels.orderBy("ch").collect()] == [(0, "MLII", -22131, 1024), (1, "V5", 20052, 1024)]
    assert [(r.seg_no, r.seg_name, r.seg_len, r.is_gap) for r in segments.orderBy("seg_no").collect()] == [(0, "lay", 0, False), (1, "s1", 10, False), (2, "~", 20, True)]


def test_annotation_files_round_trip(spark, tmp_path):
    rows = [("r", 0, 1, 4, 0, 3, 0, ""), ("r", 1, 1000, 2, -5, 1, 7, "(N"), ("r", 2, 2000, 1, 0, 2, 7, "odd"), ("r", 3, 10_000_000_000, 3, 9, 3, 0, "café")]
    schema = "record string, ann_no long, sample long, label_store int, subtype int, chan int, num int, aux_note string"
    files = ann_files.encode_annotations(spark.createDataFrame(rows, schema)).collect()
    (tmp_path / "r.atr").write_bytes(bytes(files[0].content))
    got = ann_files.read_annotations(spark, f"{tmp_path}/r.atr").orderBy("ann_no")
    assert [tuple(r) for r in got.collect()] == rows


def test_tables(spark, tmp_path):
    (tmp_path / "s.csv").write_text("sample,II,V\n0,0.5,1\n1,,2\n")
    got = tables.read_signal_csv(spark, f"{tmp_path}/s.csv", ["II", "V"], "r")
    assert {(r.sig_name, r.sample, r.pval) for r in got.collect()} == {("II", 0, 0.5), ("V", 0, 1.0), ("II", 1, None), ("V", 1, 2.0)}
    (tmp_path / "a.csv").write_text("onset,duration,description\n1.5,,hello\n2,0.5,bye\n")
    got = tables.read_annotation_csv(spark, f"{tmp_path}/a.csv", 100.0, "r")
    assert {(r.sample, r.duration, r.aux_note) for r in got.collect()} == {(150, 0, "hello"), (200, 50, "bye")}
    (tmp_path / "RECORDS").write_text("100\tfirst one\n101\n\n")
    assert {(r.record, r.description) for r in tables.read_record_list(spark, f"{tmp_path}/RECORDS").collect()} == {("100", "first one"), ("101", None)}


def test_csv_files_in_splits(spark, tmp_path):
    for name, n in (("a", 400), ("b", 3), ("c", 0)):
        (tmp_path / f"{name}.csv").write_text("I,II\n" + "".join(f"{i / 4},{-i}\n" if i % 5 else f"{i / 4},\n" for i in range(n)))
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    try:
        got = tables.read_signal_csv(spark, f"{tmp_path}/*.csv", ["I", "II"], numbered=False)
        rows = {(r.record, r.sig_name, r["sample"]): r.pval for r in got.collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    assert rows == {(f, s, i): (i / 4 if s == "I" else -i if i % 5 else None) for f, n in (("a", 400), ("b", 3)) for s in ("I", "II") for i in range(n)}
    samples, channels = tables.csv_record(got, fmt=["16", "212"], baseline=5)
    assert {r.dval for r in samples.where("record = 'b'").collect()} == {5, 55, 105, -195, -395, -2048}
    assert {(r.record, r.ch, r.fmt, r.adc_gain) for r in channels.collect()} == {(f, c, t, 200.0) for f in "ab" for c, t in ((0, "16"), (1, "212"))}


def test_streams(spark, tmp_path):
    rows = [(1, i, i, "N" if i % 3 else "V") for i in range(0, 200, 2)] + [(2, 5, 900, "N")]
    df = spark.createDataFrame(rows, "record long, s long, ann_no long, symbol string").select("record", F.timestamp_seconds("s").alias("ts"), "ann_no", "symbol")
    df.coalesce(1).write.parquet(f"{tmp_path}/in")

    def run(transform, mode):
        stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
        name = f"out_{transform.__name__}"
        query = transform(stream).writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{tmp_path}/{name}").start()
        query.processAllAvailable()
        query.stop()
        return spark.table(name).collect()

    assert sum(r.n for r in run(live.label_counts, "complete")) == 101
    assert sum(r.n_beats for r in run(live.beat_rates, "complete")) == 101
    assert sorted(r.n_beats for r in run(live.beat_runs, "complete")) == [1, 100]
    rr = run(live.rr_intervals, "append")
    assert len(rr) == 99 and {r.rr_sec for r in rr} == {2.0}

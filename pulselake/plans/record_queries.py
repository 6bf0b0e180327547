"""Queries that write files and read them again: signals, annotations, headers, interchange formats."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulselake import dims
from pulselake.plans.annotation_queries import BOUNDS, LABELS, _bounds
from pulselake.plans.annotation_queries import WITH as ANN_WITH
from pulselake.plans.tables import REC_FORMATS, REC_SQL, SKEW, SKEWED, annotations, recording_channels, recording_records, recordings, table
from pulselake.sources import annotations as ann_files
from pulselake.sources import headers, segmented, signals, tables
from pulselake.sources.files import listed, scratch_folder, settled, write_parts

FROM, TO, BLOCK = 1000, 2000, 600
# The last frames of the skewed channel, of 32 bits, are missing.
WITH = f"""WITH rec AS {REC_SQL}, len AS (SELECT record, k, max(frame) + 1 AS n FROM rec GROUP BY record, k),
raw AS (SELECT record, k, ch, frame - CASE WHEN k = {SKEWED} AND ch = 1 THEN {SKEW} ELSE 0 END AS frame, dval FROM rec
  UNION ALL SELECT record, k, 1, unnest(range(n - {SKEW}, n)), -2147483648 FROM len WHERE k = {SKEWED})"""
PHYSICAL = "CASE WHEN dval <> -2147483648 THEN round((dval - 10 * ch) / (200.0::DOUBLE + 50 * ch), 6) END"
SIX = "CASE k " + " ".join(f"WHEN {i} THEN {signals.SIX[f]}" for i, f in enumerate(REC_FORMATS)) + " END"


def _written(spark: SparkSession, sf_dir: str) -> tuple[str, DataFrame, DataFrame]:
    """A folder with the recordings, their channels, and what was written."""
    folder, chs = scratch_folder(spark, "signals"), recording_channels(spark)
    return folder, chs, signals.write_signals(recordings(spark, sf_dir), chs, folder)


def k1_write_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _written(spark, sf_dir)[2]


def s7_scan_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, chs, _ = _written(spark, sf_dir)
    out = signals.read_signals(spark, f"{folder}/*.dat", chs, FROM, TO, physical=True, block_frames=BLOCK)
    return out.select("record", F.col("ch").cast("long").alias("ch"), "frame", "dval", F.round("pval", 6).alias("pval"))


def s8_samples_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Physical samples with a column a signal, in the order asked for."""
    folder, chs, _ = _written(spark, sf_dir)
    out = signals.read_signals(spark, f"{folder}/*.dat", chs, end=500, names=["II", "I"], physical=True).join(chs.select("record", "ch", "sig_name"), ["record", "ch"])
    wide = out.groupBy("record", "frame").pivot("sig_name", ["II", "I"]).agg(F.first("pval"))
    return wide.select("record", "frame", F.round("II", 6).alias("II"), F.round("I", 6).alias("I"))


def s9_one_channel(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, chs, _ = _written(spark, sf_dir)
    return signals.read_signals(spark, f"{folder}/*.dat", chs, FROM, numbers=[1], block_frames=BLOCK).select("record", "frame", "dval")


def s10_smoothed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four samples a frame, written and read as frame means, in one channel a file."""
    folder = scratch_folder(spark, "smoothed")
    s = recordings(spark, sf_dir).where("ch = 0").select("record", F.lit(0).alias("ch"), F.expr("frame div 4").alias("frame"), (F.col("frame") % 4).cast("int").alias("sub"), "dval")
    chs = recording_channels(spark).where("ch = 0").withColumn("spf", F.lit(4))
    signals.write_signals(s, chs, folder, BLOCK)
    return signals.read_signals(spark, f"{folder}/*.dat", chs, smooth=True).select("record", "frame", "dval")


#: Frames of a segment of a recording; of four segments the second has signal II only, the last is a gap.
SEGMENT = 300


def _segmented(spark: SparkSession, sf_dir: str) -> tuple[str, tuple[DataFrame, DataFrame, DataFrame]]:
    """A folder with the recordings in segments under a layout each, and its headers as they are read."""
    folder, s = scratch_folder(spark, "segments"), recordings(spark, sf_dir)
    number = F.expr(f"frame div {SEGMENT}")
    name = F.concat("record", F.lit("s"), number.cast("string"))
    there = s.withColumn("g", number).where("g % 4 <> 3 and (g % 4 <> 1 or ch = 1)")
    parts = there.select(name.alias("record"), "ch", (F.col("frame") % SEGMENT).alias("frame"), "sub", "sample", "dval")
    cut = s.groupBy("record", number.alias("g")).agg(F.count_distinct("frame").alias("seg_len"))
    segments = cut.select("record", (F.col("g") + 1).alias("seg_no"), F.concat("record", F.lit("s"), F.col("g").cast("string")).alias("seg_name"), "seg_len", (F.col("g") % 4 == 3).alias("is_gap"))
    layout = cut.select("record", F.lit(0).cast("long").alias("seg_no"), F.concat("record", F.lit("lay")).alias("seg_name"), F.lit(0).cast("long").alias("seg_len"), F.lit(False).alias("is_gap")).distinct()
    chs = recording_channels(spark).withColumn("skew", F.lit(0))
    own = cut.where("g % 4 <> 3").join(chs, "record").where("g % 4 <> 1 or ch = 1")
    seg_name = F.concat("record", F.lit("s"), F.col("g").cast("string"))
    own = own.select(seg_name.alias("seg"), F.concat(seg_name, F.lit(".dat")).alias("file_name"), *[c for c in chs.columns if c not in ("record", "file_name")]).withColumnRenamed("seg", "record")
    lay = chs.select(F.concat("record", F.lit("lay")).alias("record"), F.lit("~").alias("file_name"), *[c for c in chs.columns if c not in ("record", "file_name", "fmt")], F.lit("0").alias("fmt"))
    records = recording_records(spark).withColumn("sig_len", F.lit(0))
    segmented.write_segments(records, segments.unionByName(layout), own.unionByName(lay), parts, folder)
    return folder, headers.read_headers(spark, f"{folder}/*.hea")


def s7_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A range of records of segments, gaps and missing signals filled."""
    folder, tables_ = _segmented(spark, sf_dir)
    out = segmented.read_segments(spark, f"{folder}/*.dat", *tables_, 400, TO, ["II", "I"], block_frames=BLOCK)
    return out.select("record", F.col("ch").cast("long").alias("ch"), "frame", "dval", F.round("pval", 6).alias("pval"))


def s7_segment_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is read of each file for a range of one signal."""
    folder, tables_ = _segmented(spark, sf_dir)
    plan = segmented.segment_plan(listed(spark, f"{folder}/*.dat"), *tables_, 400, TO, ["I"], block_frames=BLOCK)
    return plan.select(F.col("as_record").alias("record"), F.expr(f"shift div {SEGMENT}").alias("segment"), "from_byte", "n_bytes", "keep_from", "keep_to")


def s11_byte_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, chs, _ = _written(spark, sf_dir)
    plan = signals.scan_plan(listed(spark, f"{folder}/*.dat"), chs, FROM, TO, block_frames=BLOCK)
    return plan.select("record", "first_frame", "n_frames", "from_byte", "n_bytes")


def s1_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headers of written records, read again."""
    folder = scratch_folder(spark, "records")
    headers.write_record(recording_records(spark).withColumn("sig_len", F.lit(0)), recording_channels(spark), recordings(spark, sf_dir), folder)
    records, chs, _ = headers.read_headers(spark, f"{folder}/*.hea")
    both = chs.join(headers.with_base_time(records).select("record", "sig_len", "base_micros"), "record")
    return both.select("record", F.col("ch").cast("long").alias("ch"), "fmt", "adc_gain", *[F.col(c).cast("long").alias(c) for c in ("baseline", "init_value", "checksum", "sig_len", "base_micros")])


def _annotated(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = annotations(spark, sf_dir)
    n = F.col("ann_no")
    return a.select("record", "sample", "ann_no", "symbol", (n % 7 - 3).cast("int").alias("subtype"), F.col("chan").cast("int").alias("chan"), (n % 2).cast("int").alias("num"), F.when(n % 3 == 0, F.col("event_type")).otherwise("").alias("aux_note"))


def _annotation_folder(spark: SparkSession, sf_dir: str) -> str:
    """Files of all records whose annotations rise with ann_no once they are numbered by sample."""
    folder = scratch_folder(spark, "annotations")
    a = _annotated(spark, sf_dir).withColumn("ann_no", F.expr("row_number() over (partition by record order by sample, ann_no)").cast("long"))
    ann_files.write_annotations(a, folder, "atr", dims.ann_labels(spark))
    return folder


def _read_back(out: DataFrame) -> DataFrame:
    return out.select(F.col("record").cast("long").alias("record"), "ann_no", "sample", *[F.col(c).cast("long").alias(c) for c in ("label_store", "subtype", "chan", "num")], "aux_note")


def k8_annotation_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read_back(ann_files.read_annotations(spark, f"{_annotation_folder(spark, sf_dir)}/*.atr"))


def s24_annotation_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    lo, hi = _bounds(annotations(spark, sf_dir))
    return _read_back(ann_files.read_annotations(spark, f"{_annotation_folder(spark, sf_dir)}/*.atr", lo, hi, shift=True))


def s26_definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frequencies and custom labels by their notes in annotation files."""
    n = table(spark, sf_dir, "nation")
    custom = n.select(F.col("n_regionkey").cast("string").alias("record"), (F.col("n_nationkey") + 20).cast("int").alias("label_store"), F.lower(F.substring("n_name", 1, 2)).alias("symbol"), F.col("n_name").alias("description"))
    fs = custom.select("record", (F.col("record").cast("double") / 2 + 250).alias("fs")).distinct()
    beats = custom.select("record", F.lit(100).cast("long").alias("sample"), F.lit(1).cast("long").alias("ann_no"), F.lit(1).alias("label_store")).distinct()
    folder = scratch_folder(spark, "definitions")
    ann_files.write_annotations(beats, folder, "atr", fs=fs, custom=custom)
    rates, labels, left = ann_files.read_defined(spark, f"{folder}/*.atr")
    counts = left.groupBy("record").agg(F.count("*").alias("n_left"))
    out = labels.join(rates, "record").join(counts, "record")
    return out.select("record", "fs", F.col("label_store").cast("long").alias("label_store"), "symbol", "description", "n_left")


def s29_edf(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, chs = scratch_folder(spark, "edf"), recording_channels(spark)
    s = recordings(spark, sf_dir)
    lengths = s.groupBy("record").agg((F.max("frame") + 1).alias("sig_len"))
    signals.write_edf(s, chs, recording_records(spark).join(lengths, "record"), folder)
    return signals.read_edf(spark, f"{folder}/*.edf", first=1, last=8, blocks=3).select("record", F.col("ch").cast("long").alias("ch"), "sample", "dval")


def s29_mixed_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recordings of two rates as EDF files: the second channel has two samples a frame of the first."""
    folder, s = scratch_folder(spark, "edf"), recordings(spark, sf_dir)
    half = F.when(F.col("ch") == 0, F.col("frame") % 2 == 0).otherwise(True)
    parts = s.where(half).select("record", "ch", F.expr("frame div 2").alias("frame"), F.when(F.col("ch") == 0, 0).otherwise(F.col("frame") % 2).cast("int").alias("sub"), "dval")
    lengths = parts.groupBy("record").agg((F.max("frame") + 1).alias("sig_len"))
    chs = recording_channels(spark).withColumn("spf", F.col("ch") + 1)
    signals.write_edf(parts, chs, recording_records(spark).withColumn("fs", F.lit(180.0)).join(lengths, "record"), folder)
    found = signals.edf_channels(spark, f"{folder}/*.edf").select("record", "ch", "spf", "fs", "base")
    out = signals.read_edf(spark, f"{folder}/*.edf", last=5, blocks=2).join(F.broadcast(found), ["record", "ch"])  # a row a channel
    return out.select("record", F.col("ch").cast("long").alias("ch"), "frame", F.col("sub").cast("long").alias("sub"), "dval", F.col("spf").cast("long").alias("spf"), "fs", "base")


def k11_edf_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = recordings(spark, sf_dir)
    lengths = s.groupBy("record").agg((F.max("frame") + 1).alias("sig_len"))
    return signals.write_edf(s, recording_channels(spark), recording_records(spark).join(lengths, "record"), scratch_folder(spark, "edf"))


def _lengths(spark: SparkSession, s: DataFrame) -> DataFrame:
    return recording_records(spark).join(s.groupBy("record").agg((F.max("frame") + 1).alias("sig_len")), "record")


def s31_wav(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, s = scratch_folder(spark, "wav"), recordings(spark, sf_dir)
    signals.write_wav(s, recording_channels(spark), _lengths(spark, s), folder)
    return signals.read_wav(spark, f"{folder}/*.wav", FROM, TO).select("record", F.col("ch").cast("long").alias("ch"), "frame", "dval")


def k13_wav_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = recordings(spark, sf_dir)
    return signals.write_wav(s, recording_channels(spark), _lengths(spark, s), scratch_folder(spark, "wav"))


def k12_mat_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = recordings(spark, sf_dir)
    return signals.write_mat(s, recording_channels(spark), _lengths(spark, s), scratch_folder(spark, "mat"))


def s27_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recordings as CSV files without sample numbers, read, calibrated, written as signal files, read again."""
    folder, s = scratch_folder(spark, "csv"), recordings(spark, sf_dir)
    lines = s.groupBy("record", "frame").agg(F.max(F.when(F.col("ch") == 0, F.col("dval"))).alias("a"), F.max(F.when(F.col("ch") == 1, F.col("dval"))).alias("b"))
    lines = lines.select(F.concat("record", F.lit(".csv")).alias("file_name"), (F.col("frame") + 1).alias("part"), F.encode(F.format_string("%.3f,%s\n", F.col("a") / 1000, F.when(F.col("frame") % 7 == 0, "").otherwise(F.format_string("%.3f", F.col("b") / 1000))), "UTF-8").alias("content"))
    heads = s.select(F.concat("record", F.lit(".csv")).alias("file_name"), F.lit(0).cast("long").alias("part"), F.lit(b"I,II\n").alias("content")).distinct()
    write_parts(lines.unionByName(heads), folder)
    got, chs = tables.csv_record(tables.read_signal_csv(spark, f"{folder}/*.csv", ["I", "II"], numbered=False), adc_gain=[1000.0, 500.0], baseline=[0, 7])
    got, chs = settled(got), settled(chs)
    signals.write_signals(got, chs, folder)
    out = signals.read_signals(spark, f"{folder}/*.dat", chs, physical=True)
    return out.select("record", F.col("ch").cast("long").alias("ch"), "frame", "dval", F.round("pval", 6).alias("pval"))


def s28_annotation_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as CSV files of seconds and texts, one for each of a few types."""
    folder = scratch_folder(spark, "notes")
    a = annotations(spark, sf_dir).select("event_type", "ann_no", (F.col("sample") % 100_000 / 8).alias("onset"))
    name = F.concat("event_type", F.lit(".csv")).alias("file_name")
    lines = a.select(name, (F.col("ann_no") + 1).alias("part"), F.encode(F.concat(F.col("onset").cast("decimal(12,3)").cast("string"), F.lit(",note "), F.col("ann_no").cast("string"), F.lit("\n")), "UTF-8").alias("content"))
    write_parts(lines.unionByName(a.select(name, F.lit(0).cast("long").alias("part"), F.lit(b"onset,description\n").alias("content")).distinct()), folder)
    out = tables.read_annotation_csv(spark, f"{folder}/*.csv", 16.0, duration=False)
    return out.select("record", "sample", "ann_no", F.col("subtype").cast("long").alias("subtype"), "aux_note", "duration")


def s35_record_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_folder(spark, "lists")
    text = table(spark, sf_dir, "nation").select(F.lit("RECORDS").alias("file_name"), F.col("n_nationkey").cast("long").alias("part"), F.encode(F.concat("n_name", F.lit("\t"), F.col("n_regionkey").cast("string"), F.lit("\n")), "UTF-8").alias("content"))
    write_parts(text, folder)
    return tables.read_record_list(spark, f"{folder}/RECORDS")


_ANN_ROWS = f"""{ANN_WITH}, coded AS (SELECT record, row_number() OVER (PARTITION BY record ORDER BY sample, ann_no) AS n, sample, CAST(label_store AS BIGINT) AS label_store, chan, event_type FROM ann JOIN {LABELS} ON ann.symbol = lab.symbol),
rows_ AS (SELECT record, n - 1 AS ann_no, sample, label_store, n % 7 - 3 AS subtype, chan, n % 2 AS num, CASE WHEN n % 3 = 0 THEN event_type ELSE '' END AS aux_note FROM coded)"""
# The numbers of annotations come from their order, so subtype, num and notes go by the event itself.
_ANN_ROWS = _ANN_ROWS.replace("chan, event_type FROM ann", "chan, event_type, ann_no AS e FROM ann").replace("n % 7 - 3", "e % 7 - 3").replace("n % 2 AS num", "e % 2 AS num").replace("n % 3 = 0", "e % 3 = 0")

QUERIES = {
    "k1_write_signals": (k1_write_signals, f"{WITH} SELECT record || '.dat' AS file_name, CAST(ceil(n * 2 * ({SIX}) / 6.0) AS BIGINT) AS n_bytes FROM len"),
    "s7_scan_range": (s7_scan_range, f"{WITH} SELECT record, CAST(ch AS BIGINT) AS ch, frame, dval, {PHYSICAL} AS pval FROM raw WHERE frame >= {FROM} AND frame < {TO}"),
    "s8_samples_wide": (s8_samples_wide, f'{WITH} SELECT record, frame, max(CASE WHEN ch = 1 THEN {PHYSICAL} END) AS "II", max(CASE WHEN ch = 0 THEN {PHYSICAL} END) AS "I" FROM raw WHERE frame >= 0 AND frame < 500 GROUP BY record, frame'),
    "s7_segments": (s7_segments, f"{WITH} SELECT record, CAST(1 - ch AS BIGINT) AS ch, frame, CASE WHEN there THEN dval END AS dval, CASE WHEN there THEN round((dval - 10 * ch) / (200.0::DOUBLE + 50 * ch), 6) END AS pval FROM (SELECT *, frame // {SEGMENT} % 4 <> 3 AND (frame // {SEGMENT} % 4 <> 1 OR ch = 1) AS there FROM rec WHERE frame >= 400 AND frame < {TO})"),
    "s7_segment_bytes": (s7_segment_bytes, f"{WITH}, g AS (SELECT record, k, n, unnest(range(0, (n + {SEGMENT - 1}) // {SEGMENT})) AS segment FROM len), c AS (SELECT *, greatest(0, 400 - segment * {SEGMENT}) AS lo, least({SEGMENT}, n - segment * {SEGMENT}, {TO} - segment * {SEGMENT}) AS hi FROM g WHERE segment % 4 NOT IN (1, 3)) SELECT record, segment, CAST((lo - lo % 6) * 2 * ({SIX}) / 6 AS BIGINT) AS from_byte, CAST(ceil((hi - lo + lo % 6) * 2 * ({SIX}) / 6.0) AS BIGINT) AS n_bytes, lo AS keep_from, hi AS keep_to FROM c WHERE lo < hi"),
    "s9_one_channel": (s9_one_channel, f"{WITH} SELECT record, frame, dval FROM raw WHERE ch = 1 AND frame >= {FROM}"),
    "s10_smoothed": (s10_smoothed, f"{WITH} SELECT record, frame // 4 AS frame, CAST(trunc(sum(dval) / 4.0) AS BIGINT) AS dval FROM rec WHERE ch = 0 GROUP BY record, frame // 4"),
    "s11_byte_ranges": (s11_byte_ranges, f"{WITH}, b AS (SELECT record, k, least(n, {TO} + CASE WHEN k = {SKEWED} THEN {SKEW} ELSE 0 END) AS hi FROM len), r AS (SELECT *, unnest(range({FROM - FROM % 6}, hi, {BLOCK})) AS first_frame FROM b) SELECT record, first_frame, least({BLOCK}, hi - first_frame) AS n_frames, CAST(first_frame * 2 * ({SIX}) / 6 AS BIGINT) AS from_byte, CAST(ceil(least({BLOCK}, hi - first_frame) * 2 * ({SIX}) / 6.0) AS BIGINT) AS n_bytes FROM r"),
    "s1_headers": (s1_headers, f"{WITH} SELECT rec.record, CAST(ch AS BIGINT) AS ch, {'CASE any_value(rec.k) ' + ' '.join(f'WHEN {i} THEN {chr(39)}{f}{chr(39)}' for i, f in enumerate(REC_FORMATS)) + ' END'} AS fmt, 200.0::DOUBLE + 50 * ch AS adc_gain, CAST(10 * ch AS BIGINT) AS baseline, arg_min(dval, frame) AS init_value, CAST(((sum(dval) % 65536) + 65536) % 65536 AS BIGINT) AS checksum, max(n) AS sig_len, CAST(epoch_us(TIMESTAMP '2003-02-01 10:00:00') AS BIGINT) AS base_micros FROM rec JOIN len ON len.record = rec.record GROUP BY rec.record, ch"),
    "k8_annotation_files": (k8_annotation_files, f"{_ANN_ROWS} SELECT * FROM rows_"),
    "s24_annotation_range": (s24_annotation_range, f"{_ANN_ROWS}, {BOUNDS} SELECT record, ann_no, sample - lo AS sample, label_store, subtype, chan, num, aux_note FROM rows_, b WHERE sample BETWEEN lo AND hi"),
    "s26_definitions": (s26_definitions, "SELECT CAST(n_regionkey AS VARCHAR) AS record, n_regionkey / 2.0::DOUBLE + 250 AS fs, CAST(n_nationkey + 20 AS BIGINT) AS label_store, lower(substr(n_name, 1, 2)) AS symbol, n_name AS description, CAST(1 AS BIGINT) AS n_left FROM nation"),
    "s29_edf": (s29_edf, f"{WITH} SELECT record, CAST(ch AS BIGINT) AS ch, frame AS sample, dval FROM rec WHERE frame >= 360 AND frame < 8 * 360 UNION ALL SELECT record, CAST(ch AS BIGINT), unnest(range(n, least(CAST(ceil(n / 360.0) AS BIGINT), 8) * 360)) AS sample, -32768 FROM len, (VALUES (0), (1)) AS c(ch)"),
    "s29_mixed_rates": (s29_mixed_rates, f"{WITH}, p AS (SELECT record, ch, frame // 2 AS frame, CASE WHEN ch = 1 THEN frame % 2 ELSE 0 END AS sub, dval FROM rec WHERE ch = 1 OR frame % 2 = 0), l AS (SELECT record, max(frame) + 1 AS n FROM p GROUP BY record), f AS (SELECT record, unnest(range(n, CAST(ceil(n / 180.0) * 180 AS BIGINT))) AS frame FROM l), a AS (SELECT * FROM p UNION ALL SELECT record, ch, frame, s, -32768 FROM f, (VALUES (0, 0), (1, 0), (1, 1)) AS c(ch, s)) SELECT record, CAST(ch AS BIGINT) AS ch, frame, CAST(sub AS BIGINT) AS sub, dval, CAST(ch + 1 AS BIGINT) AS spf, 180.0::DOUBLE AS fs, '01.02.0310.00.00' AS base FROM a WHERE frame < 5 * 180"),
    "k11_edf_bytes": (k11_edf_bytes, f"{WITH} SELECT record || '.edf' AS file_name, CAST(768 + ceil(n / 360.0) * 360 * 4 AS BIGINT) AS n_bytes FROM len"),
    "s31_wav": (s31_wav, f"{WITH} SELECT record, CAST(ch AS BIGINT) AS ch, frame, dval FROM rec WHERE frame >= {FROM} AND frame < {TO}"),
    "k13_wav_bytes": (k13_wav_bytes, f"{WITH} SELECT record || '.wav' AS file_name, 44 + n * 4 AS n_bytes FROM len"),
    "k12_mat_bytes": (k12_mat_bytes, f"{WITH} SELECT record || '.mat' AS file_name, CAST(184 + ceil(n * 4 / 8.0) * 8 AS BIGINT) AS n_bytes FROM len"),
    "s27_csv": (s27_csv, f"{WITH} SELECT record, CAST(ch AS BIGINT) AS ch, frame, CASE WHEN ch = 0 THEN dval WHEN frame % 7 = 0 THEN -32768 ELSE CAST(round_even(dval / 1000.0::DOUBLE * 500 + 7, 0) AS BIGINT) END AS dval, CASE WHEN ch = 0 THEN round(dval / 1000.0::DOUBLE, 6) WHEN frame % 7 > 0 THEN round((round_even(dval / 1000.0::DOUBLE * 500 + 7, 0) - 7) / 500.0::DOUBLE, 6) END AS pval FROM rec"),
    "s28_annotation_csv": (s28_annotation_csv, f"{ANN_WITH} SELECT event_type AS record, sample % 100000 * 2 AS sample, row_number() OVER (PARTITION BY event_type ORDER BY ann_no) - 1 AS ann_no, CAST(22 AS BIGINT) AS subtype, 'note ' || ann_no AS aux_note, CAST(0 AS BIGINT) AS duration FROM ann"),
    "s35_record_list": (s35_record_list, "SELECT n_name AS record, CAST(n_regionkey AS VARCHAR) AS description FROM nation"),
}

"""Header files (text) as tables of records, channels and segments, and back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulselake.functions import header
from pulselake.functions.times import timestamp_of
from pulselake.operators.signals import channel_features
from pulselake.sources.files import write_parts
from pulselake.sources.signals import write_signals


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, no, line: header lines in order without comments and blanks; and comments as they are."""
    text = spark.read.text(path, wholetext=True).select(F.element_at(F.split(F.col("_metadata.file_name"), r"\.hea$"), 1).alias("file"), F.split("value", "\r?\n").alias("lines"))
    lines = text.withColumn("lines", F.filter(F.transform("lines", F.trim), lambda x: x != ""))
    return lines.select("file", F.filter("lines", lambda x: ~x.startswith("#")).alias("lines"), F.transform(F.filter("lines", lambda x: x.startswith("#")), lambda x: F.regexp_replace(x, r"^[ \t#]+", "")).alias("comments"))


def read_headers(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(records, channels, segments) of header files. A record line with a number of segments makes a
    record of segments; it is of variable layout if its first segment has no samples."""
    lines = read_lines(spark, path)
    records = header.parse_record_line(lines.withColumn("line", F.get("lines", F.lit(0)))).drop("line")
    rest = records.select("record", "n_seg", F.posexplode(F.slice("lines", F.lit(2), F.greatest(F.size("lines") - 1, F.lit(0)))).alias("no", "line"))
    channels = header.parse_signal_line(rest.where("n_seg is null")).withColumnRenamed("no", "ch").drop("line", "n_seg")
    segments = header.parse_segment_line(rest.where("n_seg is not null")).withColumnRenamed("no", "seg_no").drop("line", "n_seg")
    first = segments.where("seg_no = 0").select("record", F.when(F.col("seg_len") == 0, "variable").otherwise("fixed").alias("layout"))
    return records.drop("lines", "file").join(first, "record", "left"), channels, segments


def with_base_time(records: DataFrame) -> DataFrame:
    """Adds base_micros (microseconds since the epoch, null without a date) and base_datetime."""
    out = records.withColumn("base_micros", header.base_micros(F.col("base_time"), F.col("base_date")))
    return out.withColumn("base_datetime", timestamp_of(F.col("base_micros")))


def segment_channels(segments: DataFrame, channels: DataFrame) -> DataFrame:
    """Signals of each segment of records of segments, by the headers of the segments themselves: record,
    seg_no, ch, sig_name. Gaps have none."""
    own = channels.select(F.col("record").alias("seg_name"), "ch", "sig_name")
    return segments.where(~F.col("is_gap")).select("record", "seg_no", "seg_name").join(own, "seg_name").drop("seg_name")


def _joined(first: DataFrame, lines: DataFrame, comments: DataFrame | None) -> DataFrame:
    """record, value: a first line, lines in the order of n, then comments in theirs."""
    parts = first.select("record", F.lit(0).alias("kind"), F.lit(0).cast("long").alias("n"), "line").unionByName(lines.select("record", F.lit(1).alias("kind"), F.col("n").cast("long").alias("n"), "line"))
    if comments is not None:
        parts = parts.unionByName(comments.select("record", F.lit(2).alias("kind"), F.col("n").cast("long").alias("n"), F.concat(F.lit("# "), F.col("comment")).alias("line")))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("kind", "n", "line"))), lambda x: x["line"])
    return parts.groupBy("record").agg(F.concat(F.array_join(ordered, "\n"), F.lit("\n")).alias("value"))


def _first_line(records: DataFrame) -> DataFrame:
    """The record line of each record, with those of the optional fields that the table has."""
    more = {c: F.col(c) for c in ("n_seg", "base_time", "base_date", "counter_freq", "base_counter") if c in records.columns}
    return records.select("record", header.record_line(F.col("record"), F.col("n_sig"), F.col("fs"), F.col("sig_len"), **more).alias("line"))


def header_text(records: DataFrame, channels: DataFrame, comments: DataFrame | None = None) -> DataFrame:
    """record, value: the text of each record's header; ``comments`` has record, n, comment. A file name
    that is null is that of the record."""
    more = {c: F.col(c) for c in ("byte_offset", "block_size") if c in channels.columns}
    name = F.coalesce("file_name", F.concat(F.col("record").cast("string"), F.lit(".dat")))
    line = header.signal_line(name, F.col("fmt"), F.col("spf"), F.col("skew"), F.col("adc_gain"), F.col("baseline"), F.col("units"), F.col("adc_res"), F.col("adc_zero"), F.col("init_value"), F.col("checksum"), F.col("sig_name"), **more)
    return _joined(_first_line(records), channels.select("record", F.col("ch").alias("n"), line.alias("line")), comments)


def multi_header_text(records: DataFrame, segments: DataFrame, comments: DataFrame | None = None) -> DataFrame:
    """record, value: the text of headers of records of segments (record, seg_no, seg_name, seg_len). A
    record whose length isn't that of its segments together raises an error."""
    total = segments.groupBy("record").agg(F.sum("seg_len").alias("_len"), F.count("*").alias("n_seg"))
    both = records.drop("n_seg").join(total, "record")
    wrong = F.raise_error(F.concat(F.lit("segments don't add up to the length of record "), F.col("record").cast("string"))).cast("long")
    both = both.withColumn("sig_len", F.when(F.col("sig_len") == F.col("_len"), F.col("sig_len")).otherwise(wrong))
    lines = segments.select("record", F.col("seg_no").alias("n"), header.segment_line(F.col("seg_name"), F.col("seg_len")).alias("line"))
    return _joined(_first_line(both), lines, comments)


def write_headers(text: DataFrame, folder: str) -> DataFrame:
    """Writes ``<record>.hea`` for each record of ``header_text`` or ``multi_header_text``; returns
    file_name and n_bytes."""
    return write_parts(text.select(F.concat(F.col("record").cast("string"), F.lit(".hea")).alias("file_name"), F.lit(0).cast("long").alias("part"), F.encode("value", "UTF-8").alias("content")), folder)


def write_record(records: DataFrame, channels: DataFrame, samples: DataFrame, folder: str) -> DataFrame:
    """Writes signal files and headers of records, with first value, checksum and length taken from the
    samples; returns file_name and n_bytes."""
    found = channel_features(samples).select("record", "ch", "init_value", "checksum")
    length = samples.groupBy("record").agg((F.max("frame") + 1).alias("sig_len"))
    own = channels.drop("init_value", "checksum").join(found, ["record", "ch"])
    text = header_text(records.drop("sig_len").join(length, "record"), own)
    return write_signals(samples, own, folder).unionByName(write_headers(text, folder))

"""Records of segments: read from the files of those segments alone that hold wanted samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulselake.operators.segments import offsets, required_segments
from pulselake.sources.files import listed
from pulselake.sources.headers import header_text, multi_header_text, write_headers
from pulselake.sources.signals import BLOCK_FRAMES, decode_ranges, scan_plan, write_signals

#: Frames that a row of missing samples stands for before it is spread out.
FILL = 1 << 16


def record_signals(segments: DataFrame, channels: DataFrame, names: list[str] | None = None) -> DataFrame:
    """record, place, sig_name, spf: the signals of records of segments, by the header of the first segment
    (the layout, or the first one with samples); with ``names`` these, in their order."""
    first = segments.where("seg_no = 0").select("record", "seg_name").join(channels.withColumnRenamed("record", "seg_name"), "seg_name")
    out = first.select("record", F.col("ch").cast("int").alias("place"), "sig_name", F.coalesce("spf", F.lit(1)).alias("spf"))
    if names is None:
        return out
    place = F.array_position(F.array(*[F.lit(n) for n in names]), F.col("sig_name")) - 1
    return out.where(F.col("sig_name").isin(names)).withColumn("place", place.cast("int"))


def _needed(segments: DataFrame, start: int, end: int | None) -> DataFrame:
    """Segments with samples of [start, end), and the part of each: seg_from, seg_to."""
    placed = offsets(segments)
    last = F.lit(1 << 62) if end is None else F.lit(end)
    return required_segments(placed, F.lit(start), last).where("seg_len > 0")


def _available(needed: DataFrame, channels: DataFrame, layout: DataFrame, signals: DataFrame) -> DataFrame:
    """Channels of needed segments that are wanted signals, with their place: by name in records of
    variable layout, by number in others."""
    own = needed.where(~F.col("is_gap")).join(channels.withColumnRenamed("record", "seg_name"), "seg_name").join(layout, "record")
    first = signals.select("record", F.col("sig_name").alias("_name"), F.col("first_ch").alias("_ch"), "place")
    same = F.when(F.col("layout") == "variable", F.col("sig_name") == F.col("_name")).otherwise(F.col("ch") == F.col("_ch"))
    return own.join(first, "record").where(same)


def segment_plan(files: DataFrame, records: DataFrame, channels: DataFrame, segments: DataFrame, start: int = 0, end: int | None = None, names: list[str] | None = None, block_frames: int = BLOCK_FRAMES) -> DataFrame:
    """The byte ranges (as ``scan_plan``, with as_record and shift) that hold the frames [start, end) of
    records of segments: of segments that overlap them and have a wanted signal, no others. A segment
    that a record has twice, or that several have, is read for each place."""
    signals = _numbered_signals(segments, channels, names)
    needed = _needed(segments, start, end)
    own = _available(needed, channels, records.select("record", "layout"), signals)
    use = F.concat_ws("/", F.col("record").cast("string"), F.col("seg_no").cast("string"))
    picked = own.select(use.alias("record"), "ch", "place")
    ranges = own.select(use.alias("record"), F.col("seg_from").alias("start"), F.col("seg_to").alias("end"), F.col("record").alias("as_record"), F.col("seg_start").alias("shift")).distinct()
    # The layout of a file says where its channels lie, so all channels of a used segment's files go along.
    lengths = needed.select("record", "seg_no", "seg_name", "seg_len").where("seg_name <> '~'")
    every = lengths.join(channels.drop("sig_len").withColumnRenamed("record", "seg_name"), "seg_name").select(use.alias("record"), *[c for c in channels.columns if c not in ("record", "sig_len")], F.col("seg_len").alias("sig_len"))
    every = every.join(picked, ["record", "ch"], "left").withColumn("place", F.coalesce("place", F.lit(-1)))
    return scan_plan(files, every, chosen=picked, block_frames=block_frames, ranges=ranges)


def _numbered_signals(segments: DataFrame, channels: DataFrame, names: list[str] | None) -> DataFrame:
    own = record_signals(segments, channels).select("record", F.col("place").alias("first_ch"), "sig_name")
    return own.join(record_signals(segments, channels, names), ["record", "sig_name"])


def read_segments(spark: SparkSession, path: str, records: DataFrame, channels: DataFrame, segments: DataFrame, start: int = 0, end: int | None = None, names: list[str] | None = None, fill: bool = True, block_frames: int = BLOCK_FRAMES) -> DataFrame:
    """Records of segments as one: record, ch (place of the signal, see ``record_signals``), frame, sub,
    sample, dval and pval of the frames [start, end).

    The three tables are those of ``read_headers`` over records and segments alike; ``path`` has the signal
    files. Gains are those of each segment. With ``fill`` there are rows where a segment is a gap or
    lacks the signal, with null values; without, only samples that are in files. Segments of format 8
    aren't read here. No samples are joined or shuffled: places and offsets go along with the plan.
    """
    plan = segment_plan(listed(spark, path), records, channels, segments, start, end, names, block_frames)
    out = decode_ranges(plan.repartition("path", "first_frame"), physical=True)
    if not fill:
        return out
    signals = _numbered_signals(segments, channels, names)
    needed = _needed(segments, start, end)
    have = _available(needed, channels, records.select("record", "layout"), signals).select("record", "seg_no", "place")
    gaps = needed.join(signals, "record").join(have, ["record", "seg_no", "place"], "left_anti")
    first, last = F.col("seg_start") + F.col("seg_from"), F.col("seg_start") + F.col("seg_to")
    spread = gaps.select("record", "place", "spf", last.alias("last"), F.explode(F.sequence(first, last - 1, F.lit(FILL).cast("long"))).alias("first"))
    spread = spread.select("record", "place", "spf", F.explode(F.sequence(F.col("first"), F.least(F.col("first") + FILL, F.col("last")) - 1)).alias("frame"))
    spread = spread.select("record", F.col("place").alias("ch"), "frame", "spf", F.explode(F.sequence(F.lit(0), F.col("spf") - 1)).alias("sub"))
    empty = [F.lit(None).cast(t).alias(n) for n, t in (("dval", "long"), ("pval", "double"))]
    return out.unionByName(spread.select("record", "ch", "frame", "sub", (F.col("frame") * F.col("spf") + F.col("sub")).alias("sample"), *empty))


def write_segments(records: DataFrame, segments: DataFrame, channels: DataFrame, samples: DataFrame, folder: str) -> DataFrame:
    """Writes records of segments: signal files and headers of the segments, and headers of the records
    (record, n_sig, fs, and what else a record line has). ``segments`` has record, seg_no, seg_name, seg_len,
    is_gap; ``channels`` and ``samples`` are those of the segments, by seg_name as record. A segment of
    length 0 is the layout of its record: only its header is written. Returns file_name and n_bytes."""
    names = F.when(F.col("is_gap"), "~").otherwise(F.col("seg_name"))
    named = segments.withColumn("seg_name", names)
    total = segments.groupBy("record").agg(F.sum("seg_len").alias("sig_len"))
    whole = multi_header_text(records.drop("sig_len").join(total, "record"), named)
    own = named.where("seg_name <> '~'").join(records.drop("n_sig", "sig_len"), "record").drop("record").withColumnRenamed("seg_name", "record")
    counts = channels.groupBy("record").agg(F.count("*").alias("n_sig"))
    heads = own.dropDuplicates(["record"]).join(counts, "record").withColumn("sig_len", F.col("seg_len"))
    text = header_text(heads.select("record", "n_sig", "fs", "sig_len"), channels)
    return write_signals(samples, channels, folder).unionByName(write_headers(whole.unionByName(text), folder))

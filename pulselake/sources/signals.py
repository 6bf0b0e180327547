"""Signal files: binary samples of several channels, frame by frame.

A scan is planned as byte ranges of frame blocks: only files with wanted channels, and only the bytes of
wanted frames, are read, by as many tasks as there are ranges. Files are written in parts of frame
blocks. Channels of a file are interleaved by frame and share its format.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pulselake import dims
from pulselake.functions.ordered import with_running_sum
from pulselake.operators.signals import average_frames, select_channels, to_physical
from pulselake.sources.files import listed, read_range, write_parts

#: Frames of a block; a multiple of 6, so that blocks of all formats begin at whole bytes.
BLOCK_FRAMES = 6 * 16384

# Fixed value: bytes of an EDF data record.
EDF_BLOCK = 61440
# Bytes of six samples, and samples and bytes of a group that is packed together.
SIX = {"8": 6, "80": 6, "16": 12, "61": 12, "160": 12, "24": 18, "32": 24, "212": 9, "310": 8, "311": 8}
MISSING = {f[0]: f[5] for f in dims.DAT_FORMATS}
PACKED = {"212": (2, 3), "310": (3, 4), "311": (3, 4)}


def _signed(v: np.ndarray, bits: int) -> np.ndarray:
    return np.where(v >= 1 << (bits - 1), v - (1 << bits), v)


def unpack(data: bytes, fmt: str, n: int) -> np.ndarray:
    """The first ``n`` samples of bytes in a format; those of format 8 are differences."""
    if fmt == "16":
        return np.frombuffer(data, "<i2", n).astype(np.int64)
    if fmt == "61":
        return np.frombuffer(data, ">i2", n).astype(np.int64)
    if fmt == "32":
        return np.frombuffer(data, "<i4", n).astype(np.int64)
    if fmt == "8":
        return np.frombuffer(data, np.int8, n).astype(np.int64)
    if fmt == "80":
        return np.frombuffer(data, np.uint8, n).astype(np.int64) - 128
    if fmt == "160":
        return np.frombuffer(data, "<u2", n).astype(np.int64) - 32768
    if fmt == "24":
        b = np.frombuffer(data, np.uint8, 3 * n).reshape(-1, 3).astype(np.int64)
        return _signed(b[:, 0] + (b[:, 1] << 8) + (b[:, 2] << 16), 24)
    if fmt not in PACKED:
        raise ValueError(f"format {fmt} can't be read here")
    size, width = PACKED[fmt]
    groups = -(-n // size)
    b = np.frombuffer(data[: groups * width].ljust(groups * width, b"\0"), np.uint8).reshape(-1, width).astype(np.int64)
    if fmt == "212":
        parts = [b[:, 0] + ((b[:, 1] & 15) << 8), b[:, 2] + ((b[:, 1] >> 4) << 8)]
    elif fmt == "310":
        parts = [(b[:, 0] >> 1) + ((b[:, 1] & 7) << 7), (b[:, 2] >> 1) + ((b[:, 3] & 7) << 7), (b[:, 1] >> 3) + ((b[:, 3] >> 3) << 5)]
    else:
        word = b[:, 0] + (b[:, 1] << 8) + (b[:, 2] << 16) + (b[:, 3] << 24)
        parts = [word & 1023, (word >> 10) & 1023, (word >> 20) & 1023]
    return _signed(np.stack(parts, 1).ravel()[:n], 12 if fmt == "212" else 10)


def pack(v: np.ndarray, fmt: str) -> bytes:
    """Bytes of samples in a format; for format 8 they are differences. A last group that isn't full is
    filled up with zeros, but for format 212, which ends with its last sample."""
    simple = {"16": "<i2", "61": ">i2", "32": "<i4", "8": "i1"}
    if fmt in simple:
        return v.astype(simple[fmt]).tobytes()
    if fmt == "80":
        return (v + 128).astype(np.uint8).tobytes()
    if fmt == "160":
        return (v + 32768).astype("<u2").tobytes()
    if fmt == "24":
        return (v & 0xFFFFFF).astype("<u4").view(np.uint8).reshape(-1, 4)[:, :3].tobytes()
    if fmt not in PACKED:
        raise ValueError(f"format {fmt} can't be written here")
    size, width = PACKED[fmt]
    g = np.pad(v, (0, -len(v) % size)).reshape(-1, size) & (4095 if fmt == "212" else 1023)
    if fmt == "212":
        b = [g[:, 0] & 255, (g[:, 0] >> 8) + ((g[:, 1] >> 8) << 4), g[:, 1] & 255]
    elif fmt == "310":
        b = [(g[:, 0] & 127) << 1, (g[:, 0] >> 7) + ((g[:, 2] & 31) << 3), (g[:, 1] & 127) << 1, (g[:, 1] >> 7) + ((g[:, 2] >> 5) << 3)]
    else:
        word = g[:, 0] + (g[:, 1] << 10) + (g[:, 2] << 20)
        b = [(word >> s) & 255 for s in (0, 8, 16, 24)]
    out = np.stack(b, 1).astype(np.uint8).tobytes()
    return out[: -(-3 * len(v) // 2)] if fmt == "212" else out


def _by_format(values: dict[str, int], fmt: str = "fmt") -> Column:
    out = None
    for name, v in values.items():
        out = F.when(F.col(fmt) == name, v) if out is None else out.when(F.col(fmt) == name, v)
    return out


def inferred_length(size: Column, fmt: str, per_frame: Column, byte_offset: Column) -> Column:
    """Frames that a file of ``size`` bytes holds."""
    return F.floor((size - byte_offset) * 6 / (_by_format(SIX, fmt) * per_frame)).cast("long")


def scan_plan(files: DataFrame, channels: DataFrame, start: int = 0, end: int | None = None, chosen: DataFrame | None = None, block_frames: int = BLOCK_FRAMES, ranges: DataFrame | None = None) -> DataFrame:
    """Byte ranges that hold the frames [start, end) of the chosen channels (record, ch; else all): record,
    path, fmt, chs (of the file, in order), wanted, first_frame, n_frames, from_byte, n_bytes, and the
    frames that are to be kept (keep_from, keep_to) of those in the file (total).

    With ``ranges`` (record, start, end) each record has frames of its own, and others aren't read; its
    further columns go along. Ranges begin at a multiple of 6 frames, and reach beyond the end by the
    largest skew. Format 8 holds differences, so its files are read from their beginning. ``files`` has
    file_name, path, length; a format that isn't known raises an error.
    """
    if block_frames % 6 or block_frames <= 0:
        raise ValueError("blocks are multiples of 6 frames")
    if start < 0 or (end is not None and end < start):
        raise ValueError("a range of frames begins at 0 or later and doesn't end before it begins")
    optional = {"skew": F.lit(0), "byte_offset": F.lit(0).cast("long"), "sig_len": F.lit(None).cast("long"), "place": F.col("ch"), "adc_gain": F.lit(None).cast("double"), "baseline": F.lit(None).cast("long")}
    own = channels.withColumns({c: v for c, v in optional.items() if c not in channels.columns})
    slots = F.array_sort(F.collect_list(F.struct("ch", F.coalesce("spf", F.lit(1)).alias("spf"), F.coalesce("skew", F.lit(0)).alias("skew"), "place", "adc_gain", "baseline")))
    layout = own.groupBy("record", "file_name").agg(slots.alias("chs"), F.first("fmt").alias("fmt"), F.coalesce(F.first("byte_offset"), F.lit(0)).alias("byte_offset"), F.max("sig_len").alias("sig_len"))
    picked = (own if chosen is None else own.join(chosen.select("record", "ch"), ["record", "ch"], "left_semi")).groupBy("record", "file_name").agg(F.array_sort(F.collect_list("ch")).alias("wanted"))
    out = layout.join(picked, ["record", "file_name"]).join(files, "file_name")
    six = F.coalesce(_by_format(SIX), F.raise_error(F.concat(F.lit("no such format: "), F.col("fmt"))).cast("int"))
    out = out.withColumn("per_frame", F.aggregate("chs", F.lit(0), lambda a, c: a + c["spf"])).withColumn("six", six)
    held = inferred_length(F.col("length"), "fmt", F.col("per_frame"), F.col("byte_offset"))
    total = F.least(held, F.coalesce(F.col("sig_len"), held))
    skew = F.array_max(F.transform("chs", lambda c: c["skew"]))
    more = [] if ranges is None else [c for c in ranges.columns if c not in ("record", "start", "end")]
    if ranges is None:
        out = out.withColumns({"start": F.lit(start).cast("long"), "end": F.lit(end).cast("long")})
    else:
        out = out.join(ranges, "record")
    out = out.withColumns({"total": total, "keep_from": F.col("start"), "keep_to": F.least(total, F.coalesce("end", total))}).where("keep_from < keep_to")
    out = out.withColumn("lo", F.when(F.col("fmt") == "8", F.lit(0).cast("long")).otherwise(F.col("keep_from") - F.col("keep_from") % 6))
    out = out.withColumn("hi", F.least("total", F.col("keep_to") + skew))
    out = out.withColumn("first_frame", F.explode(F.sequence("lo", F.col("hi") - 1, F.lit(block_frames).cast("long"))))
    out = out.withColumn("n_frames", F.least(F.lit(block_frames), F.col("hi") - F.col("first_frame")))
    n = F.col("n_frames") * F.col("per_frame")
    size, width = _by_format({f: PACKED.get(f, (1, 0))[0] for f in SIX}), _by_format({f: PACKED.get(f, (1, SIX[f] // 6))[1] for f in SIX})
    out = out.withColumn("from_byte", F.col("byte_offset") + (F.col("first_frame") * F.col("per_frame") * F.col("six") / 6).cast("long"))
    out = out.withColumn("n_bytes", F.least((F.ceil(n / size) * width).cast("long"), F.col("length") - F.col("from_byte")))
    return out.select("record", "path", "fmt", "chs", "wanted", "first_frame", "n_frames", "from_byte", "n_bytes", "keep_from", "keep_to", "total", *more, *[c for c in files.columns if c == "content"])


def decode_ranges(plan: DataFrame, physical: bool = False) -> DataFrame:
    """record, ch, frame, sub, sample, dval of the ranges of a plan, skew taken out: the frames that are to
    be kept. The last frames of a skewed channel are missing samples (but in format 8). A plan with a
    column content has the files' bytes with it; one with columns as_record and shift gives frames of
    another record, from the frame ``shift`` of it on. With ``physical`` there is pval by the plan's
    gains, null for missing samples."""
    content, moved = "content" in plan.columns, "as_record" in plan.columns
    key = "as_record" if moved else "record"
    kind = plan.schema[key].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column(batch.schema.get_field_index(key))
            for i, row in enumerate(batch.to_pylist()):
                data = row["content"][row["from_byte"] : row["from_byte"] + row["n_bytes"]] if content else read_range(row["path"], row["from_byte"], row["n_bytes"])
                for c, sub, frame, v, pval in decoded_channels(row, data, physical):
                    frame = frame + (row["shift"] if moved else 0)
                    same = pa.array(np.zeros(len(v), np.int64))
                    arrays = [names.slice(i, 1).take(same), *map(pa.array, (np.full(len(v), c["place"], np.int32), frame, np.full(len(v), sub, np.int32), frame * c["spf"] + sub, v))]
                    yield pa.RecordBatch.from_arrays([*arrays, pval] if physical else arrays, names=["record", "ch", "frame", "sub", "sample", "dval", "pval"][: len(arrays) + physical])

    return plan.mapInArrow(run, f"record {kind}, ch int, frame long, sub int, sample long, dval long" + ", pval double" * physical)


def decoded_channels(row: dict, data: bytes, physical: bool = False) -> Iterator[tuple[dict, int, np.ndarray, np.ndarray, pa.Array | None]]:
    """(channel, sub, frames, dval, pval or None) of the wanted channels in a range of ``scan_plan`` and
    its bytes: the frames that are to be kept."""
    slots = [(c, k) for c in row["chs"] for k in range(c["spf"])]
    values = unpack(data, row["fmt"], row["n_frames"] * len(slots)).reshape(-1, len(slots))
    no_value = MISSING.get(row["fmt"])
    for j, (c, sub) in enumerate(slots):
        if c["ch"] not in row["wanted"]:
            continue
        frame, v = np.arange(len(values)) + row["first_frame"] - c["skew"], values[:, j]
        if c["skew"] and no_value is not None and row["first_frame"] + row["n_frames"] == row["total"]:
            tail = np.arange(max(0, row["total"] - c["skew"]), row["total"])
            frame, v = np.append(frame, tail), np.append(v, np.full(len(tail), no_value))
        keep = (frame >= (0 if row["fmt"] == "8" else row["keep_from"])) & (frame < row["keep_to"])
        frame, v = frame[keep], v[keep]
        yield c, sub, frame, v, pa.array((v - c["baseline"]) / c["adc_gain"], mask=v == no_value if no_value is not None else None) if physical else None


def _summed(samples: DataFrame, channels: DataFrame, start: int) -> DataFrame:
    """Samples of format 8: running sums of the differences, from the value of the header on."""
    first = channels.select("record", "ch", F.coalesce("init_value", F.lit(0)).cast("long").alias("_first")) if "init_value" in channels.columns else channels.select("record", "ch", F.lit(0).cast("long").alias("_first"))
    out = with_running_sum(samples, ["record", "ch"], "sample", F.expr(f"sample div {BLOCK_FRAMES}"), F.col("dval"), name="_sum").join(first, ["record", "ch"])
    return out.withColumn("dval", F.col("_sum") + F.col("_first")).drop("_sum", "_first").where(F.col("frame") >= start)


def decode_files(files: DataFrame, channels: DataFrame, start: int = 0, end: int | None = None) -> DataFrame:
    """record, ch, frame, sub, sample, dval of signal files that are rows (file_name, content)."""
    plan = scan_plan(files.select("file_name", F.col("file_name").alias("path"), F.length("content").cast("long").alias("length"), "content"), channels, start, end)
    return _decoded(plan, channels, start, end)


def _decoded(plan: DataFrame, channels: DataFrame, start: int, end: int | None) -> DataFrame:
    plain = decode_ranges(plan.where("fmt <> '8'"))
    return plain.unionByName(_summed(decode_ranges(plan.where("fmt = '8'")), channels, start))


def read_signals(spark: SparkSession, path: str, channels: DataFrame, start: int = 0, end: int | None = None, names: list[str] | None = None, numbers: list[int] | None = None, physical: bool = False, smooth: bool = False, skewed: bool = False, block_frames: int = BLOCK_FRAMES) -> DataFrame:
    """Samples of the files of a path: record, ch, frame, sub, sample, dval.

    ``channels`` is a table of a header (file_name, fmt, spf, skew, byte_offset, and sig_len where it is
    known). ``start`` and ``end`` are frames, half open; channels are all, or those of ``names`` or
    ``numbers``. With ``physical`` there is pval too (null for missing samples), by adc_gain and
    baseline. ``smooth`` gives the mean of each frame: record, ch, frame and the value. Skew is taken
    out unless ``skewed``. A block's task reads the bytes of its own range alone.
    """
    own = channels.withColumn("skew", F.lit(0)) if skewed else channels
    chosen = select_channels(own, names, numbers) if names is not None or numbers is not None else None
    plan = scan_plan(listed(spark, path), own, start, end, chosen, block_frames)
    out = _decoded(plan.repartition("path", "first_frame"), own, start, end)
    if physical:
        invalid = F.broadcast(dims.dat_formats(spark).select("fmt", "invalid"))  # ten rows
        scale = own.select("record", "ch", "fmt", "adc_gain", "baseline").join(invalid, "fmt", "left")
        out = to_physical(out.join(scale, ["record", "ch"]), F.col("adc_gain"), F.col("baseline"), F.coalesce("invalid", F.lit(-(2**62)))).drop("fmt", "adc_gain", "baseline", "invalid")
    if smooth:
        spf = own.select("record", "ch", "spf")
        return average_frames(out.join(spf, ["record", "ch"]), F.max("spf"), digital=not physical)
    return out


# --- writing ---


def encode_parts(samples: DataFrame, channels: DataFrame, block_frames: int = BLOCK_FRAMES, by_channel: bool = False) -> DataFrame:
    """file_name, part, content: the samples (record, ch, frame, sub, dval) of each file in blocks of
    frames, packed in its format; a null sample is the format's missing one. ``by_channel`` puts a
    block's samples channel by channel instead of frame by frame. Samples come to a block's task in
    order, so that it holds one block at a time, and no more."""
    if block_frames <= 0 or (block_frames % 6 and not by_channel):
        raise ValueError("blocks are multiples of 6 frames")
    own = samples.join(channels.select("record", "ch", "file_name", "fmt"), ["record", "ch"]).withColumn("part", F.expr(f"frame div {block_frames}"))
    order = ["ch", "frame", "sub", "dval"] if by_channel else ["frame", "ch", "sub", "dval"]
    rows = own.repartition("file_name", "part").sortWithinPartitions("file_name", "part", *order)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held, done = None, [], []

        def close() -> None:
            name, part, fmt = block
            done.append((name, part, pack(np.concatenate(held), fmt)))
            held.clear()

        def closed() -> pa.RecordBatch:
            out = [pa.array(c, t) for c, t in zip(zip(*done, strict=True), (pa.string(), pa.int64(), pa.binary()), strict=True)]
            done.clear()
            return pa.RecordBatch.from_arrays(out, names=["file_name", "part", "content"])

        for batch in batches:
            if not batch.num_rows:
                continue
            names, parts = (batch.column(i).dictionary_encode().indices.fill_null(-1).to_numpy() for i in range(2))
            begins = [0, *np.flatnonzero((names[1:] != names[:-1]) | (parts[1:] != parts[:-1])) + 1]
            for i, j in zip(begins, [*begins[1:], batch.num_rows], strict=True):
                key = tuple(batch.column(c)[int(i)].as_py() for c in range(3))
                if held and key[:2] != block[:2]:
                    close()
                if not held:
                    block = key
                held.append(batch.column(3).slice(i, j - i).fill_null(MISSING.get(block[2]) or 0).to_numpy())
            if done:
                yield closed()
        if held:
            close()
            yield closed()

    return rows.select("file_name", "part", "fmt", "dval").mapInArrow(run, "file_name string, part long, content binary")


def encode_files(samples: DataFrame, channels: DataFrame, fmt: str) -> DataFrame:
    """record, file_name, content: one row a file, for files that fit a row."""
    files = channels.select("record", "file_name").distinct()
    parts = encode_parts(samples, channels.withColumn("fmt", F.lit(fmt)))
    whole = parts.groupBy("file_name").agg(F.array_sort(F.collect_list(F.struct("part", "content"))).alias("p"))
    joined = F.aggregate(F.transform("p", lambda x: x["content"]), F.lit(b""), lambda a, x: F.concat(a, x))
    return whole.select("file_name", joined.alias("content")).join(files, "file_name").select("record", "file_name", "content")


def write_signals(samples: DataFrame, channels: DataFrame, folder: str, block_frames: int = BLOCK_FRAMES) -> DataFrame:
    """Writes the signal files of all records; returns file_name and n_bytes. Files with a byte offset
    begin with as many zeros."""
    parts = encode_parts(samples, channels, block_frames)
    if "byte_offset" in channels.columns:
        lead = channels.groupBy("file_name").agg(F.max("byte_offset").alias("n")).where("n > 0")
        parts = parts.unionByName(lead.select("file_name", F.lit(-1).cast("long").alias("part"), F.unhex(F.repeat(F.lit("00"), F.col("n").cast("int"))).alias("content")))
    return write_parts(parts, folder)


# --- interchange files ---


def _text(value: object, width: int) -> bytes:
    return str(value).encode("ascii", "replace")[:width].ljust(width)


def write_wav(samples: DataFrame, channels: DataFrame, records: DataFrame, folder: str) -> DataFrame:
    """A WAV file of 16 bits a sample for each record: ``<record>.wav``. ``records`` has record, n_sig,
    fs, sig_len; all channels have one sample a frame."""
    named = channels.withColumn("file_name", F.concat(F.col("record").cast("string"), F.lit(".wav"))).withColumn("fmt", F.lit("16"))
    heads = []
    for r in records.select(F.col("record").cast("string").alias("record"), "n_sig", "fs", "sig_len").toLocalIterator():  # a row a file
        n, width = r["n_sig"] * r["sig_len"] * 2, r["n_sig"] * 2
        head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", n + 36, b"WAVE", b"fmt ", 16, 1, r["n_sig"], int(r["fs"]), int(r["fs"]) * width, width, 16, b"data", n)
        heads.append((f"{r['record']}.wav", -1, bytearray(head)))
    lead = samples.sparkSession.createDataFrame(heads, "file_name string, part long, content binary")
    return write_parts(encode_parts(samples, named).unionByName(lead), folder)


def wav_channels(spark: SparkSession, path: str) -> DataFrame:
    """The channels of WAV files as a header would have them: record (the file's name without extension),
    ch, file_name, fmt, spf, skew, byte_offset, fs, sig_len, adc_gain, baseline. Chunks other than
    ``fmt `` and ``data`` are passed over; other than 8 or 16 bits raise an error."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for name, file_path, length in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                head = read_range(file_path, 0, min(length, 1 << 16))
                if head[:4] != b"RIFF" or head[8:12] != b"WAVE":
                    raise ValueError(f"{name} is no WAV file")
                at, form = 12, None
                while at + 8 <= len(head):
                    kind, size = struct.unpack_from("<4sI", head, at)
                    if kind == b"fmt ":
                        form = struct.unpack_from("<HHIIHH", head, at + 8)
                    if kind == b"data":
                        break
                    at += 8 + size + size % 2
                if form is None or form[5] not in (8, 16) or form[4] != form[1] * form[5] // 8:
                    raise ValueError(f"{name}: 8 or 16 bits a sample")
                frames = min(size, length - at - 8) // form[4]
                gain = 12.5 if form[5] == 8 else 6400.0  # fixed values of the format
                rows += [(name.rsplit(".", 1)[0], ch, name, "80" if form[5] == 8 else "16", 1, 0, at + 8, float(form[2]), frames, gain, 0) for ch in range(form[1])]
            kinds = [pa.string(), pa.int32(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.float64(), pa.int64(), pa.float64(), pa.int32()]
            names = [c.split()[0] for c in ddl.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * len(kinds), kinds, strict=True)], names=names)

    ddl = "record string, ch int, file_name string, fmt string, spf int, skew int, byte_offset long, fs double, sig_len long, adc_gain double, baseline int"
    return listed(spark, path).mapInArrow(run, ddl)


def read_wav(spark: SparkSession, path: str, start: int = 0, end: int | None = None) -> DataFrame:
    """record, ch, frame, sub, sample, dval of WAV files."""
    return read_signals(spark, path, wav_channels(spark, path), start, end)


def write_mat(samples: DataFrame, channels: DataFrame, records: DataFrame, folder: str) -> DataFrame:
    """A MAT-5 file for each record, ``<record>.mat``, with one matrix ``val`` of 16-bit samples: a row a
    channel, a column a frame."""
    named = channels.withColumn("file_name", F.concat(F.col("record").cast("string"), F.lit(".mat"))).withColumn("fmt", F.lit("16"))
    ends = []
    for r in records.select(F.col("record").cast("string").alias("record"), "n_sig", "sig_len").toLocalIterator():  # a row a file
        n = r["n_sig"] * r["sig_len"] * 2
        body = struct.pack("<IIII", 6, 8, 10, 0) + struct.pack("<IIii", 5, 8, r["n_sig"], r["sig_len"]) + struct.pack("<HH4s", 1, 3, b"val\0") + struct.pack("<II", 3, n)
        head = _text("MATLAB 5.0", 116) + b"\0" * 8 + struct.pack("<H2s", 0x0100, b"IM") + struct.pack("<II", 14, len(body) + n + -n % 8) + body
        ends += [(f"{r['record']}.mat", -1, bytearray(head)), (f"{r['record']}.mat", 1 << 60, bytearray(-n % 8))]
    more = samples.sparkSession.createDataFrame(ends, "file_name string, part long, content binary")
    return write_parts(encode_parts(samples, named).unionByName(more), folder)


def write_edf(samples: DataFrame, channels: DataFrame, records: DataFrame, folder: str, seconds: int = 1) -> DataFrame:
    """An EDF file for each record, ``<record>.edf``: data records of ``seconds``, the last one filled up
    with missing samples. ``channels`` has sig_name, units, adc_gain, baseline, spf; fs is whole. The date is
    that of base_date and base_time (``DD/MM/YYYY``, ``HH:MM:SS``), or 01.01.85 without them. Data records
    have at most 61,440 bytes."""
    named = channels.withColumn("file_name", F.concat(F.col("record").cast("string"), F.lit(".edf"))).withColumn("fmt", F.lit("16"))
    heads, parts, spark = [], None, samples.sparkSession
    layout = named.groupBy("record").agg(F.array_sort(F.collect_list(F.struct("ch", "sig_name", "units", "adc_gain", "baseline", "spf"))).alias("chs"))
    dated = [F.col(c) if c in records.columns else F.lit(None).cast("string").alias(c) for c in ("base_date", "base_time")]
    rows = records.join(layout, "record").select("record", "fs", "sig_len", "chs", *dated).collect()  # a row a file
    for r in rows:
        frames = int(r["fs"]) * seconds
        blocks, chs = -(-r["sig_len"] // frames), r["chs"]
        if 2 * frames * sum(c["spf"] for c in chs) > EDF_BLOCK:
            raise ValueError(f"record {r['record']}: data records of over {EDF_BLOCK} bytes, take fewer seconds")
        day = (r["base_date"] or "01/01/1985").split("/")
        began = ".".join([*day[:2], day[2][-2:]]) + (r["base_time"] or "00:00:00")[:8].replace(":", ".")
        fields = [(16, [c["sig_name"] for c in chs]), (80, [""] * len(chs)), (8, [c["units"] for c in chs])]
        fields += [(8, [f"{(x - c['baseline']) / c['adc_gain']:.6g}"[:8] for c in chs]) for x in (-32768, 32767)]
        fields += [(8, [-32768] * len(chs)), (8, [32767] * len(chs)), (80, [""] * len(chs)), (8, [frames * c["spf"] for c in chs]), (32, [""] * len(chs))]
        head = _text(0, 8) + _text("", 160) + _text(began, 16) + _text(256 * (len(chs) + 1), 8) + _text("", 44) + _text(blocks, 8) + _text(seconds, 8) + _text(len(chs), 4)
        heads.append((f"{r['record']}.edf", -1, bytearray(head + b"".join(_text(v, w) for w, vs in fields for v in vs))))
    for fs in sorted({r["fs"] for r in rows}):
        frames = int(fs) * seconds
        some = records.where(F.col("fs") == fs).select("record", "sig_len")
        fill = some.where(F.col("sig_len") % frames > 0).join(channels.select("record", "ch", "spf"), "record")
        fill = fill.withColumn("frame", F.explode(F.sequence(F.col("sig_len"), (F.floor(F.col("sig_len") / frames) + 1) * frames - 1)))
        fill = fill.select("record", "ch", "frame", F.explode(F.sequence(F.lit(0), F.col("spf") - 1)).alias("sub"), F.lit(-32768).cast("long").alias("dval"))
        own = samples.join(some.select("record"), "record", "left_semi").select("record", "ch", "frame", "sub", "dval")
        got = encode_parts(own.unionByName(fill), named, frames, by_channel=True)
        parts = got if parts is None else parts.unionByName(got)
    lead = spark.createDataFrame(heads, "file_name string, part long, content binary")
    return write_parts(lead if parts is None else parts.unionByName(lead), folder)


_EDF = "record string, file_name string, path string, ch int, sig_name string, units string, adc_gain double, baseline long, per_block int, before int, block_samples int, header_bytes long, n_blocks long, seconds double, kind string, base string, spf int, fs double"


def edf_channels(spark: SparkSession, path: str) -> DataFrame:
    """The signals of EDF files, from their headers: gain and baseline by the digital and physical
    extremes, per_block (samples in a data record) and where they lie. kind is ``signal`` or
    ``annotations``. Channels of a file may have different rates: its frames are as many as the greatest
    common divisor of their rates (fs), and each has spf samples of a frame. A channel with equal physical
    limits has gain 1, and its lowest digital value there."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for name, file_path, length in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                first = read_range(file_path, 0, 256).decode("latin-1")
                n = int(first[252:256])
                rest = read_range(file_path, 256, 256 * n).decode("latin-1")
                columns, at = [], 0
                for width in (16, 80, 8, 8, 8, 8, 8, 80, 8, 32):
                    columns.append([rest[at + i * width : at + (i + 1) * width].strip() for i in range(n)])
                    at += width * n
                per = [int(x) for x in columns[8]]
                held = (length - 256 * (n + 1)) // (2 * sum(per))
                blocks, seconds = int(first[236:244]), float(first[244:252])
                frames = math.gcd(*[p for p, name_ in zip(per, columns[0], strict=True) if name_ != "EDF Annotations"])
                for ch in range(n):
                    p_lo, p_hi, d_lo, d_hi = (float(columns[i][ch]) for i in (3, 4, 5, 6))
                    gain = (d_hi - d_lo) / (p_hi - p_lo) if p_hi != p_lo else 1.0
                    baseline = int(d_hi - p_hi * gain + 1) if p_hi != p_lo else int(d_lo - p_lo)
                    units = {"": "mV"}.get(columns[2][ch], columns[2][ch]).replace("µ", "u")
                    kind = "annotations" if columns[0][ch] == "EDF Annotations" else "signal"
                    rows.append((name.rsplit(".", 1)[0], name, file_path, ch, columns[0][ch], units, gain, baseline, per[ch], sum(per[:ch]), sum(per), 256 * (n + 1), held if blocks < 0 else min(held, blocks), seconds, kind, first[168:184], per[ch] // frames if kind == "signal" and frames else 1, frames / seconds if seconds else None))
            types = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "double": pa.float64()}
            fields = [c.split() for c in _EDF.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, types[t]) for c, (_, t) in zip(zip(*rows, strict=True) if rows else [[]] * len(fields), fields, strict=True)], names=[f[0] for f in fields])

    return listed(spark, path).mapInArrow(run, _EDF)


def _edf_blocks(channels: DataFrame, kind: str, first: int, last: int | None, blocks: int) -> DataFrame:
    """Ranges of data records [first, last) of files: record, path, place of each, and its channels."""
    chs = F.array_sort(F.collect_list(F.struct("ch", "before", "per_block", "spf")))
    files = channels.where(F.col("kind") == kind).groupBy("record", "path").agg(chs.alias("chs"), F.first("block_samples").alias("block_samples"), F.first("header_bytes").alias("header_bytes"), F.first("n_blocks").alias("n_blocks"))
    hi = F.col("n_blocks") if last is None else F.least(F.col("n_blocks"), F.lit(last))
    out = files.withColumn("hi", hi).where(F.col("hi") > first).withColumn("block", F.explode(F.sequence(F.lit(first).cast("long"), F.col("hi") - 1, F.lit(blocks).cast("long"))))
    return out.withColumn("n", F.least(F.lit(blocks), F.col("hi") - F.col("block"))).select("record", "path", "chs", "block_samples", "header_bytes", "block", "n").repartition("path", "block")


def read_edf(spark: SparkSession, path: str, first: int = 0, last: int | None = None, blocks: int = 256) -> DataFrame:
    """record, ch, frame, sub, sample, dval of the signals of EDF files, in data records [first, last); each
    task reads ``blocks`` data records at a time. Frames are those of ``edf_channels``, so channels of
    different rates go into signal files as they are."""
    plan = _edf_blocks(edf_channels(spark, path), "signal", first, last, blocks)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                size = row["block_samples"]
                raw = read_range(row["path"], row["header_bytes"] + 2 * size * row["block"], 2 * size * row["n"])
                values = np.frombuffer(raw, "<i2").reshape(-1, size)
                for c in row["chs"]:
                    v = values[:, c["before"] : c["before"] + c["per_block"]].ravel().astype(np.int64)
                    sample = np.arange(len(v)) + row["block"] * c["per_block"]
                    arrays = [pa.array([row["record"]] * len(v)), pa.array(np.full(len(v), c["ch"], np.int32)), pa.array(sample // c["spf"]), pa.array((sample % c["spf"]).astype(np.int32)), pa.array(sample), pa.array(v)]
                    yield pa.RecordBatch.from_arrays(arrays, names=["record", "ch", "frame", "sub", "sample", "dval"])

    return plan.mapInArrow(run, "record string, ch int, frame long, sub int, sample long, dval long")


def time_stamped_notes(raw: bytes) -> list[tuple[float, float | None, str]]:
    """(onset, duration, text) of the time-stamped lists of a data record; those without text only tell
    the record's time."""
    out = []
    for entry in raw.split(b"\0"):
        if not entry:
            continue
        at, *texts = entry.decode("utf-8", "replace").split("\x14")
        onset, _, duration = at.partition("\x15")
        out += [(float(onset), float(duration) if duration else None, t) for t in texts if t]
    return out


def read_edf_annotations(spark: SparkSession, path: str, blocks: int = 256) -> DataFrame:
    """record, block, onset and duration (seconds; null without one), aux_note of EDF+ files."""
    plan = _edf_blocks(edf_channels(spark, path), "annotations", 0, None, blocks)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                size = 2 * row["block_samples"]
                whole = read_range(row["path"], row["header_bytes"] + size * row["block"], size * row["n"])
                for k in range(row["n"]):
                    for c in row["chs"]:
                        raw = whole[size * k + 2 * c["before"] : size * k + 2 * (c["before"] + c["per_block"])]
                        rows += [(row["record"], row["block"] + k, *note) for note in time_stamped_notes(raw)]
            kinds = [pa.string(), pa.int64(), pa.float64(), pa.float64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 5, kinds, strict=True)], names=["record", "block", "onset", "duration", "aux_note"])

    return plan.mapInArrow(run, "record string, block long, onset double, duration double, aux_note string")

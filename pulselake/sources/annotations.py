"""Annotation files: two-byte words of a code and a delta, with fields of their own after them."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulselake.functions.ordered import with_previous
from pulselake.operators.annotations import apply_range, block_of, definitions, violations
from pulselake.sources.files import write_parts

# Codes of words that aren't annotations.
SKIP, NUM, SUB, CHAN, AUX = 59, 60, 61, 62, 63

_OUT = "record string, ann_no long, sample long, label_store int, subtype int, chan int, num int, aux_note string"


def decode(content: bytes, until: int | None = None) -> Iterator[tuple]:
    """(sample, label_store, subtype, chan, num, aux_note) of one file: it is a chain of words, each of
    which says what the next ones are. chan and num hold on until they change. Reading ends with the
    first annotation after ``until``. A subtype or note before any annotation belongs to none and is left
    out; what a file that breaks off has of its last word too."""
    at = sample = chan = num = 0
    current = None
    while at + 1 < len(content):
        low, high = content[at], content[at + 1]
        code, delta = high >> 2, low + 256 * (high & 3)
        at += 2
        if code == 0 and delta == 0:
            break
        if code == SKIP:
            step = int.from_bytes(content[at + 2 : at + 4] + content[at : at + 2], "little", signed=True)
            sample += step
            at += 4
        elif code == NUM:
            num = low
        elif code == CHAN:
            chan = low
        elif code == SUB:
            if current is not None:
                current[1] = low - 256 if low > 127 else low
        elif code == AUX:
            if current is not None:
                current[2] = content[at : at + low].decode("latin-1")
            at += low + low % 2
        else:
            if current is not None:
                yield current[0], current[3], current[1], current[4], current[5], current[2]
                if until is not None and current[0] > until:
                    return
            sample += delta
            current = [sample, 0, "", code, chan, num]
        if current is not None and code in (NUM, CHAN):
            current[4], current[5] = chan, num
    if current is not None:
        yield current[0], current[3], current[1], current[4], current[5], current[2]


def read_annotations(spark: SparkSession, path: str, start: int | None = None, end: int | None = None, shift: bool = False) -> DataFrame:
    """Annotations of files, by record (the file's name without its extension). Empty codes are left
    out. With ``start`` or ``end`` those of the closed range, decoded up to its end only; ``shift``
    counts samples from ``start``. A file is a chain of words, and read by one task."""
    files = spark.read.format("binaryFile").load(path).select(F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]*$", "").alias("record"), "content")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string()]
        for batch in batches:
            for record, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows = [(record, i, *r) for i, r in enumerate(decode(content, end)) if r[1]]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=[f.split()[0] for f in _OUT.split(", ")])

    out = files.mapInArrow(run, _OUT)
    return out if start is None and end is None else apply_range(out, start or 0, 2**62 if end is None else end, shift)


def read_defined(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(record, fs), (record, label_store, symbol, description) of custom labels, and the annotations
    without the notes that define them."""
    return definitions(read_annotations(spark, path))


def with_definitions(ann: DataFrame, fs: DataFrame | None = None, custom: DataFrame | None = None) -> DataFrame:
    """Annotations with notes at sample 0 before them that define the frequency (record, fs) and custom
    labels (record, label_store, symbol, description)."""

    def notes(df: DataFrame, order: object, text: object) -> DataFrame:
        return df.select("record", F.lit(0).cast("long").alias("sample"), order.cast("long").alias("ann_no"), F.lit(22).alias("label_store"), F.lit(0).alias("subtype"), F.lit(0).alias("chan"), F.lit(0).alias("num"), text.alias("aux_note"))

    out = ann.select("record", "sample", "ann_no", *[F.col(c).cast("int").alias(c) for c in ("label_store", "subtype", "chan", "num")], "aux_note")
    if fs is not None:
        rate = F.when(F.col("fs") == F.floor("fs"), F.floor("fs").cast("string")).otherwise(F.col("fs").cast("string"))
        out = out.unionByName(notes(fs, F.lit(-1000), F.concat(F.lit("## time resolution: "), rate)))
    if custom is not None:
        records = custom.select("record").distinct()
        out = out.unionByName(notes(records, F.lit(-999), F.lit("## annotation type definitions")))
        out = out.unionByName(notes(custom, F.lit(-900) + F.col("label_store"), F.concat_ws(" ", F.col("label_store").cast("string"), "symbol", "description")))
        out = out.unionByName(notes(records, F.lit(-1), F.lit("## end of definitions")))
    return out


def encode(step: int, label_store: int, subtype: int, chan: int | None, num: int | None, note: bytes) -> bytes:
    """The words of an annotation ``step`` samples after the one before; chan and num where they change. A
    step above 1023 takes words of its own, of at most 2**31 - 1 each."""
    out = bytearray()
    if step > 1023:
        while step > 0:
            part = min(step, 0x7FFFFFFF)
            out += bytes((0, SKIP << 2)) + (part >> 16).to_bytes(2, "little") + (part & 0xFFFF).to_bytes(2, "little")
            step -= part
    out += bytes((step & 255, label_store << 2 | step >> 8))
    if subtype:
        out += bytes((subtype & 255, SUB << 2))
    for code, value in ((CHAN, chan), (NUM, num)):
        if value is not None:
            out += bytes((value, code << 2))
    if note:
        out += bytes((len(note), AUX << 2)) + note + b"\0" * (len(note) % 2)
    return bytes(out)


def encode_parts(ann: DataFrame) -> DataFrame:
    """record, part, content: the bytes of annotation files in parts, one for each block of samples.
    Samples may not fall; chan and num are written where they change. What the annotation before had is
    carried once for all fields, and a block's rows stream through one task in order."""
    kind = ann.schema["record"].dataType.simpleString()
    now = F.struct(F.col("sample").cast("long").alias("sample"), F.col("chan").cast("int").alias("chan"), F.col("num").cast("int").alias("num"))
    both = with_previous(ann.withColumn("_now", now), "record", "sample", block_of(), ["ann_no"], "_before", "_now")
    own = [F.col(c).cast("int").alias(c) for c in ("label_store", "subtype", "chan", "num")]
    rows = both.select("record", block_of().alias("part"), F.col("sample").cast("long").alias("sample"), "ann_no", *own, "aux_note", *[F.coalesce(f"_before.{c}", F.lit(0)).alias(f"old_{c}") for c in ("sample", "chan", "num")])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, data, first = None, bytearray(), None

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([first, pa.array([place[1]], pa.int64()), pa.array([bytes(data)], pa.binary())], names=["record", "part", "content"])

        for batch in batches:
            for i, (record, part, sample, n, label, subtype, chan, num, note, *old) in enumerate(zip(*(c.to_pylist() for c in batch.columns), strict=True)):
                if (record, part) != place:
                    if place is not None:
                        yield done()
                    place, data, first = (record, part), bytearray(), batch.column(0).slice(i, 1)
                try:
                    text = (note or "").encode("latin-1")
                    if len(text) > 255 or sample < old[0]:
                        raise ValueError("a note of over 255 bytes" if len(text) > 255 else "falling samples")
                    data += encode(sample - old[0], label, subtype, chan if chan != old[1] else None, num if num != old[2] else None, text)
                except (ValueError, OverflowError) as e:
                    raise ValueError(f"record {record}, annotation {n}: {e}") from e
        if place is not None:
            yield done()

    ordered = rows.repartition("record", "part").sortWithinPartitions("record", "part", "sample", "ann_no")
    last = ann.select("record").distinct().select("record", F.lit(1 << 60).cast("long").alias("part"), F.lit(b"\0\0").alias("content"))
    return ordered.mapInArrow(run, f"record {kind}, part long, content binary").unionByName(last)


def encode_annotations(ann: DataFrame) -> DataFrame:
    """record, content: one row a file, for files that fit a row."""
    whole = encode_parts(ann).groupBy("record").agg(F.array_sort(F.collect_list(F.struct("part", "content"))).alias("p"))
    return whole.select("record", F.aggregate(F.transform("p", lambda x: x["content"]), F.lit(b""), lambda a, x: F.concat(a, x)).alias("content"))


def write_annotations(ann: DataFrame, folder: str, extension: str, labels: DataFrame | None = None, fs: DataFrame | None = None, custom: DataFrame | None = None) -> DataFrame:
    """Writes ``<record>.<extension>`` for each record; returns file_name and n_bytes.

    Where label_store is missing it is looked up by symbol in ``labels`` (standard ones with custom ones
    over them); absent subtype, chan, num and aux_note are 0 or empty. Rows that break a field's rule
    raise an error that names one.
    """
    out = ann
    if "label_store" not in ann.columns:
        if labels is None:
            raise ValueError("annotations without label_store need labels")
        out = out.join(F.broadcast(labels.select("symbol", "label_store")), "symbol", "left")  # fewer than 50 rows
    for column, value in (("subtype", 0), ("chan", 0), ("num", 0), ("aux_note", "")):
        out = out.withColumn(column, F.coalesce(column, F.lit(value)) if column in out.columns else F.lit(value))
    if "symbol" not in out.columns:
        out = out.withColumn("symbol", F.lit("N"))
    unknown = out.where("label_store is null").select("record", "ann_no", F.lit("no_label").alias("rule"))
    wrong = violations(out).unionByName(unknown).first()
    if wrong is not None:
        raise ValueError(f"record {wrong['record']}, annotation {wrong['ann_no']}: {wrong['rule']}")
    parts = encode_parts(with_definitions(out, fs, custom))
    return write_parts(parts.select(F.concat(F.col("record").cast("string"), F.lit(f".{extension}")).alias("file_name"), "part", "content"), folder)

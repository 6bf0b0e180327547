"""Signal and annotation files as data sources: ``spark.read.format("waveform").load(folder)``.

Conditions on record, ch, sig_name and frame (or on record and sample of annotations) reach the reader:
only files of wanted records are opened, only channels' files and the bytes of wanted frames are read.
Spark asks Python sources for that where ``spark.sql.python.filterPushdown.enabled`` is set, as
``register`` does; without it, it filters afterwards.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual

from pulselake.functions.header import DEFAULT_GAIN
from pulselake.sources.annotations import decode
from pulselake.sources.files import opened, read_range
from pulselake.sources.signals import BLOCK_FRAMES, PACKED, SIX, decoded_channels, unpack

#: Bytes of signal files, or of annotation files, that a partition reads.
PARTITION_BYTES = 32 << 20

_SIGNAL_LINE = re.compile(r"(?P<file>\S+)\s+(?P<fmt>\d+)(?:x(?P<spf>\d+))?(?::(?P<skew>\d+))?(?:\+(?P<offset>\d+))?(?:\s+(?P<gain>-?[\d.eE+-]+)?(?:\((?P<baseline>-?\d+)\))?(?:/(?P<units>\S+))?(?:\s+(?P<res>-?\d+)(?:\s+(?P<zero>-?\d+)(?:\s+(?P<first>-?\d+)(?:\s+-?\d+(?:\s+-?\d+(?:\s+(?P<name>.+))?)?)?)?)?)?)?\s*$")


def channels_of_header(text: str) -> tuple[str, int | None, list[dict]]:
    """(record, frames, channels) of a header; no channels for a record of segments."""
    lines = [x.strip() for x in text.splitlines() if x.strip() and not x.lstrip().startswith("#")]
    first = lines[0].split() if lines else [""]
    if "/" in first[0]:
        return first[0].split("/")[0], None, []
    out = []
    for ch, line in enumerate(lines[1:]):
        m = _SIGNAL_LINE.match(line)
        if m is None:
            raise ValueError(f"record {first[0]}: no signal line: {line}")
        gain = float(m["gain"] or 0) or DEFAULT_GAIN
        baseline = m["baseline"] if m["baseline"] is not None else m["zero"] or 0
        out.append({"ch": ch, "place": ch, "file": m["file"], "fmt": m["fmt"], "spf": int(m["spf"] or 1), "skew": int(m["skew"] or 0), "offset": int(m["offset"] or 0), "adc_gain": gain, "baseline": int(baseline), "first": int(m["first"] or 0), "sig_name": m["name"]})
    return first[0], int(first[3]) if len(first) > 3 else None, out


class Wanted:
    """What pushed conditions leave of columns: sets of values, and a range of one whole-number column."""

    def __init__(self, values: tuple[str, ...], ordered: str):
        self.sets: dict[str, set | None] = dict.fromkeys(values)
        self.ordered, self.low, self.high = ordered, 0, 1 << 62

    def push(self, f: Filter) -> bool:
        """Takes a condition, if it can be kept to here."""
        name = ".".join(f.attribute) if hasattr(f, "attribute") else None
        if name == self.ordered:
            if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                self.low = max(self.low, f.value + isinstance(f, GreaterThan))
            if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                self.high = min(self.high, f.value + (not isinstance(f, LessThan)))
            return isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual, IsNotNull))
        if name in self.sets and isinstance(f, (EqualTo, In)):
            values = {f.value} if isinstance(f, EqualTo) else set(f.value)
            self.sets[name] = values if self.sets[name] is None else self.sets[name] & values
            return True
        return name == "record" and isinstance(f, IsNotNull)

    def has(self, name: str, value: object) -> bool:
        return self.sets[name] is None or value in self.sets[name]


def _files(path: str, extension: str) -> Iterator[tuple[str, str, int]]:
    """(name without extension, path, bytes) of the files of a folder."""
    from pyarrow import fs

    system, inner = opened(path)
    scheme = path.split("://")[0] + "://" if "://" in path and not path.startswith("file:") else ""
    for info in sorted(system.get_file_info(fs.FileSelector(inner)), key=lambda i: i.path):
        stem, _, own = info.base_name.rpartition(".")
        if info.is_file and own == extension:
            yield stem, scheme + info.path, info.size


@dataclass
class Ranges(InputPartition):
    """Byte ranges of signal files (rows as those of ``scan_plan``), or annotation files."""

    rows: list[dict]


def _grouped(rows: Iterable[dict], size: str) -> list[InputPartition]:
    out, total = [], PARTITION_BYTES
    for row in rows:
        if total >= PARTITION_BYTES:
            out.append(Ranges([]))
            total = 0
        out[-1].rows.append(row)
        total += row[size]
    return out or [Ranges([])]


class SignalReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.block = options["path"].rstrip("/"), int(options.get("blockFrames", BLOCK_FRAMES))
        if self.block % 6 or self.block <= 0:
            raise ValueError("blocks are multiples of 6 frames")
        self.wanted = Wanted(("record", "ch", "sig_name"), "frame")

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        return [f for f in filters if not self.wanted.push(f)]

    def _rows(self) -> Iterator[dict]:
        """One row a byte range. Headers are read here, one for each wanted record."""
        for stem, path, size in _files(self.path, "hea"):
            if not self.wanted.has("record", stem):
                continue
            record, frames, channels = channels_of_header(read_range(path, 0, size).decode("utf-8", "replace"))
            by_file: dict[str, list[dict]] = {}
            for c in channels:
                by_file.setdefault(c["file"], []).append(c)
            for name, chs in by_file.items():
                picked = [c["ch"] for c in chs if self.wanted.has("ch", c["ch"]) and self.wanted.has("sig_name", c["sig_name"])]
                if name != "~" and picked and self.wanted.low < self.wanted.high:
                    yield from self._ranges(record, f"{path.rsplit('/', 1)[0]}/{name}", chs, picked, frames)

    def _ranges(self, record: str, path: str, chs: list[dict], picked: list[int], frames: int | None) -> Iterator[dict]:
        fmt, offset, per_frame = chs[0]["fmt"], chs[0]["offset"], sum(c["spf"] for c in chs)
        if fmt not in SIX:
            raise ValueError(f"record {record}: no such format: {fmt}")
        system, inner = opened(path)
        length = system.get_file_info(inner).size
        held = (length - offset) * 6 // (SIX[fmt] * per_frame)
        total = held if frames is None else min(frames, held)
        keep_to = min(total, self.wanted.high)
        last = min(total, keep_to + max(c["skew"] for c in chs))
        group, width = PACKED.get(fmt, (1, SIX[fmt] // 6))
        step = last if fmt == "8" else self.block  # differences are summed from the file's beginning on
        for first in range(0 if fmt == "8" else self.wanted.low - self.wanted.low % 6, last if self.wanted.low < keep_to else 0, max(step, 1)):
            n = min(step, last - first)
            at = offset + first * per_frame * SIX[fmt] // 6
            yield {"record": record, "path": path, "fmt": fmt, "chs": chs, "wanted": picked, "first_frame": first, "n_frames": n, "from_byte": at, "n_bytes": min(-(-n * per_frame // group) * width, length - at), "keep_from": self.wanted.low, "keep_to": keep_to, "total": total}

    def partitions(self) -> list[InputPartition]:
        return _grouped(self._rows(), "n_bytes")

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        for row in partition.rows:
            data = read_range(row["path"], row["from_byte"], row["n_bytes"])
            if row["fmt"] == "8":
                data, row = self._summed(row, data)
            for c, sub, frame, v, pval in decoded_channels(row, data, physical=True):
                n, frame_from = len(v), frame >= row["keep_from"]
                arrays = [pa.array([row["record"]] * n, pa.string()), pa.array(np.full(n, c["ch"], np.int32)), pa.array([c["sig_name"]] * n, pa.string()), pa.array(frame), pa.array(np.full(n, sub, np.int32)), pa.array(frame * c["spf"] + sub), pa.array(v), pval]
                yield pa.RecordBatch.from_arrays(arrays, names=["record", "ch", "sig_name", "frame", "sub", "sample", "dval", "pval"]).filter(pa.array(frame_from))

    @staticmethod
    def _summed(row: dict, data: bytes) -> tuple[bytes, dict]:
        """Samples of format 8 as those of 32 bits: running sums over each channel from its first value."""
        slots = [c for c in row["chs"] for _ in range(c["spf"])]
        values = unpack(data, "8", row["n_frames"] * len(slots)).reshape(-1, len(slots))
        out, at = np.empty_like(values), 0
        for c in row["chs"]:
            own = values[:, at : at + c["spf"]]
            out[:, at : at + c["spf"]] = (np.cumsum(own.ravel()) + c["first"]).reshape(own.shape)
            at += c["spf"]
        return out.astype("<i4").tobytes(), row | {"fmt": "32"}


class SignalSource(DataSource):
    """``waveform``: a folder of header and signal files. Option blockFrames: frames of a byte range."""

    @classmethod
    def name(cls) -> str:
        return "waveform"

    def schema(self) -> str:
        return "record string, ch int, sig_name string, frame long, sub int, sample long, dval long, pval double"

    def reader(self, schema: object) -> DataSourceReader:
        return SignalReader(self.options)


class AnnotationReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.extension = options["path"].rstrip("/"), options.get("extension", "atr")
        self.wanted = Wanted(("record",), "sample")

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        return [f for f in filters if not self.wanted.push(f)]

    def partitions(self) -> list[InputPartition]:
        found = _files(self.path, self.extension)
        return _grouped(({"record": stem, "path": path, "size": size} for stem, path, size in found if self.wanted.has("record", stem)), "size")

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        names = ["record", "ann_no", "sample", "label_store", "subtype", "chan", "num", "aux_note"]
        kinds = [pa.string(), pa.int64(), pa.int64(), *[pa.int32()] * 4, pa.string()]
        for file in partition.rows:
            content = read_range(file["path"], 0, file["size"])
            rows = [(file["record"], i, *r) for i, r in enumerate(decode(content, self.wanted.high)) if r[1] and self.wanted.low <= r[0] < self.wanted.high]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


class AnnotationSource(DataSource):
    """``waveform_annotations``: a folder of annotation files. Option extension (``atr``). A file is read up
    to the largest sample that is asked for."""

    @classmethod
    def name(cls) -> str:
        return "waveform_annotations"

    def schema(self) -> str:
        return "record string, ann_no long, sample long, label_store int, subtype int, chan int, num int, aux_note string"

    def reader(self, schema: object) -> DataSourceReader:
        return AnnotationReader(self.options)


def register(spark: SparkSession) -> None:
    """Makes both sources known to a session, and lets conditions reach Python sources."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in (SignalSource, AnnotationSource):
        spark.dataSource.register(source)

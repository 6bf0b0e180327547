"""Functions for ``spark.sql``: times, calibration and rates as expressions, ranges and peaks as table functions.

``register(spark)`` makes them temporary functions of a session. Scalar ones are SQL themselves, so
Catalyst inlines them. Table functions take a table that is partitioned and ordered in the call:

    SELECT * FROM joined_ranges(TABLE(ranges) PARTITION BY record ORDER BY start)

They read a partition's rows one after another and hold none of them; a partition is one task, so for
records of any length the DataFrame operators of the same kind are the better way.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn, SelectedColumn, udtf
from pyspark.sql.types import DoubleType, LongType, StructType

#: name(arguments) RETURNS type, and its SQL.
SCALARS = {
    "clock_micros(t STRING) RETURNS BIGINT": """
        CASE WHEN size(split(trim(t), ':')) <= 3 THEN
          CAST(try_cast(element_at(split(trim(t), ':'), -1) AS DECIMAL(18, 6)) * 1000000 AS BIGINT)
          + CASE WHEN size(split(trim(t), ':')) > 1 THEN try_cast(element_at(split(trim(t), ':'), -2) AS BIGINT) ELSE 0 END * 60000000
          + CASE WHEN size(split(trim(t), ':')) > 2 THEN try_cast(element_at(split(trim(t), ':'), -3) AS BIGINT) ELSE 0 END * 3600000000 END""",
    "sample_micros(n BIGINT, fs DOUBLE) RETURNS BIGINT": "CAST(bround(n * 1000000 / fs) AS BIGINT)",
    "micros_sample(m BIGINT, fs DOUBLE) RETURNS BIGINT": "CAST(floor(m * fs / 1000000 + 0.5D) AS BIGINT)",
    "sample_time(base BIGINT, n BIGINT, fs DOUBLE) RETURNS TIMESTAMP_NTZ": "timestampadd(MICROSECOND, base + CAST(bround(n * 1000000 / fs) AS BIGINT), TIMESTAMP_NTZ'1970-01-01 00:00:00')",
    "physical(dval BIGINT, gain DOUBLE, baseline BIGINT, missing BIGINT) RETURNS DOUBLE": "CASE WHEN missing IS NULL OR dval <> missing THEN (dval - baseline) / gain END",
    "digital(pval DOUBLE, gain DOUBLE, baseline BIGINT, missing BIGINT) RETURNS BIGINT": "coalesce(CAST(bround(pval * gain + baseline) AS BIGINT), missing)",
    "heart_rate(rr BIGINT, fs DOUBLE) RETURNS DOUBLE": "CASE WHEN rr > 0 THEN 60 * fs / rr END",
    "storage_format(bits INT) RETURNS STRING": "CASE WHEN bits <= 8 THEN '80' WHEN bits <= 12 THEN '212' WHEN bits <= 16 THEN '16' WHEN bits <= 24 THEN '24' ELSE '32' END",
}


def _analyzed(row: AnalyzeArgument, columns: list[tuple[str, object]]) -> StructType:
    """The columns of the table that make up its keys (all but those named), then ``columns``."""
    if not row.isTable:
        raise ValueError("the first argument is a table: TABLE(t) PARTITION BY keys ORDER BY order")
    out, taken = StructType(), {c for c, _ in columns}
    for field in row.dataType.fields:
        if field.name not in taken:
            out.add(field)
    for name, kind in columns:
        out.add(name, kind)
    return out


@udtf
class JoinedRanges:
    """Ranges (start, end) of a partition, in the order of start: those that touch or overlap become one.
    The table's other columns are those of the first range of each."""

    @staticmethod
    def analyze(row: AnalyzeArgument) -> AnalyzeResult:
        return AnalyzeResult(_analyzed(row, [("start", LongType()), ("end", LongType())]))

    def __init__(self) -> None:
        self.keys: tuple = ()
        self.start = self.end = None

    def eval(self, row: Row) -> Iterator[tuple]:
        if row["start"] is None or row["end"] is None:
            return
        if self.end is not None and row["start"] <= self.end:
            self.end = max(self.end, row["end"])
            return
        yield from self.terminate()
        self.keys = tuple(v for k, v in row.asDict(recursive=False).items() if k not in ("start", "end"))
        self.start, self.end = row["start"], row["end"]

    def terminate(self) -> Iterator[tuple]:
        if self.end is not None:
            yield (*self.keys, self.start, self.end)


@udtf
class ApartPeaks:
    """Rows of a partition, in the order of sample, each at least ``distance`` after the one before that
    stayed."""

    @staticmethod
    def analyze(row: AnalyzeArgument, distance: AnalyzeArgument) -> AnalyzeResult:
        if distance.value is None or distance.value < 1:
            raise ValueError("the distance is a number of samples")
        return AnalyzeResult(_analyzed(row, []))

    def __init__(self) -> None:
        self.last = None

    def eval(self, row: Row, distance: int) -> Iterator[tuple]:
        if row["sample"] is not None and (self.last is None or row["sample"] - self.last >= distance):
            self.last = row["sample"]
            yield tuple(row)


@udtf
class HardPeaks:
    """Rows of a partition, in the order of sample, with kind: 1 above both neighbours, -1 below both, by
    ``value``. The last row is none."""

    @staticmethod
    def analyze(row: AnalyzeArgument) -> AnalyzeResult:
        return AnalyzeResult(_analyzed(row, [("kind", LongType())]))

    def __init__(self) -> None:
        self.before = self.here = None

    def eval(self, row: Row) -> Iterator[tuple]:
        if self.before is not None and None not in (self.before["value"], self.here["value"], row["value"]):
            up, down = self.here["value"] - self.before["value"], row["value"] - self.here["value"]
            if up * down < 0:
                yield (*self.here, 1 if up > 0 else -1)
        self.before, self.here = self.here, row


@udtf
class Intervals:
    """Beats with rr (samples since the one before) and its rate a minute at ``fs``; a record's first beat has
    no row. Partitions and order are those of record and sample, without saying so in the call, and of
    the table only these columns are read."""

    @staticmethod
    def analyze(row: AnalyzeArgument, fs: AnalyzeArgument) -> AnalyzeResult:
        kinds = {f.name: f.dataType for f in row.dataType.fields}
        schema = StructType().add("record", kinds["record"]).add("sample", LongType()).add("rr", LongType()).add("hr", DoubleType())
        return AnalyzeResult(schema, partitionBy=[PartitioningColumn("record")], orderBy=[OrderingColumn("sample")], select=[SelectedColumn("record"), SelectedColumn("sample")])

    def __init__(self) -> None:
        self.last = None

    def eval(self, row: Row, fs: float) -> Iterator[tuple]:
        if self.last is not None:
            rr = row["sample"] - self.last
            yield row["record"], row["sample"], rr, 60.0 * float(fs) / rr if rr > 0 else None
        self.last = row["sample"]


TABLES = {"joined_ranges": JoinedRanges, "apart_peaks": ApartPeaks, "sharp_peaks": HardPeaks, "rr_intervals": Intervals}


def register(spark: SparkSession) -> None:
    """Makes all of them temporary functions of a session; once more does no harm."""
    for head, body in SCALARS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
    for name, kind in TABLES.items():
        spark.udtf.register(name, kind)

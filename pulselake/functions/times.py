"""Sample numbers, elapsed times and absolute times, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clock_micros(text: Column) -> Column:
    """Microseconds of ``SS``, ``MM:SS`` or ``HH:MM:SS``, each with a fraction or without; null where it is
    none of these."""
    parts = F.reverse(F.split(F.trim(text), ":"))
    seconds = F.get(parts, F.lit(0)).try_cast("decimal(18,6)")
    minutes, hours = (F.when(F.size(parts) > i, F.get(parts, F.lit(i)).try_cast("long")).otherwise(0) for i in (1, 2))
    return F.when(F.size(parts) <= 3, (seconds * 1_000_000).cast("long") + minutes * 60_000_000 + hours * 3_600_000_000)


def timestamp_of(micros: Column) -> Column:
    """A timestamp without zone of microseconds since the epoch, whatever the session's time zone is."""
    return F.timestamp_add("MICROSECOND", micros.cast("long"), F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'"))


def elapsed_micros(sample: Column, fs: Column | float) -> Column:
    return F.bround(sample * 1_000_000 / fs).cast("long")


def absolute_time(base: Column, sample: Column, fs: Column | float) -> Column:
    """Base time (microseconds since the epoch) plus a sample's time, as a timestamp without zone."""
    return timestamp_of(base + elapsed_micros(sample, fs))


def to_sample(micros: Column, fs: Column | float) -> Column:
    """The sample at a time, halves upwards."""
    return F.floor(micros * fs / 1_000_000 + 0.5).cast("long")


def moved_time(base: Column, start: Column | int, fs: Column | float) -> Column:
    """Base time (microseconds since the epoch) of a record that is cut to begin at sample ``start``."""
    return base + elapsed_micros(F.lit(start) if isinstance(start, int) else start, fs)


def down_to(x: Column, base: int) -> Column:
    """The largest multiple of ``base`` that is at most x."""
    return (F.floor(x / base) * base).cast("long")


def up_to(x: Column, base: int) -> Column:
    """The smallest multiple of ``base`` that is at least x."""
    return (F.ceil(x / base) * base).cast("long")


def date_micros(text: Column) -> Column:
    """Microseconds from the epoch to a date as ``DD/MM/YYYY``; null where it is none."""
    return F.unix_date(F.try_to_date(text, "dd/MM/yyyy")).cast("long") * 86_400_000_000


def clock_text(micros: Column) -> Column:
    """``HH:MM:SS.mmm`` of microseconds."""
    ms = F.floor(micros / 1000).cast("long")
    return F.format_string("%02d:%02d:%02d.%03d", F.expr("1") * F.floor(ms / 3_600_000), F.floor(ms / 60_000) % 60, F.floor(ms / 1000) % 60, ms % 1000)


def parse_time(text: Column, fs: Column | float, length: Column | int | None = None, base: Column | None = None) -> Column:
    """Sample number of a time: ``e`` (the end: ``length``), ``sN`` (sample N), a clock time, plain
    seconds, or ``[clock date]`` with a date as DD/MM/YYYY, counted from ``base`` (microseconds since
    the epoch). Null where it says nothing."""
    end = F.lit(length) if length is None or isinstance(length, int) else length
    inner = F.regexp_extract(text, r"^\[([^\]]*)\]$", 1)
    parts = F.split(inner, " ")
    absolute = to_sample(clock_micros(F.get(parts, F.lit(0))) + date_micros(F.get(parts, F.lit(1))) - base, fs) if base is not None else F.lit(None).cast("long")
    plain = F.when(text.startswith("s"), F.substring(text, 2, 20).try_cast("long")).when(text.startswith("["), absolute).otherwise(to_sample(clock_micros(text), fs))
    return F.when(text == "e", end.cast("long")).otherwise(plain)


def time_triple(text: Column, fs: Column | float, length: Column | int | None = None, base: Column | None = None) -> Column:
    """A struct of a time's sample, elapsed (``HH:MM:SS.mmm``) and at (a timestamp, null without ``base``)."""
    n = parse_time(text, fs, length, base)
    at = absolute_time(base, n, fs) if base is not None else F.lit(None).cast("timestamp_ntz")
    return F.struct(n.alias("sample"), clock_text(elapsed_micros(n, fs)).alias("elapsed"), at.alias("at"))

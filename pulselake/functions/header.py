"""Header lines of records, signals and segments: parsing and formatting, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulselake.functions.times import clock_micros, date_micros

# What a reader assumes where a field is absent.
DEFAULT_FS, DEFAULT_GAIN, DEFAULT_UNITS = 250.0, 200.0, "mV"


def _tokens(line: str, limit: int = -1) -> Column:
    """Parts of a line between blanks; with a limit the last one is all that is left."""
    return F.split(F.trim(F.translate(line, "\t", " ")), " +", limit)


def _part(text: Column, pattern: str) -> Column:
    """The group of a pattern, null where there is none or it is empty."""
    return F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))


def parse_record_line(lines: DataFrame, line: str = "line") -> DataFrame:
    """Adds the fields of a record line: name[/segments] signals [frequency[/counter frequency]
    [(counter)] [length [time [date]]]]. Absent ones are null but for fs."""
    at = [F.get(_tokens(line), F.lit(i)) for i in range(6)]
    number = r"(-?[\d.]+)"
    out = lines.withColumns({
        "record": _part(at[0], r"^([^/]*)"),
        "n_seg": _part(at[0], r"/(\d+)").try_cast("int"),
        "n_sig": at[1].try_cast("int"),
        "fs": F.coalesce(_part(at[2], f"^{number}").try_cast("double"), F.lit(DEFAULT_FS)),
        "counter_freq": _part(at[2], f"/{number}").try_cast("double"),
        "base_counter": _part(at[2], rf"\({number}\)").try_cast("double"),
        "sig_len": at[3].try_cast("long"),
        "base_time": at[4],
        "base_date": at[5],
    })
    return out


def base_micros(time: Column, date: Column) -> Column:
    """Microseconds since the epoch of a header's base time and date; null without a date."""
    return date_micros(date) + F.coalesce(clock_micros(time), F.lit(0))


def parse_signal_line(lines: DataFrame, line: str = "line") -> DataFrame:
    """Adds the fields of a signal line: file format[xspf][:skew][+offset] [gain[(baseline)][/units]
    [resolution [zero [first value [checksum [block size [name]]]]]]]. A gain of zero or none is the
    default gain; a baseline that is absent is the ADC zero."""
    at = [F.get(_tokens(line, 9), F.lit(i)) for i in range(9)]
    gain = _part(at[2], r"^([^(/]+)").try_cast("double")
    zero, baseline = at[4].try_cast("int"), _part(at[2], r"\((-?\d+)\)").try_cast("int")
    return lines.withColumns({
        "file_name": at[0],
        "fmt": _part(at[1], r"^(\d+)"),
        "spf": F.coalesce(_part(at[1], r"x(\d+)").try_cast("int"), F.lit(1)),
        "skew": F.coalesce(_part(at[1], r":(\d+)").try_cast("int"), F.lit(0)),
        "byte_offset": F.coalesce(_part(at[1], r"\+(\d+)").try_cast("long"), F.lit(0)),
        "adc_gain": F.when(F.coalesce(gain, F.lit(0.0)) == 0, DEFAULT_GAIN).otherwise(gain),
        "baseline": F.coalesce(baseline, zero, F.lit(0)),
        "units": F.coalesce(_part(at[2], r"/(.+)$"), F.lit(DEFAULT_UNITS)),
        "adc_res": at[3].try_cast("int"),
        "adc_zero": zero,
        "init_value": at[5].try_cast("int"),
        "checksum": at[6].try_cast("int"),
        "block_size": at[7].try_cast("int"),
        "sig_name": at[8],
    })


def parse_segment_line(lines: DataFrame, line: str = "line") -> DataFrame:
    """Adds seg_name, seg_len and is_gap (a name of ``~``)."""
    at = [F.get(_tokens(line), F.lit(i)) for i in range(2)]
    return lines.withColumns({"seg_name": at[0], "seg_len": at[1].try_cast("long"), "is_gap": at[0] == "~"})


def _number(c: Column) -> Column:
    """A number without a fraction of zero."""
    return F.when(c == F.floor(c), F.floor(c).cast("long").cast("string")).otherwise(c.cast("string"))


def record_line(record: Column, n_sig: Column, fs: Column, sig_len: Column, n_seg: Column | None = None, base_time: Column | None = None, base_date: Column | None = None, counter_freq: Column | None = None, base_counter: Column | None = None) -> Column:
    """A record line; absent fields at its end are left out, a date needs a time."""
    name = record.cast("string") if n_seg is None else F.concat(record.cast("string"), F.coalesce(F.concat(F.lit("/"), n_seg.cast("string")), F.lit("")))
    rate = _number(fs)
    if counter_freq is not None:
        counter = F.coalesce(F.concat(F.lit("("), _number(base_counter), F.lit(")")), F.lit("")) if base_counter is not None else F.lit("")
        rate = F.concat(rate, F.coalesce(F.concat(F.lit("/"), _number(counter_freq), counter), F.lit("")))
    parts = [name, n_sig.cast("string"), rate, sig_len.cast("string")]
    if base_time is not None:
        parts.append(base_time)
        if base_date is not None:
            parts.append(F.when(base_time.isNotNull(), base_date))
    return F.concat_ws(" ", *parts)


def signal_line(file_name: Column, fmt: Column, spf: Column, skew: Column, gain: Column, baseline: Column, units: Column, adc_res: Column, adc_zero: Column, init_value: Column, checksum: Column, sig_name: Column, byte_offset: Column | None = None, block_size: Column | None = None) -> Column:
    def more(mark: str, n: Column | None, least: int) -> Column:
        return F.lit("") if n is None else F.when(n > least, F.concat(F.lit(mark), n.cast("string"))).otherwise("")

    form = F.concat(fmt, more("x", spf, 1), more(":", skew, 0), more("+", byte_offset, 0))
    scale = F.concat(_number(gain), F.lit("("), baseline.cast("string"), F.lit(")/"), units)
    block = F.lit("0") if block_size is None else F.coalesce(block_size.cast("string"), F.lit("0"))
    return F.concat_ws(" ", file_name, form, scale, adc_res.cast("string"), adc_zero.cast("string"), init_value.cast("string"), checksum.cast("string"), block, sig_name)


def segment_line(seg_name: Column, seg_len: Column) -> Column:
    return F.concat_ws(" ", seg_name, seg_len.cast("string"))

"""Annotation algebra: labels, merges, ranges, R-R intervals.

Annotations have record, sample, ann_no, symbol and further columns; records are keys throughout.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulselake.functions.ordered import with_known, with_neighbours, with_previous, with_running_sum
from pulselake.functions.times import parse_time

#: Samples of a block in which a record's rows are handled together: some hours at usual frequencies.
BLOCK = 1 << 22


def block_of(order: str = "sample", size: int = BLOCK) -> Column:
    return F.expr(f"{order} div {size}")


def rr_intervals(ann: DataFrame, fs: float, first_from_zero: bool = False) -> DataFrame:
    """record, sample, rr (samples since the beat before) and rr_sec. A record's first beat has none,
    or counts from sample 0."""
    out = with_previous(ann, "record", "sample", block_of(), ["ann_no"])
    if first_from_zero:
        out = out.withColumn("previous", F.coalesce("previous", F.lit(0)))
    out = out.withColumn("rr", F.col("sample") - F.col("previous")).where("rr is not null")
    return out.withColumn("rr_sec", F.col("rr") / fs).drop("previous")


def filter_rr(rr: DataFrame, least: float | None = None, most: float | None = None) -> DataFrame:
    """Intervals strictly between the bounds (in seconds)."""
    if least is not None:
        rr = rr.where(F.col("rr_sec") > least)
    if most is not None:
        rr = rr.where(F.col("rr_sec") < most)
    return rr


def ann_to_rr(ann: DataFrame, fs: float, start: float | None = None, stop: float | None = None, unit: str = "samples") -> DataFrame:
    """record, sample, interval: intervals (the first from sample 0) that are longer than ``start`` and
    shorter than ``stop`` seconds, in samples (whole) or s, m, h."""
    rr = filter_rr(rr_intervals(ann, fs, first_from_zero=True), start, stop)
    scale = {"s": 1.0, "m": 60.0, "h": 3600.0}
    if unit != "samples" and unit not in scale:
        raise ValueError(f"unit {unit}: samples, s, m or h")
    return rr.select("record", "sample", (F.col("rr") if unit == "samples" else F.col("rr_sec") / scale[unit]).alias("interval"))


def mean_heart_rate(rr: DataFrame, records: DataFrame | None = None) -> DataFrame:
    """record, n_rr, mean_hr (beats a minute). With ``records`` those of them without intervals have a
    rate of 0; else only records with intervals have a row."""
    found = rr.groupBy("record").agg(F.count("*").alias("n_rr"), F.coalesce(60.0 / F.avg("rr_sec"), F.lit(0.0)).alias("mean_hr"))
    if records is None:
        return found
    all_ = records.select("record").distinct().select(F.col("record").alias("_r"))
    return all_.join(found, F.col("_r").eqNullSafe(F.col("record")), "left").select(F.col("_r").alias("record"), F.coalesce("n_rr", F.lit(0)).alias("n_rr"), F.coalesce("mean_hr", F.lit(0.0)).alias("mean_hr"))


def beats_from_rr(rr: DataFrame, fs: float) -> DataFrame:
    """Beat samples from intervals (record, i, rr_sec): the running sum, rounded to samples."""
    ticks = F.bround(F.col("rr_sec") * fs).cast("long")
    return with_running_sum(rr, "record", "i", F.expr("i div 100000"), ticks, name="sample")


def contained_labels(ann: DataFrame, labels: DataFrame) -> DataFrame:
    """Occurrences of every symbol of a record, with the label's attributes (null if not standard)."""
    counts = ann.groupBy("record", "symbol").agg(F.count("*").alias("n_occurrences"))
    return counts.join(F.broadcast(labels), "symbol", "left").select("record", "symbol", "label_store", "description", "n_occurrences")


def convert_labels(ann: DataFrame, labels: DataFrame, source: str, target: str) -> DataFrame:
    """Adds ``target`` looked up by ``source`` in the labels; null where there is none."""
    return ann.join(F.broadcast(labels.select(source, target)), source, "left")


def overlay_labels(standard: DataFrame, custom: DataFrame) -> DataFrame:
    """Label map in which custom rows replace standard ones of the same label_store."""
    s, c = standard.alias("s"), custom.alias("c")
    both = s.join(c, F.col("s.label_store") == F.col("c.label_store"), "full_outer")
    return both.select(*[F.coalesce(f"c.{n}", f"s.{n}").alias(n) for n in ("label_store", "symbol", "description")])


def symbols_to_notes(ann: DataFrame, labels: DataFrame) -> DataFrame:
    """Symbols that aren't labels become comments: symbol ``"``, the old one before the note's text."""
    known = F.broadcast(labels.select("symbol", F.lit(True).alias("known")))
    out = ann.join(known, "symbol", "left")
    note = F.when(F.col("known").isNull(), F.concat_ws(" ", "symbol", F.when(F.col("aux_note") != "", F.col("aux_note")))).otherwise(F.col("aux_note"))
    return out.withColumn("aux_note", note).withColumn("symbol", F.when(F.col("known").isNull(), '"').otherwise(F.col("symbol"))).drop("known")


def available_codes(used: DataFrame, limit: int = 50) -> DataFrame:
    """label_store codes from 1 below ``limit`` that a record doesn't use."""
    records = used.select("record").distinct()
    codes = records.select("record", F.explode(F.sequence(F.lit(1), F.lit(limit - 1))).alias("label_store"))
    return codes.join(used.select("record", "label_store").distinct(), ["record", "label_store"], "left_anti")


def assign_free_codes(symbols: DataFrame, free: DataFrame) -> DataFrame:
    """Gives each symbol of a record (in order) the next free code."""
    a = symbols.withColumn("n", F.row_number().over(Window.partitionBy("record").orderBy("symbol")))
    b = free.withColumn("n", F.row_number().over(Window.partitionBy("record").orderBy("label_store")))
    return a.join(b, ["record", "n"]).select("record", "symbol", "label_store")


def apply_range(ann: DataFrame, start: int, end: int, shift: bool = False) -> DataFrame:
    """Annotations in the closed range; ``shift`` counts samples from its start."""
    out = ann.where(F.col("sample").between(start, end))
    return out.withColumn("sample", F.col("sample") - start) if shift else out


def _bound(time: int | float | str, fs: float | None) -> int | Column:
    """A sample: a whole number is one, a fraction seconds, a text a clock time or ``e`` for the end."""
    if isinstance(time, int):
        return time
    if fs is None:
        raise ValueError("times in seconds or by the clock need fs")
    return int(time * fs) if isinstance(time, float) else parse_time(F.lit(time), fs, 1 << 62)


def merge(first: DataFrame, second: DataFrame, method: str, start: int | float | str, end: int | float | str, fs: float | None = None, channels: tuple[int | None, int | None] = (None, None)) -> DataFrame:
    """Bag union of two annotation sets, with ``source`` 1 or 2 (ties of a sample: by source, ann_no).

    ``combine`` takes both within the closed range, ``delete`` both outside of it, ``replace1`` the
    first set within and the second outside, ``replace2`` the other way round. The range is in samples,
    seconds (fractions) or clock times (``e``: the end), with ``fs``. ``channels`` sets chan of either set.
    """
    if any(c is not None and c < 0 for c in channels):
        raise ValueError("channels are numbered from 0")
    if start == "e":
        raise ValueError("a range doesn't begin at the end")
    both = [df.withColumn("source", F.lit(i)) if c is None else df.withColumns({"source": F.lit(i), "chan": F.lit(c)}) for i, df, c in ((1, first, channels[0]), (2, second, channels[1]))]
    inside = F.col("sample").between(_bound(start, fs), _bound(end, fs))
    rules = {"combine": (inside, inside), "delete": (~inside, ~inside), "replace1": (inside, ~inside), "replace2": (~inside, inside)}
    if method not in rules:
        raise ValueError(f"merge method {method}: one of {', '.join(rules)}")
    return both[0].where(rules[method][0]).unionByName(both[1].where(rules[method][1]))


def expand_durations(ann: DataFrame, duration: str = "duration") -> DataFrame:
    """Rows with a duration become an opening ``(`` row and a closing ``)`` row; others stay."""
    parts = F.when(F.col(duration) > 0, F.array(F.struct(F.lit("(").alias("a"), F.lit("").alias("z"), F.lit(0).cast("long").alias("d")), F.struct(F.lit("").alias("a"), F.lit(")").alias("z"), F.col(duration).cast("long").alias("d"))))
    parts = F.coalesce(parts, F.array(F.struct(F.lit("").alias("a"), F.lit("").alias("z"), F.lit(0).cast("long").alias("d"))))
    out = ann.withColumn("_p", F.explode(parts))
    return out.withColumn("aux_note", F.concat("_p.a", "aux_note", "_p.z")).withColumn("sample", F.col("sample") + F.col("_p.d")).drop("_p", duration)


def compact_carried(ann: DataFrame, column: str) -> DataFrame:
    """Marks where a carried field must be written: its value isn't that of the annotation before (0
    before the first)."""
    out = with_previous(ann, "record", "sample", block_of(), ["ann_no"], name="_before", value=column)
    return out.withColumn(f"write_{column}", ~F.col(column).eqNullSafe(F.coalesce("_before", F.lit(0)))).drop("_before")


def carry_forward(ann: DataFrame, column: str, default: int = 0) -> DataFrame:
    """Fills nulls with the last value before in the record (``default`` before any)."""
    out = with_known(ann, "record", "sample", block_of(), F.col(column), ["ann_no"], "_filled")
    return out.withColumn(column, F.coalesce("_filled", F.lit(default))).drop("_filled")


def sample_deltas(ann: DataFrame, longest: int = 1023, chunk: int = 0x7FFFFFFF) -> DataFrame:
    """Delta of each annotation from the one before, and the long skips that its coding takes."""
    out = with_previous(ann, "record", "sample", block_of(), ["ann_no"]).withColumn("delta", F.col("sample") - F.coalesce("previous", F.lit(0)))
    return out.withColumn("n_skips", F.when(F.col("delta") > longest, F.ceil(F.col("delta") / chunk)).otherwise(0).cast("long")).drop("previous")


def contiguous_groups(ann: DataFrame, column: str) -> DataFrame:
    """record, n_runs, n_distinct and whether equal values of a column stand together."""
    out = with_previous(ann, "record", "sample", block_of(), ["ann_no"], name="_before", value=column)
    runs = F.sum(F.when(F.col("_before").isNull() | (F.col("_before") != F.col(column)), 1).otherwise(0))
    found = out.groupBy("record").agg(runs.alias("n_runs"), F.count_distinct(column).alias("n_distinct"))
    return found.withColumn("contiguous", F.col("n_runs") == F.col("n_distinct"))


def hr_steps(ann: DataFrame, fs: float, lengths: DataFrame | None = None) -> DataFrame:
    """Instantaneous heart rate as steps: the rate of the interval that ends at a beat holds after it,
    up to the next beat. Rates begin with the second beat. With ``lengths`` (record, sig_len) the last
    step goes on to the record's end; else it ends with the last beat."""
    beats = with_neighbours(ann, "record", "sample", block_of(), ["ann_no"], previous="_previous", following="_next")
    rr = F.col("sample") - F.col("_previous")
    rate = F.when(rr > 0, 60.0 * fs / rr)
    steps = beats.where("_previous is not null and _next is not null").select("record", (F.col("sample") + 1).alias("start_sample"), F.col("_next").alias("end_sample"), rate.alias("hr"))
    if lengths is None:
        return steps
    last = ann.groupBy("record").agg(F.max("sample").alias("_last")).join(lengths.select("record", "sig_len"), "record")
    goes_on = (F.col("end_sample") == F.col("_last")) & (F.col("sig_len") > F.col("_last"))
    return steps.join(last, "record", "left").withColumn("end_sample", F.when(goes_on, F.col("sig_len") - 1).otherwise(F.col("end_sample"))).drop("_last", "sig_len")


def unmatched(reference: DataFrame, test: DataFrame) -> DataFrame:
    """Reference annotations without one of the same record, sample and symbol in the test set."""
    return reference.join(test, ["record", "sample", "symbol"], "left_anti")


def resample(ann: DataFrame, fs: float, target: float) -> DataFrame:
    """Samples at another frequency, cut to whole numbers."""
    return ann.withColumn("sample", (F.col("sample") * (target / fs)).cast("long"))


def violations(ann: DataFrame) -> DataFrame:
    """Annotation rows that break a field's rule: record, ann_no, rule. Samples must not fall with
    ann_no. Notes, where there is such a column, have at most 255 letters, each of one byte."""
    found = with_previous(ann, "record", "ann_no", F.expr("ann_no div 100000"), name="_before", value="sample")
    rules = {
        "label_range": ~F.col("label_store").between(1, 49),
        "subtype_range": ~F.col("subtype").between(-128, 127),
        "chan_range": ~F.col("chan").between(0, 255),
        "num_range": ~F.col("num").between(0, 127),
        "symbol_length": ~F.length("symbol").between(1, 3),
        "symbol_space": F.col("symbol").rlike(r"\s"),
        "negative_sample": F.col("sample") < 0,
        "falling_sample": F.col("sample") < F.col("_before"),
    }
    if "aux_note" in ann.columns:
        rules |= {"note_length": F.length("aux_note") > 255, "note_letters": F.col("aux_note").rlike("[^\\x00-\\xff]")}
    broken = F.array_compact(F.array(*[F.when(b, F.lit(name)) for name, b in rules.items()]))
    return found.select("record", "ann_no", F.explode(broken).alias("rule"))


def numbered(ann: DataFrame, by: list[str], name: str = "place") -> DataFrame:
    """Adds each row's place (from 0) in its record by sample, then by ``by``, which says how ties go."""
    out = with_running_sum(ann, "record", "sample", block_of(), F.lit(1), by, name)
    return out.withColumn(name, F.col(name) - 1)


def by_onset(ann: DataFrame, index: str = "ann_no") -> DataFrame:
    """All annotations in the order of record, onset (sample) and their place in the source."""
    return ann.orderBy("record", "sample", index)


# Notes at sample 0 that say something of the whole record.
FS_NOTE, LABELS_BEGIN, LABELS_END = "## time resolution:", "## annotation type definitions", "## end of definitions"


def definitions(ann: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What notes at sample 0 define: (record, fs), (record, label_store, symbol, description) and the
    annotations that remain, without those notes and without empty codes. Label lines stand between
    two marks, in the order of ann_no."""
    at_zero = (F.col("sample") == 0) & (F.col("label_store") == 22)
    notes = ann.where(at_zero).select("record", "ann_no", "aux_note")
    rest = F.trim(F.substring("aux_note", len(FS_NOTE) + 1, 255))
    fs = F.when(F.col("aux_note").startswith(FS_NOTE), F.get(F.split(rest, " "), F.lit(0)).try_cast("double"))
    rates = notes.where(fs.isNotNull()).groupBy("record").agg(F.min(F.struct("ann_no", fs.alias("fs")))["fs"].alias("fs"))
    marks = notes.groupBy("record").agg(F.min(F.when(F.col("aux_note") == LABELS_BEGIN, F.col("ann_no"))).alias("_a"), F.min(F.when(F.col("aux_note") == LABELS_END, F.col("ann_no"))).alias("_z"))
    parts = F.split(F.trim("aux_note"), r"\s+", 3)
    lines = notes.join(marks, "record").where("ann_no > _a and ann_no < _z")
    labels = lines.select("record", F.get(parts, F.lit(0)).try_cast("int").alias("label_store"), F.get(parts, F.lit(1)).alias("symbol"), F.get(parts, F.lit(2)).alias("description")).where("label_store is not null and symbol is not null")
    return rates, labels, ann.where(~F.coalesce(at_zero | (F.col("label_store") == 0), F.lit(False)))


def with_label_elements(ann: DataFrame, labels: DataFrame, wanted: list[str]) -> DataFrame:
    """Annotations with the label columns ``wanted`` (of label_store, symbol, description) and no other
    of these; missing ones are looked up by one that is there."""
    kinds = ["label_store", "symbol", "description"]
    if not wanted or not set(wanted) <= set(kinds):
        raise ValueError(f"label elements are some of {', '.join(kinds)}")
    there = [k for k in kinds if k in ann.columns]
    missing = [k for k in wanted if k not in there]
    if missing:
        if not there:
            raise ValueError("annotations without any label column")
        ann = ann.join(F.broadcast(labels.select(there[0], *missing)), there[0], "left")  # labels have fewer than 50 rows
    return ann.drop(*[k for k in kinds if k not in wanted])


def standard_labels(custom: DataFrame, used: DataFrame, limit: int = 50) -> DataFrame:
    """record, label_store, symbol, description of custom labels: those without a code (null
    label_store) get the free codes of their record in the order of symbols."""
    taken = used.select("record", "label_store").union(custom.where("label_store is not null").select("record", "label_store"))
    without = custom.where("label_store is null")
    free = available_codes(taken.unionByName(without.select("record", "label_store")), limit)
    given = assign_free_codes(without.select("record", "symbol").distinct(), free)
    named = without.drop("label_store").join(given, ["record", "symbol"])
    columns = ["record", "label_store", "symbol", "description"]
    return custom.where("label_store is not null").select(*columns).unionByName(named.select(*columns))


def differences(first: DataFrame, second: DataFrame) -> DataFrame:
    """Rows of one table that the other lacks, as often as it lacks them, with ``only_in`` (1 or 2).
    Nulls are equal, and so are NaN. Tables are equal where this has no rows."""
    columns = first.columns
    a, b = first, second.select(*columns)
    return a.exceptAll(b).withColumn("only_in", F.lit(1)).unionByName(b.exceptAll(a).withColumn("only_in", F.lit(2)))

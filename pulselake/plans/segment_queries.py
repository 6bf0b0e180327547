"""Queries on segments, header lines and times."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulselake import dims
from pulselake.functions import header, times
from pulselake.operators import segments as seg
from pulselake.operators import signals as sig
from pulselake.plans.tables import CHAN_SQL, SEG_SQL, channels, lengths, segments, signal_names, table
from pulselake.sources import headers, tables
from pulselake.sources.files import settled

WITH = f"WITH seg AS {SEG_SQL}, chan AS {CHAN_SQL}"
_ISLANDS = """, {name} AS (SELECT {keys}, min(s) AS start, max(e) AS "end" FROM (SELECT *, sum(n) OVER (PARTITION BY {keys} ORDER BY s) AS run FROM (SELECT *, CASE WHEN lag(e) OVER (PARTITION BY {keys} ORDER BY s) = s THEN 0 ELSE 1 END AS n FROM ({rows}))) GROUP BY {keys}, run)"""
RANGES = WITH + _ISLANDS.format(name="rng", keys="record, sig_name", rows="SELECT seg.record, sig_name, seg_start AS s, seg_end AS e FROM seg JOIN chan USING (record, seg_no) WHERE seg_len > 0 AND NOT is_gap")
BOTH = WITH + _ISLANDS.format(name="rng", keys="record", rows="SELECT record, seg_start AS s, seg_end AS e FROM seg WHERE seg_len > 0 AND NOT is_gap AND (SELECT count(DISTINCT sig_name) FROM chan WHERE chan.record = seg.record AND chan.seg_no = seg.seg_no AND sig_name IN ('I', 'II')) = 2")
# Segments at a twentieth of their frequency.
COARSE = WITH.replace("% 5000 AS seg_len", "% 5000 // 20 AS seg_len")
NUMBERED = WITH + ", num AS (SELECT *, row_number() OVER (PARTITION BY record, seg_no ORDER BY sig_name) - 1 AS ch FROM chan)"
ARRANGED = WITH + ", cut AS (SELECT record, seg_no, is_gap, least(seg_len, 12000 - seg_start) - greatest(0, 4000 - seg_start) AS len FROM seg WHERE seg_start < 12000 AND seg_end > 4000 AND seg_len > 0)"


def _ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = settled(segments(spark, sf_dir))
    return seg.signal_ranges(s, channels(s))


def w10_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments(spark, sf_dir).select("record", "seg_no", "seg_start", "seg_end")


def w8_signal_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranges(spark, sf_dir)


def w9_combined_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = settled(segments(spark, sf_dir))
    return seg.combined_ranges(s, channels(s), ["I", "II"])


def j5_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _ranges(spark, sf_dir)
    return seg.overlaps(r.where("sig_name = 'II'"), r.where("sig_name = 'V'"))


def _numbered_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Channels of segments, numbered by name."""
    s = channels(segments(spark, sf_dir))
    return s.withColumn("ch", F.expr("row_number() over (partition by record, seg_no order by sig_name) - 1").cast("long"))


def _wanted(s: DataFrame) -> DataFrame:
    names = F.array(*[F.struct(F.lit(n).alias("sig_name"), F.lit(i).cast("long").alias("place")) for i, n in enumerate(["V", "I", "III"])])
    return s.select("record").distinct().select("record", F.explode(names).alias("w")).select("record", "w.sig_name", "w.place")


def j7_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = segments(spark, sf_dir)
    return seg.required_channels(s, _numbered_channels(spark, sf_dir), _wanted(s))


def _arranged(part: int, force: bool):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        s = segments(spark, sf_dir)
        out = seg.arrange(s, channels(s), _wanted(s), 4000, 12000, force)[part]
        return out.select(*[F.col(c).cast("long").alias(c) if c.startswith(("n_", "place")) else c for c in out.columns])

    return query


def f11_record_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = segments(spark, sf_dir).withColumn("fs", F.when(F.col("record") % 7 == 3, 125.0).otherwise(360.0))
    sums = s.groupBy("record").agg(F.count("*").alias("n"), F.sum("seg_len").alias("len"))
    r = F.col("record")
    records = sums.select("record", (F.col("n") + (r % 7 == 1).cast("int")).alias("n_seg"), (F.col("len") - (r % 7 == 2).cast("int")).alias("sig_len"), F.lit(360.0).alias("fs"), F.when(r % 7 == 4, "variable").otherwise("fixed").alias("layout"))
    return seg.segment_violations(s, records)


def j8_required_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seg.required_segments(segments(spark, sf_dir), F.lit(4000), F.lit(12000)).select("record", "seg_no", "seg_from", "seg_to")


def g8_signal_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = seg.segments_of_signals(channels(segments(spark, sf_dir)))
    return found.select("record", "sig_name", F.array_join("seg_nos", ",").alias("seg_nos"))


def g9_file_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("record"), F.concat("l_returnflag", "l_linestatus").alias("file_name"), F.col("l_linenumber").cast("long").alias("ch"))
    return seg.file_groups(li).select("record", "file_name", F.array_join("chs", ",").alias("chs"), "first_ch")


def u6_stitch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums over the stitched record of each signal, at a twentieth of the segments' frequency."""
    s = settled(seg.offsets(lengths(spark, sf_dir).withColumn("seg_len", F.expr("seg_len div 20"))))
    names = channels(s).select("record", "sig_name").distinct()
    whole = seg.stitch(s.withColumn("signals", signal_names()), names, F.col("seg_no") * 100 + F.col("sample"), -32768)
    return whole.groupBy("record", "sig_name").agg(F.count("*").alias("n"), F.count(F.when(F.col("dval") != -32768, 1)).alias("n_valid"), F.sum("dval").alias("total"), F.sum(F.col("dval") * (F.col("sample") % 997)).alias("weighted"))


def f11_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = segments(spark, sf_dir).withColumn("seg_len", F.when(F.col("seg_no") % 4 == 1, -F.col("seg_len") - 1).otherwise(F.col("seg_len"))).where("seg_no <> 2")
    return seg.segment_violations(s)


def _record_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    line = F.concat(F.regexp_replace("c_name", "[^-A-Za-z0-9_]", "_"), F.lit(" "), F.col("c_nationkey").cast("string"), F.when(F.col("c_custkey") % 3 > 0, F.concat(F.lit(" "), (F.col("c_custkey") % 1000).cast("string"), F.lit(".5"))).otherwise(""), F.when(F.col("c_custkey") % 3 == 2, F.concat(F.lit(" "), (F.col("c_custkey") * 7).cast("string"), F.lit(" 10:20:30.5 01/02/2003"))).otherwise(""))
    return c.select(F.col("c_custkey").alias("i"), line.alias("line"))


_LINE = "regexp_replace(c_name, '[^-A-Za-z0-9_]', '_', 'g') AS nm, c_nationkey, c_custkey AS i"


def s3_record_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = header.parse_record_line(_record_lines(spark, sf_dir))
    return out.select("i", "record", F.col("n_sig").cast("long").alias("n_sig"), "fs", "sig_len", "base_time", "base_date")


def _signal_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    line = header.signal_line(F.concat(F.lit("f"), (k % 10).cast("string"), F.lit(".dat")), F.lit("16"), k % 3, k % 2, k % 7 + F.lit(0.5), k % 100, F.lit("mV"), F.col("p_size"), k % 5, k % 50, k % 60, F.regexp_replace("p_type", "[\t\n]", " "))
    return p.select(k.alias("i"), line.alias("line"))


def k3_signal_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _signal_lines(spark, sf_dir)


def s4_signal_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = header.parse_signal_line(_signal_lines(spark, sf_dir))
    whole = [F.col(c).cast("long").alias(c) for c in ("spf", "skew", "baseline", "adc_res", "adc_zero", "init_value", "checksum")]
    return out.select("i", "file_name", "fmt", "adc_gain", "units", "sig_name", *whole)


def s5_segment_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = segments(spark, sf_dir).select("record", "seg_no", F.concat(F.when(F.col("is_gap"), "~").otherwise(F.concat(F.lit("s"), F.col("seg_no").cast("string"))), F.lit(" "), F.col("seg_len").cast("string")).alias("line"))
    return header.parse_segment_line(s).drop("line")


def k4_multi_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Header text of every record of segments."""
    s = segments(spark, sf_dir)
    named = s.select("record", "seg_no", F.when(F.col("is_gap"), "~").otherwise(F.concat(F.lit("s"), F.col("seg_no").cast("string"))).alias("seg_name"), "seg_len")
    records = s.groupBy("record").agg(F.lit(3).alias("n_sig"), F.lit(360.0).alias("fs"), F.sum("seg_len").alias("sig_len"))
    return headers.multi_header_text(records, named).select("record", F.rtrim("value", F.lit("\n")).alias("text"))


def s6_clock(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id")
    k = F.col("event_id")
    text = F.when(k % 3 == 0, F.format_string("%d.25", k % 60)).when(k % 3 == 1, F.format_string("%d:%02d", k % 60, k % 50)).otherwise(F.format_string("%02d:%02d:%02d", k % 24, k % 60, k % 50))
    micros = times.clock_micros(text)
    return e.select("event_id", micros.alias("micros"), times.clock_text(micros).alias("clock"), times.parse_time(F.when(k % 5 == 0, F.concat(F.lit("s"), k.cast("string"))).otherwise(text), 360.0).alias("sample"))


def p10_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", (F.col("event_id") * 1009).alias("n"))
    el = times.elapsed_micros(F.col("n"), 360.0)
    return e.select("event_id", el.alias("elapsed"), times.to_sample(el, 360.0).alias("n_again"), times.absolute_time(F.lit(1_000_000_000_000_000), F.col("n"), 360.0).alias("at"))


def p11_moved_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id")
    k = F.col("event_id")
    base = times.date_micros(F.format_string("%02d/%02d/20%02d", k % 28 + 1, k % 12 + 1, k % 30)) + times.clock_micros(F.lit("10:20:30.5"))
    return e.select("event_id", times.moved_time(base, k * 9, 360.0).alias("micros"))


def p12_time_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id")
    k = F.col("event_id")
    clock = F.format_string("%02d:%02d:%02d", k % 24, k % 60, k % 50)
    text = F.when(k % 5 == 0, F.lit("e")).when(k % 5 == 1, F.concat(F.lit("s"), k.cast("string"))).when(k % 5 == 2, F.concat(F.lit("["), clock, F.lit(" 03/01/2001]"))).when(k % 5 == 3, (k % 60).cast("string")).otherwise(clock)
    base = F.lit(978307200000000)  # 01/01/2001
    return e.select("event_id", times.time_triple(text, 360.0, 99999, base).alias("t")).select("event_id", "t.sample", "t.elapsed", "t.at")


def p17_multiples(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", (F.col("event_id") - 700).alias("x"))
    return e.select("event_id", times.down_to(F.col("x"), 6).alias("down"), times.up_to(F.col("x"), 6).alias("up"))


def p19_time_to_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id")
    return e.select("event_id", times.to_sample(F.col("event_id") * 2000, 250.0).alias("sample"))


def f2_channel_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sig.select_channels(_numbered_channels(spark, sf_dir).withColumn("ch", F.col("ch").cast("int")), numbers=[2, 0]).select("record", "seg_no", "sig_name", F.col("place").cast("long").alias("place"))


def f3_channels_padded(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = _numbered_channels(spark, sf_dir).where("seg_no = 0")
    return sig.select_channels(first, names=["V", "I"], pad=True).select("record", "sig_name", "ch", F.col("place").cast("long").alias("place"))


def f8_record_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    c = table(spark, sf_dir, "customer").select(F.when(k % 6 == 0, F.concat(F.lit("a b"), k.cast("string"))).otherwise(F.concat(F.lit("r-"), k.cast("string"))).alias("record"), (F.col("c_nationkey") - 2).alias("n_sig"), (k % 5 - 1).cast("double").alias("fs"), (k % 9 - 1).alias("sig_len"))
    return sig.record_violations(c)


def f8_channel_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    p = table(spark, sf_dir, "part").select(F.expr("p_partkey div 4").alias("record"), (k % 4).alias("ch"), F.when(k % 11 == 0, "bad name").otherwise(F.concat(F.lit("f"), (k % 2).cast("string"), F.lit(".dat"))).alias("file_name"), F.when(k % 7 == 0, "9").otherwise("16").alias("fmt"), (k % 3).alias("spf"), (k % 5 - 1).alias("skew"), F.lit(0).alias("byte_offset"), (k % 6).cast("double").alias("adc_gain"), F.lit(0).alias("baseline"), F.when(k % 8 == 0, "m V").otherwise("mV").alias("units"), F.lit(12).alias("adc_res"), F.lit(0).alias("block_size"), F.when(k % 10 == 0, " x").otherwise(F.concat(F.lit("n"), (k % 3).cast("string"))).alias("sig_name"))
    return sig.channel_violations(p, dims.dat_formats(spark))


def g7_channel_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = segments(spark, sf_dir)
    records = s.groupBy("record").agg(F.lit(360.0).alias("fs"), F.sum("seg_len").alias("sig_len"))
    chs = _numbered_channels(spark, sf_dir).where("seg_no = 0").withColumn("spf", F.col("ch") + 1)
    return sig.channel_summary(records, chs).select("record", "ch", "sig_name", "frequency", F.round("seconds", 6).alias("seconds"))


def s36_missing_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select(F.concat(F.lit("f"), F.col("p_partkey").cast("string")).alias("name"), F.col("p_size").cast("long").alias("size"), F.col("p_partkey").alias("k"))
    present = p.where("k % 3 > 0").select("name", (F.col("size") + (F.col("k") % 5 == 0).cast("int")).alias("size"))
    return tables.missing_files(p.select("name", "size"), present)


def v2_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ticks of an ECG grid for each vector: large ones every 0.5 of its value range."""
    e = table(spark, sf_dir, "embeddings")
    return sig.grid_ticks(e.select(F.col("vec_id").alias("record"), F.array_min("embedding").cast("double").alias("lo"), F.array_max("embedding").cast("double").alias("hi")), 0.125, 4)


def v2_time_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ticks of the time axis of every record of segments, in units of a quarter second."""
    s = segments(spark, sf_dir).groupBy("record").agg(F.lit(0.0).alias("lo"), (F.sum("seg_len") / 512).alias("hi"))
    return sig.grid_ticks(s, 0.25, 5)


_CLOCK = "SELECT event_id, CASE event_id % 3 WHEN 0 THEN (event_id % 60) * 1000000 + 250000 WHEN 1 THEN (event_id % 60) * 60000000 + (event_id % 50) * 1000000 ELSE (event_id % 24) * 3600000000 + (event_id % 60) * 60000000 + (event_id % 50) * 1000000 END AS micros FROM events"

QUERIES = {
    "w10_offsets": (w10_offsets, f"{WITH} SELECT record, seg_no, seg_start, seg_end FROM seg"),
    "w8_signal_ranges": (w8_signal_ranges, f"{RANGES} SELECT * FROM rng"),
    "w9_combined_ranges": (w9_combined_ranges, f"{BOTH} SELECT * FROM rng"),
    "j5_overlaps": (j5_overlaps, f'{RANGES} SELECT a.record, greatest(a.start, b.start) AS start, least(a."end", b."end") AS "end" FROM rng a JOIN rng b ON a.record = b.record AND a.sig_name = \'II\' AND b.sig_name = \'V\' AND greatest(a.start, b.start) < least(a."end", b."end")'),
    "j7_channels": (j7_channels, f"{NUMBERED} SELECT num.record, num.seg_no, ch, CASE num.sig_name WHEN 'V' THEN 0 WHEN 'I' THEN 1 ELSE 2 END::BIGINT AS place FROM num JOIN seg USING (record, seg_no) WHERE seg_len > 0 AND NOT is_gap AND num.sig_name IN ('V', 'I', 'III')"),
    "u7_records": (_arranged(0, True), f"{ARRANGED} SELECT record, count(*) AS n_seg, CAST(sum(len) AS BIGINT) AS sig_len, CAST(3 AS BIGINT) AS n_sig FROM cut GROUP BY record"),
    "u7_segments": (_arranged(1, True), f"{ARRANGED} SELECT record, seg_no - min(seg_no) OVER (PARTITION BY record) AS seg_no, len AS seg_len FROM cut"),
    "u7_signals": (_arranged(2, False), f"{ARRANGED}, h AS (SELECT DISTINCT record, sig_name, CASE sig_name WHEN 'V' THEN 0 WHEN 'I' THEN 1 ELSE 2 END AS p FROM cut JOIN chan USING (record, seg_no) WHERE NOT is_gap AND sig_name IN ('V', 'I', 'III')) SELECT record, sig_name, row_number() OVER (PARTITION BY record ORDER BY p) - 1 AS place FROM h"),
    "f11_record_violations": (f11_record_violations, f"{WITH}, s AS (SELECT record, count(*) FILTER (seg_len = 0) AS empty, arg_min(seg_len, seg_no) AS first_len FROM seg GROUP BY record) SELECT record, CAST(NULL AS BIGINT) AS seg_no, rule FROM (SELECT record, unnest([CASE record % 7 WHEN 1 THEN 'n_seg' END, CASE record % 7 WHEN 2 THEN 'total_length' END, CASE record % 7 WHEN 3 THEN 'fs' END, CASE WHEN (record % 7 = 4 AND (first_len <> 0 OR empty <> 1)) OR (record % 7 <> 4 AND empty > 0) THEN 'layout' END]) AS rule FROM s) WHERE rule IS NOT NULL"),
    "p11_moved_time": (p11_moved_time, "SELECT event_id, epoch_us(make_timestamp(2000 + event_id % 30, event_id % 12 + 1, event_id % 28 + 1, 10, 20, 30.5)) + CAST(round_even(event_id * 9 * 1000000 / CAST(360 AS DOUBLE), 0) AS BIGINT) AS micros FROM events"),
    "p12_time_triples": (p12_time_triples, "WITH c AS (SELECT event_id, (event_id % 24) * 3600 + (event_id % 60) * 60 + event_id % 50 AS sec FROM events), n AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN 99999 WHEN 1 THEN event_id WHEN 2 THEN (sec + 172800) * 360 WHEN 3 THEN (event_id % 60) * 360 ELSE sec * 360 END AS sample FROM c), u AS (SELECT event_id, sample, CAST(round_even(sample * 1000000 / CAST(360 AS DOUBLE), 0) AS BIGINT) AS us FROM n) SELECT event_id, sample, printf('%02d:%02d:%02d.%03d', us // 3600000000, us // 60000000 % 60, us // 1000000 % 60, us // 1000 % 1000) AS elapsed, make_timestamp(978307200000000 + us) AS at FROM u"),
    "p17_multiples": (p17_multiples, "SELECT event_id, CAST(floor((event_id - 700) / 6.0) * 6 AS BIGINT) AS down, CAST(ceil((event_id - 700) / 6.0) * 6 AS BIGINT) AS up FROM events"),
    "p19_time_to_sample": (p19_time_to_sample, "SELECT event_id, (event_id + 1) // 2 AS sample FROM events"),
    "f2_channel_order": (f2_channel_order, f"{NUMBERED} SELECT record, seg_no, sig_name, CASE ch WHEN 2 THEN 0 ELSE 1 END::BIGINT AS place FROM num WHERE ch IN (0, 2)"),
    "f3_channels_padded": (f3_channels_padded, f"{NUMBERED}, a AS (SELECT * FROM num WHERE seg_no = 0), w AS (SELECT * FROM (SELECT DISTINCT record FROM a), (VALUES ('V', 0::BIGINT), ('I', 1::BIGINT)) AS v(sig_name, place)) SELECT w.record, w.sig_name, a.ch, w.place FROM w LEFT JOIN a ON a.record = w.record AND a.sig_name = w.sig_name"),
    "f8_record_violations": (f8_record_violations, "WITH x AS (SELECT CASE WHEN c_custkey % 6 = 0 THEN 'a b' || c_custkey ELSE 'r-' || c_custkey END AS record, c_custkey AS k, c_nationkey AS n FROM customer) SELECT record, rule FROM (SELECT record, unnest([CASE WHEN k % 6 = 0 THEN 'record_name' END, CASE WHEN n <= 2 THEN 'n_sig' END, CASE WHEN k % 5 <= 1 THEN 'fs' END, CASE WHEN k % 9 = 0 THEN 'sig_len' END]) AS rule FROM x) WHERE rule IS NOT NULL"),
    "f8_channel_violations": (f8_channel_violations, "WITH x AS (SELECT p_partkey AS k, p_partkey // 4 AS record, p_partkey % 4 AS ch, CASE WHEN p_partkey % 11 = 0 THEN 'bad name' ELSE 'f' || p_partkey % 2 || '.dat' END AS f, CASE WHEN p_partkey % 10 = 0 THEN ' x' ELSE 'n' || p_partkey % 3 END AS s FROM part), y AS (SELECT *, count(*) OVER (PARTITION BY record, s) AS same, max(ch) OVER (PARTITION BY record, f) - min(ch) OVER (PARTITION BY record, f) + 1 <> count(*) OVER (PARTITION BY record, f) AS apart FROM x) SELECT record, ch, rule FROM (SELECT record, ch, unnest([CASE WHEN k % 11 = 0 THEN 'file_name' END, CASE WHEN apart THEN 'file_apart' END, CASE WHEN k % 7 = 0 THEN 'fmt' END, CASE WHEN k % 3 = 0 THEN 'spf' END, CASE WHEN k % 5 = 0 THEN 'skew' END, CASE WHEN k % 6 = 0 THEN 'adc_gain' END, CASE WHEN k % 8 = 0 THEN 'units' END, CASE WHEN k % 10 = 0 THEN 'name_space' END, CASE WHEN same > 1 THEN 'name_twice' END]) AS rule FROM y) WHERE rule IS NOT NULL"),
    "g7_channel_summary": (g7_channel_summary, f"{NUMBERED}, t AS (SELECT record, sum(seg_len) AS len FROM seg GROUP BY record) SELECT record, ch, sig_name, 360 * (ch + 1)::DOUBLE AS frequency, round(len / 360.0::DOUBLE, 6) AS seconds FROM num JOIN t USING (record) WHERE seg_no = 0"),
    "s36_missing_files": (s36_missing_files, "SELECT 'f' || p_partkey AS name, CAST(p_size AS BIGINT) AS size FROM part WHERE p_partkey % 3 = 0 OR p_partkey % 5 = 0"),
    "v2_time_grid": (v2_time_grid, f"{WITH}, t AS (SELECT record, CAST(ceil(sum(seg_len) / 512.0 / 0.25) AS BIGINT) AS hi FROM seg GROUP BY record) SELECT record, i * 0.25::DOUBLE AS tick, i % 5 = 0 AS large FROM (SELECT record, unnest(range(0, hi + 1)) AS i FROM t)"),
    "j8_required_segments": (j8_required_segments, f"{WITH} SELECT record, seg_no, greatest(0, 4000 - seg_start) AS seg_from, least(seg_len, 12000 - seg_start) AS seg_to FROM seg WHERE seg_start < 12000 AND seg_end > 4000"),
    "g8_signal_segments": (g8_signal_segments, f"{WITH} SELECT record, sig_name, string_agg(CAST(seg_no AS VARCHAR), ',' ORDER BY seg_no) AS seg_nos FROM chan GROUP BY record, sig_name"),
    "g9_file_groups": (g9_file_groups, "SELECT l_orderkey AS record, l_returnflag || l_linestatus AS file_name, string_agg(CAST(l_linenumber AS VARCHAR), ',' ORDER BY l_linenumber) AS chs, CAST(min(l_linenumber) AS BIGINT) AS first_ch FROM lineitem GROUP BY 1, 2"),
    "u6_stitch": (u6_stitch, f"{COARSE}, g AS (SELECT record, unnest(range(0, max(seg_end))) AS sample FROM seg GROUP BY record), n AS (SELECT DISTINCT record, sig_name FROM chan), w AS (SELECT g.record, n.sig_name, g.sample, coalesce(CASE WHEN NOT s.is_gap AND chan.sig_name IS NOT NULL THEN s.seg_no * 100 + g.sample - s.seg_start END, -32768) AS dval FROM g JOIN n ON n.record = g.record JOIN seg s ON s.record = g.record AND g.sample >= s.seg_start AND g.sample < s.seg_end LEFT JOIN chan ON chan.record = s.record AND chan.seg_no = s.seg_no AND chan.sig_name = n.sig_name) SELECT record, sig_name, count(*) AS n, count(*) FILTER (dval <> -32768) AS n_valid, CAST(sum(dval) AS BIGINT) AS total, CAST(sum(dval * (sample % 997)) AS BIGINT) AS weighted FROM w GROUP BY record, sig_name"),
    "f11_violations": (f11_violations, f"{WITH}, x AS (SELECT record, seg_no, CASE WHEN seg_no % 4 = 1 THEN -seg_len - 1 ELSE seg_len END AS seg_len, lag(seg_no, 1, -1) OVER (PARTITION BY record ORDER BY seg_no) AS p FROM seg WHERE seg_no <> 2) SELECT record, seg_no, 'negative_length' AS rule FROM x WHERE seg_len < 0 UNION ALL SELECT record, seg_no, 'number' FROM x WHERE seg_no <> p + 1"),
    "s3_record_line": (s3_record_line, f"SELECT i, nm AS record, CAST(c_nationkey AS BIGINT) AS n_sig, CASE WHEN i % 3 > 0 THEN i % 1000 + 0.5::DOUBLE ELSE 250.0::DOUBLE END AS fs, CASE WHEN i % 3 = 2 THEN i * 7 END AS sig_len, CASE WHEN i % 3 = 2 THEN '10:20:30.5' END AS base_time, CASE WHEN i % 3 = 2 THEN '01/02/2003' END AS base_date FROM (SELECT {_LINE} FROM customer)"),
    "k3_signal_line": (k3_signal_line, "SELECT p_partkey AS i, 'f' || p_partkey % 10 || '.dat 16' || CASE WHEN p_partkey % 3 > 1 THEN 'x' || p_partkey % 3 ELSE '' END || CASE WHEN p_partkey % 2 > 0 THEN ':1' ELSE '' END || ' ' || p_partkey % 7 || '.5(' || p_partkey % 100 || ')/mV ' || p_size || ' ' || p_partkey % 5 || ' ' || p_partkey % 50 || ' ' || p_partkey % 60 || ' 0 ' || p_type AS line FROM part"),
    "s4_signal_line": (s4_signal_line, "SELECT p_partkey AS i, 'f' || p_partkey % 10 || '.dat' AS file_name, '16' AS fmt, p_partkey % 7 + 0.5::DOUBLE AS adc_gain, 'mV' AS units, p_type AS sig_name, CASE WHEN p_partkey % 3 > 1 THEN p_partkey % 3 ELSE 1 END AS spf, p_partkey % 2 AS skew, p_partkey % 100 AS baseline, CAST(p_size AS BIGINT) AS adc_res, p_partkey % 5 AS adc_zero, p_partkey % 50 AS init_value, p_partkey % 60 AS checksum FROM part"),
    "s5_segment_line": (s5_segment_line, f"{WITH} SELECT record, seg_no, CASE WHEN is_gap THEN '~' ELSE 's' || seg_no END AS seg_name, seg_len, is_gap FROM seg"),
    "k4_multi_header": (k4_multi_header, f"{WITH} SELECT record, record || '/' || count(*) || ' 3 360 ' || CAST(sum(seg_len) AS BIGINT) || chr(10) || string_agg(CASE WHEN is_gap THEN '~' ELSE 's' || seg_no END || ' ' || seg_len, chr(10) ORDER BY seg_no) AS text FROM seg GROUP BY record"),
    "s6_clock": (s6_clock, f"WITH c AS ({_CLOCK}) SELECT event_id, micros, printf('%02d:%02d:%02d.%03d', micros // 3600000000, micros // 60000000 % 60, micros // 1000000 % 60, micros // 1000 % 1000) AS clock, CASE WHEN event_id % 5 = 0 THEN event_id ELSE CAST(round_even(micros * 360::DOUBLE / 1000000, 0) AS BIGINT) END AS sample FROM c"),
    "p10_times": (p10_times, "SELECT event_id, CAST(round_even(event_id * 1009 * 1000000 / CAST(360 AS DOUBLE), 0) AS BIGINT) AS elapsed, event_id * 1009 AS n_again, make_timestamp(1000000000000000 + CAST(round_even(event_id * 1009 * 1000000 / CAST(360 AS DOUBLE), 0) AS BIGINT)) AS at FROM events"),
    "v2_grid": (v2_grid, "SELECT record, i * 0.125::DOUBLE AS tick, i % 4 = 0 AS large FROM (SELECT vec_id AS record, unnest(range(CAST(floor(CAST(list_min(embedding) AS DOUBLE) / 0.125) AS BIGINT), CAST(ceil(CAST(list_max(embedding) AS DOUBLE) / 0.125) AS BIGINT) + 1)) AS i FROM embeddings)"),
}

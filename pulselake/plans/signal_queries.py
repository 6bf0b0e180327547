"""Queries on samples: calibration, formats, codecs, windows, peaks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulselake import dims
from pulselake.functions import codec
from pulselake.operators import beats, filters
from pulselake.operators import signals as sig
from pulselake.plans.tables import REC_SQL, SIG_SQL, recordings, samples, table
from pulselake.sources.signals import inferred_length

WITH = f"WITH sig AS {SIG_SQL}"
GAIN, BASE, INVALID = 200.0, 24, -2048
# Rounded physical values, so that flat runs and ties occur.
COARSE = "CAST(round_even(pval * 20, 0) AS BIGINT)"


def _coarse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return samples(spark, sf_dir).withColumn("v", F.bround(F.col("pval") * 20).cast("long"))


def p1_dac(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = samples(spark, sf_dir).withColumn("dval", F.when(F.col("sample") % 9 == 0, INVALID).otherwise(F.col("dval")).cast("long"))
    return sig.to_physical(s, GAIN, BASE, INVALID).select("record", "sample", F.round("pval", 6).alias("pval"))


def p2_adc(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = samples(spark, sf_dir).withColumn("pval", F.when(F.col("sample") % 9 != 0, F.bround("pval", 2)))
    return sig.to_digital(s, 50.0, BASE, INVALID).select("record", "sample", "dval")


def p3_gain_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sig.fit_gain(samples(spark, sf_dir), -2048, 2047)
    return found.select("record", F.round("adc_gain", 6).alias("adc_gain"), "baseline")


def p4_est_res(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sig.estimate_bits(samples(spark, sf_dir)).select("record", F.col("bits").cast("long").alias("bits"))


def p5_pick_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sig.estimate_bits(samples(spark, sf_dir)).select("record", sig.pick_format(F.col("bits")).alias("fmt"))


def _stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as files of as many samples as their size, each in one of the formats."""
    names = F.array(*[F.lit(f[0]) for f in dims.DAT_FORMATS])
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("i"), F.element_at(names, (F.col("p_partkey") % len(dims.DAT_FORMATS) + 1).cast("int")).alias("fmt"), F.col("p_size").cast("long").alias("n"))


def p6_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a file's format says of its samples."""
    looked_up = _stored(spark, sf_dir).join(F.broadcast(dims.dat_formats(spark)), "fmt")  # ten rows
    return looked_up.select("i", "fmt", F.col("bits").cast("long").alias("bits"), F.round("bytes_per_sample", 6).alias("bytes_per_sample"), "min_value", "max_value", "invalid")


def p7_smooth_physical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sig.average_frames(samples(spark, sf_dir), 4, digital=False).select("record", "frame", F.round("pval", 6).alias("pval"))


def p7_smooth_digital(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sig.average_frames(samples(spark, sf_dir), 4, digital=True).select("record", "frame", "dval")


def p9_checksum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sig.channel_features(samples(spark, sf_dir)).select("record", "checksum")


def p24_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sig.channel_features(samples(spark, sf_dir)).drop("ch")


def f10_cohesion(spark: SparkSession, sf_dir: str) -> DataFrame:
    features = sig.channel_features(samples(spark, sf_dir))
    r = F.col("record") % 5
    headers = features.select("record", "ch", F.when(r == 0, "80").otherwise("16").alias("fmt"), (F.col("init_value") + (r == 1).cast("int")).alias("init_value"), (F.col("checksum") - 65536 + (r == 2).cast("int")).alias("checksum"), (F.col("sig_len") - (r == 3).cast("int")).alias("sig_len"))
    return sig.cohesion_violations(features, headers, dims.dat_formats(spark)).select("record", "rule")


def p13_normalize_bound(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sig.normalize_bound(samples(spark, sf_dir), -5.0, 15.0).select("record", "sample", F.round("pval", 6).alias("pval"))


def p14_normalize_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sig.normalize_length(samples(spark, sf_dir)).select("record", "sample", F.round("pval", 6).alias("pval"))


def p15_moving_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = sig.moving_average(samples(spark, sf_dir).withColumn("dval", F.col("dval").cast("double")), 4, value="dval")
    return s.select("record", "sample", F.round("smooth", 6).alias("smooth"))


def p18_ricker(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much every vector has of a wavelet in its middle."""
    wave = F.broadcast(sig.ricker(spark, 64, 4.0).withColumnRenamed("i", "sample"))  # a row a point
    return samples(spark, sf_dir).join(wave, "sample").groupBy("record").agg(F.round(F.sum(F.col("pval") * F.col("value")), 6).alias("value"))


def p8_convert_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sig.convert_type(samples(spark, sf_dir), 16).select("record", "sample", F.col("dval").cast("long").alias("dval"))


def p23_resampled_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annotations moved with their signal to another frequency, and the value there."""
    s = samples(spark, sf_dir).withColumn("pval", F.col("dval").cast("double"))
    e = table(spark, sf_dir, "events").select((F.col("event_id") % 500).alias("record"), (F.col("event_id") % 60).alias("sample"), F.col("event_id").alias("ann_no"))
    moved, ann = sig.resample_with_annotations(s, e, 4.0, 5.0)
    return ann.join(moved, ["record", "sample"]).select("record", "sample", "ann_no", F.round("pval", 6).alias("pval"))


def p24_derived_digital(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = samples(spark, sf_dir).withColumn("pval", F.col("dval") / 1024)
    found = sig.derived_digital(s)
    return found.select("record", "sample", "fmt", F.round("adc_gain", 6).alias("adc_gain"), "baseline", "dval")


def d3_filter_gain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A filter's gain at a frequency for each lineitem."""
    f = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("record"), F.col("l_linenumber").cast("long").alias("n"), (F.col("l_quantity").cast("double") * 2.5).alias("frequency"))
    return sig.filter_gain(f, [0.2, 0.3, 0.2], [1.0, -0.4, 0.1], 250.0).withColumn("gain", F.round("gain", 9))


def v3_plot_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = samples(spark, sf_dir)
    chs = s.select("record", "ch").distinct().withColumn("sig_name", F.concat(F.lit("v"), F.col("record").cast("string")))
    e = table(spark, sf_dir, "events").select((F.col("event_id") % 500).alias("record"), (F.col("event_id") % 2).cast("int").alias("chan"), (F.col("event_id") % 71).alias("sample"), F.col("event_type").alias("symbol"))
    return sig.plot_items(s, e, chs, 4.0, "dval").select("record", "sig_name", "seconds", "value", "symbol")


def p20_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = samples(spark, sf_dir).withColumns({"sig_name": F.concat(F.lit("s"), (F.col("sample") % 4).cast("string")), "sample": F.col("frame")})
    return sig.wide(s, ["s0", "s1", "s2", "s3"])


def s22_deskew(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sig.remove_skew(samples(spark, sf_dir), 3, INVALID).select("record", "sample", "dval")


def d6_interpolate(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = samples(spark, sf_dir).withColumn("pval", F.when((F.col("dval") % 3) != 0, F.col("pval")))
    return sig.interpolate(s).select("record", "sample", F.round("pval", 6).alias("pval"))


def p22_resample_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = samples(spark, sf_dir).withColumn("pval", F.col("dval").cast("double"))
    return sig.resample_linear(s, 4.0, 5.0).select("record", "sample", F.round("pval", 6).alias("pval"))


def w4_hard_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sig.hard_peaks(_coarse(spark, sf_dir), "v").select("record", "sample", F.col("kind").cast("long").alias("kind"))


def w4_soft_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sig.soft_peaks(_coarse(spark, sf_dir), "v").select("record", "sample", F.col("kind").cast("long").alias("kind"))


def w5_peak_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sig.local_peaks(_coarse(spark, sf_dir), 5, "v").select("record", "sample", "v")


def w5_local_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sig.separated_peaks(sig.local_peaks(_coarse(spark, sf_dir), 5, "v"), 5).select("record", "sample")


def w6_shift_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _coarse(spark, sf_dir)
    return sig.shift_peaks(s, sig.hard_peaks(s, "v"), 4, up=True, value="v").drop("ch")


def _corrected(direction: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        s = _coarse(spark, sf_dir).withColumn("v", F.col("v").cast("double"))
        return sig.correct_peaks(s, sig.hard_peaks(s, "v"), 4, 4, "v", direction).drop("ch")

    return query


def s23_infer_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames that a file of a size holds, by format and samples a frame."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("i"), (F.col("p_size") * 1000 + 24).cast("long").alias("size"), (F.col("p_partkey") % 4 + 1).alias("per_frame"))
    out = p.withColumn("fmt", F.explode(F.array(*[F.lit(f) for f in ("80", "212", "16", "24", "32")])))
    return out.select("i", "fmt", inferred_length(F.col("size"), "fmt", F.col("per_frame"), F.lit(24)).alias("frames"))


def d4_energy_beats(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = samples(spark, sf_dir).withColumn("d", F.col("dval").cast("double"))
    return sig.energy_beats(s, 4, 6, "d").select("record", "sample", F.round("energy", 6).alias("energy"))


def g3_average_beats(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = samples(spark, sf_dir)
    found = beats.average_around(s, sig.energy_beats(s.withColumn("d", F.col("dval").cast("double")), 4, 6, "d").select("record", "sample"), 6, 8)
    return found.select("record", F.col("lag").cast("long").alias("lag"), "n", F.round("mean", 6).alias("mean"))


def j9_values_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select((F.col("event_id") % 500).alias("record"), (F.col("event_id") % 71).alias("sample"), F.col("event_id").alias("ann_no"))
    return beats.values_at(samples(spark, sf_dir), e).select("record", "sample", "ann_no", "dval")


def s12_required_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stored(spark, sf_dir).select("i", "fmt", "n", codec.required_bytes(F.col("n"), F.col("fmt")).alias("read"), codec.required_bytes(F.col("n"), F.col("fmt"), write=True).alias("written"))


def _round_trip(fmt: str, low: int, high: int):
    """Packs every record's samples and unpacks them: bytes, a weighted sum of them, mismatches."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        e = table(spark, sf_dir, "embeddings")
        value = F.transform("embedding", lambda x: F.greatest(F.least(F.bround(x.cast("double") * 1000).cast("long"), F.lit(high)), F.lit(low)).cast("long"))
        out = e.select(F.col("vec_id").alias("record"), value.alias("s")).withColumn("b", codec.encode(F.col("s"), fmt))
        out = out.withColumn("back", codec.decode(F.col("b"), fmt, F.size("s")))
        weighted = F.aggregate(F.transform("b", lambda x, i: x.cast("long") * (i + 1)), F.lit(0).cast("long"), lambda a, x: a + x)
        wrong = F.size(F.filter(F.zip_with("s", "back", lambda x, y: ~x.eqNullSafe(y)), lambda z: z))
        return out.select("record", F.size("b").cast("long").alias("n_bytes"), weighted.alias("weighted"), wrong.cast("long").alias("mismatches"))

    return query


def _round_trip_sql(low: int, high: int, group: int, listed: str, cut: str = "") -> str:
    """``listed``: bytes of the group of samples a, b, c (unsigned 64 bits kept by masks)."""
    part = ", ".join(f"coalesce(s[g * {group} + {i + 1}], 0) AS {n}" for i, n in enumerate("abc"[:group]))
    return f"""WITH v AS (SELECT vec_id AS record, list_transform(embedding, lambda x: CAST(greatest(least(round_even(CAST(x AS DOUBLE) * 1000, 0), {high}), {low}) AS BIGINT)) AS s FROM embeddings),
g AS (SELECT record, s, unnest(range(0, CAST(ceil(len(s) / CAST({group} AS DOUBLE)) AS BIGINT))) AS g FROM v), p AS (SELECT record, len(s) AS n, g, {part} FROM g),
q AS (SELECT record, any_value(n) AS n, flatten(list({listed} ORDER BY g)) AS b FROM p GROUP BY record), k AS (SELECT record, {f'b[1:{cut}]' if cut else 'b'} AS b FROM q)
SELECT record, CAST(len(b) AS BIGINT) AS n_bytes, CAST(list_sum(list_transform(b, lambda x, i: x * i)) AS BIGINT) AS weighted, CAST(0 AS BIGINT) AS mismatches FROM k"""


def s14_fmt8(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    data = F.transform("embedding", lambda x: F.pmod(F.bround(x.cast("double") * 100).cast("long"), F.lit(256)))
    out = e.select(F.col("vec_id").alias("record"), data.alias("b")).select("record", F.posexplode(codec.decode(F.col("b"), "8", F.size("b"), F.lit(100).cast("long"))).alias("sample", "dval"))
    return out.withColumn("sample", F.col("sample").cast("long"))


_SMOOTH = "sum(CAST(dval AS DOUBLE)) OVER (PARTITION BY record ORDER BY sample ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING) / 4"
_FEATURES = f"{WITH}, f AS (SELECT record, count(*) AS sig_len, arg_min(dval, sample) AS init_value, CAST(((sum(dval) % 65536) + 65536) % 65536 AS BIGINT) AS checksum, min(dval) AS dmin, max(dval) AS dmax FROM sig GROUP BY record)"
_BITS = f"{WITH}, d AS (SELECT DISTINCT record, dval FROM sig), s AS (SELECT record, dval, dval - lag(dval) OVER (PARTITION BY record ORDER BY dval) AS step FROM d), r AS (SELECT record, CAST(least(32, ceil(round(log2(1 + (max(dval) - min(dval)) / CAST(min(step) AS DOUBLE)), 9))) AS BIGINT) AS bits FROM s GROUP BY record)"
_RANGE = f"{WITH}, m AS (SELECT record, min(pval) AS lo, max(pval) AS hi FROM sig GROUP BY record), b AS (SELECT *, -2047 - 4094 / (hi - lo) * lo AS s FROM m), c AS (SELECT *, CASE WHEN lo > 0 THEN ceil(s) ELSE floor(s) END AS base FROM b)"

_PEAKS = f"{WITH}, x AS (SELECT record, sample, {COARSE} AS v, max(sample) OVER (PARTITION BY record) AS last FROM sig), y AS (SELECT *, lag(v) OVER w AS a, lead(v) OVER w AS z FROM x WINDOW w AS (PARTITION BY record ORDER BY sample)), p AS (SELECT record, sample FROM y WHERE sign(v - a) * sign(z - v) = -1)"
_FLAT = f"""{_PEAKS}, f AS (SELECT record, sample, last, v - sum(CAST(v AS DOUBLE)) OVER (PARTITION BY record ORDER BY sample ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING) / 4 AS d FROM x),
n AS (SELECT p.record, p.sample AS peak, f.sample, f.d, row_number() OVER (PARTITION BY p.record, p.sample ORDER BY f.d DESC, f.sample) AS u, row_number() OVER (PARTITION BY p.record, p.sample ORDER BY f.d, f.sample) AS w, row_number() OVER (PARTITION BY p.record, p.sample ORDER BY abs(f.d) DESC, f.sample) AS b FROM p JOIN f ON f.record = p.record AND f.sample BETWEEN p.sample - 4 AND p.sample + 3 AND f.sample < f.last)"""
_BEATS = "x AS (SELECT record, sample, CAST(dval - lag(dval) OVER (PARTITION BY record ORDER BY sample) AS DOUBLE) AS d FROM sig), y AS (SELECT record, sample, sum(d * d) OVER (PARTITION BY record ORDER BY sample ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING) / 4 AS energy FROM x), z AS (SELECT *, max(energy) OVER (PARTITION BY record ORDER BY sample ROWS BETWEEN 6 PRECEDING AND 6 FOLLOWING) AS m, avg(energy) OVER (PARTITION BY record) AS mean FROM y)"

def _recorded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recordings(spark, sf_dir).select("record", "ch", "sample", (F.col("dval") / 1000).alias("pval"))


def d1_bandpass(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recordings between 5 and 20 a second, in blocks of 512 samples."""
    out = filters.zero_phase(_recorded(spark, sf_dir), *filters.butterworth_bandpass(5, 20, 360.0), block=512)
    return out.select("record", F.col("ch").cast("long").alias("ch"), "sample", F.round("pval", 6).alias("pval"))


def d2_moving_wave(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = filters.moving_wave(_recorded(spark, sf_dir), 9, 2.0)
    return out.select("record", F.col("ch").cast("long").alias("ch"), "sample", F.round("pval", 6).alias("pval"))


def d2_wave_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the integrated wave is largest within 20 samples on both sides."""
    wave = filters.moving_wave(_recorded(spark, sf_dir), 9, 2.0).withColumn("pval", F.round("pval", 6))
    return sig.local_peaks(wave, 20).select("record", F.col("ch").cast("long").alias("ch"), "sample")


# Channels mirrored at their ends, then the wavelet forward and backward; beyond the ends the last value holds.
_WAVE = f"""WITH s AS (SELECT record, ch, frame AS n, dval / 1000.0::DOUBLE AS x FROM {REC_SQL}), e AS (SELECT record, ch, min(n) AS lo, max(n) AS hi, arg_min(x, n) AS a, arg_max(x, n) AS z FROM s GROUP BY record, ch HAVING count(*) > 27),
x AS (SELECT record, ch, n, x FROM s JOIN e USING (record, ch) UNION ALL SELECT record, ch, 2 * lo - n, 2 * a - x FROM s JOIN e USING (record, ch) WHERE n > lo AND n <= lo + 27 UNION ALL SELECT record, ch, 2 * hi - n, 2 * z - x FROM s JOIN e USING (record, ch) WHERE n < hi AND n >= hi - 27),
w AS (SELECT k, 2 / (sqrt(6.0::DOUBLE) * pow(pi(), 0.25)) * (1 - (k - 4) * (k - 4) / 4.0::DOUBLE) * exp(-(k - 4) * (k - 4) / 8.0::DOUBLE) AS c FROM range(0, 9) r(k)),
f AS (SELECT x.record, x.ch, x.n + k AS n, x.x * c AS v FROM x, w UNION ALL SELECT record, ch, lo - 27 + d, (2 * a - x) * c FROM s JOIN e USING (record, ch) JOIN (SELECT k - j AS d, c FROM w, range(1, 9) q(j) WHERE j <= k) ON true WHERE n = lo + 27),
y AS (SELECT f.record, f.ch, n, sum(v) AS y FROM f JOIN e ON e.record = f.record AND e.ch = f.ch AND n BETWEEN lo - 27 AND hi + 27 GROUP BY f.record, f.ch, n),
b AS (SELECT record, ch, n - k AS n, y * c AS v FROM y, w UNION ALL SELECT y.record, y.ch, hi + 27 - d, y * c FROM y JOIN e USING (record, ch) JOIN (SELECT k - j AS d, c FROM w, range(1, 9) q(j) WHERE j <= k) ON true WHERE n = hi + 27),
m AS (SELECT b.record, b.ch, n AS sample, round(pow(sum(v), 2), 6) AS pval FROM b JOIN e ON e.record = b.record AND e.ch = b.ch AND n BETWEEN lo AND hi GROUP BY b.record, b.ch, n)"""

_STORED = f"(SELECT p_partkey AS i, CAST(p_size AS BIGINT) AS n, p_partkey % {len(dims.DAT_FORMATS)} AS k FROM part) JOIN {dims.sql_values([(i, *f) for i, f in enumerate(dims.DAT_FORMATS)])} AS t(k, fmt, bits, w, lo, hi, inv) USING (k)"

QUERIES = {
    "p1_dac": (p1_dac, f"{WITH} SELECT record, sample, CASE WHEN sample % 9 <> 0 AND dval <> -2048 THEN round((dval - 24) / 200.0, 6) END AS pval FROM sig"),
    "p2_adc": (p2_adc, f"{WITH} SELECT record, sample, CASE WHEN sample % 9 = 0 THEN -2048 ELSE CAST(round_even(round_even(pval, 2) * 50 + 24, 0) AS BIGINT) END AS dval FROM sig"),
    "p3_gain_baseline": (p3_gain_baseline, f"{_RANGE} SELECT record, round(CASE WHEN base <> -2047 THEN (-2047 - base) / lo ELSE 4094 / (hi - lo) END, 6) AS adc_gain, CAST(base AS BIGINT) AS baseline FROM c"),
    "p4_est_res": (p4_est_res, f"{_BITS} SELECT record, bits FROM r"),
    "p5_pick_format": (p5_pick_format, f"{_BITS} SELECT record, CASE WHEN bits <= 8 THEN '80' WHEN bits <= 12 THEN '212' WHEN bits <= 16 THEN '16' WHEN bits <= 24 THEN '24' ELSE '32' END AS fmt FROM r"),
    "p6_formats": (p6_formats, f"SELECT i, fmt, CAST(bits AS BIGINT) AS bits, round(CAST(w AS DOUBLE), 6) AS bytes_per_sample, CAST(lo AS BIGINT) AS min_value, CAST(hi AS BIGINT) AS max_value, CAST(inv AS BIGINT) AS invalid FROM {_STORED}"),
    "p7_smooth_physical": (p7_smooth_physical, f"{WITH} SELECT record, frame, round(sum(pval) / 4, 6) AS pval FROM sig GROUP BY record, frame"),
    "p7_smooth_digital": (p7_smooth_digital, f"{WITH} SELECT record, frame, CAST(trunc(sum(dval) / 4.0) AS BIGINT) AS dval FROM sig GROUP BY record, frame"),
    "p9_checksum": (p9_checksum, f"{_FEATURES} SELECT record, checksum FROM f"),
    "p24_features": (p24_features, f"{_FEATURES} SELECT * FROM f"),
    "f10_cohesion": (f10_cohesion, f"{_FEATURES} SELECT record, CASE record % 5 WHEN 0 THEN 'bounds' WHEN 1 THEN 'init_value' WHEN 2 THEN 'checksum' ELSE 'length' END AS rule FROM f WHERE (record % 5 = 0 AND (dmin < -128 OR dmax > 127)) OR record % 5 IN (1, 2, 3)"),
    "p13_normalize_bound": (p13_normalize_bound, f"{WITH}, m AS (SELECT record, min(pval) AS lo, max(pval) AS hi FROM sig GROUP BY record) SELECT record, sample, round(-5 + (pval - lo) * 20 / nullif(hi - lo, 0), 6) AS pval FROM sig JOIN m USING (record)"),
    "p14_normalize_length": (p14_normalize_length, f"{WITH} SELECT record, sample, round(pval / nullif(sqrt(sum(pval * pval) OVER (PARTITION BY record)), 0), 6) AS pval FROM sig"),
    "p15_moving_average": (p15_moving_average, f"{WITH} SELECT record, sample, round({_SMOOTH}, 6) AS smooth FROM sig"),
    "p18_ricker": (p18_ricker, f"{WITH} SELECT record, round(sum(pval * 2 / (sqrt(12.0::DOUBLE) * pow(pi(), 0.25)) * (1 - t * t / 16) * exp(-t * t / 32)), 6) AS value FROM (SELECT record, pval, sample - 31.5::DOUBLE AS t FROM sig) GROUP BY record"),
    "p20_wide": (p20_wide, f"{WITH} SELECT record, frame AS sample, " + ", ".join(f"max(CASE WHEN sample % 4 = {i} THEN dval END) AS s{i}" for i in range(4)) + " FROM sig GROUP BY record, frame"),
    "s22_deskew": (s22_deskew, f"{WITH} SELECT record, sample, coalesce(lead(dval, 3) OVER (PARTITION BY record ORDER BY sample), -2048) AS dval FROM sig"),
    "d6_interpolate": (d6_interpolate, f"""{WITH}, x AS (SELECT record, sample, CASE WHEN dval % 3 <> 0 THEN pval END AS v FROM sig), y AS (SELECT *, max(CASE WHEN v IS NOT NULL THEN sample END) OVER (PARTITION BY record ORDER BY sample) AS a, min(CASE WHEN v IS NOT NULL THEN sample END) OVER (PARTITION BY record ORDER BY sample ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS z FROM x)
SELECT y.record, y.sample, round(coalesce(y.v, l.v + (r.v - l.v) * (y.sample - a) / nullif(z - a, 0), l.v), 6) AS pval FROM y LEFT JOIN x l ON l.record = y.record AND l.sample = y.a LEFT JOIN x r ON r.record = y.record AND r.sample = y.z"""),
    "p22_resample_linear": (p22_resample_linear, f"{WITH}, n AS (SELECT record, CAST(floor((max(sample)) * 5 / 4.0) AS BIGINT) AS last FROM sig GROUP BY record), k AS (SELECT record, unnest(range(0, last + 1)) AS k FROM n) SELECT k.record, k AS sample, round(a.dval + coalesce((z.dval - a.dval) * (k * 0.8::DOUBLE - a.sample), 0), 6) AS pval FROM k JOIN sig a ON a.record = k.record AND a.sample = (k * 4) // 5 LEFT JOIN sig z ON z.record = k.record AND z.sample = a.sample + 1"),
    "w4_hard_peaks": (w4_hard_peaks, f"{WITH}, x AS (SELECT record, sample, {COARSE} AS v FROM sig), y AS (SELECT *, lag(v) OVER w AS a, lead(v) OVER w AS z FROM x WINDOW w AS (PARTITION BY record ORDER BY sample)) SELECT record, sample, CAST(sign(v - a) AS BIGINT) AS kind FROM y WHERE sign(v - a) * sign(z - v) = -1"),
    "w4_soft_peaks": (w4_soft_peaks, f"{WITH}, x AS (SELECT record, sample, {COARSE} AS v FROM sig), y AS (SELECT *, sample - row_number() OVER (PARTITION BY record, v ORDER BY sample) AS run FROM x), r AS (SELECT record, v, run, min(sample) AS s, max(sample) AS e FROM y GROUP BY record, v, run), q AS (SELECT *, lag(v) OVER w AS a, lead(v) OVER w AS z FROM r WINDOW w AS (PARTITION BY record ORDER BY s)) SELECT record, (s + e) // 2 AS sample, CAST(sign(v - a) AS BIGINT) AS kind FROM q WHERE e > s AND sign(v - a) * sign(z - v) = -1"),
    "w5_peak_candidates": (w5_peak_candidates, f"{WITH}, x AS (SELECT record, sample, {COARSE} AS v FROM sig) SELECT record, sample, v FROM (SELECT *, max(v) OVER (PARTITION BY record ORDER BY sample ROWS BETWEEN 5 PRECEDING AND 4 FOLLOWING) AS m FROM x) WHERE v = m"),
    "w5_local_peaks": (w5_local_peaks, f"{WITH.replace('WITH sig', 'WITH RECURSIVE sig')}, x AS (SELECT record, sample, {COARSE} AS v FROM sig), c AS (SELECT record, sample FROM (SELECT *, max(v) OVER (PARTITION BY record ORDER BY sample ROWS BETWEEN 5 PRECEDING AND 4 FOLLOWING) AS m FROM x) WHERE v = m), t AS (SELECT record, min(sample) AS s FROM c GROUP BY record UNION ALL SELECT t.record, min(c.sample) FROM t JOIN c ON c.record = t.record AND c.sample >= t.s + 5 GROUP BY t.record, t.s) SELECT record, s AS sample FROM t"),
    "w6_shift_peaks": (w6_shift_peaks, f"{_PEAKS} SELECT p.record, p.sample AS peak, arg_max(s.sample, s.v * 1000 - s.sample) AS sample FROM p JOIN x s ON s.record = p.record AND s.sample BETWEEN p.sample - 4 AND p.sample + 3 AND s.sample < s.last GROUP BY p.record, p.sample"),
    "w7_correct_peaks": (_corrected("compare"), f"{_FLAT}, m AS (SELECT record, avg(abs(d)) FILTER (u = 1) >= avg(abs(d)) FILTER (w = 1) AS up FROM n GROUP BY record) SELECT n.record, peak, sample FROM n JOIN m ON n.record = m.record WHERE (up AND u = 1) OR (NOT up AND w = 1)"),
    "w7_peaks_up": (_corrected("up"), f"{_FLAT} SELECT record, peak, sample FROM n WHERE u = 1"),
    "w7_peaks_down": (_corrected("down"), f"{_FLAT} SELECT record, peak, sample FROM n WHERE w = 1"),
    "w7_peaks_both": (_corrected("both"), f"{_FLAT} SELECT record, peak, sample FROM n WHERE b = 1"),
    "p8_convert_type": (p8_convert_type, f"{WITH} SELECT record, sample, dval FROM sig"),
    "p23_resampled_pair": (p23_resampled_pair, f"{WITH}, e AS (SELECT event_id % 500 AS record, CAST(trunc(event_id % 60 * 1.25::DOUBLE) AS BIGINT) AS sample, event_id AS ann_no FROM events) SELECT e.record, e.sample, ann_no, round(a.dval + coalesce((z.dval - a.dval) * (e.sample * 0.8::DOUBLE - a.sample), 0), 6) AS pval FROM e JOIN sig a ON a.record = e.record AND a.sample = (e.sample * 4) // 5 LEFT JOIN sig z ON z.record = a.record AND z.sample = a.sample + 1 WHERE e.sample <= 78"),
    "p24_derived_digital": (p24_derived_digital, f"""{_BITS}, f AS (SELECT record, CASE WHEN bits <= 8 THEN '80' WHEN bits <= 12 THEN '212' ELSE '16' END AS fmt, CASE WHEN bits <= 8 THEN 128 WHEN bits <= 12 THEN 2048 ELSE 32768 END AS h FROM r), m AS (SELECT f.record, any_value(fmt) AS fmt, any_value(h) AS h, min(dval) / 1024.0::DOUBLE AS lo, max(dval) / 1024.0::DOUBLE AS hi FROM sig JOIN f USING (record) GROUP BY f.record),
b AS (SELECT *, 1 - h - (2 * h - 2) / (hi - lo) * lo AS st FROM m), c AS (SELECT *, CASE WHEN lo > 0 THEN ceil(st) ELSE floor(st) END AS base FROM b), g AS (SELECT *, CASE WHEN base <> 1 - h THEN (1 - h - base) / lo ELSE (2 * h - 2) / (hi - lo) END AS gain FROM c)
SELECT sig.record, sample, fmt, round(gain, 6) AS adc_gain, CAST(base AS BIGINT) AS baseline, CAST(round_even(dval / 1024.0::DOUBLE * gain + base, 0) AS BIGINT) AS dval FROM sig JOIN g ON g.record = sig.record"""),
    "d3_filter_gain": (d3_filter_gain, "WITH f AS (SELECT l_orderkey AS record, CAST(l_linenumber AS BIGINT) AS n, CAST(l_quantity AS DOUBLE) * 2.5::DOUBLE AS frequency FROM lineitem), w AS (SELECT record, n, frequency, least(ceil(frequency / 125 * 512), 511) * pi() / 512 AS w FROM f) SELECT record, n, frequency, round(sqrt(pow(0.2 + 0.3 * cos(w) + 0.2 * cos(2 * w), 2) + pow(0.3 * sin(w) + 0.2 * sin(2 * w), 2)) / sqrt(pow(1 - 0.4 * cos(w) + 0.1 * cos(2 * w), 2) + pow(-0.4 * sin(w) + 0.1 * sin(2 * w), 2)), 9) AS gain FROM w"),
    "v3_plot_items": (v3_plot_items, f"{WITH} SELECT sig.record, 'v' || sig.record AS sig_name, sig.sample / 4.0::DOUBLE AS seconds, dval AS value, event_type AS symbol FROM events JOIN sig ON sig.record = event_id % 500 AND sig.sample = event_id % 71 WHERE event_id % 2 = 0"),
    "s23_infer_length": (s23_infer_length, f"SELECT p_partkey AS i, fmt, CAST(floor(p_size * 1000 / (CAST(w AS DOUBLE) * (p_partkey % 4 + 1))) AS BIGINT) AS frames FROM part, {dims.sql_values(dims.DAT_FORMATS)} AS t(fmt, bits, w, lo, hi, inv) WHERE fmt IN ('80', '212', '16', '24', '32')"),
    "d4_energy_beats": (d4_energy_beats, f"{WITH}, x AS (SELECT record, sample, CAST(dval - lag(dval) OVER (PARTITION BY record ORDER BY sample) AS DOUBLE) AS d FROM sig), y AS (SELECT record, sample, sum(d * d) OVER (PARTITION BY record ORDER BY sample ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING) / 4 AS energy FROM x), z AS (SELECT *, max(energy) OVER (PARTITION BY record ORDER BY sample ROWS BETWEEN 6 PRECEDING AND 6 FOLLOWING) AS m, avg(energy) OVER (PARTITION BY record) AS mean FROM y) SELECT record, sample, round(energy, 6) AS energy FROM z WHERE energy = m AND energy > 2 * mean"),
    "g3_average_beats": (g3_average_beats, f"{WITH}, {_BEATS}, q AS (SELECT record, sample FROM z WHERE energy = m AND energy > 2 * mean), n AS (SELECT record, count(*) AS n FROM q GROUP BY record), l AS (SELECT record, sample, unnest(range(-6, 8)) AS lag FROM q) SELECT l.record, lag, any_value(n.n) AS n, round(sum(dval) / CAST(any_value(n.n) AS DOUBLE), 6) AS mean FROM l JOIN sig ON sig.record = l.record AND sig.sample = l.sample + lag JOIN n ON n.record = l.record GROUP BY l.record, lag"),
    "j9_values_at": (j9_values_at, f"{WITH} SELECT sig.record, sig.sample, event_id AS ann_no, dval FROM events JOIN sig ON sig.record = event_id % 500 AND sig.sample = event_id % 71"),
    "s12_required_bytes": (s12_required_bytes, f"SELECT i, fmt, n, CAST(CASE WHEN fmt = '212' THEN ceil(n * 1.5) WHEN fmt = '310' AND n % 3 = 2 THEN ceil(n / 3.0) * 4 WHEN fmt IN ('310', '311') THEN ceil(n * 4 / 3.0) ELSE n * w END AS BIGINT) AS read, CAST(CASE WHEN fmt = '212' THEN ceil(n * 1.5) WHEN fmt IN ('310', '311') AND n % 3 = 2 THEN ceil(n / 3.0) * 4 WHEN fmt IN ('310', '311') THEN ceil(n * 4 / 3.0) ELSE n * w END AS BIGINT) AS written FROM {_STORED}"),
    "s14_fmt8": (s14_fmt8, f"{WITH}, x AS (SELECT record, sample, ((CAST(round_even(pval * 100, 0) AS BIGINT) + 128) & 255) - 128 AS d FROM sig) SELECT record, sample, CAST(100 + sum(d) OVER (PARTITION BY record ORDER BY sample) AS BIGINT) AS dval FROM x"),
    "s15_fmt16_roundtrip": (_round_trip("16", -32768, 32767), _round_trip_sql(-32768, 32767, 1, "[a & 255, (a >> 8) & 255]")),
    "s15_fmt61_roundtrip": (_round_trip("61", -32768, 32767), _round_trip_sql(-32768, 32767, 1, "[(a >> 8) & 255, a & 255]")),
    "s15_fmt32_roundtrip": (_round_trip("32", -(2**31), 2**31 - 1), _round_trip_sql(-(2**31), 2**31 - 1, 1, "[a & 255, (a >> 8) & 255, (a >> 16) & 255, (a >> 24) & 255]")),
    "s16_fmt80_roundtrip": (_round_trip("80", -128, 127), _round_trip_sql(-128, 127, 1, "[a + 128]")),
    "s16_fmt160_roundtrip": (_round_trip("160", -32768, 32767), _round_trip_sql(-32768, 32767, 1, "[(a + 32768) & 255, (a + 32768) >> 8]")),
    "s17_fmt212_roundtrip": (_round_trip("212", -2048, 2047), _round_trip_sql(-2048, 2047, 2, "[a & 255, ((a >> 8) & 15) + 16 * ((b >> 8) & 15), b & 255]", "CAST(ceil(n * 1.5) AS BIGINT)")),
    "s18_fmt310_roundtrip": (_round_trip("310", -512, 511), _round_trip_sql(-512, 511, 3, "[2 * (a & 127), ((a >> 7) & 7) + 8 * (c & 31), 2 * (b & 127), ((b >> 7) & 7) + 8 * ((c >> 5) & 31)]")),
    "s19_fmt311_roundtrip": (_round_trip("311", -512, 511), _round_trip_sql(-512, 511, 3, "[a & 255, ((a >> 8) & 3) + 4 * (b & 63), ((b >> 6) & 15) + 16 * (c & 15), (c >> 4) & 63]")),
    "s20_fmt24_roundtrip": (_round_trip("24", -(2**23), 2**23 - 1), _round_trip_sql(-(2**23), 2**23 - 1, 1, "[a & 255, (a >> 8) & 255, (a >> 16) & 255]")),
    "d1_bandpass": (d1_bandpass, None),
    "d2_moving_wave": (d2_moving_wave, f"{_WAVE} SELECT record, CAST(ch AS BIGINT) AS ch, sample, pval FROM m"),
    "d2_wave_peaks": (d2_wave_peaks, f"{_WAVE} SELECT record, CAST(ch AS BIGINT) AS ch, sample FROM (SELECT *, max(pval) OVER (PARTITION BY record, ch ORDER BY sample ROWS BETWEEN 20 PRECEDING AND 19 FOLLOWING) AS most FROM m) WHERE pval = most"),
}

"""Queries on annotations and beats."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulselake import dims
from pulselake.operators import annotations as ann
from pulselake.operators import beats
from pulselake.plans.tables import ANN_SQL, FS, REC_SQL, annotations, recording_channels, recordings, table

LABELS = f"{dims.sql_values([(*r, r[0] in dims.QRS_LABELS) for r in dims.ANN_LABELS])} AS lab(label_store, symbol, short_description, description, is_qrs)"
WITH = f"WITH ann AS {ANN_SQL}, rr AS (SELECT record, sample, ann_no, sample - lag(sample) OVER (PARTITION BY record ORDER BY sample, ann_no) AS rr FROM ann)"
MATCH_WINDOW = 5_000_000


def _two(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two annotators: even and odd events."""
    a = annotations(spark, sf_dir)
    return a.where("ann_no % 2 = 0"), a.where("ann_no % 2 = 1")


def _bounds(a: DataFrame) -> tuple[int, int]:
    """A closed range: from a quarter to a half of all samples' span."""
    lo, hi = a.agg(F.min("sample"), F.max("sample")).first()
    return (0, 0) if lo is None else (lo + (hi - lo) // 4, lo + (hi - lo) // 2)


BOUNDS = "b AS (SELECT min(sample) + (max(sample) - min(sample)) // 4 AS lo, min(sample) + (max(sample) - min(sample)) // 2 AS hi FROM ann)"


def w1_rr_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.rr_intervals(annotations(spark, sf_dir), FS).select("record", "sample", "rr", F.round("rr_sec", 6).alias("rr_sec"))


def f7_rr_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    rr = ann.filter_rr(ann.rr_intervals(annotations(spark, sf_dir), FS), 60.0, 40000.0)
    return rr.select("record", "sample", "rr")


def g1_mean_hr(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ann.mean_heart_rate(ann.rr_intervals(annotations(spark, sf_dir), FS))
    return found.select("record", "n_rr", F.round("mean_hr", 9).alias("mean_hr"))


def w2_ann2rr(spark: SparkSession, sf_dir: str) -> DataFrame:
    rr = ann.rr_intervals(annotations(spark, sf_dir), FS, first_from_zero=True)
    return rr.select("record", "sample", F.bround(F.col("rr_sec") * 1000).cast("long").alias("rr_ms"))


def w3_hr_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.hr_steps(annotations(spark, sf_dir), FS).withColumn("hr", F.round("hr", 6))


def w3_hr_to_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = annotations(spark, sf_dir)
    lengths = a.groupBy("record").agg((F.max("sample") + 1000).alias("sig_len"))
    return ann.hr_steps(a, FS, lengths).withColumn("hr", F.round("hr", 6))


def w2_rr_minutes(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ann.ann_to_rr(annotations(spark, sf_dir), FS, 60.0, 40000.0, "m")
    return out.select("record", "sample", F.round("interval", 9).alias("interval"))


def g1_mean_hr_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates of the views of all records; those with fewer than two have 0."""
    a = annotations(spark, sf_dir)
    found = ann.mean_heart_rate(ann.rr_intervals(a.where("event_type = 'purchase'"), FS), a)
    return found.select("record", "n_rr", F.round("mean_hr", 9).alias("mean_hr"))


def j11_label_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ann.with_label_elements(annotations(spark, sf_dir), dims.ann_labels(spark), ["label_store", "description"])
    return out.select("record", "ann_no", F.col("label_store").cast("long").alias("label_store"), "description")


def j12_standard_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    custom = annotations(spark, sf_dir).select("record", F.when(F.col("event_type") == "click", 45).alias("label_store"), F.col("event_type").alias("symbol"), F.upper("event_type").alias("description")).distinct()
    used = annotations(spark, sf_dir).select("record", (F.col("ann_no") % 17 + 1).cast("int").alias("label_store"))
    return ann.standard_labels(custom, used).withColumn("label_store", F.col("label_store").cast("long"))


def o1_ordered_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    one, two = (x.withColumn("sample", F.expr("sample div 100000000")) for x in _two(spark, sf_dir))
    both = ann.merge(one, two, "combine", 0, 1 << 60)
    return ann.numbered(both, ["source", "ann_no"]).select("record", "sample", "ann_no", F.col("place").cast("long").alias("place"))


def o2_onset_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = annotations(spark, sf_dir).withColumn("sample", F.expr("sample div 100000000"))
    return ann.by_onset(a).select("record", "sample", "ann_no")


def u9_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = annotations(spark, sf_dir).select("record", "sample", "symbol")
    b = annotations(spark, sf_dir).select("record", (F.col("sample") + (F.col("ann_no") % 10 == 0).cast("int")).alias("sample"), "symbol")
    return ann.differences(a, b).withColumn("only_in", F.col("only_in").cast("long"))


def k14_rr_cumsum(spark: SparkSession, sf_dir: str) -> DataFrame:
    rr = ann.rr_intervals(annotations(spark, sf_dir), FS).select("record", F.col("ann_no").alias("i"), "rr_sec")
    return ann.beats_from_rr(rr, FS).select("record", "i", "sample")


def g2_contained_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ann.contained_labels(annotations(spark, sf_dir), dims.ann_labels(spark))
    return found.withColumn("label_store", F.col("label_store").cast("long"))


def j1_label_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ann.convert_labels(annotations(spark, sf_dir), dims.ann_labels(spark), "symbol", "label_store")
    return out.select("record", "ann_no", "symbol", F.col("label_store").cast("long").alias("label_store"))


def j2_label_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    custom = table(spark, sf_dir, "nation").select((F.col("n_nationkey") * 2).cast("int").alias("label_store"), F.lower(F.substring("n_name", 1, 2)).alias("symbol"), F.col("n_name").alias("description"))
    out = ann.overlay_labels(dims.ann_labels(spark), custom)
    return out.withColumn("label_store", F.col("label_store").cast("long"))


def j3_symbols_to_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = annotations(spark, sf_dir).withColumn("symbol", F.when(F.col("event_type") == "click", "N").otherwise(F.col("event_type")))
    return ann.symbols_to_notes(a, dims.ann_labels(spark)).select("record", "ann_no", "symbol", "aux_note")


def _used(spark: SparkSession, sf_dir: str) -> DataFrame:
    return annotations(spark, sf_dir).select("record", (F.col("ann_no") % 49 + 1).cast("int").alias("label_store"))


def j4_available_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.available_codes(_used(spark, sf_dir)).withColumn("label_store", F.col("label_store").cast("long"))


def j12_custom_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    symbols = annotations(spark, sf_dir).select("record", F.col("event_type").alias("symbol")).distinct()
    return ann.assign_free_codes(symbols, ann.available_codes(_used(spark, sf_dir))).withColumn("label_store", F.col("label_store").cast("long"))


def _merged(method: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        one, two = _two(spark, sf_dir)
        lo, hi = _bounds(annotations(spark, sf_dir))
        return ann.merge(one, two, method, lo, hi).select("record", "sample", "ann_no", F.col("source").cast("long").alias("source"))

    return query


def _merged_sql(first: str, second: str) -> str:
    part = "SELECT record, sample, ann_no, {s} AS source FROM ann, b WHERE ann_no % 2 = {p} AND sample {rule} lo AND hi"
    return f"{WITH}, {BOUNDS} " + part.format(s="CAST(1 AS BIGINT)", p=0, rule=first) + " UNION ALL " + part.format(s="CAST(2 AS BIGINT)", p=1, rule=second)


def u5_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = annotations(spark, sf_dir).withColumn("duration", F.col("ann_no") % 4).withColumn("aux_note", F.col("event_type"))
    return ann.expand_durations(a).select("record", "sample", "ann_no", "aux_note")


def u8_setdiff(spark: SparkSession, sf_dir: str) -> DataFrame:
    one, two = (x.withColumn("sample", F.expr("sample div 100000000")) for x in _two(spark, sf_dir))
    return ann.unmatched(one, two).select("record", "sample", "symbol", "ann_no")


def f4_apply_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = annotations(spark, sf_dir)
    return ann.apply_range(a, *_bounds(a), shift=True).select("record", "sample", "ann_no")


def f9_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = annotations(spark, sf_dir)
    a = a.select("record", "ann_no", "sample", (F.col("ann_no") % 53).alias("label_store"), (F.col("ann_no") % 300 - 150).alias("subtype"), "chan", (F.col("ann_no") % 130).alias("num"), F.when(F.col("event_type") == "error", "a b").otherwise(F.substring("event_type", 1, 4)).alias("symbol"))
    return ann.violations(a)


def f13_contiguous_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.contiguous_groups(annotations(spark, sf_dir), "chan").select("record", F.col("n_runs").cast("long").alias("n_runs"), "n_distinct", "contiguous")


def k10_compact_carried(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.compact_carried(annotations(spark, sf_dir), "chan").select("record", "ann_no", "write_chan")


def s25_carry_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = annotations(spark, sf_dir).withColumn("chan", F.when(F.col("ann_no") % 5 == 0, F.col("chan")))
    return ann.carry_forward(a, "chan").select("record", "ann_no", "chan")


def k9_sample_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.sample_deltas(annotations(spark, sf_dir)).select("record", "ann_no", "delta", "n_skips")


def p16_resample_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.resample(annotations(spark, sf_dir), FS, 250.0).select("record", "ann_no", "sample")


def j6_mutual_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return beats.match_nearest(*_two(spark, sf_dir), MATCH_WINDOW)


def j6_greedy_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return beats.match_beats(*_two(spark, sf_dir), MATCH_WINDOW)


def g4_greedy_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = beats.beat_statistics(*_two(spark, sf_dir), MATCH_WINDOW)
    return found.select("record", *[F.col(c).cast("long").alias(c) for c in ("tp", "fp", "fn")], *[F.round(c, 6).alias(c) for c in ("sensitivity", "positive_predictivity")])


def g4_match_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = beats.match_statistics(*_two(spark, sf_dir), MATCH_WINDOW)
    return found.select("record", *[F.col(c).cast("long").alias(c) for c in ("tp", "fp", "fn")], *[F.round(c, 6).alias(c) for c in ("sensitivity", "positive_predictivity")])


def g5_benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = beats.benchmark(*_two(spark, sf_dir), MATCH_WINDOW)
    return found.select(F.round("sensitivity", 6).alias("sensitivity"), F.round("positive_predictivity", 6).alias("positive_predictivity"), "n_records")


def m7_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every standard label and how many annotations have its symbol."""
    used = annotations(spark, sf_dir).groupBy("symbol").agg(F.count("*").alias("n"))
    out = dims.ann_labels(spark).join(used, "symbol", "left")
    return out.select(F.col("label_store").cast("long").alias("label_store"), "symbol", "short_description", "description", "is_qrs", F.coalesce("n", F.lit(0)).alias("n_used"))


def m9_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annotations and records of every class of annotators; records are dealt to the classes."""
    names = F.array(*[F.lit(c[0]) for c in dims.ANN_CLASSES])
    own = annotations(spark, sf_dir).select("record", F.element_at(names, (F.col("record") % len(dims.ANN_CLASSES) + 1).cast("int")).alias("extension"))
    found = own.groupBy("extension").agg(F.count("*").alias("n"), F.count_distinct("record").alias("n_records"))
    return dims.ann_classes(spark).join(found, "extension", "left").select("extension", "description", "human_reviewed", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("n_records", F.lit(0)).alias("n_records"))


def _from_clock(a: DataFrame) -> str:
    """The full second at which a quarter of all samples' span is over."""
    return f"{_bounds(a)[0] // int(FS) // 3600}:{_bounds(a)[0] // int(FS) // 60 % 60:02d}:{_bounds(a)[0] // int(FS) % 60:02d}"


def u4_merge_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two annotators from a clock time to the end, the second one on a channel of its own."""
    one, two = _two(spark, sf_dir)
    out = ann.merge(one, two, "combine", _from_clock(annotations(spark, sf_dir)), "e", FS, (None, 7))
    return out.select("record", "sample", "ann_no", F.col("chan").cast("long").alias("chan"), F.col("source").cast("long").alias("source"))


def g3_signal_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recordings around events that are beats, within and beyond their ends."""
    a = annotations(spark, sf_dir).select(F.concat(F.lit("r"), (F.col("ann_no") % 5).cast("string")).alias("record"), (F.col("ann_no") * 7 % 2500).alias("sample"), "symbol")
    out = beats.signal_average(recordings(spark, sf_dir), a, recording_channels(spark), dims.ann_labels(spark), FS, -0.02, 0.03, start=0.5)
    return out.select("record", F.col("ch").cast("long").alias("ch"), F.col("lag").cast("long").alias("lag"), "seconds", "n", F.round("mean", 4).alias("mean"))


def g10_label_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = annotations(spark, sf_dir).cube("symbol", "chan").agg(F.count("*").alias("n"), F.count_distinct("record").alias("n_records"))
    return out.select("symbol", "chan", "n", "n_records")


# One reference beat a step: k is the nearest test beat from ``start`` on, q that of the next reference beat.
GREEDY = f"""{WITH.replace('WITH', 'WITH RECURSIVE', 1)}, sides AS (
  SELECT record, list_sort(list_distinct(list(sample) FILTER (ann_no % 2 = 0))) AS r, list_sort(list(sample) FILTER (ann_no % 2 = 1)) AS t FROM ann GROUP BY record
), step AS (
  SELECT record, 0 AS i, 1 AS start, CAST(NULL AS BIGINT) AS got, CAST(NULL AS BIGINT) AS k FROM sides WHERE len(r) > 0 AND len(t) > 0
  UNION ALL
  SELECT record, i + 1, CASE WHEN taken IS NULL THEN start ELSE taken + 1 END, CASE WHEN abs(ref - t[taken]) < {MATCH_WINDOW} THEN taken END, taken
  FROM (
    SELECT *, CASE WHEN k = q AND abs(r[i + 2] - t[k]) < abs(ref - t[k]) THEN CASE WHEN k > 1 AND k - 1 IS DISTINCT FROM got THEN k - 1 END ELSE k END AS taken
    FROM (
      SELECT record, i, start, got, r, t, r[i + 1] AS ref,
        start - 1 + list_position(list_transform(t[start:], lambda x: abs(x - r[i + 1])), list_min(list_transform(t[start:], lambda x: abs(x - r[i + 1])))) AS k,
        start - 1 + list_position(list_transform(t[start:], lambda x: abs(x - r[i + 2])), list_min(list_transform(t[start:], lambda x: abs(x - r[i + 2])))) AS q
      FROM step JOIN sides USING (record) WHERE i < len(r) AND start <= len(t)
    )
  )
), m AS (
  SELECT step.record, r[i] AS ref_sample, t[got] AS test_sample FROM step JOIN sides USING (record) WHERE got IS NOT NULL
)"""
NEAREST = f"""{WITH}, r AS (SELECT DISTINCT record, sample FROM ann WHERE ann_no % 2 = 0), t AS (SELECT DISTINCT record, sample FROM ann WHERE ann_no % 2 = 1),
p AS (SELECT r.record, r.sample AS ref_sample, t.sample AS test_sample, abs(r.sample - t.sample) AS d FROM r JOIN t ON r.record = t.record AND abs(r.sample - t.sample) < {MATCH_WINDOW}),
m AS (SELECT record, ref_sample, test_sample FROM (SELECT *, row_number() OVER (PARTITION BY record, ref_sample ORDER BY d, test_sample) AS a, row_number() OVER (PARTITION BY record, test_sample ORDER BY d, ref_sample) AS z FROM p) WHERE a = 1 AND z = 1)"""
STATS = f"""{NEAREST}, s AS (SELECT record, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(t) - sum(tp) AS BIGINT) AS fp, CAST(sum(r) - sum(tp) AS BIGINT) AS fn, sum(tp) / nullif(sum(r), 0) AS se, sum(tp) / nullif(sum(t), 0) AS pp
FROM (SELECT record, 1 AS tp, 0 AS r, 0 AS t FROM m UNION ALL SELECT record, 0, 1, 0 FROM r UNION ALL SELECT record, 0, 0, 1 FROM t) GROUP BY record)"""

QUERIES = {
    "w1_rr_intervals": (w1_rr_intervals, f"{WITH} SELECT record, sample, rr, round(rr / 360.0, 6) AS rr_sec FROM rr WHERE rr IS NOT NULL"),
    "f7_rr_filtered": (f7_rr_filtered, f"{WITH} SELECT record, sample, rr FROM rr WHERE rr / 360.0 > 60 AND rr / 360.0 < 40000"),
    "g1_mean_hr": (g1_mean_hr, f"{WITH} SELECT record, count(*) AS n_rr, round(coalesce(60.0 / avg(rr / CAST(360 AS DOUBLE)), 0), 9) AS mean_hr FROM rr WHERE rr IS NOT NULL GROUP BY record"),
    "w2_ann2rr": (w2_ann2rr, f"{WITH} SELECT record, sample, CAST(round_even(coalesce(rr, sample) / CAST(360 AS DOUBLE) * 1000, 0) AS BIGINT) AS rr_ms FROM rr"),
    "w3_hr_steps": (w3_hr_steps, f"{WITH}, n AS (SELECT *, lead(sample) OVER (PARTITION BY record ORDER BY sample, ann_no) AS nxt FROM rr) SELECT record, sample + 1 AS start_sample, nxt AS end_sample, round(21600.0 / nullif(CAST(rr AS DOUBLE), 0), 6) AS hr FROM n WHERE rr IS NOT NULL AND nxt IS NOT NULL"),
    "w3_hr_to_end": (w3_hr_to_end, f"{WITH}, n AS (SELECT *, lead(sample) OVER w AS nxt, max(sample) OVER (PARTITION BY record) AS last FROM rr WINDOW w AS (PARTITION BY record ORDER BY sample, ann_no)) SELECT record, sample + 1 AS start_sample, CASE WHEN nxt = last THEN last + 999 ELSE nxt END AS end_sample, round(21600.0 / nullif(CAST(rr AS DOUBLE), 0), 6) AS hr FROM n WHERE rr IS NOT NULL AND nxt IS NOT NULL"),
    "w2_rr_minutes": (w2_rr_minutes, f"{WITH} SELECT record, sample, round(coalesce(rr, sample) / CAST(360 AS DOUBLE) / 60, 9) AS interval FROM rr WHERE coalesce(rr, sample) / CAST(360 AS DOUBLE) > 60 AND coalesce(rr, sample) / CAST(360 AS DOUBLE) < 40000"),
    "g1_mean_hr_all": (g1_mean_hr_all, f"{WITH}, v AS (SELECT record, sample - lag(sample) OVER (PARTITION BY record ORDER BY sample, ann_no) AS d FROM ann WHERE event_type = 'purchase') SELECT r.record, count(d) AS n_rr, round(coalesce(60.0 / avg(d / CAST(360 AS DOUBLE)), 0), 9) AS mean_hr FROM (SELECT DISTINCT record FROM ann) r LEFT JOIN v ON v.record = r.record GROUP BY r.record"),
    "j11_label_elements": (j11_label_elements, f"{WITH} SELECT record, ann_no, CAST(label_store AS BIGINT) AS label_store, description FROM ann a LEFT JOIN {LABELS} ON a.symbol = lab.symbol"),
    "j12_standard_labels": (j12_standard_labels, f"{WITH}, c AS (SELECT DISTINCT record, event_type AS symbol FROM ann), f AS (SELECT record, label_store FROM (SELECT DISTINCT record FROM ann), (SELECT unnest(generate_series(1, 49)) AS label_store) EXCEPT (SELECT record, ann_no % 17 + 1 FROM ann UNION ALL SELECT record, 45 FROM c WHERE symbol = 'click')), x AS (SELECT record, symbol, row_number() OVER (PARTITION BY record ORDER BY symbol) AS n FROM c WHERE symbol <> 'click'), y AS (SELECT *, row_number() OVER (PARTITION BY record ORDER BY label_store) AS n FROM f) SELECT record, CAST(45 AS BIGINT) AS label_store, symbol, upper(symbol) AS description FROM c WHERE symbol = 'click' UNION ALL SELECT x.record, label_store, symbol, upper(symbol) FROM x JOIN y ON x.record = y.record AND x.n = y.n"),
    "o1_ordered_merge": (o1_ordered_merge, f"{WITH}, c AS (SELECT record, sample // 100000000 AS sample, ann_no FROM ann) SELECT record, sample, ann_no, row_number() OVER (PARTITION BY record ORDER BY sample, ann_no % 2, ann_no) - 1 AS place FROM c"),
    "o2_onset_order": (o2_onset_order, f"{WITH} SELECT record, sample // 100000000 AS sample, ann_no FROM ann ORDER BY record, 2, ann_no"),
    "u9_differences": (u9_differences, f"{WITH}, a AS (SELECT record, sample, symbol FROM ann), b AS (SELECT record, sample + CAST(ann_no % 10 = 0 AS BIGINT) AS sample, symbol FROM ann) SELECT *, CAST(1 AS BIGINT) AS only_in FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL SELECT *, CAST(2 AS BIGINT) FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)"),
    "k14_rr_cumsum": (k14_rr_cumsum, f"{WITH} SELECT record, ann_no AS i, CAST(sum(rr) OVER (PARTITION BY record ORDER BY ann_no) AS BIGINT) AS sample FROM rr WHERE rr IS NOT NULL"),
    "g2_contained_labels": (g2_contained_labels, f"{WITH} SELECT record, a.symbol, CAST(label_store AS BIGINT) AS label_store, description, count(*) AS n_occurrences FROM ann a LEFT JOIN {LABELS} ON a.symbol = lab.symbol GROUP BY ALL"),
    "j1_label_lookup": (j1_label_lookup, f"{WITH} SELECT record, ann_no, a.symbol, CAST(label_store AS BIGINT) AS label_store FROM ann a LEFT JOIN {LABELS} ON a.symbol = lab.symbol"),
    "j2_label_overlay": (j2_label_overlay, f"WITH c AS (SELECT n_nationkey * 2 AS label_store, lower(substr(n_name, 1, 2)) AS symbol, n_name AS description FROM nation) SELECT CAST(coalesce(c.label_store, lab.label_store) AS BIGINT) AS label_store, coalesce(c.symbol, lab.symbol) AS symbol, coalesce(c.description, lab.description) AS description FROM c FULL OUTER JOIN {LABELS} ON c.label_store = lab.label_store"),
    "j3_symbols_to_notes": (j3_symbols_to_notes, f"{WITH} SELECT record, ann_no, CASE WHEN event_type = 'click' THEN 'N' ELSE '\"' END AS symbol, CASE WHEN event_type = 'click' THEN aux_note WHEN aux_note = '' THEN event_type ELSE event_type || ' ' || aux_note END AS aux_note FROM ann"),
    "j4_available_codes": (j4_available_codes, f"{WITH} SELECT record, label_store FROM (SELECT DISTINCT record FROM ann), (SELECT unnest(generate_series(1, 49)) AS label_store) EXCEPT SELECT record, ann_no % 49 + 1 FROM ann"),
    "j12_custom_codes": (j12_custom_codes, f"{WITH}, f AS (SELECT record, label_store FROM (SELECT DISTINCT record FROM ann), (SELECT unnest(generate_series(1, 49)) AS label_store) EXCEPT SELECT record, ann_no % 49 + 1 FROM ann), s AS (SELECT DISTINCT record, event_type AS symbol FROM ann) SELECT x.record, symbol, label_store FROM (SELECT *, row_number() OVER (PARTITION BY record ORDER BY symbol) AS n FROM s) x JOIN (SELECT *, row_number() OVER (PARTITION BY record ORDER BY label_store) AS n FROM f) y ON x.record = y.record AND x.n = y.n"),
    "u1_merge_combine": (_merged("combine"), _merged_sql("BETWEEN", "BETWEEN")),
    "u2_merge_delete": (_merged("delete"), _merged_sql("NOT BETWEEN", "NOT BETWEEN")),
    "u3_merge_replace1": (_merged("replace1"), _merged_sql("BETWEEN", "NOT BETWEEN")),
    "u3_merge_replace2": (_merged("replace2"), _merged_sql("NOT BETWEEN", "BETWEEN")),
    "u5_durations": (u5_durations, f"{WITH} SELECT record, sample, ann_no, CASE WHEN ann_no % 4 > 0 THEN '(' ELSE '' END || event_type AS aux_note FROM ann UNION ALL SELECT record, sample + ann_no % 4, ann_no, event_type || ')' FROM ann WHERE ann_no % 4 > 0"),
    "u8_setdiff": (u8_setdiff, f"{WITH}, c AS (SELECT record, sample // 100000000 AS sample, symbol, ann_no FROM ann) SELECT * FROM c WHERE ann_no % 2 = 0 AND NOT EXISTS (SELECT 1 FROM c d WHERE d.ann_no % 2 = 1 AND d.record = c.record AND d.sample = c.sample AND d.symbol = c.symbol)"),
    "f4_apply_range": (f4_apply_range, f"{WITH}, {BOUNDS} SELECT record, sample - lo AS sample, ann_no FROM ann, b WHERE sample BETWEEN lo AND hi"),
    "f9_violations": (f9_violations, f"{WITH}, x AS (SELECT record, ann_no, CASE WHEN ann_no % 53 NOT BETWEEN 1 AND 49 THEN 'label_range' END AS a, CASE WHEN ann_no % 300 - 150 NOT BETWEEN -128 AND 127 THEN 'subtype_range' END AS b, CASE WHEN ann_no % 130 > 127 THEN 'num_range' END AS c, CASE WHEN event_type <> 'error' THEN 'symbol_length' END AS d, CASE WHEN event_type = 'error' THEN 'symbol_space' END AS e, CASE WHEN sample < lag(sample) OVER (PARTITION BY record ORDER BY ann_no) THEN 'falling_sample' END AS f FROM ann) SELECT record, ann_no, rule FROM (SELECT record, ann_no, unnest([a, b, c, d, e, f]) AS rule FROM x) WHERE rule IS NOT NULL"),
    "f13_contiguous_groups": (f13_contiguous_groups, f"{WITH} SELECT record, CAST(sum(CASE WHEN p IS NULL OR p <> chan THEN 1 ELSE 0 END) AS BIGINT) AS n_runs, count(DISTINCT chan) AS n_distinct, sum(CASE WHEN p IS NULL OR p <> chan THEN 1 ELSE 0 END) = count(DISTINCT chan) AS contiguous FROM (SELECT record, chan, lag(chan) OVER (PARTITION BY record ORDER BY sample, ann_no) AS p FROM ann) GROUP BY record"),
    "k10_compact_carried": (k10_compact_carried, f"{WITH} SELECT record, ann_no, chan IS DISTINCT FROM lag(chan, 1, 0) OVER (PARTITION BY record ORDER BY sample, ann_no) AS write_chan FROM ann"),
    "s25_carry_forward": (s25_carry_forward, f"{WITH} SELECT record, ann_no, coalesce(last_value(CASE WHEN ann_no % 5 = 0 THEN chan END IGNORE NULLS) OVER (PARTITION BY record ORDER BY sample, ann_no ROWS UNBOUNDED PRECEDING), 0) AS chan FROM ann"),
    "k9_sample_deltas": (k9_sample_deltas, f"{WITH} SELECT record, ann_no, coalesce(rr, sample) AS delta, CAST(CASE WHEN coalesce(rr, sample) > 1023 THEN ceil(coalesce(rr, sample) / 2147483647.0) ELSE 0 END AS BIGINT) AS n_skips FROM rr"),
    "p16_resample_ann": (p16_resample_ann, f"{WITH} SELECT record, ann_no, CAST(trunc(sample * (250 / CAST(360 AS DOUBLE))) AS BIGINT) AS sample FROM ann"),
    "j6_mutual_nearest": (j6_mutual_nearest, f"{NEAREST} SELECT * FROM m"),
    "j6_greedy_match": (j6_greedy_match, f"{GREEDY} SELECT * FROM m"),
    "g4_greedy_stats": (g4_greedy_stats, f"{GREEDY}, s AS (SELECT sides.record, (SELECT count(*) FROM m WHERE m.record = sides.record) AS tp, len(coalesce(r, [])) AS r, len(coalesce(t, [])) AS t FROM sides) SELECT record, tp, t - tp AS fp, r - tp AS fn, round(tp / nullif(r, 0), 6) AS sensitivity, round(tp / nullif(t, 0), 6) AS positive_predictivity FROM s"),
    "g4_match_stats": (g4_match_stats, f"{STATS} SELECT record, tp, fp, fn, round(se, 6) AS sensitivity, round(pp, 6) AS positive_predictivity FROM s"),
    "g5_benchmark": (g5_benchmark, f"{STATS} SELECT round(avg(se), 6) AS sensitivity, round(avg(pp), 6) AS positive_predictivity, count(*) AS n_records FROM s"),
    "u4_merge_times": (u4_merge_times, f"WITH ann AS {ANN_SQL}, {BOUNDS} SELECT record, sample, ann_no, CASE WHEN ann_no % 2 = 0 THEN chan ELSE 7 END AS chan, 1 + ann_no % 2 AS source FROM ann, b WHERE sample >= lo // 360 * 360"),
    "g3_signal_average": (g3_signal_average, f"WITH ann AS {ANN_SQL}, q AS (SELECT 'r' || ann_no % 5 AS record, ann_no * 7 % 2500 AS sample FROM ann JOIN {LABELS} ON lab.symbol = ann.symbol WHERE is_qrs AND ann_no * 7 % 2500 >= 180), c AS (SELECT record, count(*) AS n FROM q GROUP BY record), rec AS {REC_SQL}, l AS (SELECT record, sample, unnest(range(-7, 11)) AS lag FROM q), s AS (SELECT l.record, ch, lag, sum(dval) AS total FROM l JOIN rec ON rec.record = l.record AND rec.frame = l.sample + lag GROUP BY l.record, ch, lag) SELECT c.record, CAST(k.ch AS BIGINT) AS ch, g.lag, round(g.lag / 360.0::DOUBLE, 5) AS seconds, n, round(round((coalesce(total, 0) / n - 10 * k.ch) / (200.0::DOUBLE + 50 * k.ch), 5), 4) AS mean FROM c, (VALUES (0), (1)) AS k(ch), (SELECT unnest(range(-7, 11)) AS lag) g LEFT JOIN s ON s.record = c.record AND s.ch = k.ch AND s.lag = g.lag"),
    "m7_labels": (m7_labels, f"WITH ann AS {ANN_SQL}, u AS (SELECT symbol, count(*) AS n FROM ann GROUP BY symbol) SELECT CAST(label_store AS BIGINT) AS label_store, lab.symbol, short_description, description, is_qrs, coalesce(n, 0) AS n_used FROM {LABELS} LEFT JOIN u ON u.symbol = lab.symbol"),
    "m9_classes": (m9_classes, f"WITH ann AS {ANN_SQL}, u AS (SELECT record % {len(dims.ANN_CLASSES)} AS k, count(*) AS n, count(DISTINCT record) AS n_records FROM ann GROUP BY 1) SELECT extension, description, human_reviewed, coalesce(n, 0) AS n, coalesce(n_records, 0) AS n_records FROM {dims.sql_values([(i, *c) for i, c in enumerate(dims.ANN_CLASSES)])} AS c(k, extension, description, human_reviewed) LEFT JOIN u ON u.k = c.k"),
    "g10_label_cube": (g10_label_cube, f"{WITH} SELECT symbol, chan, count(*) AS n, count(DISTINCT record) AS n_records FROM ann GROUP BY CUBE (symbol, chan)"),
}

"""Queries written in SQL, with the functions of ``functions/sql.py`` and the data sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulselake.functions import sql
from pulselake.plans.annotation_queries import WITH as ANN_WITH
from pulselake.plans.annotation_queries import _two
from pulselake.plans.record_queries import FROM, TO
from pulselake.plans.record_queries import WITH as REC_WITH
from pulselake.plans.segment_queries import RANGES
from pulselake.plans.tables import FS, channels, recording_channels, recording_records, recordings, segments, table
from pulselake.sources import formats, headers
from pulselake.sources.files import scratch_folder, settled

_WHERE = f"frame >= {FROM} AND frame < {TO} AND sig_name = 'II' AND record <> 'r2'"


def s7_source_where(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recordings by the data source: the conditions say which files and bytes are read."""
    folder = scratch_folder(spark, "source")
    headers.write_record(recording_records(spark).withColumn("sig_len", F.lit(0)), recording_channels(spark), recordings(spark, sf_dir), folder)
    formats.register(spark)
    read = spark.read.format("waveform").option("blockFrames", 600).load(folder)
    return spark.sql(f"SELECT record, frame, dval, round(pval, 6) AS pval FROM {{read}} WHERE {_WHERE}", read=read)


def sql_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    sql.register(spark)
    events = table(spark, sf_dir, "events").select("event_id", F.format_string("%d:%02d:%02d", F.col("event_id") % 24, F.col("event_id") % 60, F.col("event_id") % 50).alias("clock"))
    return spark.sql("SELECT event_id, clock_micros(clock) AS micros, micros_sample(clock_micros(clock), 360D) AS n, sample_time(978307200000000, event_id * 1009, 360D) AS at, clock_micros('x' || clock) AS none FROM {e}", e=events)


def sql_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digital samples of every vector to physical ones and back, and the heart rate of their size."""
    sql.register(spark)
    s = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("record"), F.posexplode("embedding").alias("sample", "x")).withColumn("dval", F.bround(F.col("x").cast("double") * 1000).cast("long"))
    return spark.sql("SELECT record, CAST(sample AS BIGINT) AS sample, round(physical(dval, 200D, 5, -100), 6) AS pval, digital(physical(dval, 200D, 5, -100), 200D, 5, -32768) AS again, round(heart_rate(abs(dval), 360D), 6) AS hr, storage_format(CAST(abs(dval) % 30 AS INT)) AS fmt FROM {s}", s=s)


def sql_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    sql.register(spark)
    placed = settled(segments(spark, sf_dir))
    there = placed.where("seg_len > 0 and not is_gap").join(channels(placed), ["record", "seg_no"]).selectExpr("record", "sig_name", "seg_start AS start", "seg_end AS end")
    return spark.sql("SELECT * FROM joined_ranges(TABLE(SELECT * FROM {r}) PARTITION BY (record, sig_name) ORDER BY start)", r=there)


def sql_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sharp maxima of every vector, at least five samples apart."""
    sql.register(spark)
    s = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("record"), F.posexplode("embedding").alias("p", "x")).selectExpr("record", "CAST(p AS BIGINT) AS sample", "CAST(bround(CAST(x AS DOUBLE) * 1000) AS BIGINT) AS value")
    return spark.sql("SELECT record, sample FROM apart_peaks(TABLE(SELECT record, sample FROM sharp_peaks(TABLE(SELECT * FROM {s}) PARTITION BY record ORDER BY sample) WHERE kind = 1) PARTITION BY record ORDER BY (sample), 5)", s=s)


def sql_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    sql.register(spark)
    beats = _two(spark, sf_dir)[0].select("record", "sample", "symbol")
    return spark.sql(f"SELECT record, sample, rr, round(hr, 6) AS hr FROM rr_intervals(TABLE(SELECT * FROM {{b}}), {FS})", b=beats)


_MS = "((event_id % 24) * 3600 + (event_id % 60) * 60 + event_id % 50) * 1000000"

QUERIES = {
    "s7_source_where": (s7_source_where, f"{REC_WITH} SELECT record, frame, dval, CASE WHEN dval <> -2147483648 THEN round((dval - 10) / 250.0::DOUBLE, 6) END AS pval FROM raw WHERE ch = 1 AND frame >= {FROM} AND frame < {TO} AND record <> 'r2'"),
    "sql_times": (sql_times, f"SELECT event_id, {_MS} AS micros, CAST(floor({_MS} * 360::DOUBLE / 1000000 + 0.5) AS BIGINT) AS n, make_timestamp(978307200000000 + CAST(round_even(event_id * 1009 * 1000000 / CAST(360 AS DOUBLE), 0) AS BIGINT)) AS at, CAST(NULL AS BIGINT) AS none FROM events"),
    "sql_calibration": (sql_calibration, "WITH s AS (SELECT vec_id AS record, CAST(i - 1 AS BIGINT) AS sample, CAST(round_even(CAST(embedding[i] AS DOUBLE) * 1000, 0) AS BIGINT) AS dval FROM (SELECT vec_id, embedding, unnest(generate_series(1, len(embedding))) AS i FROM embeddings)) SELECT record, sample, CASE WHEN dval <> -100 THEN round((dval - 5) / 200.0::DOUBLE, 6) END AS pval, CASE WHEN dval <> -100 THEN dval ELSE -32768 END AS again, CASE WHEN dval <> 0 THEN round(60 * 360.0::DOUBLE / abs(dval), 6) END AS hr, CASE WHEN abs(dval) % 30 <= 8 THEN '80' WHEN abs(dval) % 30 <= 12 THEN '212' WHEN abs(dval) % 30 <= 16 THEN '16' WHEN abs(dval) % 30 <= 24 THEN '24' ELSE '32' END AS fmt FROM s"),
    "sql_ranges": (sql_ranges, f"{RANGES} SELECT * FROM rng"),
    "sql_peaks": (sql_peaks, "WITH RECURSIVE s AS (SELECT vec_id AS record, CAST(i - 1 AS BIGINT) AS sample, CAST(round_even(CAST(embedding[i] AS DOUBLE) * 1000, 0) AS BIGINT) AS v FROM (SELECT vec_id, embedding, unnest(generate_series(1, len(embedding))) AS i FROM embeddings)), c AS (SELECT record, sample FROM (SELECT *, lag(v) OVER w AS a, lead(v) OVER w AS b FROM s WINDOW w AS (PARTITION BY record ORDER BY sample)) WHERE v > a AND v > b), t AS (SELECT record, min(sample) AS sample FROM c GROUP BY record UNION ALL SELECT t.record, min(c.sample) FROM t JOIN c ON c.record = t.record AND c.sample >= t.sample + 5 GROUP BY t.record, t.sample) SELECT * FROM t"),
    "sql_intervals": (sql_intervals, f"{ANN_WITH}, b AS (SELECT record, sample, sample - lag(sample) OVER (PARTITION BY record ORDER BY sample) AS rr FROM ann WHERE ann_no % 2 = 0) SELECT record, sample, rr, CASE WHEN rr > 0 THEN round(60 * {FS}::DOUBLE / rr, 6) END AS hr FROM b WHERE rr IS NOT NULL"),
}

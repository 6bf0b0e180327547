"""The driver's tables as recordings: annotations, samples, segments, header text.

Each is given twice: as a DataFrame and as the SQL that makes the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pulselake.operators import segments as seg
from pulselake.operators import signals as sig

FS = 360.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- annotations: events of a user ---

ANN_SQL = """(SELECT user_id AS record, epoch_us(ts) // 2777 AS sample, event_id AS ann_no, event_id % 3 AS chan,
  CASE event_type WHEN 'click' THEN 'N' WHEN 'view' THEN 'V' WHEN 'purchase' THEN 'A' WHEN 'error' THEN '~' WHEN 'signup' THEN '"' ELSE event_type END AS symbol,
  event_type, coalesce(props, '') AS aux_note FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL)"""


def annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").where("user_id is not null and ts is not null")
    symbol = F.col("event_type")
    for name, code in (("click", "N"), ("view", "V"), ("purchase", "A"), ("error", "~"), ("signup", '"')):
        symbol = F.when(F.col("event_type") == name, code).otherwise(symbol)
    micros = "timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)"
    return e.select(F.col("user_id").alias("record"), F.expr(f"{micros} div 2777").alias("sample"), F.col("event_id").alias("ann_no"), (F.col("event_id") % 3).alias("chan"), symbol.alias("symbol"), "event_type", F.coalesce("props", F.lit("")).alias("aux_note"))


# --- samples: the components of a vector ---

SIG_SQL = """(SELECT vec_id AS record, CAST(i - 1 AS BIGINT) AS sample, CAST((i - 1) // 4 AS BIGINT) AS frame,
  CAST(round_even(CAST(embedding[i] AS DOUBLE) * 1000, 0) AS BIGINT) AS dval, CAST(embedding[i] AS DOUBLE) AS pval
  FROM (SELECT vec_id, embedding, unnest(generate_series(1, len(embedding))) AS i FROM embeddings))"""


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    long = sig.from_arrays(e, "vec_id", "embedding", F.col("x").cast("double"), spf=4, name="pval")
    return long.withColumn("dval", F.bround(F.col("pval") * 1000).cast("long"))


# --- segments: orders of a customer ---

SEG_SQL = """(SELECT *, seg_end - seg_len AS seg_start FROM (SELECT *, CAST(sum(seg_len) OVER (PARTITION BY record ORDER BY seg_no) AS BIGINT) AS seg_end FROM (
  SELECT o_custkey AS record, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS seg_no,
  CAST(trunc(o_totalprice) AS BIGINT) % 5000 AS seg_len, o_orderstatus = 'P' AS is_gap, o_orderpriority AS priority FROM orders)))"""

# Signals of a segment by its priority's first letter.
SIGNALS = {"1": ["I", "II", "V"], "2": ["I", "III"], "3": ["I", "II"], "4": ["II"], "5": ["V"]}
CHAN_SQL = """(SELECT record, seg_no, unnest(CASE substr(priority, 1, 1) WHEN '1' THEN ['I', 'II', 'V'] WHEN '2' THEN ['I', 'III'] WHEN '3' THEN ['I', 'II'] WHEN '4' THEN ['II'] ELSE ['V'] END) AS sig_name FROM seg)"""


def lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments without their offsets."""
    numbered = F.expr("row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) - 1").cast("long")
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("record"), numbered.alias("seg_no"), (F.col("o_totalprice").cast("long") % 5000).alias("seg_len"), (F.col("o_orderstatus") == "P").alias("is_gap"), F.col("o_orderpriority").alias("priority"))


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seg.offsets(lengths(spark, sf_dir))


def signal_names() -> Column:
    """The signals that a segment has."""
    names = F.array(*[F.lit(n) for n in SIGNALS["5"]])
    for code, own in SIGNALS.items():
        names = F.when(F.substring("priority", 1, 1) == code, F.array(*[F.lit(n) for n in own])).otherwise(names)
    return names


def channels(placed: DataFrame) -> DataFrame:
    return placed.select("record", "seg_no", F.explode(signal_names()).alias("sig_name"))


# --- recordings in files: five records of two channels, the components of every fifth vector ---

REC_SQL = """(SELECT 'r' || vec_id % 5 AS record, vec_id % 5 AS k, CAST((i - 1) % 2 AS INTEGER) AS ch, CAST((vec_id // 5) * 32 + (i - 1) // 2 AS BIGINT) AS frame,
  CAST(round_even(CAST(embedding[i] AS DOUBLE) * 1000, 0) AS BIGINT) AS dval FROM (SELECT vec_id, embedding, unnest(generate_series(1, len(embedding))) AS i FROM embeddings))"""

# Format of each record; one has a skew of 3 frames in its second channel.
REC_FORMATS, SKEWED, SKEW = ["16", "212", "24", "32", "160"], 3, 3


def recordings(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "x"))
    record = F.concat(F.lit("r"), (F.col("vec_id") % 5).cast("string"))
    frame = F.expr("vec_id div 5 * 32 + i div 2")
    return e.select(record.alias("record"), (F.col("i") % 2).alias("ch"), frame.alias("frame"), F.lit(0).alias("sub"), frame.alias("sample"), F.bround(F.col("x").cast("double") * 1000).cast("long").alias("dval"))


def recording_channels(spark: SparkSession) -> DataFrame:
    rows = [(f"r{k}", ch, f"r{k}.dat", fmt, 1, SKEW if (k, ch) == (SKEWED, 1) else 0, 0, 200.0 + 50 * ch, 10 * ch, "mV", 12, 0, 0, 0, "II" if ch else "I") for k, fmt in enumerate(REC_FORMATS) for ch in (0, 1)]
    return spark.createDataFrame(rows, "record string, ch int, file_name string, fmt string, spf int, skew int, byte_offset long, adc_gain double, baseline int, units string, adc_res int, adc_zero int, init_value int, checksum int, sig_name string")


def recording_records(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(f"r{k}", 2, 360.0, "10:00:00", "01/02/2003") for k in range(5)], "record string, n_sig int, fs double, base_time string, base_date string")

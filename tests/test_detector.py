"""The detector on streams against the one on tables."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulselake.operators import signals as sig
from pulselake.streaming import detector


def wave(seed, n):
    rng = random.Random(seed)
    return [(10 if i % 37 in (5, 6) else 0) * rng.random() + rng.gauss(0, 0.4) for i in range(n)]


@pytest.mark.parametrize("cuts", [[40, 41, 42, 90, 200], [150], list(range(7, 300, 23))])
def test_beats_don_t_depend_on_batches(spark, tmp_path, cuts):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = [(r, c, i, v) for k, (r, c) in enumerate((("a", 0), ("a", 1), ("b", 0))) for i, v in enumerate(wave(k, 300))]
    want = {(r.record, r.ch, r.sample): r.energy for r in sig.energy_beats(spark.createDataFrame(rows, "record string, ch int, sample long, pval double"), 5, 9, threshold=2.0).collect()}
    schema = "record string, ch int, sample long, pval double, ts timestamp"
    bounds = [0, *cuts, 300]
    stamped = spark.createDataFrame(rows, "record string, ch int, sample long, pval double").withColumn("ts", F.timestamp_seconds(F.col("sample") / 100 + 1000))
    query = detector.live_beats(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in"), 5, 9, 2.0, "1 second", 2000) if (tmp_path / "in").mkdir() is None else None
    run = query.writeStream.format("memory").queryName(f"beats_{len(cuts)}").outputMode("append").option("checkpointLocation", f"{tmp_path}/state").start()
    try:
        for lo, hi in zip(bounds, bounds[1:]):
            part = stamped.where(F.col("sample").between(lo, hi - 1))
            part = part.unionByName(part.limit(3))  # repeated samples
            part.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
            run.processAllAvailable()
        for later in (5000, 9000):  # the watermark passes all pauses
            spark.createDataFrame([("z", 0, 0, 0.0)], "record string, ch int, sample long, pval double").withColumn("ts", F.timestamp_seconds(F.lit(later))).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
            run.processAllAvailable()
    finally:
        run.stop()
    got = {(r.record, r.ch, r["sample"]): r.energy for r in spark.table(f"beats_{len(cuts)}").collect()}
    assert len(want) > 12 and set(got) == set(want)
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_energies():
    x = np.array([0.0, 1, 3, 2, 2])
    assert np.allclose(detector.energies(x, 3), np.array([1, 5, 6, 5, 1]) / 3)

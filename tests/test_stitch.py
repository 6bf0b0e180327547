"""Records of segments as one record."""

import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from pulselake.operators import segments as seg
from tests.test_plans import plan_of

# record, seg_no, seg_len, is_gap, signals, samples by name
SEGMENTS = [
    ("a", 0, 3, False, ["I", "II"], {"I": [1, 2, 3], "II": [4, None, 6]}),
    ("a", 1, 0, False, ["V"], {"V": []}),
    ("a", 2, 4, True, ["I"], {"I": [7, 7, 7, 7]}),
    ("a", 3, 11, False, ["II"], {"II": list(range(11))}),
    ("a", 4, 2, None, ["I"], {"I": [8, 8]}),
    ("b", 0, 1, False, ["I"], {"I": []}),
    ("b", 1, 2, False, None, None),
    (None, 0, 2, False, ["I"], {"I": [9, 9]}),
]


@pytest.mark.parametrize(("piece", "block"), [(1 << 16, 1 << 22), (4, 8), (1, 1)])
def test_every_sample_of_every_signal(spark, monkeypatch, piece, block):
    monkeypatch.setattr(seg, "PIECE", piece)
    monkeypatch.setattr(seg, "RANGE_BLOCK", block)
    placed = seg.offsets(spark.createDataFrame(SEGMENTS, "record string, seg_no long, seg_len long, is_gap boolean, signals array<string>, held map<string, array<long>>"))
    names = placed.select("record", F.explode("signals").alias("sig_name")).distinct()
    got = seg.stitch(placed, names, F.get(F.try_element_at("held", F.col("sig_name")), F.col("sample")), -1)
    want, start = [], {}
    for record, _, n, gap, signals, held in SEGMENTS:
        for name in sorted({s for r, *_, own, _ in SEGMENTS if r == record and r for s in own or []}):
            there = gap is False and name in (signals or [])
            values = [held[name][i] if there and i < len(held[name]) else None for i in range(n)]
            want += [(record, name, start.get(record, 0) + i, -1 if v is None else v) for i, v in enumerate(values)]
        start[record] = start.get(record, 0) + n
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_samples_are_not_shuffled(spark):
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, "-1")
    try:
        plan = plan_of(__spark_entry__.queries()["u6_stitch"](spark, "/root/testdata/sf0.001"))
    finally:
        spark.conf.set(name, before)
    keys = re.findall(r"Exchange hashpartitioning\(([^()]*)", plan)
    assert keys and not any("sample" in k for k in keys), plan

"""Filters over many blocks against a loop over samples."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from pulselake.operators import filters
from pulselake.plans.tables import recordings


def loop(b, a, x, steady):
    size = max(len(a), len(b))
    b, a = ([v / a[0] for v in c] + [0.0] * (size - len(c)) for c in (b, a))
    z = [s * x[0] for s in steady] + [0.0]
    out = []
    for v in x:
        y = b[0] * v + z[0]
        z = [b[i + 1] * v + z[i + 1] - a[i + 1] * y for i in range(size - 1)] + [0.0]
        out.append(y)
    return out


def steady(b, a):
    """The state after a long constant signal."""
    size = max(len(a), len(b))
    z = [0.0] * (size - 1)
    probe = list(b) + [0.0] * (size - len(b)), list(a) + [0.0] * (size - len(a))
    for _ in range(60_000):
        y = probe[0][0] / a[0] + (z[0] if z else 0)
        z = [probe[0][i + 1] / a[0] + (z[i + 1] if i + 2 < size else 0.0) - probe[1][i + 1] / a[0] * y for i in range(size - 1)]
    return z


def both_ways(b, a, x):
    pad, zi = 3 * max(len(a), len(b)), steady(b, a)
    ext = [2 * x[0] - v for v in x[pad:0:-1]] + x + [2 * x[-1] - v for v in x[-2 : -pad - 2 : -1]]
    return loop(b, a, loop(b, a, ext, zi)[::-1], zi)[::-1][pad:-pad]


@pytest.mark.parametrize(("b", "a"), [filters.butterworth_bandpass(5, 20, 360), ([0.2, 0.3, 0.5], [1.0]), (filters.ricker_points(36, 4.0), [1.0]), ([0.5], [1.0, -0.5]), ([2.0], [4.0])])
def test_blocks_give_what_a_loop_does(spark, b, a):
    rng = random.Random(7)
    lengths = {("x", 0): 2500, ("x", 1): 300, (None, 0): 130, ("short", 0): 3 * max(len(a), len(b))}
    rows, want = [], {}
    for (r, c), n in lengths.items():
        x = [10 + math.sin(i / 9) + rng.gauss(0, 0.3) for i in range(n)]
        rows += [(r, c, 50 + i, v) for i, v in enumerate(x)]
        if n > 3 * max(len(a), len(b)):
            want[r, c] = both_ways(b, a, x)
    df = spark.createDataFrame(rows, "record string, ch int, sample long, pval double").repartition(5)
    got = {(r.record, r.ch, r.sample): r.pval for r in filters.zero_phase(df, b, a, block=301).collect()}
    assert set(got) == {(*k, 50 + i) for k, own in want.items() for i in range(len(own))}
    assert max(abs(got[(*k, 50 + i)] - v) for k, own in want.items() for i, v in enumerate(own)) < 1e-9


def test_design():
    b, a = filters.butterworth_bandpass(5, 20, 360)
    w = np.exp(-2j * np.pi * np.array([5, 20, math.sqrt(5 * 20), 0.01, 170]) / 360)
    size = np.abs(np.polyval(b[::-1], w) / np.polyval(a[::-1], w))
    assert abs(size[0] - 0.5**0.5) < 1e-9 and abs(size[1] - 0.5**0.5) < 1e-9 and abs(size[2] - 1) < 2e-3 and size[3] < 1e-4 and size[4] < 1e-2
    with pytest.raises(ValueError):
        filters.butterworth_bandpass(5, 200, 360)


def test_long_runs_of_pieces():
    rng = np.random.default_rng(1)
    b, a = filters.butterworth_bandpass(0.5, 40, 360)
    x = rng.normal(size=5 * filters.PIECE + 77).tolist()
    own = filters.Recurrence(tuple(b), tuple(a))
    assert np.abs(own.run(np.array(x), own.steady * x[0])[0] - loop(b, a, x, own.steady.tolist())).max() < 1e-8  # its poles nearly are on the circle


def test_gaps_and_empty_tables(spark):
    df = spark.createDataFrame([("r", 0, i, None if i == 7 else 1.0) for i in range(40)] + [("s", 0, i, 2.0) for i in range(40)], "record string, ch int, sample long, pval double")
    got = filters.zero_phase(df, [0.5, 0.5], [1.0], block=8)
    assert got.where("record = 'r'").where("pval is not null").count() == 0 and got.where("record = 's' and abs(pval - 2) < 1e-12").count() == 40
    assert filters.bandpass(df.limit(0), 5, 20, 360).collect() == []
    assert filters.moving_wave(df.where("record = 's'"), 5, 2.0).where(F.col("pval") < 0).count() == 0


def test_query_by_a_loop(spark):
    folder, (b, a) = "/root/testdata/sf0.001", filters.butterworth_bandpass(5, 20, 360.0)
    channels = {}
    for r in recordings(spark, folder).orderBy("frame").collect():
        channels.setdefault((r.record, r.ch), []).append(r.dval / 1000)
    want = {(*k, i): v for k, x in channels.items() for i, v in enumerate(both_ways(b, a, x))}
    got = {(r.record, r.ch, r["sample"]): r.pval for r in __spark_entry__.queries()["d1_bandpass"](spark, folder).collect()}
    assert set(got) == set(want) and max(abs(got[k] - v) for k, v in want.items()) < 2e-6

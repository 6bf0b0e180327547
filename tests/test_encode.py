"""Signal files in blocks: what they hold, and that no block is collected."""

import numpy as np
import pytest

from pulselake.sources import signals
from tests.test_plans import plan_of

CHANNELS = [("a", 0, "a.dat", "16"), ("a", 1, "a.dat", "16"), ("b", 0, "b.dat", "212"), ("c", 0, None, "80")]
SAMPLES = [(r, ch, f, 0, None if f % 5 == 3 else (f * 37 + ch * 11) % 200 - 100) for r, ch, *_ in CHANNELS for f in range(29)]
SAMPLES += [("a", 0, None, 0, 5), ("b", 0, 3, 1, 9), ("b", 0, 3, 1, -9), ("d", 0, 0, 0, 1)]


@pytest.fixture(scope="module")
def tables(spark):
    channels = spark.createDataFrame(CHANNELS, "record string, ch int, file_name string, fmt string")
    return spark.createDataFrame(SAMPLES, "record string, ch int, frame long, sub int, dval long").repartition(5), channels


@pytest.mark.parametrize("by_channel", [False, True])
@pytest.mark.parametrize("batch", [1, 7, 10000])
def test_blocks_hold_their_samples_in_order(spark, tables, by_channel, batch):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(batch))
    try:
        got = [(r[0], r[1], bytes(r[2])) for r in signals.encode_parts(*tables, block_frames=6, by_channel=by_channel).collect()]
    finally:
        spark.conf.set(name, before)
    files, want = {(r, ch): (f, fmt) for r, ch, f, fmt in CHANNELS}, {}
    for r, ch, frame, sub, v in SAMPLES:
        if (r, ch) in files:
            place = (ch, frame or -1, sub) if by_channel else (frame or -1, ch, sub)
            want.setdefault((*files[r, ch], None if frame is None else frame // 6), []).append((*place, signals.MISSING[files[r, ch][1]] if v is None else v))
    packed = [(f, part, signals.pack(np.array([x[-1] for x in sorted(rows)]), fmt)) for (f, fmt, part), rows in want.items()]
    assert sorted(got, key=repr) == sorted(packed, key=repr)


def test_no_block_is_collected(tables):
    """A block of 100,000 frames is no row of an aggregate, of which a task would hold 128 at once."""
    plan = plan_of(signals.encode_parts(*tables))
    assert "Aggregate" not in plan and "Sort [file_name" in plan, plan

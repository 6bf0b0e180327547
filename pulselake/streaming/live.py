"""Live annotation streams: rates in windows, runs of beats, counts, intervals with state.

A stream has record, ts (timestamp), ann_no, symbol.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def beat_rates(stream: DataFrame, length: str = "1 minute", late: str = "30 seconds") -> DataFrame:
    """Beats of each record in windows of event time."""
    return stream.withWatermark("ts", late).groupBy(F.window("ts", length), "record").agg(F.count("*").alias("n_beats"))


def beat_runs(stream: DataFrame, gap: str = "10 seconds", late: str = "30 seconds") -> DataFrame:
    """Runs of beats without a pause of ``gap``."""
    return stream.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "record").agg(F.count("*").alias("n_beats"))


def label_counts(stream: DataFrame) -> DataFrame:
    return stream.groupBy("record", "symbol").agg(F.count("*").alias("n"))


def rr_intervals(stream: DataFrame) -> DataFrame:
    """record, ts, rr_sec across micro-batches: the state of a record is the time of its last beat.
    Beats that come late, behind that one, give no interval."""

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: object) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        beats = pd.concat(list(frames)).sort_values(["ts", "ann_no"])
        micros = beats["ts"].astype("datetime64[us]").astype("int64").to_numpy()
        rows = []
        for ts, at in zip(beats["ts"], micros.tolist(), strict=True):
            if last is not None and at > last:
                rows.append((key[0], ts, (at - last) / 1e6))
            last = at if last is None else max(last, at)
        state.update((last,))
        yield pd.DataFrame(rows, columns=["record", "ts", "rr_sec"])

    return stream.groupBy("record").applyInPandasWithState(update, "record long, ts timestamp, rr_sec double", "last long", "append", "NoTimeout")

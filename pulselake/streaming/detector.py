"""Beats of live signals: the detector of ``energy_beats`` across micro-batches.

State needs a store that holds large values: set ``spark.sql.streaming.stateStore.providerClass`` to the
RocksDB provider.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

_STATE = "samples binary, values binary, decided long"
_OUT = "record string, ch int, sample long, energy double"


def energies(values: np.ndarray, window: int) -> np.ndarray:
    """Mean squared difference over ``window`` samples around each; what lies beyond the ends counts as none."""
    squares = np.append(0.0, np.diff(values) ** 2)
    total = np.append(0.0, np.cumsum(squares))
    at = np.arange(len(values))
    return (total[np.minimum(at + (window - 1) // 2, len(values) - 1) + 1] - total[np.maximum(at - window // 2, 0)]) / window


class BeatDetector(StatefulProcessor):
    """Holds the samples of a channel that later ones can still decide on, and those that these need.

    A sample is decided once ``refractory`` and half a window after it are there, or once no sample has come
    for ``idle_ms`` of event time. Samples that come behind a decided one are left out; so are repeated ones.
    """

    def __init__(self, window: int, refractory: int, threshold: float, idle_ms: int):
        self.window, self.refractory, self.threshold, self.idle_ms = window, refractory, threshold, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", _STATE)

    def _load(self) -> tuple[np.ndarray, np.ndarray, int]:
        if not self.held.exists():
            return np.empty(0, np.int64), np.empty(0), -1
        samples, values, decided = self.held.get()
        return np.frombuffer(bytes(samples), np.int64), np.frombuffer(bytes(values)), decided

    def _decide(self, key: tuple, samples: np.ndarray, values: np.ndarray, decided: int, last: bool) -> Iterator[pd.DataFrame]:
        first = int(np.searchsorted(samples, decided, "right"))
        end = len(samples) if last else max(first, len(samples) - self.refractory - (self.window - 1) // 2)
        if end > first:
            energy = energies(values, self.window)
            rows = [(*key, int(samples[i]), float(energy[i])) for i in range(first, end) if energy[i] > self.threshold and energy[i] == energy[max(0, i - self.refractory) : i + self.refractory + 1].max()]
            decided = int(samples[end - 1])
            if rows:
                yield pd.DataFrame(rows, columns=["record", "ch", "sample", "energy"])
        keep = max(0, end - self.refractory - self.window // 2 - 1)
        self.held.update((samples[keep:].tobytes(), values[keep:].tobytes(), decided))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        samples, values, decided = self._load()
        new = pd.concat(list(rows))
        late = new["ts"].astype("datetime64[ms]").astype("int64").max()
        new = new[new["sample"] > decided]
        samples, at = np.unique(np.append(samples, new["sample"].to_numpy(np.int64)), return_index=True)
        values = np.append(values, new["pval"].to_numpy(float))[at]
        for timer in self.handle.listTimers():
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(int(late) + self.idle_ms)
        yield from self._decide(key, samples, values, decided, last=False)

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        samples, values, decided = self._load()
        yield from self._decide(key, samples, values, decided, last=True)
        self.held.clear()

    def close(self) -> None:
        pass


def live_beats(stream: DataFrame, window: int, refractory: int, threshold: float, late: str = "10 seconds", idle_ms: int = 60_000) -> DataFrame:
    """record, ch, sample, energy of beats in a stream of samples (record string, ch int, sample long, pval
    double, ts): those of ``energy_beats`` with the same arguments over all of them, however the samples
    are cut into batches. A channel that pauses for ``idle_ms`` begins anew."""
    watched = stream.withWatermark("ts", late).select("record", "ch", "sample", "pval", "ts")
    return watched.groupBy("record", "ch").transformWithStateInPandas(BeatDetector(window, refractory, threshold, idle_ms), _OUT, "Append", "EventTime")

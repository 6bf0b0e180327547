"""Zero-phase filters over channels of any length.

A digital filter is a recurrence on a few numbers, its state; over a block of samples the last state is an
affine map of the first one. So blocks are filtered from an empty state, by many tasks; their maps are
composed over one row a block; and each block then adds what its true first state gives. That runs forward
and, on what came out, backward.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulselake.functions.ordered import join_carried
from pulselake.sources.files import settled

#: Samples of a block, and of a piece of it that is filtered side by side with the others.
BLOCK, PIECE = 1 << 16, 256


def butterworth_bandpass(low: float, high: float, fs: float, order: int = 2) -> tuple[list[float], list[float]]:
    """(b, a) of a Butterworth band-pass between two frequencies: the poles of the analogue low-pass, moved
    to the band and to the unit circle."""
    if not 0 < low < high < fs / 2:
        raise ValueError("a band lies between 0 and half of the sampling frequency")
    w1, w2 = (2 * fs * math.tan(math.pi * f / fs) for f in (low, high))
    width, middle = w2 - w1, math.sqrt(w1 * w2)
    analogue = width / 2 * np.exp(1j * np.pi * (2 * np.arange(order) + order + 1) / (2 * order))
    root = np.sqrt(analogue**2 - middle**2 + 0j)
    poles = np.concatenate([analogue + root, analogue - root])
    digital = (2 * fs + poles) / (2 * fs - poles)
    gain = (width**order * (2 * fs) ** order / np.prod(2 * fs - poles)).real
    b = gain * np.real(np.poly(np.concatenate([np.ones(order), -np.ones(order)])))
    return b.tolist(), np.real(np.poly(digital)).tolist()


class Recurrence:
    """The filter with numerator ``b`` and denominator ``a`` as y = z[0] + b[0] x, z' = A z + B x."""

    def __init__(self, b: tuple[float, ...], a: tuple[float, ...]):
        size = max(len(a), len(b), 2)
        b_, a_ = (np.pad(np.array(c, float), (0, size - len(c))) / a[0] for c in (b, a))
        self.order, self.gain = size - 1, b_[0]
        self.step = np.zeros((self.order, self.order))
        self.step[:, 0] = -a_[1:]
        self.step[np.arange(self.order - 1), np.arange(1, self.order)] = 1
        self.input = b_[1:] - a_[1:] * b_[0]
        #: The state in which a signal that was 1 for ever leaves the filter.
        self.steady = np.linalg.solve(np.eye(self.order) - self.step, self.input)
        rows = [np.eye(self.order)[0]]
        for _ in range(PIECE - 1):
            rows.append(rows[-1] @ self.step)
        self.shown = np.array(rows)  # what a first state adds to each value of a piece

    @classmethod
    @lru_cache(maxsize=8)
    def of(cls, b: tuple[float, ...], a: tuple[float, ...]) -> "Recurrence":
        return cls(b, a)

    def run(self, x: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Output and last state."""
        whole = len(x) // PIECE * PIECE
        out, pieces = np.empty(len(x)), x[:whole].reshape(-1, PIECE)
        if whole:
            y, z = np.empty_like(pieces), np.zeros((len(pieces), self.order))
            for t in range(PIECE):  # all pieces side by side, each from an empty state
                y[:, t] = z[:, 0] + self.gain * pieces[:, t]
                z = z @ self.step.T + pieces[:, t, None] * self.input
            firsts, power = np.empty_like(z), np.linalg.matrix_power(self.step, PIECE)
            for i, last in enumerate(z):
                firsts[i] = state
                state = power @ state + last
            out[:whole] = (y + firsts @ self.shown.T).ravel()
        for i in range(whole, len(x)):
            out[i] = state[0] + self.gain * x[i]
            state = self.step @ state + self.input * x[i]
        return out, state


def _extended(samples: DataFrame, value: str, pad: int) -> DataFrame:
    """Channels with ``pad`` samples more at both ends, mirrored at the first and last one: record, ch,
    sample, x, and lo and hi (the first and last own sample)."""
    place = F.struct("sample", F.col(value).cast("double").alias("v"))
    ends = samples.groupBy("record", "ch").agg(F.min(place).alias("_a"), F.max(place).alias("_z"), F.count("*").alias("_n"))
    both = join_carried(samples.select("record", "ch", "sample", F.col(value).cast("double").alias("x")), ends.where(F.col("_n") > pad), ["record", "ch"])
    own = both.select("record", "ch", "sample", "x", F.col("_a.sample").alias("lo"), F.col("_z.sample").alias("hi"), F.col("_a.v").alias("first"), F.col("_z.v").alias("last"))
    mirrored = F.array(
        F.struct("sample", "x"),
        F.when((F.col("sample") > F.col("lo")) & (F.col("sample") <= F.col("lo") + pad), F.struct((2 * F.col("lo") - F.col("sample")).alias("sample"), (2 * F.col("first") - F.col("x")).alias("x"))),
        F.when((F.col("sample") < F.col("hi")) & (F.col("sample") >= F.col("hi") - pad), F.struct((2 * F.col("hi") - F.col("sample")).alias("sample"), (2 * F.col("last") - F.col("x")).alias("x"))),
    )
    return own.select("record", "ch", "lo", "hi", F.explode(F.array_compact(mirrored)).alias("p")).select("record", "ch", "lo", "hi", "p.sample", "p.x")


def _blocks(extended: DataFrame, block: int) -> DataFrame:
    """record, ch, block, lo, hi, at (first sample) and x (doubles, as bytes)."""
    rows = extended.groupBy("record", "ch", F.floor(F.col("sample") / block).alias("block")).agg(F.first("lo").alias("lo"), F.first("hi").alias("hi"), F.min("sample").alias("at"), F.transform(F.array_sort(F.collect_list(F.struct("sample", "x"))), lambda p: p["x"]).alias("x"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = [np.array([np.nan if v is None else v for v in x], float).tobytes() for x in batch.column(6).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:6], pa.array(packed, pa.binary())], names=batch.schema.names)

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    return rows.select("record", "ch", "block", "lo", "hi", "at", "x").mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in ("record", "ch", "block", "lo", "hi", "at")) + ", x binary")


def _passed(blocks: DataFrame, b: tuple[float, ...], a: tuple[float, ...], back: bool) -> DataFrame:
    """The blocks after one pass, forward or backward. A channel begins in the steady state of its first value."""
    kinds = {f.name: f.dataType.simpleString() for f in blocks.schema}
    turn = -1 if back else 1

    def last_states(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filter_ = Recurrence.of(b, a)
        for batch in batches:
            xs = [np.frombuffer(x.as_buffer())[::turn] for x in batch.column(3)]
            states = [filter_.run(x, np.zeros(filter_.order))[1].tobytes() for x in xs]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([len(x) for x in xs], pa.int64()), pa.array([float(x[0]) for x in xs], pa.float64()), pa.array(states, pa.binary())], names=["record", "ch", "block", "n", "x0", "z"])

    def composed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filter_, channel, state, powers = Recurrence.of(b, a), None, None, {}
        for batch in batches:
            firsts = []
            for record, ch, n, x0, z in zip(*(batch.column(i).to_pylist() for i in (0, 1, 3, 4, 5)), strict=True):
                if channel != (record, ch):
                    channel, state = (record, ch), filter_.steady * x0
                firsts.append(state.tobytes())
                if n not in powers:
                    powers = powers if len(powers) < 64 else {}
                    powers[n] = np.linalg.matrix_power(filter_.step, n)
                state = powers[n] @ state + np.frombuffer(z)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(firsts, pa.binary())], names=["record", "ch", "block", "state"])

    def finished(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filter_ = Recurrence.of(b, a)
        for batch in batches:
            out = [filter_.run(np.frombuffer(x.as_buffer())[::turn], np.frombuffer(s.as_buffer()))[0][::turn].tobytes() for x, s in zip(batch.column(6), batch.column(7), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:6], pa.array(out, pa.binary())], names=batch.schema.names[:7])

    key = f"record {kinds['record']}, ch {kinds['ch']}, block long"
    order = F.col("block").desc() if back else F.col("block")
    edges = blocks.select("record", "ch", "block", "x").mapInArrow(last_states, f"{key}, n long, x0 double, z binary")
    states = edges.repartition("record", "ch").sortWithinPartitions("record", "ch", order).mapInArrow(composed, f"{key}, state binary")
    both = join_carried(blocks, states, ["record", "ch", "block"]).select("record", "ch", "block", "lo", "hi", "at", "x", "state")
    return both.mapInArrow(finished, ", ".join(f"{c} {kinds[c]}" for c in ("record", "ch", "block", "lo", "hi", "at", "x")))


def zero_phase(samples: DataFrame, b: list[float], a: list[float], value: str = "pval", block: int | None = None) -> DataFrame:
    """record, ch, sample and ``value`` of channels filtered forward and backward by numerator ``b`` and
    denominator ``a``, so that nothing is delayed.

    Channels are mirrored at their ends by three times the longer of ``b`` and ``a``; shorter ones give no
    rows. Samples of a channel are numbered without gaps; a null value makes all values of its channel
    null (fill gaps first, see ``interpolate``).
    """
    coefficients = tuple(map(float, b)), tuple(map(float, a))
    blocks = settled(_blocks(_extended(samples, value, 3 * max(len(a), len(b))), block or BLOCK), "blocks")
    forward = settled(_passed(blocks, *coefficients, back=False), "forward")
    done = _passed(forward, *coefficients, back=True)
    kinds = {f.name: f.dataType.simpleString() for f in done.schema}

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, (lo, hi, at) in enumerate(zip(*(batch.column(j).to_pylist() for j in (2, 3, 4)), strict=True)):
                x = np.frombuffer(batch.column(5)[i].as_buffer())
                x, at = x[max(0, lo - at) : max(0, hi + 1 - at)], max(lo, at)
                same = pa.array(np.zeros(len(x), np.int64))
                yield pa.RecordBatch.from_arrays([*[batch.column(j).slice(i, 1).take(same) for j in (0, 1)], pa.array(np.arange(at, at + len(x))), pa.array(x, mask=np.isnan(x))], names=["record", "ch", "sample", value])

    return done.select("record", "ch", "lo", "hi", "at", "x").mapInArrow(run, f"record {kinds['record']}, ch {kinds['ch']}, sample long, `{value}` double")


def bandpass(samples: DataFrame, low: float, high: float, fs: float, order: int = 2, value: str = "pval") -> DataFrame:
    """Channels without what lies outside of a band of frequencies: a Butterworth filter, as ``zero_phase``."""
    return zero_phase(samples, *butterworth_bandpass(low, high, fs, order), value)


def ricker_points(points: int, a: float) -> list[float]:
    """The Mexican-hat wavelet of width ``a`` on ``points`` places around its middle."""
    t = np.arange(points) - (points - 1) / 2
    return (2 / (math.sqrt(3 * a) * math.pi**0.25) * (1 - t**2 / a**2) * np.exp(-(t**2) / (2 * a**2))).tolist()


def moving_wave(samples: DataFrame, points: int, a: float = 4.0, value: str = "pval") -> DataFrame:
    """Moving-wave integration: channels filtered by the Mexican-hat wavelet as ``zero_phase``, squared."""
    return zero_phase(samples, ricker_points(points, a), [1.0], value).withColumn(value, F.col(value) * F.col(value))

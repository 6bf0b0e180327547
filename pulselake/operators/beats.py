"""Beats: matching of annotators, averages of the signal around beats, peak values."""

from __future__ import annotations

import math
from bisect import bisect_left
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pulselake.functions.ordered import with_known, with_neighbours, with_running_sum
from pulselake.operators.annotations import block_of
from pulselake.sources.files import settled


def match_nearest(reference: DataFrame, test: DataFrame, window: int) -> DataFrame:
    """record, ref_sample, test_sample: pairs less than ``window`` apart of which each is the other's
    nearest (of ties the earlier one).

    Candidates meet by buckets of ``window`` samples: every test beat is in the buckets around its own,
    so only near pairs are ever made.
    """
    r = reference.select("record", F.col("sample").alias("ref_sample")).distinct().withColumn("bucket", F.expr(f"ref_sample div {window}"))
    t = test.select("record", F.col("sample").alias("test_sample")).distinct().withColumn("home", F.expr(f"test_sample div {window}"))
    t = t.withColumn("bucket", F.explode(F.array(F.col("home") - 1, F.col("home"), F.col("home") + 1))).drop("home")
    pairs = r.join(t, ["record", "bucket"]).withColumn("d", F.abs(F.col("ref_sample") - F.col("test_sample"))).where(F.col("d") < window)
    pairs = pairs.withColumn("a", F.row_number().over(Window.partitionBy("record", "ref_sample").orderBy("d", "test_sample")))
    pairs = pairs.withColumn("b", F.row_number().over(Window.partitionBy("record", "test_sample").orderBy("d", "ref_sample")))
    return pairs.where("a = 1 and b = 1").select("record", "ref_sample", "test_sample")


def _nearest(tests: list[int], at: int, start: int) -> int:
    """Which of ``tests`` (sorted) from ``start`` on is nearest to ``at``; the first of equally near ones."""
    k = min(bisect_left(tests, at, start), len(tests) - 1)
    if k > start and at - tests[k - 1] <= abs(tests[k] - at):
        k = bisect_left(tests, tests[k - 1], start)
    return k


def contest(refs: list[int], tests: list[int], window: int) -> list[int | None]:
    """The place of the test beat that each reference beat gets, or None; both lists are sorted.

    Reference beats choose one after another, among test beats after the last one that was looked at.
    Each wants the nearest, unless that is the next one's nearest too and nearer to it: then it falls back
    on the test beat before, if the reference beat before hasn't got that. A beat is only got at less
    than ``window``; also one that wasn't got has been looked at.
    """
    got: list[int | None] = [None] * len(refs)
    start = 0
    for i, at in enumerate(refs):
        if start >= len(tests):
            break
        k = _nearest(tests, at, start)
        if i + 1 < len(refs) and _nearest(tests, refs[i + 1], start) == k and abs(refs[i + 1] - tests[k]) < abs(at - tests[k]):
            if k == 0 or (i and got[i - 1] == k - 1):
                continue
            k -= 1
        if abs(at - tests[k]) < window:
            got[i] = k
        start = k + 1
    return got


def match_beats(reference: DataFrame, test: DataFrame, window: int) -> DataFrame:
    """record, ref_sample, test_sample: one-to-one pairs less than ``window`` apart, by ``contest``.

    Reference beats at least two windows apart have no test beat in reach of both, so a record is cut
    there into clusters of near reference beats, each with the test beats in reach of one of them. What
    lies beyond a cluster can only make its last beat fall back: for that it gets the next reference beat
    and the next two test beats, and is then decided on its own. So no record is a single task, but for
    one whose reference beats are all nearer than two windows. Reference beats of equal samples are one
    beat (as two, they could take a test beat at any distance), equal test beats are beats of their own.
    Rows with a null record or sample take no part.
    """
    kind = reference.schema["record"].dataType.simpleString()
    both = [df.where("record is not null and sample is not null").groupBy("record", F.col("sample").cast("long").alias("sample")).agg(count.alias("n")) for df, count in ((reference, F.lit(1)), (test, F.count("*")))]
    near = settled(with_neighbours(both[0], "record", "sample", block_of(), previous="before", following="rival"), "reference-beats")
    begins = F.when(F.col("sample") - F.col("before") < 2 * window, 0).otherwise(1)
    refs = settled(with_running_sum(near, "record", "sample", block_of(), begins, name="cluster").drop("before"), "clusters")
    others = settled(with_neighbours(both[1], "record", "sample", block_of(), following="after"), "test-beats")

    homes = F.explode(F.sequence(F.expr(f"sample div {window}") - 1, F.expr(f"sample div {window}") + 1))
    wanted = refs.select("record", "cluster", F.col("sample").alias("at"), homes.alias("bucket"))
    tests = others.withColumn("bucket", F.expr(f"sample div {window}")).join(wanted, ["record", "bucket"]).where(F.abs(F.col("at") - F.col("sample")) < window)
    tests = tests.groupBy("record", "sample", "n").agg(F.min("cluster").alias("cluster"))  # all within a window are of one cluster

    last = refs.groupBy("record", "cluster").agg(F.max(F.struct("sample", "rival")).alias("e"))
    last = last.select("record", "cluster", (F.col("e.sample") + window).alias("sample"), F.col("e.rival").alias("rival"))
    pair = F.when(F.col("n") > 1, F.array("sample", "sample")).otherwise(F.array_compact(F.array("sample", "after")))
    line = last.select("record", "sample", "cluster", "rival", F.lit(None).cast("array<long>").alias("next")).unionByName(others.select("record", "sample", F.lit(None).cast("long").alias("cluster"), F.lit(None).cast("long").alias("rival"), pair.alias("next")))
    beyond = with_known(line, "record", "sample", block_of(), F.col("next"), ["cluster"], "found", ahead=True).where("cluster is not null")

    def listed(name: str, each: object) -> object:
        return F.array_sort(F.flatten(F.collect_list(F.when(F.col("kind") == name, each)))).alias(name)

    copies, none = F.array_repeat("sample", F.col("n").cast("int")), F.lit(None).cast("array<long>")
    sides = [refs.select("record", "cluster", F.lit("refs").alias("kind"), copies.alias("at")), tests.select("record", "cluster", F.lit("tests").alias("kind"), copies.alias("at"))]
    sides += [beyond.select("record", "cluster", F.lit("tests").alias("kind"), F.coalesce("found", none).alias("at")), beyond.select("record", "cluster", F.lit("rival").alias("kind"), F.array_compact(F.array("rival")).alias("at"))]
    joined = sides[0].union(sides[1]).union(sides[2]).union(sides[3])
    clusters = joined.groupBy("record", "cluster").agg(*[listed(name, F.col("at")) for name in ("refs", "tests", "rival")]).where(F.size("tests") > 0)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, pairs = [], []
            for i, (own, others, rival) in enumerate(zip(*(batch.column(j).to_pylist() for j in (1, 2, 3)), strict=True)):
                found = [(r, others[k]) for r, k in zip(own, contest(own + rival, others, window), strict=False) if k is not None]
                pairs += found
                rows += [i] * len(found)
            columns = [pa.array([p[j] for p in pairs], pa.int64()) for j in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), *columns], names=["record", "ref_sample", "test_sample"])

    return clusters.select("record", "refs", "tests", "rival").mapInArrow(run, f"record {kind}, ref_sample long, test_sample long")


def beat_statistics(reference: DataFrame, test: DataFrame, window: int) -> DataFrame:
    """As ``match_statistics``, with the pairs of ``match_beats``; test beats of equal samples all count."""
    sides = [df.where("record is not null and sample is not null").select("record", "sample") for df in (reference.dropDuplicates(["record", "sample"]), test)]
    sides = [df.select("record", F.lit(0).alias("tp"), F.lit(int(k == 0)).alias("r"), F.lit(int(k == 1)).alias("t")) for k, df in enumerate(sides)]
    return _statistics(match_beats(reference, test, window).select("record", F.lit(1).alias("tp"), F.lit(0).alias("r"), F.lit(0).alias("t")).union(sides[0]).union(sides[1]))


def _statistics(counted: DataFrame) -> DataFrame:
    out = counted.groupBy("record").agg(F.sum("tp").alias("tp"), F.sum("r").alias("r"), F.sum("t").alias("t"))
    out = out.withColumns({"fp": F.col("t") - F.col("tp"), "fn": F.col("r") - F.col("tp")})
    return out.withColumns({"sensitivity": F.col("tp") / F.nullif("r", F.lit(0)), "positive_predictivity": F.col("tp") / F.nullif("t", F.lit(0))}).drop("r", "t")


def match_statistics(reference: DataFrame, test: DataFrame, window: int) -> DataFrame:
    """record, tp, fp, fn, sensitivity and positive_predictivity (null where nothing is to be found)."""
    matched = match_nearest(reference, test, window).select("record", F.lit(1).alias("tp"), F.lit(0).alias("r"), F.lit(0).alias("t"))
    r = reference.select("record", "sample").distinct().select("record", F.lit(0).alias("tp"), F.lit(1).alias("r"), F.lit(0).alias("t"))
    t = test.select("record", "sample").distinct().select("record", F.lit(0).alias("tp"), F.lit(0).alias("r"), F.lit(1).alias("t"))
    return _statistics(matched.union(r).union(t))


def benchmark(reference: DataFrame, test: DataFrame, window: int) -> DataFrame:
    """Mean over records of sensitivity and positive predictivity."""
    found = match_statistics(reference, test, window)
    return found.agg(F.avg("sensitivity").alias("sensitivity"), F.avg("positive_predictivity").alias("positive_predictivity"), F.count("*").alias("n_records"))


def average_around(samples: DataFrame, beats: DataFrame, before: int, after: int, value: str = "dval") -> DataFrame:
    """record, ch, lag, n, mean: the mean signal from ``before`` samples before beats up to ``after``
    after them. Beyond a record's ends the signal counts as zero, the beat still counts."""
    counts = beats.groupBy("record").agg(F.count("*").alias("n_beats"))
    lags = beats.select("record", "sample", F.explode(F.sequence(F.lit(-before), F.lit(after - 1))).alias("lag"))
    moved = lags.select("record", "lag", (F.col("sample") + F.col("lag")).alias("sample"))
    sums = moved.join(samples, ["record", "sample"]).groupBy("record", "ch", "lag").agg(F.sum(value).alias("total"))
    return sums.join(counts, "record").select("record", "ch", "lag", F.col("n_beats").alias("n"), (F.col("total") / F.col("n_beats")).alias("mean"))


def signal_average(samples: DataFrame, ann: DataFrame, channels: DataFrame, labels: DataFrame, fs: float, start_range: float = -0.05, stop_range: float = 0.05, symbols: list[str] | None = None, start: float = 0.0, stop: float | None = None) -> DataFrame:
    """record, ch, lag, seconds, n, mean: the mean physical signal around QRS annotations (all, or those of
    ``symbols``) between ``start`` and ``stop`` seconds, from ``start_range`` to before ``stop_range``
    seconds from them.

    ``labels`` (symbol, is_qrs) say what is a QRS; ``channels`` has record, ch, adc_gain, baseline. Every
    channel has a row for each lag; beyond a record's ends the digital signal counts as zero, the beat still
    counts. Means are rounded to five digits. Records without such annotations have no rows.
    """
    if start_range >= stop_range or (stop is not None and start >= stop) or start < 0:
        raise ValueError("ranges end after they begin, and times begin at 0 or later")
    lo, hi = int(start_range * fs), math.ceil(round(stop_range * fs, 9))
    chosen = labels.where("is_qrs").select("symbol") if symbols is None else labels.where(F.col("is_qrs") & F.col("symbol").isin(symbols)).select("symbol")
    beats = ann.join(F.broadcast(chosen), "symbol").where(F.col("sample") >= int(start * fs))  # fewer than 50 rows
    beats = beats if stop is None else beats.where(F.col("sample") <= int(stop * fs))
    counts = beats.groupBy("record").agg(F.count("*").alias("n"))
    moved = beats.select("record", "sample", F.explode(F.sequence(F.lit(lo), F.lit(hi - 1))).alias("lag")).select("record", "lag", (F.col("sample") + F.col("lag")).alias("sample"))
    sums = moved.join(samples.select("record", "ch", "sample", "dval"), ["record", "sample"]).groupBy("record", "ch", "lag").agg(F.sum("dval").alias("total"))
    grid = channels.select("record", "ch", "adc_gain", "baseline").join(counts, "record").withColumn("lag", F.explode(F.sequence(F.lit(lo), F.lit(hi - 1))))
    mean = (F.coalesce("total", F.lit(0)) / F.col("n") - F.col("baseline")) / F.col("adc_gain")
    return grid.join(sums, ["record", "ch", "lag"], "left").select("record", "ch", "lag", F.round(F.col("lag") / fs, 5).alias("seconds"), "n", F.round(mean, 5).alias("mean"))


def values_at(samples: DataFrame, ann: DataFrame, value: str = "dval") -> DataFrame:
    """Annotations with the signal's value at their sample; those outside of the record drop out."""
    return ann.join(samples.select("record", "ch", "sample", value), ["record", "sample"])

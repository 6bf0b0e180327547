"""Packing token sequences by shortest-pack-first over the length histogram.

Documents are cut into full sequences and one rest shorter than a sequence. The rests' lengths are
packed as a histogram on the driver (it has one count a length, whatever the corpus): the longest
length is placed first, into the emptiest packs that it fits, and packs of one pattern are counted,
not listed. Patterns are then joined back: the document of rank r among the rests of its length
takes the r-th slot of that length.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pulselake.llm.common import columns, parallel, record_batch, slices, trim, write_table
from pulselake.llm.tokens import as_ids, tokenize

#: More slots than this (a histogram of usual capacity gives a few thousand) aren't broadcast.
BROADCAST_SLOTS = 200_000


def pack_histogram(histogram: dict[int, int], capacity: int) -> list[tuple[int, tuple[int, ...]]]:
    """Patterns (number of packs, lengths in order of placing) that hold each length as often as the
    histogram says. At most two patterns a length."""
    open_packs: dict[int, list[tuple[int, tuple[int, ...]]]] = {}  # by the space left
    for length in sorted(histogram, reverse=True):
        if not 0 < length <= capacity:
            raise ValueError(f"length {length} with capacity {capacity}")
        left = histogram[length]
        for space in sorted((s for s in open_packs if s >= length), reverse=True):
            while left and open_packs.get(space):
                count, lengths = open_packs[space].pop()
                used = min(count, left)
                if count > used:
                    open_packs[space].append((count - used, lengths))
                open_packs.setdefault(space - length, []).append((used, (*lengths, length)))
                left -= used
            if not left:
                break
        while left:  # packs opened by this length may take it again
            room = capacity // length
            each, more = divmod(left, room)
            if each:
                open_packs.setdefault(capacity - room * length, []).append((each, (length,) * room))
            if more:
                open_packs.setdefault(capacity - more * length, []).append((1, (length,) * more))
            left = 0
    return [p for s in sorted(open_packs) for p in open_packs[s]]


def slots_of(patterns: list[tuple[int, tuple[int, ...]]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, rank after the last, first sequence, offset) for each place in each
    pattern; ranks count the rests of one length."""
    out, taken, sequence = [], {}, 0
    for count, lengths in patterns:
        offset = 0
        for n in lengths:
            at = taken.get(n, 0)
            out.append((n, at, at + count, sequence, offset))
            taken[n] = at + count
            offset += n
        sequence += count
    return out


def pack(docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 0) -> DataFrame:
    """Packs all documents, each followed by ``end_id``, into sequences of at most ``capacity`` ids.

    Returns one row a piece: doc_id, start (its document's ids before it), length, ids (binary,
    uint32 little-endian), doc_tokens, sequence_id, offset. Each id lies in one piece, pieces of a
    sequence are gapless from 0, and sequence ids are dense: packs of rests first, then full ones.

    Texts are tokenized once, into a scratch table. Ranks come from range partitions by length and
    doc_id, so that a length that a third of the documents have is ranked by many tasks.
    Null and empty texts are ``end_id`` alone; very long ones are cut into as many pieces as they need. Repeated rows are packed each; rows with a null doc_id
    too. Other columns are ignored. An empty table gives no rows.
    """
    spark = docs.sparkSession
    table, _ = write_table(tokenize(docs, tokenizer, end_id).drop("text_hash").withColumn("row_id", F.monotonically_increasing_id()), "tokenized")
    lengths = table.select("row_id", "doc_id", (F.col("n_tokens") % capacity).cast("int").alias("rest"), F.expr(f"n_tokens div {capacity}").alias("full"))
    order = ["rest", "doc_id", "row_id"]
    dealt = lengths.repartitionByRange(parallel(spark), *order).withColumn("part", F.spark_partition_id())
    dealt, _ = write_table(dealt, "dealt")
    ranked = dealt.withColumn("rank", F.row_number().over(Window.partitionBy("part", "rest").orderBy("doc_id", "row_id")) - 1)
    ranked = ranked.withColumn("full_before", F.sum("full").over(Window.partitionBy("part").orderBy("row_id")) - F.col("full"))
    sums = dealt.groupBy("part", "rest").agg(F.count("*").alias("n"), F.sum("full").alias("full"))  # a row for each length of a partition
    sums, _ = write_table(sums, "sums")
    histogram = {r["rest"]: r["n"] for r in sums.where("rest > 0").groupBy("rest").agg(F.sum("n").alias("n")).collect()}  # below capacity rows
    patterns = pack_histogram(histogram, capacity)
    packs = sum(c for c, _ in patterns)
    places = slots_of(patterns)
    slots = spark.createDataFrame(places, "rest int, lo long, hi long, first long, offset long")
    if len(places) <= BROADCAST_SLOTS:
        slots = F.broadcast(slots)
    rank_before = sums.select("part", "rest", (F.sum("n").over(Window.partitionBy("rest").orderBy("part")) - F.col("n")).alias("rank_before"))
    by_part = sums.groupBy("part").agg(F.sum("full").alias("full"))  # a row for each partition
    part_before = by_part.select("part", (F.sum("full").over(Window.orderBy("part")) - F.col("full")).alias("part_before"))
    plan = ranked.join(rank_before, ["part", "rest"]).join(part_before, "part")
    plan = plan.select("row_id", "rest", (F.col("rank") + F.col("rank_before")).alias("rank"), (F.lit(packs) + F.col("part_before") + F.col("full_before")).alias("full_first"))
    plan = plan.alias("p").join(slots.alias("s"), (F.col("p.rest") == F.col("s.rest")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")), "left")
    plan = plan.select("row_id", "full_first", (F.col("first") + F.col("rank") - F.col("lo")).alias("rest_sequence"), F.col("offset").alias("rest_offset"))
    src = table.join(plan, "row_id").select("doc_id", "n_tokens", "ids", "full_first", "rest_sequence", "rest_offset")

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "ids", 1 << 20):
            rows, at = [], []
            for k, (n, ids, first, sequence, offset) in enumerate(zip(*columns(batch, "n_tokens", "ids", "full_first", "rest_sequence", "rest_offset"), strict=True)):
                ids = as_ids(ids, n).astype("<u4")
                for i, start in enumerate(range(0, n, capacity)):
                    piece = ids[start : start + capacity]
                    full = len(piece) == capacity
                    rows.append((start, len(piece), piece.tobytes(), n, first + i if full else sequence, 0 if full else offset))
                    at.append(k)
            out = pa.schema([batch.schema.field(0), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])
            yield record_batch(out, [batch.column(0).take(pa.array(np.array(at, np.int64))), *zip(*rows, strict=True)])
        trim()

    return src.mapInArrow(cut, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")

"""The prefix trie of conversations, rolled up to all ancestors by pointer jumping.

A node is a distinct sequence of first turns. Its digest is the exclusive or of two 64-bit hashes of
each (place, role, text) in it, so that the digests of all prefixes of a conversation are running
values, which blocks of a long conversation compute apart. Parent edges are pairs of digests.

Sums over subtrees take a round for each doubling of the depth: before round k a node has the sum over
what lies less than 2**k below it, and a pointer to its ancestor 2**k above. In the round it adds the
sums of all nodes that point at it, and takes over its ancestor's pointer. Hot nodes are no single
task: what points at them is summed in part first, and the adaptive join splits them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pulselake.llm.common import columns, drop_path, parallel, record_batch, write_table

#: Turns of a conversation that are digested together.
BLOCK = 1024
#: Ids of a node that go as one row to the hash of its ids.
IDS = 8192

_NOTHING = hashlib.sha256(b"").hexdigest()
_NODE = ["d1", "d2"]
_UP = ["p1", "p2"]


def _numbered(rows: DataFrame) -> DataFrame:
    """part and at (place among the rows of the conversation in this partition, from 1) of rows that are
    sorted by conversation in range partitions."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, seen = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            conv = batch.column(0).to_numpy()
            if len(conv):
                starts = np.append(0, np.flatnonzero(conv[1:] != conv[:-1]) + 1)
                at = np.arange(1, len(conv) + 1) - np.repeat(starts, np.diff(np.append(starts, len(conv))))
                if conv[0] == last:
                    at[: starts[1] if len(starts) > 1 else len(conv)] += seen
                last, seen = conv[-1], int(at[-1])
                schema = pa.schema([*batch.schema, ("part", pa.int64()), ("at", pa.int64())])
                yield record_batch(schema, [*batch.columns, pa.array(np.full(len(conv), part)), pa.array(at)])

    return rows.mapInArrow(run, "conv_id long, t1 long, t2 long, bytes long, part long, at long")


def rebuilt_turns(conversations: DataFrame, width: int = 5, longest: int = 9) -> tuple[DataFrame, DataFrame]:
    """Turns of rebuilt conversations (conv_id, depth, t1 and t2 (hashes of role and text), bytes of the
    text, total), and conv_id and total of all, those without turns too.

    Conversation c begins with the first h turns of conversation c - c % ``width`` (all if fewer, none if
    that is absent), h = crc32 of its decimal id % ``longest``; its own turns after its first h follow.
    Turns are ordered by turn (null first); ties by role, then text. A conversation of any length is
    numbered by many tasks (only ties of one turn that begin alike come to one of them).
    """
    role, text = (F.coalesce(c, F.lit("")) for c in ("role", "text"))
    src = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), text.alias("text"))
    hashes = [F.xxhash64(F.lit(i), "role", "text").alias(f"t{i}") for i in (1, 2)]
    order = ["conv_id", F.col("turn").asc_nulls_first()]
    dealt = src.select("*", *hashes, F.octet_length("text").cast("long").alias("bytes")).repartitionByRange(parallel(src.sparkSession), *order, F.substring("role", 1, 32), F.substring("text", 1, 64))
    dealt = dealt.sortWithinPartitions(*order, "role", "text").select("conv_id", "t1", "t2", "bytes")
    turns, _ = write_table(_numbered(dealt), "turns")

    parts = turns.groupBy("part", "conv_id").agg(F.max("at").alias("m"))  # at most one row a task for a long conversation
    parts = parts.withColumn("before", F.sum("m").over(Window.partitionBy("conv_id").orderBy("part")) - F.col("m"))
    convs = parts.groupBy("conv_id").agg(F.sum("m").alias("n"))
    base = (F.col("conv_id") - F.col("conv_id") % width).alias("base")
    convs = convs.select("conv_id", "n", base, (F.crc32(F.col("conv_id").cast("string")) % longest).alias("h"))
    info = convs.join(convs.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n")), "base", "left")
    lead = F.least("h", F.coalesce("base_n", F.lit(0)))
    info = info.select("conv_id", "base", "h", lead.alias("lead"), (lead + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("total"))
    info, _ = write_table(info, "conversations")

    placed = turns.join(parts.join(info, "conv_id"), ["part", "conv_id"]).withColumn("place", F.col("before") + F.col("at"))
    own = placed.where("place > h").select("conv_id", (F.col("place") - F.col("h") + F.col("lead")).alias("depth"), "t1", "t2", "bytes", "total")
    first = turns.where(F.col("at") < longest).join(parts, ["part", "conv_id"]).withColumn("place", F.col("before") + F.col("at")).where(F.col("place") < longest)
    heads = first.select(F.col("conv_id").alias("base"), "place", "t1", "t2", "bytes").join(info, "base").where("place <= lead")
    heads = heads.select("conv_id", F.col("place").alias("depth"), "t1", "t2", "bytes", "total")
    return own.union(heads), info.select("conv_id", "total")


def prefixes(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """A row for each conversation and depth from 0 on: conv_id, depth, digest (d1, d2) of the prefix and
    (p1, p2) of the one before, bytes of its last text, ends (whether the conversation ends there)."""
    hashed = turns.select("conv_id", "depth", "bytes", "total", *[F.xxhash64("depth", f"t{i}").alias(f"h{i}") for i in (1, 2)], F.expr(f"(depth - 1) div {BLOCK}").alias("block"))
    upto = Window.partitionBy("conv_id", "block").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    running = hashed.select("*", *[F.bit_xor(f"h{i}").over(upto).alias(f"x{i}") for i in (1, 2)])
    blocks = hashed.where(F.col("total") > BLOCK).groupBy("conv_id", "block").agg(*[F.bit_xor(f"h{i}").alias(f"x{i}") for i in (1, 2)])
    earlier = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = blocks.select("conv_id", "block", *[F.bit_xor(f"x{i}").over(earlier).alias(f"c{i}") for i in (1, 2)])
    digest = [F.col(f"x{i}").bitwiseXOR(F.coalesce(f"c{i}", F.lit(0).cast("long"))) for i in (1, 2)]
    out = running.join(carried, ["conv_id", "block"], "left").select("conv_id", "depth", *[d.alias(f"d{i + 1}") for i, d in enumerate(digest)], *[d.bitwiseXOR(F.col(f"h{i + 1}")).alias(f"p{i + 1}") for i, d in enumerate(digest)], "bytes", (F.col("depth") == F.col("total")).alias("ends"))
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("long")
    return out.union(convs.select("conv_id", zero, zero, zero, none, none, zero, F.col("total") == 0))


def ids_sha256(members: DataFrame) -> DataFrame:
    """SHA-256 of the decimal conv_ids of each node, ascending and joined by commas: d1, d2, sha.
    Sorted ids come in rows of many; a node's rows stream through one hash, so none is held whole."""

    def joined(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, chunk = TaskContext.get().partitionId(), 0
        schema = pa.schema([("d1", pa.int64()), ("d2", pa.int64()), ("part", pa.int64()), ("chunk", pa.int64()), ("ids", pa.string())])
        for batch in batches:
            d1, d2, conv = (batch.column(i).to_numpy() for i in range(3))
            if len(conv):
                new = np.flatnonzero((d1[1:] != d1[:-1]) | (d2[1:] != d2[:-1])) + 1
                cuts = np.unique(np.concatenate([[0], new, np.arange(0, len(conv), IDS)]))
                ids = [",".join(map(str, conv[a:b].tolist())) for a, b in zip(cuts, [*cuts[1:], len(conv)], strict=True)]
                yield record_batch(schema, [d1[cuts], d2[cuts], np.full(len(cuts), part), np.arange(chunk, chunk + len(cuts)), ids])
                chunk += len(cuts)

    def hashed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("d1", pa.int64()), ("d2", pa.int64()), ("sha", pa.string())])
        node = state = None
        for batch in batches:
            out = []
            for d1, d2, ids in zip(*columns(batch, "d1", "d2", "ids"), strict=True):
                if node == (d1, d2):
                    state.update(b",")
                else:
                    if node is not None:
                        out.append((*node, state.hexdigest()))
                    node, state = (d1, d2), hashlib.sha256()
                state.update(ids.encode())
            if out:
                yield record_batch(schema, zip(*out, strict=True))
        if node is not None:
            yield record_batch(schema, [[node[0]], [node[1]], [state.hexdigest()]])

    n = parallel(members.sparkSession)
    ordered = members.select(*_NODE, "conv_id").repartitionByRange(n, *_NODE, "conv_id").sortWithinPartitions(*_NODE, "conv_id")
    rows = ordered.mapInArrow(joined, "d1 long, d2 long, part long, chunk long, ids string")
    return rows.repartition(n, *_NODE).sortWithinPartitions(*_NODE, "part", "chunk").mapInArrow(hashed, "d1 long, d2 long, sha string")


def rolled_up(nodes: DataFrame, values: list[str], deepest: int) -> DataFrame:
    """d1, d2 and ``values`` summed over each node and all below it. ``nodes`` has d1, d2, p1, p2 (null at
    the root) and the values; ``deepest`` is the largest depth."""
    spark, step = nodes.sparkSession, 1
    state, path = nodes.select(*_NODE, *_UP, *values), None
    while step <= deepest:
        sums = state.where("p1 is not null").groupBy(*_UP).agg(*[F.sum(v).alias(f"more_{v}") for v in values]).withColumnsRenamed(dict(zip(_UP, _NODE, strict=True)))
        grown = state.join(sums, _NODE, "left").select(*_NODE, *_UP, *[(F.col(v) + F.coalesce(f"more_{v}", F.lit(0))).alias(v) for v in values])
        grown, grown_path = write_table(grown, "grown")
        jumps = grown.select(*[F.col(d).alias(p) for d, p in zip(_NODE, _UP, strict=True)], F.col("p1").alias("q1"), F.col("p2").alias("q2"))
        moved = grown.where("p1 is not null").join(jumps, _UP).select(*_NODE, F.col("q1").alias("p1"), F.col("q2").alias("p2"), *values)
        moved = moved.union(grown.where("p1 is null").select(moved.columns))
        before, (state, path) = path, write_table(moved, "jumped")
        for p in (before, grown_path):
            if p:
                drop_path(spark, p)
        step *= 2
    return state.select(*_NODE, *values)


def prefix_trie(conversations: DataFrame, width: int = 5, longest: int = 9) -> DataFrame:
    """Nodes of the trie of rebuilt conversations (see ``rebuilt_turns``): one row a distinct sequence of
    first turns, from the root without any.

    Returns conv_id (smallest member: a conversation that begins so), depth, parent_conv_id (its parent's
    conv_id; null at the root), n_convs (members), n_children, n_leaves (nodes without children in its
    subtree), saved_tokens (over its subtree, members but one times the bytes of a node's last text),
    ends_sha256 (of the ids of members that end there) and digest (32 hexadecimal digits).

    Null roles and texts are empty; rows without conv_id take no part; repeated rows are turns of their
    own; ties of a turn are ordered by role and text; texts and conversations may be of any length; other
    columns are ignored. An empty table gives no rows, not even a root.
    """
    turns, convs = rebuilt_turns(conversations, width, longest)
    steps, steps_path = write_table(prefixes(turns, convs), "prefixes")
    nodes = steps.groupBy(*_NODE).agg(F.min("conv_id").alias("conv_id"), F.min("depth").alias("depth"), F.count("*").alias("n_convs"), *[F.first(x).alias(x) for x in (*_UP, "bytes")])
    nodes, _ = write_table(nodes, "nodes")
    children = nodes.where("p1 is not null").groupBy(*_UP).agg(F.count("*").alias("c")).withColumnsRenamed(dict(zip(_UP, _NODE, strict=True)))
    parents = nodes.select(F.col("d1").alias("p1"), F.col("d2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    named = nodes.where("p1 is not null").join(parents, _UP)
    named = named.unionByName(nodes.where("p1 is null").withColumn("parent_conv_id", F.lit(None).cast("long")))
    n_children = F.coalesce("c", F.lit(0).cast("long"))
    named = named.join(children, _NODE, "left").select("*", n_children.alias("n_children"), F.when(n_children == 0, 1).otherwise(0).cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved_tokens")).drop("c")
    named, _ = write_table(named, "named")
    deepest = named.agg(F.max("depth")).first()[0] or 0
    sums = rolled_up(named, ["n_leaves", "saved_tokens"], deepest)
    shas, _ = write_table(ids_sha256(steps.where("ends")), "ends")
    drop_path(conversations.sparkSession, steps_path)
    out = named.drop("n_leaves", "saved_tokens").join(sums, _NODE).join(shas, _NODE, "left")
    digest = F.lower(F.concat(*[F.lpad(F.hex(d), 16, "0") for d in _NODE]))
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("sha", F.lit(_NOTHING)).alias("ends_sha256"), digest.alias("digest"))

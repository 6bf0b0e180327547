"""Connected components of a link table by alternating stars, wholly on executors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulselake.llm.common import checkpointed, parallel

#: Links of one task at least: small tables take fewer tasks than the session has shuffle partitions, as
#: each round shuffles several times, and every task of a shuffle leaves files of its own.
LINKS_A_TASK = 20_000


def _narrow(df: DataFrame, links: int) -> DataFrame:
    tasks = 1 + links // LINKS_A_TASK
    return df.coalesce(tasks) if tasks < parallel(df.sparkSession) else df


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.hash("a", "b").cast("long"))).first())


def connected_components(links: DataFrame) -> DataFrame:
    """Smallest node reachable from each node.

    ``links`` has columns a and b (long, a <> b). Returns node, root, for nodes that have a link.
    Each round is two rewirings of the link table (large star: larger neighbours to the smallest
    neighbour; small star: smaller ones and the node itself), until nothing changes: the number of
    rounds grows with the logarithm of the longest chain. Every round is checkpointed. The smallest
    neighbours come from partial aggregation, and star centres with many links are split by the
    adaptive join.
    """
    edges = checkpointed(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = _state(edges)
    while state[0]:
        edges = _narrow(edges, state[0])
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = checkpointed(_narrow(_narrow(large.where("a <> b"), state[0]).distinct(), state[0]))
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
        edges = checkpointed(_narrow(_narrow(small.where("a <> b"), state[0]).distinct(), state[0]))
        before, state = state, _state(edges)
        if before == state:
            break
    nodes = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return nodes.union(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())

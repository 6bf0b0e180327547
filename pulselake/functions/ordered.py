"""Neighbours, running sums and last known values in the order of a key's rows, with a hot key split.

A window over a whole key puts all of its rows into one task. Here rows are cut into blocks of the
order column; a window runs within each block, and a second one over one row a block carries values
from block to block. Rows with a null key are one key, those with a null order come first, as in a
window.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _listed(key: str | list[str]) -> list[str]:
    return [key] if isinstance(key, str) else list(key)


def join_carried(rows: DataFrame, carried: DataFrame, keys: list[str]) -> DataFrame:
    """Joins the columns of ``carried`` to rows of the same keys; null keys are equal."""
    right = carried.select(*[F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)], *[c for c in carried.columns if c not in keys])
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_key{i}")) for i, k in enumerate(keys)])
    return rows.join(right, same).drop(*[f"_key{i}" for i in range(len(keys))])


def with_neighbours(df: DataFrame, key: str | list[str], order: str, block: Column, ties: list[str] | None = None, previous: str | None = None, following: str | None = None, value: str | None = None) -> DataFrame:
    """Adds ``value`` (by default the order column) of the row before as ``previous``, and of the row after
    as ``following``, by (order, ties) within its key; null where there is none. Both, or the one that
    has a name, in one pass. ``block`` must not fall as ``order`` grows."""
    value, keys = value or order, _listed(key)
    by = [order, *(ties or [])]
    blocked = df.withColumn("_block", block)
    inner, blocks = Window.partitionBy(*keys, "_block").orderBy(*by), Window.partitionBy(*keys).orderBy("_block")
    place = F.struct(*by, F.col(value).alias("_v"))
    wanted = [(n, ahead) for n, ahead in ((previous, False), (following, True)) if n]
    edges = blocked.groupBy(*keys, "_block").agg(*[(F.min(place) if ahead else F.max(place))["_v"].alias(f"_edge{int(ahead)}") for _, ahead in wanted])
    carried = edges.select(*keys, "_block", *[(F.lead if ahead else F.lag)(f"_edge{int(ahead)}").over(blocks).alias(f"_carry{int(ahead)}") for _, ahead in wanted])
    own = {f"_own{int(ahead)}": (F.lead if ahead else F.lag)(F.struct(F.col(value).alias("_v"))).over(inner) for _, ahead in wanted}
    out = join_carried(blocked.withColumns(own), carried, [*keys, "_block"])
    out = out.withColumns({n: F.when(F.col(f"_own{int(ahead)}").isNull(), F.col(f"_carry{int(ahead)}")).otherwise(F.col(f"_own{int(ahead)}")["_v"]) for n, ahead in wanted})
    return out.drop("_block", *own, *[f"_carry{int(ahead)}" for _, ahead in wanted])


def with_previous(df: DataFrame, key: str | list[str], order: str, block: Column, ties: list[str] | None = None, name: str = "previous", value: str | None = None) -> DataFrame:
    """Adds ``name``: ``value`` (by default the order column) of the row before, as ``with_neighbours``."""
    return with_neighbours(df, key, order, block, ties, previous=name, value=value)


def with_running_sum(df: DataFrame, key: str | list[str], order: str, block: Column, value: Column, ties: list[str] | None = None, name: str = "running") -> DataFrame:
    """Adds ``name``: the sum of ``value`` over the rows of its key up to and with each row."""
    by, keys = [order, *(ties or [])], _listed(key)
    blocked = df.withColumn("_block", block).withColumn("_value", value)
    totals = blocked.groupBy(*keys, "_block").agg(F.sum("_value").alias("_total"))
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.withColumn("_carry", F.coalesce(F.sum("_total").over(before), F.lit(0))).drop("_total")
    inner = Window.partitionBy(*keys, "_block").orderBy(*by).rowsBetween(Window.unboundedPreceding, 0)
    out = join_carried(blocked.withColumn("_own", F.sum("_value").over(inner)), carried, [*keys, "_block"])
    return out.withColumn(name, F.col("_own") + F.col("_carry")).drop("_block", "_value", "_own", "_carry")


def with_known(df: DataFrame, key: str | list[str], order: str, block: Column, value: Column, ties: list[str] | None = None, name: str = "known", ahead: bool = False) -> DataFrame:
    """Adds ``name``: ``value`` of the last row up to and with each row where it isn't null, by (order,
    ties) within its key; with ``ahead`` of the first such row from each row on."""
    by, keys = [order, *(ties or [])], _listed(key)
    blocked = df.withColumn("_block", block).withColumn("_value", value)
    edge = F.when(F.col("_value").isNotNull(), F.struct(*by, F.col("_value").alias("_v")))
    edges = blocked.groupBy(*keys, "_block").agg((F.min(edge) if ahead else F.max(edge))["_v"].alias("_edge"))
    blocks, inner = Window.partitionBy(*keys).orderBy("_block"), Window.partitionBy(*keys, "_block").orderBy(*by)
    if ahead:
        carry = F.first("_edge", ignorenulls=True).over(blocks.rowsBetween(1, Window.unboundedFollowing))
        own = F.first("_value", ignorenulls=True).over(inner.rowsBetween(0, Window.unboundedFollowing))
    else:
        carry = F.last("_edge", ignorenulls=True).over(blocks.rowsBetween(Window.unboundedPreceding, -1))
        own = F.last("_value", ignorenulls=True).over(inner.rowsBetween(Window.unboundedPreceding, 0))
    out = join_carried(blocked.withColumn("_own", own), edges.withColumn("_carry", carry).drop("_edge"), [*keys, "_block"])
    return out.withColumn(name, F.coalesce("_own", "_carry")).drop("_block", "_value", "_own", "_carry")

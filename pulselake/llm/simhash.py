"""SimHash near-duplicates with pigeonring filtering.

The 64 bits lie on a ring of ``segments`` segments. If two fingerprints differ in at most
``max_bits`` bits, then from some segment on every chain of l consecutive segments differs in at
most l * max_bits / segments bits. While that budget is below one, segments must be equal: they are
the join key. Longer chains are checked in the join, before the full Hamming distance.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulselake.llm.common import claim, columns, doc_hash, drop_path, fresh, record_batch, slices, trim, utf8, write_table
from pulselake.llm.components import connected_components

#: Bit counts of the 256 bytes, by bit.
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
_PLACE = (np.arange(8, dtype=np.int64) * 256)[None, :]

_NONE: dict = {}

#: A key shared by more distinct fingerprints than this is resolved through bit-deletion keys: with
#: b bits outside the key that costs b * (b - 1) / 2 rows a fingerprint, about as many as the pairs
#: that a fingerprint of a group of this size has.
LARGE_GROUP = 1400


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """64-bit SimHash over all word shingles, repeats included; 0 without words."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        hashes = [xxhash.xxh64_intdigest(joined, 42)]
    else:
        starts = np.zeros(len(words) + 1, np.int64)
        np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1, out=starts[1:])
        at = starts.tolist()
        hashes = list(map(xxhash.xxh64_intdigest, [joined[a : b - 1] for a, b in zip(at, at[shingle:])], repeat(42)))  # noqa: B905
    return _majority(np.array(hashes, np.uint64))


def _majority(hashes: np.ndarray) -> int:
    each = hashes.view(np.uint8).reshape(-1, 8).astype(np.int64)
    counts = np.bincount((each + _PLACE).ravel(), minlength=2048).reshape(8, 256) @ _BITS
    return int(np.packbits((2 * counts > len(hashes)).ravel(), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id, text_hash and fp (the fingerprint as a long) of every document."""
    src = docs.select("doc_id", doc_hash().alias("text_hash"), utf8().alias("text"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim(_NONE)
        for batch in slices(batches, "text"):
            fp = np.array([fingerprint(t, shingle) for t in columns(batch, "text")[0]], np.uint64).view(np.int64)
            schema = pa.schema([batch.schema.field(0), batch.schema.field(1), pa.field("fp", pa.int64())])
            yield record_batch(schema, [batch.column(0), batch.column(1), pa.array(fp)])
        trim()

    return src.mapInArrow(run, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, text_hash long, fp long")


def _mask(start: int, width: int) -> int:
    """``width`` bits on the ring of 64 from ``start``, as a signed long."""
    m = sum(1 << ((start + i) % 64) for i in range(width))
    return m - (1 << 64) if m >= 1 << 63 else m


def ring_bounds(segments: int) -> list[int]:
    return [64 * i // segments for i in range(segments + 1)]


def chain_masks(start: int, segments: int) -> list[int]:
    """Masks of the first 1, 2, ... consecutive segments from segment ``start`` on."""
    b = ring_bounds(segments)
    widths = [b[i + 1] - b[i] for i in range(segments)]
    return [_mask(b[start], sum(widths[(start + i) % segments] for i in range(n))) for n in range(1, segments + 1)]


def _any_of(values: list[int], i: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v).cast("long") for v in values]), i + 1)


def link_fingerprints(distinct: DataFrame, max_bits: int = 2, segments: int = 5, large_group: int = LARGE_GROUP) -> DataFrame:
    """Links a < b between distinct fingerprints (column fp) at ``max_bits`` or fewer.

    Every linked pair is found, in keys shared by at most ``large_group`` fingerprints. In larger
    ones, where pairs would grow with the square, fingerprints that agree once some ``max_bits``
    bits outside the key are cleared are linked to the smallest of them: these are links too, and
    they connect the same fingerprints. So the links give the right components always, whichever way
    a key takes, and work is bounded for each fingerprint.
    """
    if not 0 <= max_bits < min(4, segments):
        raise ValueError("from 4 bits on, chains that must be equal are too short to be keys")
    exact = max(1, -(-segments // max_bits) - 1) if max_bits else segments  # chains whose budget is below one
    masks = [chain_masks(i, segments) for i in range(segments)]
    keys = distinct.select("fp", F.explode(F.array(*[F.lit(i) for i in range(segments)])).alias("i"))
    keys = keys.select("fp", "i", F.col("fp").bitwiseAND(_any_of([m[exact - 1] for m in masks], F.col("i"))).alias("key"))
    large = keys.groupBy("i", "key").count().where(F.col("count") > large_group).select("i", "key")
    few = keys.join(large, ["i", "key"], "left_anti")
    a, b = few.alias("a"), few.alias("b")
    diff = F.col("a.fp").bitwiseXOR(F.col("b.fp"))
    rule = F.col("a.fp") < F.col("b.fp")
    for n in range(exact + 1, segments):
        rule &= F.bit_count(diff.bitwiseAND(_any_of([m[n - 1] for m in masks], F.col("a.i")))) <= n * max_bits // segments
    rule &= F.bit_count(diff) <= max_bits
    pairs = a.join(b, (F.col("a.i") == F.col("b.i")) & (F.col("a.key") == F.col("b.key")) & rule).select(F.col("a.fp").alias("a"), F.col("b.fp").alias("b"))

    spare = []  # for each segment: what to clear, of the bits outside its key
    for m in masks:
        out = [x for x in range(64) if not m[exact - 1] >> x & 1]
        spare.append([sum(_mask(x, 1) for x in c) for c in combinations(out, max_bits)])
    many = keys.join(large, ["i", "key"], "left_semi")
    clear = F.element_at(F.array(*[F.array(*[F.lit(v).cast("long") for v in s]) for s in spare]), F.col("i") + 1)
    cleared = many.select("fp", F.explode(clear).alias("bits")).select("fp", "bits", F.col("fp").bitwiseAND(F.bitwise_not("bits")).alias("rest"))
    least = cleared.groupBy("bits", "rest").agg(F.min("fp").alias("a"), F.max("fp").alias("z")).where("a < z").drop("z")
    stars = cleared.join(least, ["bits", "rest"]).where("fp > a").select("a", F.col("fp").alias("b"))
    return pairs.union(stars).distinct()


def near_duplicates(docs: DataFrame, max_bits: int = 2, shingle: int = 3) -> DataFrame:
    """Groups of documents whose SimHash fingerprints link at ``max_bits`` (3 at most) or fewer bits.

    Returns doc_id, text_hash, fingerprint (16 hexadecimal digits), component_id (smallest doc_id
    reachable) and root (a number of the component). Copies share a fingerprint: they are grouped
    before any comparison, so that a group of copies of any size costs one fingerprint.

    Null, empty and blank texts have fingerprint zero and are linked like any other; very long texts
    are read whole. Rows with a null doc_id take part; component_id is null only where all of a
    component's ids are. Repeated rows each give a row. Other columns are ignored. An empty table
    gives no rows.
    """
    fps, _ = write_table(fingerprints(docs, shingle), "fingerprints")
    classes = fps.groupBy("fp").agg(F.min("doc_id").alias("least_id"))
    classes, classes_path = write_table(classes, "classes")
    links, path = write_table(link_fingerprints(classes.select("fp"), max_bits), "links")
    members = classes.join(connected_components(links), F.col("fp") == F.col("node"), "left").select("fp", "least_id", F.coalesce("root", "fp").alias("root"))
    components = members.groupBy("root").agg(F.min("least_id").alias("component_id"))
    members, _ = write_table(members.join(components, "root").select("fp", "root", "component_id"), "members")
    for p in (path, classes_path):
        drop_path(docs.sparkSession, p)
    out = fps.join(members, "fp")
    return out.select("doc_id", "text_hash", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "root")


def keep_one(docs: DataFrame, max_bits: int = 2, shingle: int = 3) -> DataFrame:
    """One document of each group of ``near_duplicates``, with all its columns: the one with the
    smallest doc_id (null last), then the smallest text hash; of repeated rows, one. Nulls and empty
    texts are one group; an empty table gives no rows."""
    return first_of_each(docs, near_duplicates(docs, max_bits, shingle))


def first_of_each(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The first document of each root of ``found`` (doc_id, text_hash, root), as in ``keep_one``. Other
    columns stay, whatever their names."""
    own, hashed, mark = (fresh(docs, n) for n in ("kept_id", "kept_hash", "text_mark"))
    first = F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("id"), F.col("text_hash").alias("h"))
    kept = found.groupBy("root").agg(F.min(first).alias("k"), F.count("*").alias("c")).select(F.col("k.id").alias(own), F.col("k.h").alias(hashed))
    kept, _ = write_table(kept, "kept")
    repeated = found.groupBy("doc_id", "text_hash").count().where("count > 1").limit(1).count() > 0
    out = docs.withColumn(mark, doc_hash()).join(kept, F.col("doc_id").eqNullSafe(F.col(own)) & (F.col(mark) == F.col(hashed)), "left_semi")
    if repeated:
        out = out.dropDuplicates(["doc_id", mark])
    return out.drop(mark)

"""Near copies by the exact Jaccard similarity of word shingles, found through HyperMinHash.

A text's sketch has ``REGISTERS`` buckets of its shingles' hashes; of the least hash in a bucket it keeps
the number of leading zeros and ``MANTISSA`` bits after them, in 16 bits. An empty bucket takes over the
register of another one, by an order of its own that all texts share. Registers of two texts agree
about as often as their similarity says, and now and then by chance.

Texts whose registers agree throughout a band are candidates. They are compared by their registers
first, with agreement by chance taken off, and dropped only if their similarity would have to be six
standard deviations off; the rest is compared by whole shingle sets. Links make groups, in rounds:

0. a few bands; each text of a key with one of it. This joins most copies of large groups.
1. all bands. Keys whose texts are in one group are done. Otherwise all pairs of different groups, or,
   with more than ``LARGE`` texts in a key, each text with one of it.
2. texts of such large keys that aren't in one group yet, by many bands of twice as many registers,
   which texts well below the bound hardly share.
3. what large keys are left: wherever an exact bound on the rarest shingles allows a link.

So no link is lost but for the chance that two texts share no band: below 0.000002 at a similarity of 0.8.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulselake.llm.common import BASE, WORD_HASHES, claim, columns, doc_hash, drop_path, mix, record_batch, slices, trim, utf8, window_hashes, write_table
from pulselake.llm.components import connected_components

REGISTERS, MANTISSA = 512, 10
#: (number of bands, registers of each): of the first round, the second and the third.
FIRST, ALL, STRONG = (4, 7), (56, 7), (192, 12)
#: Least similarity of a link, in hundredths.
PERCENT = 80
#: A key shared by more distinct texts than this is compared through a centre first.
LARGE = 24
#: Standard deviations that an estimate may be off.
SIGMAS = 6
#: Most bits of a table of wanted keys (16 MB).
MOST_BITS = 1 << 27
#: Buckets of the table of common shingles: a power of two. It orders shingles only; links don't depend on it.
SKETCH = 1 << 22

_BOUNDS = np.array([-(-(j << 64) // REGISTERS) for j in range(REGISTERS)], np.uint64)
_ORDER = np.random.default_rng(13).random((REGISTERS, REGISTERS), np.float32)
_STRONG = np.array([np.random.default_rng(1000 + i).permutation(REGISTERS)[: STRONG[1]] for i in range(STRONG[0])])


def shingles(text: bytes, width: int) -> np.ndarray:
    """Sorted hashes of the distinct shingles of ``width`` words; a shorter text is one shingle."""
    words = text.lower().split()
    return np.unique(window_hashes(WORD_HASHES.of(words), min(width, len(words)))) if words else np.empty(0, np.uint64)


def registers(found: np.ndarray) -> np.ndarray:
    """The sketch of a set that isn't empty: leading zeros and mantissa of each bucket's least hash."""
    starts = np.searchsorted(found, _BOUNDS)
    filled = np.flatnonzero(starts < np.append(starts[1:], len(found)))
    part, power = np.frexp((found[starts[filled]] - _BOUNDS[filled]).astype(np.float64) * (REGISTERS / 2.0**64))
    out = np.empty(REGISTERS, np.uint16)
    zeros = np.where(part > 0, np.minimum(-power, 63), 63)
    out[filled] = zeros << MANTISSA | np.maximum((2 * part - 1) * (1 << MANTISSA), 0).astype(np.int64)
    if len(filled) < REGISTERS:
        empty = np.setdiff1d(np.arange(REGISTERS), filled, assume_unique=True)
        out[empty] = out[filled[_ORDER[np.ix_(empty, filled)].argmin(1)]]
    return out


def band_keys(regs: np.ndarray, bands: tuple[int, int]) -> np.ndarray:
    """Keys (n, number of bands) of sketches (n, REGISTERS)."""
    n, rows = bands
    each = regs[:, _STRONG] if bands == STRONG else regs[:, : n * rows].reshape(len(regs), n, rows)
    keys = np.broadcast_to(np.arange(n, dtype=np.uint64) + np.uint64(1000 * rows), (len(regs), n))
    for i in range(rows):
        keys = keys * BASE + each[:, :, i]
    return mix(keys)


def chance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of registers that agree by chance, of sets of ``a`` and ``b`` shingles without common ones."""
    x = 1.5 * 2.0 ** -np.arange(1, 64)  # amid the least hashes with 0, 1, ... leading zeros
    la, lb = (np.maximum(n / REGISTERS, 1.0)[:, None] for n in (a, b))
    density = la * np.exp(-la * x) * lb * np.exp(-lb * x)
    return (density * (x / 1.5) ** 2).sum(1) / (1 << MANTISSA)


def may_link(a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """Whether sets with these registers (n, REGISTERS) and sizes can be similar enough."""
    by_chance = chance(size_a, size_b)
    estimate = ((a == b).mean(1) - by_chance) / (1 - by_chance)
    least = percent / 100
    deviation = np.sqrt(least * (1 - least) / np.minimum(REGISTERS, np.minimum(size_a, size_b)))
    return estimate >= least - SIGMAS * deviation


def sketches(docs: DataFrame, width: int, fingerprint: Callable[[bytes], int] | None = None) -> DataFrame:
    """doc_id, text_hash, fp (hash of the shingle set, 0 without words), size and regs of every document;
    and print, where there is a function for it."""
    src = docs.select("doc_id", doc_hash().alias("text_hash"), utf8().alias("text"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim(WORD_HASHES)
        for batch in slices(batches, "text", 4 << 20):
            rows, texts = [], columns(batch, "text")[0]
            for text in texts:
                s = shingles(text, width)
                rows.append((xxhash.xxh64_intdigest(s.tobytes(), 5) if len(s) else 0, len(s), registers(s).tobytes() if len(s) else None))
            fp, size, regs = zip(*rows, strict=True)
            schema = pa.schema([batch.schema.field(0), batch.schema.field(1), ("fp", pa.int64()), ("size", pa.int64()), ("regs", pa.binary())])
            values = [batch.column(0), batch.column(1), pa.array(np.array(fp, np.uint64).view(np.int64)), size, regs]
            if fingerprint is not None:
                schema = schema.append(pa.field("print", pa.int64()))
                values.append(pa.array(np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64)))
            yield record_batch(schema, values)
        trim()

    ddl = f"doc_id {src.schema['doc_id'].dataType.simpleString()}, text_hash long, fp long, size long, regs binary"
    return src.mapInArrow(run, ddl if fingerprint is None else ddl + ", print long")


def _regs(col: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist()), np.uint16).reshape(-1, REGISTERS)


def _keys(classes: DataFrame, bands: tuple[int, int], bits: np.ndarray | None = None) -> DataFrame:
    """key, fp, size and root: a row for each band of each class; only keys in the table, if there is one."""
    step = max(1, (1 << 15) // bands[0])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                keys = band_keys(_regs(part.column(3)), bands).ravel()
                who = np.repeat(np.arange(part.num_rows), bands[0])
                if bits is not None:
                    wanted = _wanted(keys, bits)
                    keys, who = keys[wanted], who[wanted]
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), *[pa.array(part.column(i).to_numpy()[who]) for i in range(3)]], names=["key", "fp", "size", "root"])
        trim()

    return classes.select("fp", "size", "root", "regs").mapInArrow(run, "key long, fp long, size long, root long")


def _wanted(hashes: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Places of hashes whose bit is set in a table of ``_hash_bits``."""
    bit = hashes & np.uint64(8 * len(bits) - 1)
    return np.flatnonzero(bits[bit >> np.uint64(3)] >> (bit & np.uint64(7)).astype(np.uint8) & np.uint8(1))


def _hash_bits(hashes: DataFrame, name: str, n: int) -> np.ndarray:
    """A table of at most ``MOST_BITS``, in which the bits of ``n`` hashes are set: 64 each if it can. It only
    spares rows that match nothing; where it is too small for all, more of them come along."""
    bits = min(MOST_BITS, max(1 << 16, 1 << (64 * n - 1).bit_length()))
    words = hashes.groupBy(F.expr(f"({name} & {bits - 1}L) div 64").alias("w")).agg(F.expr(f"bit_or(shiftleft(1L, cast({name} & 63L as int)))").alias("b")).toArrow()
    out = np.zeros(bits // 64, np.int64)
    out[words.column("w").to_numpy()] = words.column("b").to_numpy()
    return out.view(np.uint8)


def _sizes_fit(a: str, b: str) -> Column:
    """Sets whose sizes differ more can't be similar."""
    return 100 * F.least(a, b) >= PERCENT * F.greatest(a, b)


def _pair(a: str, b: str) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def candidates(classes: DataFrame, bands: tuple[int, int], large: int) -> tuple[DataFrame, DataFrame] | None:
    """Pairs (a, b) of classes (fp, size, root, regs) of different roots that share a key, and the
    memberships (key, fp) in keys of more than ``large`` classes; there each is paired with one only.
    None if no key has different roots."""
    opened = _keys(classes, bands).groupBy("key").agg(F.count("*").alias("c"), F.min("root").alias("x"), F.max("root").alias("y"), F.min("fp").alias("centre")).where("x < y").select("key", "c", "centre")
    opened, opened_path = write_table(opened, "open-keys")
    n = opened.count()
    if not n:
        return None
    many, _ = write_table(_keys(classes, bands, _hash_bits(opened, "key", n)).join(opened, "key"), "memberships")
    few, rest = many.where(F.col("c") <= large), many.where(F.col("c") > large)
    a, b = few.alias("a"), few.alias("b")
    rule = (F.col("a.key") == F.col("b.key")) & (F.col("a.root") < F.col("b.root")) & _sizes_fit("a.size", "b.size")
    pairs = a.join(b, rule).select(*_pair("a.fp", "b.fp"))
    roots = classes.select(F.col("fp").alias("centre"), F.col("size").alias("centre_size"), F.col("root").alias("centre_root"))
    rule = (F.col("root") != F.col("centre_root")) & _sizes_fit("size", "centre_size")  # fp is a hash: the least one is any of them
    stars = rest.select("fp", "size", "root", "centre").distinct().join(roots, "centre").where(rule).select(*_pair("fp", "centre"))
    drop_path(classes.sparkSession, opened_path)
    return pairs.union(stars).distinct(), rest.select("key", "fp")


def estimated(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs (a, b) that their registers allow."""
    side = classes.select("fp", "size", "regs")
    both = pairs.join(side.toDF("b", "size_b", "regs_b"), "b").join(side.toDF("a", "size_a", "regs_a"), "a").select("a", "b", "size_a", "size_b", "regs_a", "regs_b")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                keep = may_link(_regs(batch.column(4)), _regs(batch.column(5)), batch.column(2).to_numpy(), batch.column(3).to_numpy())
                yield batch.select(["a", "b"]).filter(pa.array(keep))
        trim()

    return both.mapInArrow(run, "a long, b long")


def shingle_sets(docs: DataFrame, width: int, bits: np.ndarray) -> DataFrame:
    """doc_id, text_hash and s (the sorted hashes as bytes) of texts whose hash is in a table of bits."""
    src = docs.select("doc_id", doc_hash().alias("text_hash"), utf8().alias("text"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim(WORD_HASHES)
        for batch in batches:
            kept = batch.take(pa.array(_wanted(batch.column(1).to_numpy().view(np.uint64), bits)))
            for part in slices([kept], "text", 4 << 20):
                sets = pa.array([shingles(t, width).tobytes() for t in columns(part, "text")[0]], pa.binary())
                yield record_batch(pa.schema([part.schema.field(0), part.schema.field(1), ("s", pa.binary())]), [part.column(0), part.column(1), sets])
        trim()

    return src.mapInArrow(run, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, text_hash long, s binary")


def similar(a: bytes, b: bytes, percent: int = PERCENT) -> bool:
    """Whether two sets of ``shingle_sets`` have a Jaccard similarity of at least ``percent`` hundredths."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    both = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
    return 100 * both >= percent * (len(x) + len(y) - both)


def checked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) of which the sets are similar."""
    both = pairs.join(sets.select(F.col("fp").alias("b"), F.col("s").alias("t")), "b").join(sets.withColumnRenamed("fp", "a"), "a").select("a", "b", "s", "t")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [similar(s.as_py(), t.as_py()) for s, t in zip(batch.column(2), batch.column(3), strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))
        trim()

    return both.mapInArrow(run, "a long, b long")


def commonness(sets: DataFrame) -> np.ndarray:
    """How common shingles are, by ``SKETCH`` buckets of their hashes: eighths of the binary logarithm of
    the count of each bucket. Counts are over all of ``sets``, added up on executors; the table has one
    byte a bucket whatever the input."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.frombuffer(s, np.uint64) & np.uint64(SKETCH - 1) for s in columns(batch, "s")[0]]
            if found:
                buckets, n = np.unique(np.concatenate(found), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(buckets.astype(np.int32)), pa.array(n, pa.int64())], names=["bucket", "n"])
        trim()

    level = F.floor(8 * F.log2(F.sum("n"))).cast("int").alias("level")
    got = sets.select("s").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(level).toArrow()  # at most SKETCH rows
    out = np.zeros(SKETCH, np.uint8)
    out[got.column("bucket").to_numpy()] = np.minimum(got.column("level").to_numpy(), 255)
    return out


def rare_pairs(sets: DataFrame) -> DataFrame:
    """Pairs (a, b) of different roots among ``sets`` (fp, s, size, root) that can be similar.

    With shingles in any one order, similar sets share one of their first ones, as many as may be
    missing in the other set and one more. In the order of ``commonness`` these are rare, so that
    sets that only have common shingles in common make few pairs; and what follows their first common
    one must be enough. No similar pair is lost, whatever the order.
    """
    common = commonness(sets)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for fp, s, size, root in zip(*columns(batch, "fp", "s", "size", "root"), strict=True):
                x = np.frombuffer(s, np.uint64)
                upto = size + (-PERCENT * size) // 100 + 1
                first = x[np.lexsort((x, common[x & np.uint64(SKETCH - 1)]))[:upto]].view(np.int64)
                at = np.arange(1, len(first) + 1)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(first), fp)), pa.array(first), pa.array(np.full(len(first), size)), pa.array(np.full(len(first), root)), pa.array(at)], names=["fp", "shingle", "size", "root", "n"])
        trim()

    first = sets.select("fp", "s", "size", "root").mapInArrow(run, "fp long, shingle long, size long, root long, n long")
    first, first_path = write_table(first, "rare-shingles")
    a, b = first.alias("a"), first.alias("b")
    left = 1 + F.least(F.col("a.size") - F.col("a.n"), F.col("b.size") - F.col("b.n"))  # from the first common shingle on
    rule = (F.col("a.root") < F.col("b.root")) & _sizes_fit("a.size", "b.size") & (left * (100 + PERCENT) >= PERCENT * (F.col("a.size") + F.col("b.size")))
    found = a.join(b, (F.col("a.shingle") == F.col("b.shingle")) & rule).select(*_pair("a.fp", "b.fp"))
    found, _ = write_table(found.distinct(), "rare-pairs")
    drop_path(sets.sparkSession, first_path)
    return found


class _Groups:
    """Links and groups of a table of documents, round by round."""

    def __init__(self, docs: DataFrame, width: int, fingerprint: Callable[[bytes], int] | None = None):
        self.docs, self.width, self.paths = docs, width, []
        found, path = write_table(sketches(docs, width, fingerprint), "sketches")
        first = F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("id"), F.col("text_hash").alias("h"))
        prints = [] if fingerprint is None else [F.min("print").alias("print")]
        classes = found.where("fp <> 0").groupBy("fp").agg(F.min(first).alias("k"), F.first("size").alias("size"), F.first("regs").alias("regs"), *prints)
        self.classes = self._kept(classes, "classes")
        self.found, _ = write_table(found.drop("regs", "print"), "found")  # registers are kept once for each class alone
        drop_path(docs.sparkSession, path)
        self.repeated = self.found.groupBy("doc_id", "text_hash").count().where("count > 1").limit(1).count() > 0
        self.tested = self.sets = self.roots = None

    def _kept(self, df: DataFrame, name: str) -> DataFrame:
        df, path = write_table(df, name)
        self.paths.append(path)
        return df

    def rooted(self, classes: DataFrame | None = None) -> DataFrame:
        """Classes (fp, size, regs) with the root of the group that they are in so far."""
        classes = (self.classes if classes is None else classes).select("fp", "size", "regs")
        if self.roots is None:
            return classes.withColumn("root", F.col("fp"))
        return classes.join(self.roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))

    def _fetch(self, fps: DataFrame) -> DataFrame:
        """Shingle sets of classes; those that were read before aren't read again."""
        fps = fps.distinct()
        new = fps if self.sets is None else fps.join(self.sets, "fp", "left_anti")
        chosen = self.classes.join(new, "fp").select("fp", F.col("k.id").alias("id"), F.col("k.h").alias("h"))
        chosen = self._kept(chosen, "chosen")
        texts = shingle_sets(self.docs, self.width, _hash_bits(chosen, "h", chosen.count()))  # a set is made of few texts
        sets = texts.join(chosen, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("text_hash") == F.col("h"))).select("fp", "s")
        if self.repeated:
            sets = sets.groupBy("fp").agg(F.first("s").alias("s"))
        sets = self._kept(sets, "shingle-sets")
        self.sets = sets if self.sets is None else self.sets.union(sets)
        return self.sets

    def add(self, pairs: DataFrame) -> None:
        """Compares pairs that haven't been compared, and joins the groups of those that are similar."""
        if self.tested is not None:
            pairs = pairs.join(self.tested, ["a", "b"], "left_anti")
        pairs = self._kept(estimated(pairs, self.classes), "pairs")
        self.tested = pairs if self.tested is None else self.tested.union(pairs)
        if not pairs.limit(1).count():
            return
        sets = self._fetch(pairs.select(F.col("a").alias("fp")).union(pairs.select(F.col("b").alias("fp"))))
        links = self._kept(checked(pairs, sets), "links")
        if links.limit(1).count():
            joined = links if self.roots is None else links.union(self.roots.where("node <> root").select("node", "root"))
            self.roots = self._kept(connected_components(joined), "roots")

    def still_open(self, many: DataFrame) -> DataFrame:
        """fp of classes in keys (key, fp) whose classes aren't in one group."""
        marked = many.join(self.roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp")) if self.roots is not None else many.withColumn("root", F.col("fp"))
        keys = marked.groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x < y").select("key")
        return self._kept(many.join(keys, "key", "left_semi").select("fp").distinct(), "open")

    def close(self) -> None:
        for path in self.paths:
            drop_path(self.docs.sparkSession, path)


def near_groups(docs: DataFrame, width: int, large: int = LARGE, *, fingerprint: Callable[[bytes], int] | None = None, first: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """doc_id, text_hash, fp (of its shingle set; 0 without words), size (shingles) and root (a number of
    the group) of every document: groups are connected by links of a similarity of at least ``PERCENT``
    hundredths over distinct shingles of ``width`` words. Texts of equal sets are one from the start, so
    a group of copies of any size costs one sketch in all rounds.

    Null, empty and blank texts have no shingles, and one root; very long texts are read whole. Rows with
    a null doc_id take part; repeated rows each give a row. Other columns are ignored. An empty table
    gives no rows.

    With ``fingerprint`` (of a text, 64 bits) candidates (a, b) of round 0 come from ``first`` instead of
    bands: from a table of classes fp and their prints, the least of their texts' fingerprints as longs.
    """
    groups = _Groups(docs, width, fingerprint)
    if first is not None:
        pairs = first(groups.classes.select("fp", "print"))
    else:
        found = candidates(groups.rooted(), FIRST, 1)
        pairs = found and found[0]
    if pairs is not None:
        groups.add(pairs)
        if found := candidates(groups.rooted(), ALL, large):
            groups.add(found[0])
            opened = groups.still_open(found[1])
            if opened.limit(1).count():
                members = groups.rooted(groups.classes.join(opened, "fp"))
                if found := candidates(members, STRONG, large):
                    groups.add(found[0])
                    opened = groups.still_open(found[1])
                    if opened.limit(1).count():
                        members = groups.rooted(groups.classes.join(opened, "fp")).drop("regs")
                        groups.add(rare_pairs(groups._fetch(opened).join(members, "fp")))
    root = F.col("fp") if groups.roots is None else F.coalesce("root", "fp")
    rows = groups.found if groups.roots is None else groups.found.join(groups.roots.withColumnRenamed("node", "fp"), "fp", "left")
    out, _ = write_table(rows.select("doc_id", "text_hash", "fp", "size", root.alias("root")), "groups")
    groups.close()
    return out


def near_duplicates(docs: DataFrame, width: int = 4) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id that links reach, its own included) and kept
    (whether that is its own) of every document.

    As ``near_groups``; documents without words are linked with nothing. With null ids, component_id is
    the smallest of the others, null if there are none; a null id is kept where that is null too.
    """
    found = near_groups(docs, width)
    least = found.where("fp <> 0").groupBy("root").agg(F.min("doc_id").alias("component_id"))
    joined = found.where("fp <> 0").join(least, "root").select("doc_id", "size", "component_id")
    joined = joined.union(found.where("fp = 0").select("doc_id", "size", "doc_id"))
    return joined.select("doc_id", F.col("size").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))

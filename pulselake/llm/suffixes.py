"""Repeated passages by a sparse suffix array.

Only the suffixes at minimiser positions are kept: in each window of ``window`` consecutive word
k-grams the one with the smallest hash (leftmost of ties), so equal passages keep equal suffixes. A
passage of ``min_words`` words holds such a position among its first ``window`` words; from there at
least ``reach = min_words - window + 1`` words lie in it. Suffixes are sorted by the hash of their
first ``reach`` words, and neighbours compared: those that agree with a neighbour are extended left
and right, as windows of ``min_words`` words around the position, which are sorted and compared
again. So each word of a result lies in ``min_words`` consecutive words that recur as they are, and
none is missed (but for collisions of 64-bit hashes).

Suffixes are ordered by hashes, not by letters: with several texts between, the alphabetical
neighbour of a suffix need not be the one with which it shares the most words to its left.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulselake.llm.common import WORD_HASHES, claim, columns, drop_path, fresh, mix, parallel, record_batch, slices, trim, utf8, window_hashes, write_table

_WORD = re.compile(rb"[^\x20\x09-\x0d]+")


def minimisers(h: np.ndarray, gram: int, window: int) -> np.ndarray:
    """Positions of the smallest k-gram hash of each window, ascending; ties to the left."""
    grams = window_hashes(h, gram)
    if len(grams) < window:
        return np.empty(0, np.int64)
    low = np.uint64(0xFFFFFFFF)
    least, size = (grams & ~low) | np.arange(len(grams), dtype=np.uint64), 1
    while 2 * size <= window:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    if size < window:
        least = np.minimum(least[: len(grams) - window + 1], least[window - size :])
    return np.unique(least & low).astype(np.int64)


def _key() -> Column:
    return F.xxhash64("doc_id", "text")


_ROWS = pa.schema([("h", pa.int64()), ("ord", pa.int64()), ("key", pa.int64()), ("pos", pa.int32()), ("repeat", pa.bool_()), ("known", pa.bool_())])
_ROWS_DDL = "h long, ord long, key long, pos int, repeat boolean, known boolean"


def _runs(h: np.ndarray, key: np.ndarray, pos: np.ndarray, before: tuple | None = None) -> tuple[np.ndarray, np.ndarray, tuple]:
    """For sorted rows: which aren't the first place of their hash, which have a neighbour of equal
    hash at another place, and (hash, key, pos) that begin the last run. ``before`` is that of the
    rows before. Rows alike in key and pos are one place: a document that is there more than once."""
    n = len(h)
    new = np.concatenate([[True], h[1:] != h[:-1]])
    start = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    first_key, first_pos = key[start], pos[start].copy()
    if before is not None and before[0] == h[0]:
        lead = np.cumsum(new) == 1
        first_key[lead], first_pos[lead] = before[1:]
    repeat = (key != first_key) | (pos != first_pos)
    following = ~new[1:] & ((key[1:] != key[:-1]) | (pos[1:] != pos[:-1]))
    return repeat, repeat | np.concatenate([following, [False]]), (h[-1], first_key[-1], first_pos[-1])


def _dealt(h: list[np.ndarray], ord_: np.ndarray, key: np.ndarray, pos: list[np.ndarray]) -> pa.RecordBatch:
    """Rows of one batch of texts. Of equal hashes in it only the first place is sorted among those
    of other batches, known to recur; the others are known repeats and get a hash of their own,
    which spreads them. So a hash that very many rows have is sorted about once a batch."""
    at = np.repeat(np.arange(len(pos)), [len(x) for x in pos])
    hs, ps = np.concatenate(h).view(np.int64), np.concatenate(pos).astype(np.int32)
    os_, ks = ord_[at], key[at]
    if len(hs):
        order = np.lexsort((ps, ks, os_, hs))
        hs, ps, os_, ks = hs[order], ps[order], os_[order], ks[order]
        repeat, known, _ = _runs(hs, ks, ps)
        own = mix(ks.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + ps.astype(np.uint64)).view(np.int64)
        hs = np.where(repeat, own, hs)
    else:
        repeat = known = np.empty(0, bool)
    return record_batch(_ROWS, [pa.array(x) for x in (hs, os_, ks, ps, repeat, known)])


def _compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows in: out come those known to recur or with the hash of a neighbour; repeat is set
    where another place came before. Holds one row over from batch to batch."""
    held = before = None  # the last row, whose next neighbour isn't known yet, and its run
    for batch in batches:
        if not batch.num_rows:
            continue
        both = pa.concat_batches([held, batch]) if held is not None else batch
        repeat, known, before = _runs(both.column(0).to_numpy(), both.column(2).to_numpy(), both.column(3).to_numpy(), before)
        repeat = repeat | both.column(4).to_numpy(zero_copy_only=False)
        known = known | repeat | both.column(5).to_numpy(zero_copy_only=False)
        both = record_batch(_ROWS, [*both.columns[:4], pa.array(repeat), pa.array(known)])
        held = both.slice(both.num_rows - 1)
        yield both.slice(0, both.num_rows - 1).filter(pa.array(known[:-1]))
    if held is not None:
        yield held.filter(held.column(5))


def _sorted_neighbours(rows: DataFrame) -> DataFrame:
    order = ["h", "ord", "key", "pos"]
    return rows.repartition(parallel(rows.sparkSession), "h").sortWithinPartitions(*order).mapInArrow(_compare, _ROWS_DDL)


def merge(starts: Iterable[int], n: int) -> list[tuple[int, int]]:
    """Union of [start, start + n) as (start, length), ascending."""
    s = np.unique(np.fromiter(starts, np.int64))
    if not len(s):
        return []
    cut = np.flatnonzero(s[1:] > s[:-1] + n) + 1
    first, last = s[np.concatenate([[0], cut])], s[np.concatenate([cut - 1, [len(s) - 1]])]
    return list(zip(first.tolist(), (last + n - first).tolist(), strict=True))


def repeated_windows(docs: DataFrame, min_words: int = 50, window: int = 24, gram: int = 8, firsts: bool = True) -> tuple[DataFrame, DataFrame]:
    """(texts with their key, recurring windows as key, repeats and, unless left out, firsts: where a
    window begins that another place had before, or that is the first of its kind)."""
    reach = min_words - window + 1
    if reach < gram or window < 1:
        raise ValueError("min_words must be at least window + gram - 1")
    last = (1 << 63) - 1
    texts = docs.select("doc_id", _key().alias("key"), F.coalesce(F.col("doc_id").cast("long"), F.lit(last)).alias("ord"), utf8().alias("text"))

    def suffixes(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim(WORD_HASHES)
        for batch in slices(batches, "text"):
            hs, ps, keep = [], [], []
            for i, text in enumerate(columns(batch, "text")[0]):
                words = text.split()
                if len(words) < min_words:
                    continue
                h = WORD_HASHES.of(words)
                p = minimisers(h, gram, window)
                p = p[p <= len(h) - reach]
                hs.append(window_hashes(h, reach)[p])
                ps.append(p)
                keep.append(i)
            if keep:
                yield _dealt(hs, batch.column(1).to_numpy()[keep], batch.column(0).to_numpy()[keep], ps)
        trim()

    found = _sorted_neighbours(texts.select("key", "ord", "text").mapInArrow(suffixes, _ROWS_DDL))
    found = found.groupBy("key").agg(F.collect_set("pos").alias("at"))  # no longer than the text, however many rows are alike
    found, path = write_table(found, "suffixes")
    near = texts.select("key", "ord", "text").join(found, "key")

    def windows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim(WORD_HASHES)
        for batch in slices(batches, "text", 4 << 20):
            texts_, ats = columns(batch, "text", "at")
            hs, ps = [], []
            for text, at in zip(texts_, ats, strict=True):
                h = WORD_HASHES.of(text.split())
                n = len(h) - min_words + 1
                edge = np.zeros(n + 1, np.int64)
                p = np.array(at, np.int64)
                np.add.at(edge, np.clip(p - window + 1, 0, n), 1)
                np.add.at(edge, np.clip(p + 1, 0, n), -1)
                starts = np.flatnonzero(np.cumsum(edge)[:n])
                hs.append(window_hashes(h, min_words)[starts])
                ps.append(starts)
            if hs:
                yield _dealt(hs, batch.column(1).to_numpy(), batch.column(0).to_numpy(), ps)
        trim()

    recurring = _sorted_neighbours(near.mapInArrow(windows, _ROWS_DDL))
    if firsts:
        recurring = recurring.groupBy("key").agg(F.collect_set(F.when(F.col("repeat"), F.col("pos"))).alias("repeats"), F.collect_set(F.when(~F.col("repeat"), F.col("pos"))).alias("firsts"))
    else:
        recurring = recurring.where("repeat").groupBy("key").agg(F.collect_set("pos").alias("repeats"))
    recurring, _ = write_table(recurring, "windows")
    drop_path(docs.sparkSession, path)
    return texts, recurring


def repeated_passages(docs: DataFrame, min_words: int = 50, window: int = 24, gram: int = 8) -> DataFrame:
    """Passages of ``min_words`` words and more (split at white space) that occur again, in another
    document or in the same one.

    Returns doc_id, start, n_words (in words) and repeat: false for passages whose windows are the
    first of their kind in the order of doc_id (null last), text hash and place, true for later ones.
    Passages of either sort are as long as possible.

    Null, empty and short texts have none. Rows alike in doc_id and text are
    one document, and give its rows each.
    Other columns are ignored; an empty table gives no rows.
    """
    texts, recurring = repeated_windows(docs, min_words, window, gram)
    src = texts.select("doc_id", "key").join(recurring, "key").select("doc_id", "repeats", "firsts")

    def spans(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, at = [], []
            for i, (repeats, firsts) in enumerate(zip(*columns(batch, "repeats", "firsts"), strict=True)):
                found = [(s, n, True) for s, n in merge(repeats, min_words)]
                found += [(s, n, False) for s, n in merge(set(firsts) - set(repeats), min_words)]
                rows += sorted(found)
                at += [i] * len(found)
            out = pa.schema([batch.schema.field(0), ("start", pa.int64()), ("n_words", pa.int64()), ("repeat", pa.bool_())])
            if rows:
                yield record_batch(out, [batch.column(0).take(pa.array(at)), *zip(*rows, strict=True)])

    return src.mapInArrow(spans, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, start long, n_words long, repeat boolean")


def cut_words(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """Text without the words of the spans (start, length), and without the space after each."""
    begins = [m.start() for m in _WORD.finditer(text)]
    ends = [*begins, len(text)]
    out, at = [], 0
    for start, n in spans:
        out.append(text[at : begins[start]])
        at = ends[start + n]
    return b"".join([*out, text[at:]])


def cut_repeats(docs: DataFrame, min_words: int = 50, window: int = 24, gram: int = 8) -> DataFrame:
    """Documents with all their columns, repeated passages cut out of their texts but for the first
    occurrence of each; n_chars, where there is such a column, is counted anew for those. Documents
    of which no word is left go; all others stay as they are.

    Null, empty and short texts stay; very long ones are read whole. Rows alike in doc_id and text are
    one document and are cut alike; a null doc_id comes last in the order. Other columns stay, whatever
    their names. An empty table gives no rows.
    """
    _, recurring = repeated_windows(docs, min_words, window, gram, firsts=False)
    key, spans = fresh(docs, "text_key"), fresh(docs, "text_repeats")
    repeats = recurring.select(F.col("key").alias(key), F.col("repeats").alias(spans))
    marked = docs.withColumn(key, _key()).join(repeats, key, "left")

    @F.arrow_udf("string")
    def cut(text: pa.Array, repeats: pa.Array) -> pa.Array:
        return pa.array([t if r is None or t is None else cut_words(t.encode(), merge(r, min_words)).decode() for t, r in zip(text.to_pylist(), repeats.to_pylist(), strict=True)], pa.string())

    held = F.col(spans).isNotNull()
    once = cut.asNondeterministic()  # else the rule below would cut anew, in further workers
    out = marked.withColumn("text", F.when(held, once(F.when(held, F.col("text")), spans)).otherwise(F.col("text"))).where(~held | (F.length(F.trim("text")) > 0))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(held, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)

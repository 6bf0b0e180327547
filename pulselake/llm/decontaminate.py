"""Benchmark decontamination by template canonicalisation.

Words become template tokens: numbers, units after numbers, and names (capitalised words that don't
begin a sentence) are replaced by typed placeholders, so that a question with other numbers or names
has the same template. Template windows of documents are hash-joined with those of the benchmark;
then slots are checked: within a window, equal values must stay equal and different ones different.
Every window is also joined by its lower-cased words themselves, so that verbatim ones match whatever
their slots and letter case, and items too short for a template match as a whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulselake.llm.common import claim, columns, doc_hash, drop_path, fresh, record_batch, slices, trim, utf8, window_hashes, write_table

#: Words that are units where they follow a number.
UNITS = frozenset(b"m cm mm km g kg mg t l ml s sec min h hr ms hz khz mhz v a w kw j kj n pa % percent meter meters metre metres kilometer kilometers kilometre kilometres mile miles foot feet inch inches gram grams kilogram kilograms pound pounds ounce ounces litre litres liter liters gallon gallons second seconds minute minutes hour hours day days week weeks month months year years dollar dollars euro euros cent cents degree degrees".split())

_NUMBER = re.compile(rb"[+-]?[$]?\d[\d.,:/]*(?:st|nd|rd|th|%)?")
_PUNCTUATION = bytes(c for c in range(33, 128) if not chr(c).isalnum() and chr(c) not in "%$+-")
_NUM, _UNIT, _CAP, _END = np.uint64(1), np.uint64(2), np.uint64(4), np.uint64(8)
_FLAGS = np.uint64(15)
NUMBER, UNIT, NAME = np.uint64(16), np.uint64(32), np.uint64(48)


class _Words(dict):
    """Word to 60 bits of hash and four flags; keeps a bounded number of words."""

    def __missing__(self, word: bytes) -> int:
        core = word.strip(_PUNCTUATION)
        low = core.lower()
        flags = 1 * bool(_NUMBER.fullmatch(low)) | 2 * (low in UNITS) | 4 * (core[:1] != low[:1]) | 8 * (word.rstrip(b"\"')")[-1:] in (b".", b"!", b"?", b":"))
        whole = low if low.isascii() else low.decode("utf-8", "replace").lower().encode()
        value = (xxhash.xxh64_intdigest(whole, 8) & ~15) | flags
        if len(self) < 120_000:
            self[word] = value
        return value


_KNOWN = _Words()
#: Hash of words of punctuation only.
_EMPTY = np.uint64(xxhash.xxh64_intdigest(b"", 8) & ~15)


def templates(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(template token of each word, hash of each word itself)."""
    words = text.split()
    packed = np.fromiter(map(_KNOWN.__getitem__, words), np.uint64, len(words))
    own = packed & ~_FLAGS
    number = (packed & _NUM) != 0
    starts = np.ones(len(words), bool)
    after_number = np.zeros(len(words), bool)
    if len(words) > 1:
        starts[1:] = (packed[:-1] & _END) != 0
        after_number[1:] = number[:-1]
    name = ((packed & _CAP) != 0) & ~starts & ~number
    unit = ((packed & _UNIT) != 0) & after_number
    return np.where(number, NUMBER, np.where(unit, UNIT, np.where(name, NAME, own))), own


def _is_slot(tokens: np.ndarray) -> np.ndarray:
    return tokens < 64


def slot_pattern(tokens: np.ndarray, own: np.ndarray) -> bytes:
    """For each slot the first place in the window that has the same type and value. Slot values of two
    windows map one to one, type by type, exactly where these are equal."""
    first: dict[tuple[int, int], int] = {}
    return np.array([first.setdefault((t, v), i) if t < 64 else -1 for i, (t, v) in enumerate(zip(tokens.tolist(), own.tolist(), strict=True))], np.int32).tobytes()


#: Kinds of windows: of the words themselves, of the template.
WORDS, TEMPLATE = 0, 1

#: Most bits of the table of window hashes (16 MB).
MOST_BITS = 1 << 27

_WINDOW = [("k", pa.int32()), ("kind", pa.int32()), ("h", pa.int64()), ("seen", pa.binary()), ("pattern", pa.binary()), ("own", pa.binary())]
_WINDOW_DDL = "k int, kind int, h long, seen binary, pattern binary, own binary"


def _salted(h: np.ndarray, kind: int, k: int) -> np.ndarray:
    return h ^ (np.uint64((2 * k + kind) * 0x9E3779B97F4A7C15 % (1 << 64)))


def windows_of_item(text: bytes, window: int, least: int) -> Iterator[tuple]:
    """(place, k, kind, h, seen, pattern, own) of each window of an item by which it can be found."""
    tokens, own = templates(text)
    k = min(window, len(tokens))
    for i, h in enumerate(_salted(window_hashes(own, k), WORDS, k).view(np.int64).tolist() if k else []):
        part = own[i : i + k]
        if (part != _EMPTY).any():
            yield i, k, WORDS, h, part.tobytes(), b"", part.tobytes()
    if not k or k < least:
        return
    variants = [tokens]
    if (packed := _KNOWN[text.split()[0]]) & 4 and not packed & 1:  # may stand in a sentence
        variants.append(np.concatenate([[NAME], tokens[1:]]))
    for v, tok in enumerate(variants):
        for i, h in enumerate(_salted(window_hashes(tok, k), TEMPLATE, k).view(np.int64)[: 1 if v else None].tolist()):
            part = tok[i : i + k]
            if 2 * int(_is_slot(part).sum()) <= k:  # mostly wording
                yield i, k, TEMPLATE, h, part.tobytes(), slot_pattern(part, own[i : i + k]), own[i : i + k].tobytes()


def benchmark_windows(benchmark: DataFrame, window: int, least: int) -> DataFrame:
    """Windows of all items: item_no (of the row), item_id, n_words, at and what ``windows_of_item`` gives."""
    src = benchmark.select("item_id", F.monotonically_increasing_id().alias("item_no"), utf8().alias("text"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim(_KNOWN)
        for batch in slices(batches, "text"):
            schema = pa.schema([batch.schema.field(0), batch.schema.field(1), ("n_words", pa.int64()), ("at", pa.int64()), *_WINDOW])
            rows, take = [], []
            for i, text in enumerate(columns(batch, "text")[0]):
                n = len(text.split())
                found = [(n, *w) for w in windows_of_item(text, window, least)]
                rows += found
                take += [i] * len(found)
            if rows:
                where = pa.array(take)
                yield record_batch(schema, [batch.column(0).take(where), batch.column(1).take(where), *zip(*rows, strict=True)])
        trim()

    ddl = f"item_id {src.schema['item_id'].dataType.simpleString()}, item_no long, n_words long, at long, {_WINDOW_DDL}"
    return src.mapInArrow(run, ddl)


def hash_bits(windows: DataFrame) -> np.ndarray:
    """A table of a power of two of bits, a thousand a window and at most ``MOST_BITS``: those that window
    hashes fall on are set. Bits are gathered on executors, 64 together."""
    n = windows.count()
    bits = min(MOST_BITS, max(1 << 16, 1 << (1024 * n - 1).bit_length())) if n else 1 << 16
    words = windows.groupBy(F.expr(f"(h & {bits - 1}L) div 64").alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(h & 63L as int)))").alias("b")).toPandas()
    out = np.zeros(bits // 64, np.int64)
    out[words["w"].to_numpy(np.int64)] = words["b"].to_numpy(np.int64)
    return out.view(np.uint8)


def document_windows(docs: DataFrame, kinds: list[tuple[int, int]], bits: np.ndarray) -> DataFrame:
    """Windows of documents, of each (kind, k), whose hash is in the table: doc_id, text_hash, row_no,
    place and the columns of a window."""
    src = docs.select("doc_id", doc_hash().alias("text_hash"), F.monotonically_increasing_id().alias("row_no"), utf8().alias("text"))
    mask = np.uint64(8 * len(bits) - 1)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim(_KNOWN)
        for batch in slices(batches, "text"):
            schema = pa.schema([*[batch.schema.field(i) for i in range(3)], ("place", pa.int64()), *_WINDOW])
            rows, take = [], []
            for d, text in enumerate(columns(batch, "text")[0]):
                tokens, own = templates(text)
                for kind, k in kinds:
                    seen = tokens if kind == TEMPLATE else own
                    h = _salted(window_hashes(seen, k), kind, k)
                    bit = h & mask
                    for p in np.flatnonzero(bits[bit >> np.uint64(3)] >> (bit & np.uint64(7)).astype(np.uint8) & np.uint8(1)).tolist():
                        part, values = seen[p : p + k], own[p : p + k]
                        rows.append((p, k, kind, int(h[p].view(np.int64)), part.tobytes(), slot_pattern(part, values) if kind == TEMPLATE else b"", values.tobytes()))
                        take.append(d)
            if rows:
                where = pa.array(take)
                yield record_batch(schema, [*[batch.column(i).take(where) for i in range(3)], *zip(*rows, strict=True)])
        trim()

    return src.mapInArrow(run, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, text_hash long, row_no long, place long, {_WINDOW_DDL}")


def matches(docs: DataFrame, benchmark: DataFrame, window: int = 10, least: int = 6) -> DataFrame:
    """Places of documents where a window of an item stands: doc_id, text_hash, row_no, place, item_id,
    item_no, n_words, at (place in the item), k and verbatim (whether all values are equal)."""
    items, _ = write_table(benchmark_windows(benchmark, window, least), "benchmark-windows")
    kinds = [(r["kind"], r["k"]) for r in items.select("kind", "k").distinct().orderBy("kind", "k").collect()]  # two a length up to window
    d, b = document_windows(docs, kinds, hash_bits(items)).alias("d"), items.alias("b")
    same = [F.col(f"d.{c}") == F.col(f"b.{c}") for c in ("kind", "k", "h")]
    slots = (F.col("d.seen") == F.col("b.seen")) & (F.col("d.pattern") == F.col("b.pattern"))
    return d.join(b, same).where(slots).select("doc_id", "text_hash", "row_no", "place", "item_id", "item_no", "n_words", "at", "d.k", (F.col("d.own") == F.col("b.own")).alias("verbatim"))


def contaminated(docs: DataFrame, benchmark: DataFrame, window: int = 10, least: int = 6) -> DataFrame:
    """Pairs of a document and a benchmark item of which it holds a window, verbatim but for letter
    case and punctuation, or with other numbers, names or units.

    Returns doc_id, text_hash, item_id, n_windows (places of the document where one begins), coverage
    (share of the item's words in matched windows), first_word (in the document) and verbatim (false
    where numbers, names or units of some place differ). A window has ``window`` words, or all of a
    shorter item. Items of fewer than ``least`` words and windows that are mostly placeholders match
    verbatim only; items without a letter or digit match nothing.

    Null and empty texts hold nothing; very long ones are read whole. Repeated documents give their
    pairs each; repeated items too. Rows with null ids take part. Other columns are ignored; an empty
    table on either side gives no rows.
    """
    pair = ["row_no", "doc_id", "text_hash", "item_no", "item_id", "n_words", "k"]
    places = matches(docs, benchmark, window, least).groupBy(*pair, "place").agg(F.max("verbatim").alias("verbatim"), F.collect_set("at").alias("at"))
    found = places.groupBy(*pair).agg(F.count("*").alias("n_windows"), F.min("place").alias("first_word"), F.min("verbatim").alias("verbatim"), F.array_distinct(F.flatten(F.collect_list("at"))).alias("at"))
    covered = F.size(F.array_distinct(F.flatten(F.transform("at", lambda i: F.sequence(i, i + F.col("k") - 1)))))
    return found.select("doc_id", "text_hash", "item_id", "n_windows", (covered / F.col("n_words")).alias("coverage"), "first_word", "verbatim")


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10, least: int = 6) -> DataFrame:
    """Documents, with all their columns, that hold no window of any benchmark item: those without a
    row in ``contaminated``. Nulls, empty and long texts and repeated rows as there; other columns stay,
    whatever their names."""
    items, items_path = write_table(benchmark_windows(benchmark, window, least), "benchmark-windows")
    kinds = [(r["kind"], r["k"]) for r in items.select("kind", "k").distinct().orderBy("kind", "k").collect()]  # two a length up to window
    same = ["kind", "k", "h", "seen", "pattern"]  # however many items have a window, a document's is kept once
    found = document_windows(docs, kinds, hash_bits(items)).join(items.select(*same).distinct(), same, "left_semi")
    own, hashed = fresh(docs, "found_id"), fresh(docs, "found_hash")
    held, _ = write_table(found.select(F.col("doc_id").alias(own), F.col("text_hash").alias(hashed)).distinct(), "contaminated")
    drop_path(docs.sparkSession, items_path)
    return docs.join(held, F.col("doc_id").eqNullSafe(F.col(own)) & (doc_hash() == F.col(hashed)), "left_anti")

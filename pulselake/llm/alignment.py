"""How the tokens of two tokenizers meet in the same texts, and how often each pair of ids does.

Both tokenizers cut the same bytes (a space and the text). Offsets where a token of either ends cut the
tokens into groups; the last tokens of a group, one of each side, are a link. A pair of linked ids is
packed into one 64-bit number (the first id in the upper half). Each task counts its pairs with
``np.unique``; the partial counts are sorted by range over the cluster and runs of equal keys are
summed, which gives shards of sorted keys and their counts. Lookups map these files into memory and
search them by ``np.searchsorted``, so that no table of all pairs is held by anyone.
"""

from __future__ import annotations

import hashlib
import json
import os
import uuid
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulselake.llm.common import claim, columns, drop_path, parallel, record_batch, scratch_root, slices, trim, utf8, write_table
from pulselake.llm.tokens import _BYTE_CHARS as BYTE_CHARS
from pulselake.llm.tokens import _has_runs as has_runs
from pulselake.sources.files import opened

#: Words kept with their aligned tokens in a worker, the longest one kept, and new ones aligned together.
CACHE_WORDS, CACHE_CHARS, TOGETHER = 300_000, 40, 2048

#: Distinct pairs that a task counts before it hands on partial counts.
PARTIAL_PAIRS = 1 << 20

SPACE = "▁"
_LOADED: dict[tuple[str, str], "Aligner"] = {}


class Aligner:
    """Two tokenizers, the bytes of their tokens and the texts of their ids.

    Usual tokenizers cut before a space that stands alone before another character: then tokens of both
    sides end together before it, and a word with its space has the same tokens and groups in any text.
    Such words are aligned once and remembered. Texts with other runs of white space are aligned whole.
    """

    def __init__(self, a_path: str, b_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(a_path), sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.a.encode_special_tokens = True  # their strings are plain text
        settings = json.loads(self.a.to_str())
        cut = settings.get("pre_tokenizer") or {}
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.by_word = cut.get("type") == "ByteLevel" and cut.get("use_regex") and not cut.get("add_prefix_space") and not settings.get("normalizer") and not any(SPACE in p.lstrip(SPACE) for p in pieces)
        byte_of = {c: b for b, c in enumerate(BYTE_CHARS.tolist())}
        vocabulary = self.a.get_vocab()
        a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            if all(ord(c) in byte_of for c in token):
                a_bytes[i] = bytes(byte_of[ord(c)] for c in token)
        b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)]
        self.bytes = a_bytes, b_bytes
        self.a_size, self.b_size = (np.array([len(x) for x in side], np.int64) for side in self.bytes)
        # Decimal ids with what follows: within a group "," and at its end "|" (first side) or ";".
        self.marked = [f"{i}{mark}" for i in range(len(a_bytes)) for mark in ",|"] + [f"{i}{mark}" for i in range(len(b_bytes)) for mark in ",;"]
        self.words: dict[str, tuple[int, bytes, str] | None] = {}
        self.before: dict[str, tuple[int, bytes, str] | None] = {}

    @classmethod
    def at(cls, a_path: str, b_path: str) -> "Aligner":
        if (a_path, b_path) not in _LOADED:
            _LOADED[a_path, b_path] = cls(a_path, b_path)
        return _LOADED[a_path, b_path]

    def whole(self, texts: list[str]) -> list[tuple[int, bytes, str] | None]:
        """Of each text (not empty): tokens of either side (the first in the upper half of a number), links
        (packed pairs) and groups as text; None where tokens don't join to a space and the text."""
        ids = [e.ids for e in self.a.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)], self.b.encode(texts, num_threads=1)
        raw = [(" " + t).encode() for t in texts]
        kept = [k for k, t in enumerate(raw) if all(b"".join(map(known.__getitem__, side[k])) == t for known, side in zip(self.bytes, ids, strict=True))]
        out: list[tuple[int, bytes, str] | None] = [None] * len(texts)
        if kept:
            own = [[side[k] for k in kept] for side in ids]
            flat = (np.array(list(chain.from_iterable(x)), np.int64) for x in own)
            for k, got in zip(kept, self._aligned(*flat, *(np.array([len(x) for x in side], np.int64) for side in own)), strict=True):
                out[k] = got
        return out

    def together(self, words: list[str]) -> Iterable[tuple[int, bytes, str] | None]:
        """As ``whole`` for words (see above), by one text of them all."""
        text = " ".join(words)
        ids = self.a.encode_batch_fast([" " + text], add_special_tokens=False)[0].ids, self.b.encode(text)
        whole = (" " + text).encode()
        if all(b"".join(map(known.__getitem__, x)) == whole for known, x in zip(self.bytes, ids, strict=True)):
            upto = np.cumsum([len(w.encode()) + 1 for w in words])
            a, b = (np.array(x, np.int64) for x in ids)
            ends = np.cumsum(self.a_size[a]), np.cumsum(self.b_size[b])
            at = [np.searchsorted(e, upto) for e in ends]
            if all((e[k] == upto).all() for e, k in zip(ends, at, strict=True)):
                return self._aligned(a, b, *(np.diff(k, prepend=-1) for k in at))
        return self.whole(words)

    def _aligned(self, a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> Iterator[tuple[int, bytes, str]]:
        """What ``whole`` gives of texts whose tokens of both sides, ``n_a`` and ``n_b`` of each, have the
        same bytes."""
        a_end, b_end = np.cumsum(self.a_size[a]), np.cumsum(self.b_size[b])
        at_a, at_b = (np.zeros(int(a_end[-1]) + 1, bool) for _ in range(2))
        at_a[a_end] = at_b[b_end] = True
        a_last, b_last = at_b[a_end], at_a[b_end]  # tokens that end a group: as many on either side
        a_place, b_place = np.flatnonzero(a_last), np.flatnonzero(b_last)
        order = np.empty(len(a) + len(b), np.int64)  # group by group, the first side's tokens before the other's
        order[np.arange(len(a)) + np.append(0, b_place + 1)[np.cumsum(a_last) - a_last]] = 2 * a + a_last
        order[np.arange(len(b)) + a_place[np.cumsum(b_last) - b_last] + 1] = 2 * (b + len(self.bytes[0])) + b_last
        marked = list(map(self.marked.__getitem__, order.tolist()))
        links = packed(a[a_place], b[b_place]).astype("<i8").tobytes()
        ends, link_ends = np.cumsum(n_a + n_b).tolist(), (8 * np.searchsorted(a_place, np.cumsum(n_a))).tolist()
        for n, w, x, y, z in zip((n_a << 32 | n_b).tolist(), [0, *ends], ends, [0, *link_ends], link_ends):  # noqa: B905
            yield n, links[y:z], "".join(marked[w:x])[:-1]

    def align(self, texts: list[str]) -> list[tuple[int, bytes, str] | None]:
        """As ``whole``, word by word where texts allow it. Empty texts have None."""
        known = self.words
        split = {k: t.split(" ") for k, t in enumerate(texts) if t and self.by_word and SPACE not in t and not has_runs(" " + t)}
        new = set().union(*split.values()).difference(known)
        if len(known) + len(new) > CACHE_WORDS // 2:  # words of the last generation stay if they come again
            self.words, self.before = {}, known
            new |= known.keys() & set().union(*split.values())
            known = self.words
        known.update((w, self.before[w]) for w in new if w in self.before)
        new = [w for w in new if w not in known]
        for at in range(0, len(new), TOGETHER):
            part = new[at : at + TOGETHER]
            known.update(zip(part, self.together(part), strict=True))
        out: list[tuple[int, bytes, str] | None] = [None] * len(texts)
        for k, words in split.items():
            parts = list(map(known.__getitem__, words))
            if None not in parts:
                n, links, groups = zip(*parts, strict=True)
                out[k] = sum(n), b"".join(links), ";".join(groups)
        rest = [k for k, t in enumerate(texts) if t and k not in split]
        for k, got in zip(rest, self.whole([texts[k] for k in rest]), strict=True):
            out[k] = got
        for w in new:
            if len(w) > CACHE_CHARS:
                del known[w]
        return out


def packed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a.astype(np.int64) << 32 | b.astype(np.int64)


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and the sum of the counts of each."""
    keys, at = np.unique(keys, return_inverse=True)
    out = np.zeros(len(keys), np.int64)
    np.add.at(out, at, counts)
    return keys, out


def links_of(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, groups_sha256 and links of every document, in one pass. ``links``
    are 64-bit packed pairs, in order. A task adds rows of partial counts, in which only pair_keys and
    pair_counts aren't null."""
    src = docs.select("doc_id", utf8().alias("text"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim(_LOADED)
        both = Aligner.at(a_path, b_path)
        keys, counts, schema = np.empty(0, np.int64), np.empty(0, np.int64), None

        def partial() -> pa.RecordBatch:
            return record_batch(schema, [pa.nulls(1, schema.field(0).type), *[[None]] * 5, [keys.tobytes()], [counts.tobytes()]])

        for batch in slices(batches, "text", 1 << 20):
            n = np.zeros((3, batch.num_rows), np.int64)
            shas, links = [""] * batch.num_rows, [b""] * batch.num_rows
            raw = columns(batch, "text")[0]
            texts = [t.decode("utf-8", "replace") for t in raw]
            for k, got in enumerate(both.align(texts)):
                if got is not None and texts[k].encode() == raw[k]:
                    n[:, k] = got[0] >> 32, got[0] & 0xFFFFFFFF, len(got[1]) // 8
                    links[k], shas[k] = got[1], hashlib.sha256(got[2].encode()).hexdigest()
            new, times = np.unique(np.frombuffer(b"".join(links), "<i8"), return_counts=True)
            keys, counts = summed(np.append(keys, new), np.append(counts, times))
            schema = pa.schema([batch.schema.field(0), *[(x, pa.int64()) for x in ("n_a", "n_b", "n_groups")], ("groups_sha256", pa.string()), *[(x, pa.binary()) for x in ("links", "pair_keys", "pair_counts")]])
            yield record_batch(schema, [batch.column(0), *[pa.array(x) for x in n], shas, links, *[pa.nulls(batch.num_rows, pa.binary())] * 2])
            if len(keys) > PARTIAL_PAIRS:
                yield partial()
                keys, counts = keys[:0], counts[:0]
        if len(keys):
            yield partial()
        trim()

    id_type = src.schema["doc_id"].dataType.simpleString()
    return src.mapInArrow(run, f"doc_id {id_type}, n_a long, n_b long, n_groups long, groups_sha256 string, links binary, pair_keys binary, pair_counts binary")


def write_counts(partial: DataFrame) -> tuple[str, DataFrame, str]:
    """Shards of sorted keys and summed counts from rows of ``links_of``: their folder, and a table of
    one row a shard (part, first, last, n) and rows (b, best) with the highest count of each id of the
    second side in a shard; and where that table lies.

    Shard p is two files of little-endian 64-bit numbers, p.keys and p.counts. They are written as they
    come, so a shard is never held whole; a task that runs again writes the same files."""
    spark = partial.sparkSession
    folder = f"{scratch_root(spark)}/pair-counts-{uuid.uuid4().hex}"

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys, counts in zip(batch.column(0), batch.column(1), strict=True):
                pair = [np.frombuffer(x.as_buffer(), "<i8") for x in (keys, counts)]
                for at in range(0, len(pair[0]), 1 << 16):
                    yield pa.RecordBatch.from_arrays([pa.array(x[at : at + (1 << 16)]) for x in pair], names=["key", "n"])

    def shard(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, inner = opened(folder)
        system.create_dir(inner, recursive=True)
        part, own = TaskContext.get().partitionId(), uuid.uuid4().hex
        names = [(f"{inner}/.{part}-{own}.{x}", f"{inner}/{part}.{x}") for x in ("keys", "counts")]
        outs = [system.open_output_stream(x) for x, _ in names]
        ids, best = np.empty(0, np.int64), np.empty(0, np.int64)
        first = last = None
        size, held = 0, (np.empty(0, np.int64), np.empty(0, np.int64))

        def write(keys: np.ndarray, counts: np.ndarray) -> None:
            nonlocal first, last, size, ids, best
            if len(keys):
                first, last, size = int(keys[0]) if first is None else first, int(keys[-1]), size + len(keys)
                outs[0].write(keys.astype("<i8").tobytes())
                outs[1].write(counts.astype("<i8").tobytes())
                seen, at = np.unique(np.append(ids, keys & 0xFFFFFFFF), return_inverse=True)
                most = np.zeros(len(seen), np.int64)
                np.maximum.at(most, at, np.append(best, counts))
                ids, best = seen, most

        for batch in batches:
            if batch.num_rows:
                keys, counts = summed(np.append(held[0], batch.column(0).to_numpy()), np.append(held[1], batch.column(1).to_numpy()))
                write(keys[:-1], counts[:-1])
                held = keys[-1:], counts[-1:]  # its run may go on
        write(*held)
        for out, (temp, name) in zip(outs, names, strict=True):
            out.close()
            system.move(temp, name)
        schema = pa.schema([(x, pa.int64()) for x in ("part", "first", "last", "n", "b", "best")])
        if size:
            yield record_batch(schema, [[part], [first], [last], [size], [None], [None]])
        yield record_batch(schema, [*[pa.nulls(len(ids), pa.int64())] * 4, pa.array(ids), pa.array(best)])

    counted = partial.where("pair_keys is not null").select("pair_keys", "pair_counts").mapInArrow(rows, "key long, n long")
    ordered = counted.repartitionByRange(parallel(spark), "key").sortWithinPartitions("key")
    return folder, *write_table(ordered.mapInArrow(shard, "part long, first long, last long, n long, b long, best long"), "pair-shards")


class CountShards:
    """Looks up counts of packed pairs in the shards of ``write_counts``: (first, last, n, part) of each,
    in order. Shards on a mounted file system are mapped into memory; of others one at a time is read."""

    def __init__(self, folder: str, shards: list[tuple[int, int, int, int]]):
        self.folder, self.shards = folder, shards
        self.lasts = np.array([s[1] for s in shards], np.int64)
        self.open: dict[int, list[np.ndarray]] = {}

    def _arrays(self, k: int) -> list[np.ndarray]:
        if k not in self.open:
            from pyarrow import fs

            system, inner = opened(self.folder)
            n, part = self.shards[k][2:]
            names = [f"{inner}/{part}.{x}" for x in ("keys", "counts")]
            if isinstance(system, fs.LocalFileSystem):
                self.open[k] = [np.memmap(x, "<i8", "r", shape=(n,)) for x in names]
            else:
                self.open = {k: [np.frombuffer(system.open_input_file(x).read(), "<i8") for x in names]}
        return self.open[k]

    def counts(self, keys: np.ndarray) -> np.ndarray:
        """Counts of sorted distinct keys, each of which is in a shard."""
        out = np.zeros(len(keys), np.int64)
        owner = np.searchsorted(self.lasts, keys)
        for k in np.unique(owner).tolist():
            mine = slice(*np.searchsorted(owner, [k, k + 1]))
            held, counts = self._arrays(k)
            out[mine] = counts[np.searchsorted(held, keys[mine])]
        return out


def align_tokens(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """Aligns the tokens of two tokenizers in every whole text, and says how common its links are.

    ``a_path`` is a byte-level BPE of the tokenizers library, which gets a space and the text;
    ``b_path`` a file of the sentencepiece library, which puts that space itself. Strings of special
    tokens are plain text. Returns one row a document: doc_id, n_a, n_b (tokens), n_groups, n_links,
    n_best (links whose pair is as common as any of its second id), count_sum (over the links, how many
    links of the corpus have the same pair), groups_sha256 (of the groups as text) and links (binary,
    64-bit packed pairs).

    Null and empty texts, and those whose tokens of either side don't join to the bytes of the text and
    its space (such as texts with U+2581), have no tokens: zeros and an empty groups_sha256. Very long
    texts are aligned whole, repeated rows each by themselves and counted each; rows with a null doc_id
    take part; ties for the best pair are all best; other columns are ignored; an empty table gives no
    rows.
    """
    spark = docs.sparkSession
    table, _ = write_table(links_of(docs, a_path, b_path), "aligned")
    folder, found, path = write_counts(table)
    shards = sorted((r["first"], r["last"], r["n"], r["part"]) for r in found.where("part is not null").collect())  # a row a shard
    top = found.where("b is not null").groupBy("b").agg(F.max("best").alias("best")).toArrow()  # at most the vocabulary
    best = np.zeros(max(top.column("b").to_pylist(), default=0) + 1, np.int64)
    best[top.column("b").to_numpy()] = top.column("best").to_numpy()
    drop_path(spark, path)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = CountShards(folder, shards)
        for batch in slices(batches, "links", 2 << 20):
            links = columns(batch, "links")[0]
            keys, at = np.unique(np.frombuffer(b"".join(links), "<i8"), return_inverse=True)
            counts = table.counts(keys)
            ends = np.cumsum([len(x) // 8 for x in links])
            sums = [np.diff(np.append(0, np.append(0, np.cumsum(x[at]))[ends])) for x in ((counts == best[keys & 0xFFFFFFFF]).astype(np.int64), counts)]
            names = ["doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "links"]
            doc_id, n_a, n_b, n_groups, sha, raw = (batch.column(batch.schema.get_field_index(x)) for x in names)
            n_links = pa.array(np.diff(np.append(0, ends)), pa.int64())
            values = [doc_id, n_a, n_b, n_groups, n_links, *[pa.array(x) for x in sums], sha, raw]
            yield pa.RecordBatch.from_arrays(values, names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "links"])
        trim()

    rows = table.where("pair_keys is null").select("doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "links")
    return rows.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string, links binary")

"""Token ids: tokenizing whole texts, and a compact binary file format for the ids.

File format: Parquet shards (so that any Hadoop file system and Spark's commit protocol serve),
one row a document, in ascending doc_id order over all shards: doc_id, shard, start_in_shard,
n_tokens, control, data. Ids are replaced by their rank (0: the most frequent id of the corpus, ties
to the smaller id) and ranks coded in 1 to 4 bytes: ``data`` holds the bytes, little-endian,
``control`` two bits a rank for its number of bytes less one, four ranks a control byte, the first
in the lowest bits. ``ranks.parquet`` beside the shards maps ranks to ids.
"""

from __future__ import annotations

import json
import os
import re
import uuid
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pulselake.llm.common import claim, columns, doc_hash, drop_path, parallel, raw_bytes, record_batch, scratch_root, slices, trim, utf8, write_table

#: Entries kept in a worker's cache of encoded pieces, and the longest piece kept.
CACHE_PIECES, CACHE_CHARS = 150_000, 40

#: A space or line break that doesn't stand alone before another character, and other white space.
_RUN = re.compile(r" (?:\s|\Z)|\n(?:\s|\Z)|\s\n")
_OTHER_SPACE = re.compile(r"[^\S \n]")

#: Marks that are cut from a word before them (but for apostrophes, which begin endings like 's).
_MARKS = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum() and chr(c) != "'")

#: By byte: 0 in printable ASCII without the apostrophe, 1 in other Latin letters (below U+0240), else 2.
_KINDS = np.array([0 if 33 <= b < 127 and b != 39 else 1 if 128 <= b < 0xC9 else 2 for b in range(256)], np.uint8)

_ENCODERS: dict[str, "PieceEncoder"] = {}

#: Characters that stand for the 256 bytes in vocabularies of this kind: printable ones for themselves,
#: the others, in order, for those from 256 on.
_PRINTABLE = {*range(33, 127), *range(161, 173), *range(174, 256)}
_BYTE_CHARS = np.array([b if b in _PRINTABLE else 256 + sum(x not in _PRINTABLE for x in range(b)) for b in range(256)], "<u4")


def _byte_chars(text: str) -> str:
    return _BYTE_CHARS[np.frombuffer(text.encode(), np.uint8)].tobytes().decode("utf-32-le")


_SPACE, _BREAK, _NO_BREAK = _byte_chars(" "), _byte_chars("\n"), _byte_chars("\xa0")


def _kind(c: str) -> int:
    return 1 if c.isalpha() else 2 if c.isdigit() else 3


def keeps_apart(settings: dict) -> bool:
    """Whether the merges of a byte-level BPE (its settings as a dictionary) never join letters, digits
    and other ASCII characters with one another, nor anything with a space or line break before it.
    Then such pieces have the same ids with the usual pre-tokenizer and without any."""
    cut, model = settings.get("pre_tokenizer") or {}, settings.get("model") or {}
    if cut.get("type") != "ByteLevel" or not cut.get("use_regex") or cut.get("add_prefix_space") or settings.get("normalizer") or model.get("type") != "BPE" or any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix")):
        return False
    for merge in model["merges"]:
        token = "".join(merge if isinstance(merge, list) else merge.split(" "))
        if _NO_BREAK in token or "'" in token:  # not in pieces that are encoded without a pre-tokenizer
            continue
        core = token.lstrip(_SPACE)
        if _SPACE in core or (_BREAK in token and token.strip(_BREAK)):
            return False
        if core.isascii() and len({_kind(c) for c in core}) > 1:
            return False
    return True


class PieceEncoder:
    """Encodes texts with a byte-level BPE of the tokenizers library, remembering pieces.

    These tokenizers cut a text before each space or line break that stands alone before another
    character, and a word from marks after it, so these pieces encode alone as they do in the text.
    A text with other white space next to a space or line break, or with the string of a special
    token, is encoded whole. New pieces are encoded as lines of one text, which saves much of the
    cost of small calls; where ``keeps_apart`` holds, plain ones go without the pre-tokenizer, which
    takes half of the time. Known pieces are an Arrow table and their ids one array, 2 bytes an id, or 4
    for vocabularies above 65,536: no piece that is known becomes an object of Python.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        settings = json.loads(self.tokenizer.to_str())
        self.special = [t["content"] for t in settings.get("added_tokens", [])]
        self.code = "H" if self.tokenizer.get_vocab_size() <= 1 << 16 else "I"
        self.line = self.tokenizer.encode("\n", add_special_tokens=False).ids
        self.bare = len(self.line) == 1 and keeps_apart(settings)
        self.cut = self.tokenizer.pre_tokenizer
        self.table = pa.array([], pa.string())  # pieces by the line break and what follows, or by what follows a space
        self.ids, self.sizes = np.zeros(0, self.code), np.zeros(0, np.int64)

    @classmethod
    def at(cls, path: str) -> "PieceEncoder":
        if path not in _ENCODERS:
            _ENCODERS[path] = cls(path)
        return _ENCODERS[path]

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [array(self.code, e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _lines(self, words: list[str], before: str, bare: bool) -> list[bytes]:
        """Ids of each word with ``before`` before it, encoded as lines of one text."""
        out = []
        if bare:
            self.tokenizer.pre_tokenizer = None
        for at in range(0, len(words), 64):
            part = words[at : at + 64]
            text = before + ("\n" + before).join(part)
            ids = np.array(self.tokenizer.encode_batch_fast([_byte_chars(text) if bare else text], add_special_tokens=False)[0].ids, self.code)
            ends = (np.append(np.flatnonzero(ids == self.line[0]), len(ids)) * ids.itemsize).tolist()
            if len(ends) != len(part):
                raise ValueError("this tokenizer doesn't cut at line breaks")
            raw, start = ids.tobytes(), 0
            for end in ends:
                out.append(raw[start:end])
                start = end + ids.itemsize
        if bare:
            self.tokenizer.pre_tokenizer = self.cut
        return out

    def _new(self, pieces: list[str]) -> list[bytes]:
        """Ids of pieces that aren't known yet."""
        known, marked = {}, []
        fast: dict[bool, list[str]] = {False: [], True: []}  # whether they begin with a line break
        rest: dict[bool, list[str]] = {False: [], True: []}
        cores = set()
        for p in pieces:
            broken = p[0] == "\n"
            if p.isascii() and self.bare and "'" not in p and (p[1:] if broken else p).isprintable():
                fast[broken].append(p)
                continue
            core = p.rstrip(_MARKS)
            word = core[1:] if broken else core
            if not word.isalpha():
                rest[broken].append(p)
                continue
            if len(core) < len(p):
                marked.append((p, core, p[len(core) :]))
                if core in known or core in cores:
                    continue
            if core not in cores:
                cores.add(core)
                (fast if self.bare and max(word) < "\u0250" else rest)[broken].append(core)
        line = array(self.code, self.line).tobytes()
        for group, bare in ((fast, True), (rest, False)):
            plain = [p for p in group[False] if bare or not p[-1].isspace()] if len(self.line) == 1 else []
            known.update(zip(plain, self._lines(plain, " ", bare), strict=True))
            broken = [p for p in group[True] if bare or not p[-1].isspace()] if len(self.line) == 1 else []
            known.update(zip(broken, [line + ids for ids in self._lines([p[1:] for p in broken], "", bare)], strict=True))
        left = [p for p in [*rest[False], *rest[True]] if p not in known]
        known.update(zip(left, self._whole([p if p[0] == "\n" else " " + p for p in left]), strict=True))
        marks = list({m for _, _, m in marked})
        ids = dict(zip(marks, self._whole(marks), strict=True))
        known.update((p, known[core] + ids[m]) for p, core, m in marked)
        return [known[p] for p in pieces]

    def _plain(self, pieces: pa.Array) -> np.ndarray:
        """Which pieces are printable ASCII without apostrophes, or Latin letters, so that ``_bare`` takes them."""
        size = pc.binary_length(pieces).to_numpy()
        if not self.bare or not len(size):
            return np.zeros(len(size), bool)
        kind = np.maximum.reduceat(np.append(_KINDS[raw_bytes(pieces)], np.uint8(0)), np.cumsum(size, dtype=np.int64) - size)
        return (size > 0) & ((kind == 0) | ((kind == 1) & np.asarray(pc.utf8_is_alpha(pieces).to_numpy(zero_copy_only=False), bool)))

    def _bare(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of plain pieces after a space, one after another, and their numbers: as lines of 64, without the
        pre-tokenizer."""
        n = len(pieces)
        if not n:
            return np.zeros(0, self.code), np.zeros(0, np.int64)
        lines = pc.binary_join(pa.ListArray.from_arrays(pa.array([*range(0, n, 64), n], pa.int32()), pieces), "\n ")
        self.tokenizer.pre_tokenizer = None
        try:
            found = self.tokenizer.encode_batch_fast([_byte_chars(f" {t}") for t in lines.to_pylist()], add_special_tokens=False)
        finally:
            self.tokenizer.pre_tokenizer = self.cut
        ids = np.concatenate([np.array([*e.ids, *self.line], self.code) for e in found])
        ends = np.flatnonzero(ids == self.line[0])
        if len(ends) != n:
            raise ValueError("this tokenizer doesn't cut at line breaks")
        return ids[ids != self.line[0]], np.diff(ends, prepend=-1) - 1

    def _add(self, pieces: pa.Array, ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Places of pieces that come to the table."""
        at = len(self.table) + np.arange(len(pieces))
        if len(pieces):
            self.table = pa.concat_arrays([self.table, pieces])
            self.ids, self.sizes = np.concatenate([self.ids, ids]), np.concatenate([self.sizes, sizes])
        return at

    def _keep(self, at: np.ndarray) -> None:
        """Only these places of the table stay."""
        self.ids = _gathered(self.ids, self.sizes, at)
        self.table, self.sizes = self.table.take(pa.array(at)), self.sizes[at]

    def _learn(self, pieces: pa.Array) -> np.ndarray:
        """Places of distinct pieces that weren't in the table. Marks after a word are encoded apart from it."""
        out = np.empty(len(pieces), np.int64)
        cores = pc.utf8_rtrim(pieces, characters=_MARKS)
        plain = self._plain(cores)
        rest = pieces.filter(pa.array(~plain))
        found = self._new(rest.to_pylist())
        out[~plain] = self._add(rest, np.frombuffer(b"".join(found), self.code), np.fromiter(map(len, found), np.int64, len(found)) // self.ids.itemsize)
        words, coded = pieces.filter(pa.array(plain)), cores.filter(pa.array(plain)).dictionary_encode()
        at = pc.fill_null(pc.index_in(coded.dictionary, value_set=self.table), -1).to_numpy().astype(np.int64)
        fresh = coded.dictionary.filter(pa.array(at < 0))
        at[at < 0] = self._add(fresh, *self._bare(fresh))
        at = at[coded.indices.to_numpy()]
        more = pc.binary_length(words).to_numpy() - pc.binary_length(cores.filter(pa.array(plain))).to_numpy()
        marked = np.flatnonzero(more)
        words = words.take(pa.array(marked))
        marks = [p[-n:] for p, n in zip(words.to_pylist(), more[marked].tolist(), strict=True)]
        index = {m: i for i, m in enumerate(dict.fromkeys(marks))}
        found = self._whole(list(index))
        source = np.concatenate([self.ids, np.frombuffer(b"".join(found), self.code)])
        sizes = np.concatenate([self.sizes, np.fromiter(map(len, found), np.int64, len(found)) // self.ids.itemsize])
        parts = np.stack([at[marked], len(self.sizes) + np.fromiter(map(index.__getitem__, marks), np.int64, len(marks))], 1).ravel()
        at[marked] = self._add(words, _gathered(source, sizes, parts), sizes[parts].reshape(-1, 2).sum(1))
        out[plain] = at
        return out

    def _places(self, pieces: pa.Array) -> np.ndarray:
        """Places of distinct pieces in the table."""
        at = pc.fill_null(pc.index_in(pieces, value_set=self.table), -1).to_numpy().astype(np.int64)
        new = at < 0
        if len(self.table) + new.sum() > CACHE_PIECES:  # what this batch has stays
            self._keep(at[~new])
            at[~new] = np.arange(len(at) - new.sum())
        at[new] = self._learn(pieces.filter(pa.array(new)))
        return at

    def encode(self, texts: list[str]) -> list[bytes]:
        apart = [_has_runs(t) or any(s in t for s in self.special) for t in texts]
        whole = iter(self._whole([t for t, x in zip(texts, apart, strict=True) if x]))
        cut = iter(self._pieces([t for t, x in zip(texts, apart, strict=True) if not x]))
        return [next(whole if x else cut) for x in apart]

    def _pieces(self, texts: list[str]) -> list[bytes]:
        """Ids of texts that are cut into pieces: each distinct piece is looked up once, the first one of a
        text, which no space precedes, is encoded for itself."""
        if not texts:
            return []
        split = pc.split_pattern(pa.array([t.replace("\n", " \n") for t in texts], pa.string()), " ")
        at = split.offsets.to_numpy()
        distinct = split.values.dictionary_encode()
        which, pieces = distinct.indices.to_numpy().astype(np.int64), distinct.dictionary
        heads = self._whole(pieces.take(pa.array(which[at[:-1]])).to_pylist())
        inner = np.ones(len(which), bool)
        inner[at[:-1]] = False
        used = np.zeros(len(pieces), bool)
        used[which[inner]] = True
        place = np.zeros(len(pieces), np.int64)
        place[used] = self._places(pieces.filter(pa.array(used)))
        which[inner] = place[which[inner]]
        which[~inner] = len(self.sizes) + np.arange(len(texts))
        source = np.concatenate([self.ids, np.frombuffer(b"".join(heads), self.code)])
        sizes = np.concatenate([self.sizes, np.fromiter(map(len, heads), np.int64, len(heads)) // source.itemsize])
        out = _gathered(source, sizes, which).tobytes()
        cuts = [0, *(np.cumsum(sizes[which])[at[1:] - 1] * source.itemsize).tolist()]
        short = pc.less_equal(pc.utf8_length(self.table), CACHE_CHARS).to_numpy(zero_copy_only=False)
        if not short.all():
            self._keep(np.flatnonzero(short))
        return [out[a:b] for a, b in zip(cuts, cuts[1:])]  # noqa: B905


def _gathered(ids: np.ndarray, sizes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Ids of the pieces at these places, one after another."""
    n = sizes[at]
    ends = np.cumsum(n)
    return ids[np.repeat((np.cumsum(sizes) - sizes)[at] - (ends - n), n) + np.arange(n.sum())]


def _has_runs(text: str) -> bool:
    """Whether ``_RUN`` is found, which most texts tell without it."""
    return "  " in text or "\n\n" in text or " \n" in text or "\n " in text or text[-1:].isspace() or (_OTHER_SPACE.search(text) is not None and _RUN.search(text) is not None)


def tokenize(docs: DataFrame, tokenizer: str, end_id: int = 0, counts: bool = False) -> DataFrame:
    """Ids of every whole text and ``end_id`` after them: doc_id, text_hash, n_tokens, ids (binary,
    little-endian, 2 or 4 bytes an id by the size of the vocabulary). Null text: only ``end_id``.
    ``tokenizer`` is the path of a file of the tokenizers library, on every machine.

    With ``counts`` there is a column id_counts too, null for documents, and a task ends with a row
    that holds nothing else: how often it saw each id, as 64-bit numbers from id 0 on.
    """
    src = docs.select("doc_id", doc_hash().alias("text_hash"), utf8().alias("text"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim(_ENCODERS)
        encoder = PieceEncoder.at(tokenizer)
        end = array(encoder.code, [end_id]).tobytes()
        total, schema = np.zeros(0, np.int64), None
        for batch in slices(batches, "text", 2 << 20):
            ids = [b + end for b in encoder.encode([t.decode("utf-8", "replace") for t in columns(batch, "text")[0]])]
            fields = [batch.schema.field(0), batch.schema.field(1), pa.field("n_tokens", pa.int64()), pa.field("ids", pa.binary())]
            schema = pa.schema([*fields, pa.field("id_counts", pa.binary())] if counts else fields)
            values = [batch.column(0), batch.column(1), [len(b) // len(end) for b in ids], ids]
            if counts:
                got = np.bincount(np.frombuffer(b"".join(ids), encoder.code), minlength=len(total))
                got[: len(total)] += total
                total = got
                values.append(pa.nulls(len(ids), pa.binary()))
            yield record_batch(schema, values)
        if len(total):
            yield record_batch(schema, [pa.nulls(1, schema.field(0).type), *[[None]] * 3, [total.astype("<i8").tobytes()]])
        trim()

    ddl = f"doc_id {src.schema['doc_id'].dataType.simpleString()}, text_hash long, n_tokens long, ids binary"
    return src.mapInArrow(run, ddl + ", id_counts binary" if counts else ddl)


def as_ids(ids: bytes | np.ndarray, n: int) -> np.ndarray:
    """Ids of a document, or of several, with ``n`` of them."""
    return np.frombuffer(ids, "<u2" if len(ids) == 2 * n else "<u4")


def id_counts(tokenized: DataFrame) -> DataFrame:
    """Occurrences of every id over all documents (a table of ``tokenize`` with its counts): id, n."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in columns(batch, "id_counts")[0]:
                total = np.frombuffer(raw, "<i8")
                seen = np.flatnonzero(total)
                yield record_batch(pa.schema([("id", pa.int64()), ("n", pa.int64())]), [pa.array(seen), pa.array(total[seen])])

    return tokenized.where("id_counts is not null").select("id_counts").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


# --- byte-aligned code with separate control bytes ---

_SHIFTS = np.array([1, 4, 16, 64], np.uint8)
#: By control byte: bytes of each of its four values.
WIDTHS = np.array([[(c >> 2 * i & 3) + 1 for i in range(4)] for c in range(256)], np.uint8)


def _padded(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each value stands if every document begins a control byte; and the documents' starts."""
    starts = np.concatenate([[0], np.cumsum(-(-lengths // 4) * 4)])
    shift = starts[:-1] - (np.cumsum(lengths) - lengths)
    return np.repeat(shift, lengths) + np.arange(lengths.sum()), starts


def encode_values(values: np.ndarray, lengths: np.ndarray) -> tuple[list[bytes], list[bytes]]:
    """Control and data bytes of documents whose values (unsigned, below 2**32) lie one after another."""
    v = np.ascontiguousarray(values, "<u2" if values.max(initial=0) < 1 << 16 else "<u4")
    code = (v > 0xFF).astype(np.uint8)
    if v.itemsize == 4:
        code += (v > 0xFFFF).astype(np.uint8) + (v > 0xFFFFFF)
    data = v.view(np.uint8).reshape(-1, v.itemsize)[np.arange(v.itemsize, dtype=np.uint8) <= code[:, None]].tobytes()
    place, starts = _padded(lengths)
    padded = np.zeros(starts[-1], np.uint8)
    padded[place] = code
    control = (padded.reshape(-1, 4) * _SHIFTS).sum(1, dtype=np.uint8).tobytes()
    bounds = np.concatenate([[0], np.cumsum(lengths)])
    more = np.concatenate([[0], np.cumsum(code, dtype=np.int64)])
    ends = (bounds + more[bounds]).tolist()
    cuts = (starts // 4).tolist()
    return [control[a:b] for a, b in zip(cuts, cuts[1:])], [data[a:b] for a, b in zip(ends, ends[1:])]  # noqa: B905


def decode_values(control: np.ndarray, data: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The values of documents (uint8 in, uint32 out), one after another: widths by table lookup, then
    a gather for each byte of a value."""
    place, starts = _padded(lengths)
    if 4 * len(control) != starts[-1]:
        raise ValueError("control bytes and lengths don't agree")
    widths = WIDTHS[control].ravel()[place]
    ends = np.cumsum(widths, dtype=np.int64)
    if (ends[-1] if len(ends) else 0) != len(data):
        raise ValueError("control and data bytes don't agree")
    at = ends - widths
    out = data[at].astype(np.uint32)
    for i in range(1, int(widths.max(initial=0))):
        more = np.flatnonzero(widths > i)
        out[more] |= data[at[more] + i].astype(np.uint32) << np.uint32(8 * i)
    return out


def write_token_files(docs: DataFrame, tokenizer: str, path: str | None = None, end_id: int = 0) -> str:
    """Tokenizes all documents and writes the file format above; returns the folder.

    Texts are tokenized once, into a scratch table that is dropped afterwards; the same pass counts
    ids. They are coded after the sort: sampling for its range partitions then reads keys alone, where it
    would code all documents a second time. The order is
    doc_id (null last), then text hash; range partitions split a doc_id that many rows repeat.
    """
    spark = docs.sparkSession
    path = path or f"{scratch_root(spark)}/token-files-{uuid.uuid4().hex}"
    tokenized, temp = write_table(tokenize(docs, tokenizer, end_id, counts=True).withColumn("row_id", F.monotonically_increasing_id()), "tokenized")
    counts = id_counts(tokenized).orderBy(F.desc("n"), "id").select("id").toPandas()["id"].to_numpy(np.int64)  # at most the vocabulary
    rank_of = np.zeros(int(counts.max(initial=0)) + 1, np.uint16 if len(counts) <= 1 << 16 else np.uint32)
    rank_of[counts] = np.arange(len(counts))
    id_type = tokenized.schema["doc_id"].dataType.simpleString()

    def code(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, start = TaskContext.get().partitionId(), 0
        for batch in slices(batches, "ids", 1 << 20):
            n = batch.column(1).to_numpy()
            ends = start + np.cumsum(n)
            control, data = encode_values(rank_of[as_ids(raw_bytes(batch.column(2)), int(n.sum()))], n)
            schema = pa.schema([batch.schema.field(0), pa.field("shard", pa.int64()), pa.field("start_in_shard", pa.int64()), batch.schema.field(1), pa.field("control", pa.binary()), pa.field("data", pa.binary())])
            yield record_batch(schema, [batch.column(0), pa.array(np.full(len(n), shard)), pa.array(ends - n), batch.column(1), control, data])
            start = int(ends[-1])

    order = [F.col("doc_id").asc_nulls_last(), F.col("text_hash"), F.col("row_id")]
    rows = tokenized.where("id_counts is null").select("doc_id", "text_hash", "row_id", "n_tokens", "ids")
    placed = rows.repartitionByRange(parallel(spark), *order).sortWithinPartitions(*order).select("doc_id", "n_tokens", "ids")
    placed.mapInArrow(code, f"doc_id {id_type}, shard long, start_in_shard long, n_tokens long, control binary, data binary").write.option("compression", "none").parquet(f"{path}/shards.parquet")
    ranks = spark.createDataFrame([(i, int(x)) for i, x in enumerate(counts)], "rank long, id long")
    ranks.coalesce(1).write.parquet(f"{path}/ranks.parquet")
    drop_path(spark, temp)
    return path


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """Documents of a folder of token files: doc_id, start (ids of all documents before it),
    n_tokens, ids (binary, uint32 little-endian)."""
    shards = spark.read.parquet(f"{path}/shards.parquet")
    ranks = spark.read.parquet(f"{path}/ranks.parquet").orderBy("rank").toPandas()["id"].to_numpy(np.uint32)  # at most the vocabulary
    sizes = shards.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    before = sizes.select("shard", F.coalesce(F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    offsets = {r["shard"]: r["before"] for r in before.collect()}  # a number for each shard

    def decode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "data", 1 << 20):
            shard, start = columns(batch, "shard", "start_in_shard")
            n = batch.column(3).to_numpy()
            values = ranks[decode_values(raw_bytes(batch.column(4)), raw_bytes(batch.column(5)), n)]
            ids = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(np.concatenate([[0], 4 * np.cumsum(n)]).astype(np.int32)), pa.py_buffer(values)])
            schema = pa.schema([batch.schema.field(0), pa.field("start", pa.int64()), pa.field("n_tokens", pa.int64()), pa.field("ids", pa.binary())])
            yield record_batch(schema, [batch.column(0), [offsets[s] + x for s, x in zip(shard, start, strict=True)], batch.column(3), ids])

    return shards.mapInArrow(decode, f"doc_id {shards.schema['doc_id'].dataType.simpleString()}, start long, n_tokens long, ids binary")


def round_trip(docs: DataFrame, tokenizer: str, end_id: int = 0) -> DataFrame:
    """Writes token files of all documents and reads them back: see the two functions above.

    Null and empty texts hold ``end_id`` alone; very long ones are one row; rows with a null doc_id come last; repeated rows each
    keep their ids; other columns are ignored; an empty table gives no rows.
    """
    return read_token_files(docs.sparkSession, write_token_files(docs, tokenizer, end_id=end_id))

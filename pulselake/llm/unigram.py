"""Token counts by a count-only Viterbi search over a unigram vocabulary.

An Aho-Corasick automaton enumerates the pieces that end at each character; of the ways to get there
only the best score and its number of tokens are carried, so no segmentation is kept or traced back.
Results are those of the Unigram model of the tokenizers library over the same pieces, with spaces as
``▁`` and one before the text:

- a way replaces an earlier one of the same end only if its score is higher: of ties, the longest last
  piece stays;
- a character that is no piece costs 10 more than the worst piece; runs of them are one token, or with
  byte fallback one for each UTF-8 byte.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulselake.llm.common import claim, columns, record_batch, slices, trim, utf8

SPACE = "▁"

#: What a character that is no piece costs beyond the worst piece (a fixed value of the tokenizer).
UNKNOWN_COST = 10.0

#: Words kept in a worker's cache.
CACHE_WORDS = 400_000

_UNITS = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")
_LOADED: dict[str, "Unigram"] = {}


class Unigram:
    """Counts tokens of texts; ``pieces`` are (piece, score), all of which text can match."""

    def __init__(self, pieces: list[tuple[str, float]], byte_fallback: bool = False):
        self.automaton = ahocorasick.Automaton()
        for piece, score in dict(pieces).items():
            if piece:
                self.automaton.add_word(piece, (len(piece), float(score)))
        self.automaton.make_automaton()
        known = {p for p, _ in pieces}
        self.bytes = byte_fallback
        if byte_fallback and not all(f"<0x{b:02X}>" in known for b in range(256)):
            raise ValueError("byte fallback needs a piece for each byte")
        self.unknown = min((s for _, s in pieces), default=0.0) - UNKNOWN_COST
        # Every way goes through a cut before each run of spaces if no piece reaches over one. With
        # whole, negative scores sums over words are exact, so words can be searched one by one.
        over = any(SPACE in p.lstrip(SPACE) for p in known)
        self.by_word = SPACE in known and not over and all(s <= 0 and s == int(s) for _, s in pieces)
        self.words = _Words(self)

    @classmethod
    def of_piece_file(cls, path: str) -> "Unigram":
        """Pieces and scores of a file of the sentencepiece library, with byte fallback."""
        if path not in _LOADED:
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            _LOADED[path] = cls([(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())], byte_fallback=True)
        return _LOADED[path]

    def best(self, text: str) -> tuple[float, int]:
        """(score, tokens) of the best way through a text in which spaces are ``▁``."""
        n = len(text)
        score, count = [0.0] * (n + 1), [0] * (n + 1)
        unknown = bytearray(n + 1)  # whether the best way to here ends in an unknown character
        done = 0
        for end, (length, s) in self._matches(text):
            end += 1
            while done < end:  # ends without an own single piece are settled first
                if done and not self._single:
                    self._take_unknown(text, done, score, count, unknown)
                done += 1
                score[done] = -float("inf")
                self._single = False
            at = score[end - length] + s
            if at > score[end]:
                score[end], count[end] = at, count[end - length] + 1
                unknown[end] = 0
            self._single = self._single or length == 1
        if done and not self._single:
            self._take_unknown(text, done, score, count, unknown)
        return score[n], count[n]

    _single = True

    def _matches(self, text: str) -> Iterator[tuple[int, tuple[int, float]]]:
        """Matches by end, the longest first; an end without any gets a match that never wins."""
        last = -1
        for end, match in self.automaton.iter(text):
            for e in range(last + 1, end):
                yield e, (0, -float("inf"))
            last = end
            yield end, match
        for e in range(last + 1, len(text)):
            yield e, (0, -float("inf"))

    def _take_unknown(self, text: str, end: int, score: list, count: list, unknown: bytearray) -> None:
        at = score[end - 1] + self.unknown
        if at > score[end]:
            tokens = len(text[end - 1].encode("utf-8", "surrogatepass")) if self.bytes else 1 - unknown[end - 1]
            score[end], count[end] = at, count[end - 1] + tokens
            unknown[end] = 1

    def count(self, text: str) -> tuple[float, int]:
        """(score, tokens) of a whole text as it is."""
        if not text:
            return 0.0, 0
        text = text.replace(" ", SPACE)
        if not text.startswith(SPACE):
            text = SPACE + text
        if not self.by_word:
            return self.best(text)
        packed = sum(map(self.words.__getitem__, text.split(SPACE)[1:])) if SPACE * 2 not in text else sum(map(self.words.unit, _UNITS.findall(text)))
        return -float(packed >> 32), packed & 0xFFFFFFFF


class _Words(dict):
    """Word (after one space) to ``-score << 32 | tokens``, for a bounded number of words."""

    def __init__(self, model: Unigram):
        self.model = model

    def unit(self, text: str) -> int:
        score, tokens = self.model.best(text)
        return -int(score) << 32 | tokens

    def __missing__(self, word: str) -> int:
        value = self.unit(SPACE + word)
        if len(self) >= CACHE_WORDS:
            self.clear()
        if len(word) <= 40:
            self[word] = value
        return value


def count_tokens(docs: DataFrame, piece_file: str) -> DataFrame:
    """Tokens of every whole text: doc_id, text_hash, n_tokens and score (of the best segmentation).

    ``piece_file`` is the path of a vocabulary of the sentencepiece library, on every machine; its
    pieces and scores are taken as a unigram model. One pass without a shuffle.

    Null and empty texts have no tokens and score 0; very long ones are counted whole. Repeated rows each give a row; other columns are
    ignored; an empty table gives no rows.
    """
    src = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), utf8().alias("text"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Unigram.of_piece_file(piece_file)
        claim(model.words)
        for batch in slices(batches, "text"):
            got = [model.count(t.decode("utf-8", "replace")) for t in columns(batch, "text")[0]]
            schema = pa.schema([batch.schema.field(0), batch.schema.field(1), pa.field("n_tokens", pa.int64()), pa.field("score", pa.float64())])
            yield record_batch(schema, [batch.column(0), batch.column(1), [n for _, n in got], [s for s, _ in got]])
        trim()

    return src.mapInArrow(run, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, text_hash long, n_tokens long, score double")

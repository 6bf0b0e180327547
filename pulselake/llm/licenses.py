"""License scans by template-markup matching.

A template is wording with ``<<optional>> ... <<end>>`` regions (may nest) and ``<<var:lo-hi>>``
regions that any ``lo`` to ``hi`` words replace. It is compiled into a token automaton; a text is
accepted where the mandatory wording matches exactly, word for word. An automaton only runs on
texts that hold the template's longest mandatory run of words (on all texts where it has none).
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from pulselake.llm.common import columns, record_batch, slices, utf8

#: Base phrases and their labels.
BASE_PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

#: Label and template wording (lower case, words only).
TEMPLATES = [
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("apache-2.0-notice", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license <<optional>>you may obtain a copy of the license at <<var:1-10>><<end>> unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"),
    ("gpl-3.0", "licensed under the <<optional>>terms of the<<end>> gnu general public license <<optional>>gpl<<end>> version 3 <<optional>>or <<optional>>at your option<<end>> any later version<<end>>"),
    ("gpl-notice", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation <<optional>>either<<end>> version <<var:1-2>> of the license <<optional>>or at your option any later version<<end>>"),
    ("mit-release", "<<optional>>released<<end>> under the <<optional>>terms of the<<end>> mit license"),
    ("mit-text", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions"),
    ("cc-by-4.0", "<<optional>>licensed under<<end>> cc by 4 0"),
    ("cc-by-sa", "<<optional>>licensed under<<end>> cc by sa <<var:1-1>> 0"),
    ("cc-by-nc", "<<optional>>licensed under<<end>> cc by nc <<var:1-1>> 0"),
    ("cc-text", "creative commons attribution <<optional>>noncommercial<<end>> <<optional>>sharealike<<end>> <<var:1-1>> 0 <<optional>>international<<end>> <<optional>>public<<end>> license"),
    ("bsd-3-clause", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met <<var:0-140>> neither the name of <<var:1-12>> nor the names of <<optional>>its<<end>> contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
]

#: What separates words: every ASCII character but letters and digits.
_SPACE = bytes(c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.lower().translate(_SPACE).split()


@dataclass(frozen=True)
class Automaton:
    """``arcs[s]``: (word or None for any word, next state). Closures over empty moves are done."""

    label: str
    arcs: tuple[tuple[tuple[bytes | None, int], ...], ...]
    final: frozenset[int]
    required: bytes

    def longest(self, words: list[bytes], start: int) -> int:
        """End of the longest match from ``start``, or -1."""
        states, at, end = {0}, start, -1
        while states:
            if states & self.final:
                end = at
            if at >= len(words):
                break
            w = words[at]
            states = {t for s in states for a, t in self.arcs[s] if a is None or a == w}
            at += 1
        return end

    def spans(self, words: list[bytes], joined: bytes) -> Iterator[tuple[int, int]]:
        if self.required not in joined:
            return
        first = {a for a, _ in self.arcs[0]}
        reach = 0
        for i, w in enumerate(words):
            if i >= reach and (w in first or None in first) and (end := self.longest(words, i)) > i:
                yield i, end
                reach = end


def compile_template(label: str, markup: str) -> Automaton:
    """The token automaton of one template."""
    tokens = re.findall(r"<<[^>]*>>|[^\s<]+", markup)
    arcs: list[list[tuple[bytes | None, int]]] = [[]]
    skips: list[tuple[int, int]] = []
    opened: list[int] = []
    run, best, here = [], [], 0

    def step(symbol: bytes | None) -> None:
        nonlocal here
        arcs.append([])
        arcs[here].append((symbol, len(arcs) - 1))
        here = len(arcs) - 1

    for tok in tokens:
        if tok == "<<optional>>":
            opened.append(here)
        elif tok == "<<end>>":
            skips.append((opened.pop(), here))
        elif m := re.fullmatch(r"<<var:(\d+)-(\d+)>>", tok):
            lo, hi = int(m[1]), int(m[2])
            ends = []
            for i in range(hi):
                if i >= lo:
                    ends.append(here)
                step(None)
            skips += [(e, here) for e in ends]
        elif tok.startswith("<<"):
            raise ValueError(f"unknown markup {tok}")
        else:
            step(tok.encode())
        if tok.startswith("<<") or opened:
            run = []
        else:
            run.append(tok.encode())
            best = max(best, run.copy(), key=len)
    if opened:
        raise ValueError(f"{label}: an optional region is not ended")
    close = [{s} for s in range(len(arcs))]
    for a, b in sorted(skips, reverse=True):  # targets lie behind, so one pass is enough
        close[a] |= close[b]
    for s in range(len(arcs) - 1, -1, -1):
        close[s] = set().union(*(close[t] for t in close[s] if t > s), close[s])
    full = tuple(tuple(x for t in sorted(close[s]) for x in arcs[t]) for s in range(len(arcs)))
    return Automaton(label, full, frozenset(s for s in range(len(arcs)) if here in close[s]), b" " + b" ".join(best) + b" " if best else b"")


def places(phrase: bytes, joined: bytes) -> list[int]:
    """First words of all places of a phrase; ``joined`` has a space before and after each word."""
    found, key, at = [], b" " + phrase + b" ", -1
    spaces = last = 0
    while (at := joined.find(key, at + 1)) >= 0:
        spaces += joined.count(b" ", last, at)
        last = at
        found.append(spaces)
    return found


_OUT = pa.schema([("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("spans", pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("n_words", pa.int64())])))])


def scan_text(text: bytes, phrases: dict[str, str], automata: list[Automaton]) -> tuple:
    """One text's row of ``scan_licenses`` (without its id)."""
    words = words_of(text)
    joined = b" " + b" ".join(words) + b" "
    spans, starts, base = [], [], set()
    for phrase, label in phrases.items():
        at = places(phrase.encode(), joined)
        if at:
            base.add(label)
            starts += at
            spans += [(label, i, phrase.count(" ") + 1) for i in at]
    labels = set(base)
    for a in automata:
        for i, j in a.spans(words, joined):
            labels.add(a.label)
            spans.append((a.label, i, j - i))
    covered = to = 0
    for _, i, n in sorted(spans, key=lambda s: s[1]):
        covered += max(0, i + n - max(to, i))
        to = max(to, i + n)
    spans = [{"label": s, "start": i, "n_words": n} for s, i, n in sorted(spans, key=lambda s: (s[1], s[0]))]
    return len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), covered / len(words) if words else 0.0, spans


def scan_licenses(docs: DataFrame, phrases: dict[str, str] | None = None, templates: Iterable[tuple[str, str]] | None = None) -> DataFrame:
    """License wording of every whole text.

    Returns doc_id, n_words, n_base (places of base phrases), first_word and last_word (their
    smallest and largest start), base_labels, labels (base ones and those of accepted templates;
    distinct, sorted, comma-joined), score (share of the words that lie in license wording) and
    spans (label, start, n_words). One pass without a shuffle.

    Null or empty text: no words, empty labels, null first_word and last_word, score 0. Very long texts
    are read whole. Repeated rows each give a row; other columns are ignored; an empty table gives no rows.
    """
    phrases = BASE_PHRASES if phrases is None else phrases
    automata = [compile_template(*t) for t in (TEMPLATES if templates is None else templates)]

    src = docs.select("doc_id", utf8().alias("text"))
    schema = src.schema["doc_id"].dataType.simpleString()

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            ids, texts = batch.column(0), columns(batch, "text")[0]
            rows = [scan_text(t, phrases, automata) for t in texts]
            out = pa.schema([pa.field("doc_id", ids.type), *_OUT])
            yield record_batch(out, [ids, *zip(*rows, strict=True)])

    return src.mapInArrow(scan, f"doc_id {schema}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,start:long,n_words:long>>")

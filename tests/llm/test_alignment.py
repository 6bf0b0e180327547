import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pulselake.llm import alignment
from tests.llm.edges import no_documents, odd_documents

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def brute(texts):
    """By the tokenizers themselves, byte by byte."""
    import sentencepiece

    a_model, b_model = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a_model.encode_special_tokens = True
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in printable]
    chars = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}
    rows, counts = [], Counter()
    for text in texts:
        links, groups, a, b = [], "", [], []
        if text:
            a = [(t, bytes(chars[c] for c in a_model.id_to_token(t))) for t in a_model.encode(" " + text, add_special_tokens=False).ids]
            b = [(t, bytes([int(p[3:5], 16)]) if b_model.is_byte(t) else p.replace("▁", " ").encode()) for t in b_model.encode(text) for p in [b_model.id_to_piece(t)]]
            if not b"".join(x for _, x in a) == b"".join(x for _, x in b) == (" " + text).encode():
                a, b = [], []
        ends = []
        for side in (a, b):
            at, found = 0, {}
            for t, x in side:
                at += len(x)
                found[at] = t
            ends.append(found)
        common = sorted(ends[0].keys() & ends[1].keys())
        links = [(ends[0][e], ends[1][e]) for e in common]
        counts.update(links)
        parts, before = [], 0
        for e in common:
            parts.append("|".join(",".join(str(t) for at, t in side.items() if before < at <= e) for side in ends))
            before = e
        groups = hashlib.sha256(";".join(parts).encode()).hexdigest() if parts else ""
        rows.append((len(a), len(b), links, groups))
    best = {}
    for (_, y), n in counts.items():
        best[y] = max(best.get(y, 0), n)
    return [(n_a, n_b, len(links), len(links), sum(counts[x] == best[x[1]] for x in links), sum(counts[x] for x in links), sha) for n_a, n_b, links, sha in rows]


def found(docs):
    return [tuple(r)[1:-1] for r in sorted(alignment.align_tokens(docs, A, B).collect(), key=lambda r: r.doc_id)]


def texts_of(seed, n=120):
    rng = random.Random(seed)
    words = ["the", "The", "of", "token", "don't", "naïve", "漢字", "🙂", "á", "x\ty", "\n", "\n\n", "", "", "<|endoftext|>", "<s>", "<0x41>", "1234", "$5.00", "ﬁ", " ", "loooong" * 9, "]);", "▁" if n > 100 else "_"]
    return [" ".join(rng.choices(words, k=rng.randrange(1, 60))) for _ in range(n)]


def test_against_tokenizers(spark):
    texts = [None, "", " ", "  ", "a", " a", "a ", "a  b", "\n", "<|endoftext|>", "a<|endoftext|>b", "</s>", "▁", "x▁y", *texts_of(1), *texts_of(2, 60), "same text", "same text"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    assert found(docs) == brute(texts)


def test_counts_in_many_shards_and_flushes(spark, monkeypatch):
    monkeypatch.setattr(alignment, "PARTIAL_PAIRS", 20)
    texts = texts_of(3, 90) * 2
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    folder, rows, _ = alignment.write_counts(alignment.links_of(docs, A, B))
    shards = sorted((r["first"], r["last"], r["n"], r["part"]) for r in rows.where("part is not null").collect())
    assert len(shards) > 1 and all(x[1] < y[0] for x, y in zip(shards, shards[1:]))  # noqa: B905
    table = alignment.CountShards(folder, shards)
    keys = np.concatenate([table._arrays(k)[0] for k in range(len(shards))])
    assert (np.diff(keys) > 0).all()
    assert table.counts(keys).sum() == sum(r[3] for r in brute(texts))
    assert found(docs) == brute(texts)


def test_words_align_as_in_texts(monkeypatch):
    monkeypatch.setattr(alignment, "CACHE_WORDS", 20)
    for seed in range(4):
        texts, both = texts_of(seed), alignment.Aligner(A, B)
        assert both.by_word
        got = both.align(texts)
        assert [x for t, x in zip(texts, got, strict=True) if t] == both.whole([t for t in texts if t])
        assert all(x is None for t, x in zip(texts, got, strict=True) if not t)


def test_texts_are_aligned_whole_where_pieces_reach_over_spaces(monkeypatch):
    import sentencepiece

    own = sentencepiece.SentencePieceProcessor.id_to_piece
    monkeypatch.setattr(sentencepiece.SentencePieceProcessor, "id_to_piece", lambda self, i: "▁of▁the" if i == 300 else own(self, i))
    both = alignment.Aligner(A, B)
    assert not both.by_word and both.align(["a b", "", "c"]) == [both.whole(["a b"])[0], None, both.whole(["c"])[0]]


def test_odd_documents(spark):
    docs = odd_documents(spark)
    got = alignment.align_tokens(docs, A, B)
    assert got.count() == docs.count()
    rows = {r.doc_id: r for r in got.where("doc_id is not null").collect()}
    assert tuple(rows[0])[1:] == tuple(rows[1])[1:] == (0, 0, 0, 0, 0, 0, "", b"")
    assert tuple(rows[8])[1:] == tuple(rows[9])[1:] and rows[6].n_links > 10_000
    assert alignment.align_tokens(no_documents(spark), A, B).collect() == []
    assert alignment.align_tokens(docs.withColumn("text", F.lit(None).cast("string")), A, B).agg(F.sum("n_a")).first()[0] == 0

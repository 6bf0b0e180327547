import random
from collections import defaultdict

import pytest
import xxhash

from pulselake.llm import simhash
from tests.llm.edges import no_documents, odd_documents


def brute_fingerprint(text):
    words = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).encode().split()
    parts = [words[i : i + 3] for i in range(len(words) - 2)] if len(words) >= 3 else [words] if words else []
    hashes = [xxhash.xxh64_intdigest(b" ".join(p), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def brute_components(values, bits):
    """value to smallest value reachable."""
    values = sorted(set(values))
    root = {v: v for v in values}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for i, a in enumerate(values):
        for b in values[i + 1 :]:
            if (a ^ b).bit_count() <= bits:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {v: find(v) for v in values}


def signed(v):
    return v - (1 << 64) if v >= 1 << 63 else v


def planted(rng, n, flips):
    out = set()
    for _ in range(n):
        base = rng.getrandbits(64)
        out.add(base)
        for _ in range(rng.randrange(6)):
            v = base
            for _ in range(rng.randrange(flips + 2)):
                v ^= 1 << rng.randrange(64)
            out.add(v)
    return sorted(out)


@pytest.mark.parametrize("large", [1000, 2])
def test_links_at_two_bits_connect_what_brute_force_does(spark, large):
    values = planted(random.Random(4), 60, 2)
    df = spark.createDataFrame([(signed(v),) for v in values], "fp long")
    got = {(a % 2**64, b % 2**64) for a, b in simhash.link_fingerprints(df, 2, 5, large).collect()}
    assert all((a ^ b).bit_count() <= 2 for a, b in got)
    if large == 1000:
        assert {tuple(sorted(p)) for p in got} == {(a, b) for i, a in enumerate(values) for b in values[i + 1 :] if (a ^ b).bit_count() <= 2}
    assert joined(values, got) == brute_components(values, 2)


def joined(values, links):
    root = {v: v for v in values}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for a, b in links:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    return {v: find(v) for v in values}


def test_documents_match_brute_force(spark):
    rng = random.Random(6)
    vocabulary = [f"w{i}" for i in range(400)]
    texts = []
    for _ in range(30):
        words = [rng.choice(vocabulary) for _ in range(120)]
        texts.append(" ".join(words))
        words[rng.randrange(120)] = "changed"
        texts += [" ".join(words)] * rng.randrange(3)
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    got = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    prints = {i: brute_fingerprint(t) for i, t in rows}
    comp = brute_components(prints.values(), 2)
    least = defaultdict(lambda: 1 << 60)
    for i, f in prints.items():
        least[comp[f]] = min(least[comp[f]], i)
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got} == {i: (f"{f:016x}", least[comp[f]]) for i, f in prints.items()}
    assert len(got) == len(rows)


def test_odd_documents(spark):
    docs = odd_documents(spark)
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == docs.count()
    empty = [r for r in got if r.fingerprint == "0" * 16]
    assert {r.doc_id for r in empty} == {0, 1, 2, None} and {r.component_id for r in empty} == {0}
    kept = simhash.keep_one(docs, max_bits=2, shingle=3)
    assert kept.columns == docs.columns
    ids = sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in kept.collect())
    assert (False, 9, "same text here again " * 20) not in ids and (False, 8, "same text here again " * 20) in ids
    assert len([x for x in ids if x[1] == 3]) == 2  # one of the repeated rows, and the other text of that id
    assert simhash.near_duplicates(no_documents(spark)).collect() == []
    assert simhash.keep_one(no_documents(spark)).collect() == []


def test_clashing_columns_are_kept(spark):
    rows = [(1, "a b c d", "x", "y", "z"), (2, "a b c d", "x", "y", "z"), (3, "other words here now", None, "y", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, _th string, kept_id string, Kept_Hash string")
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns and sorted(map(tuple, kept.collect())) == [rows[0], rows[2]]


def test_too_many_bits_are_refused(spark):
    with pytest.raises(ValueError):
        simhash.near_duplicates(spark.createDataFrame([(1, "a")], "doc_id long, text string"), max_bits=4)

import random

import pytest

import corpus_pipeline
from pulselake.llm import components, hyperminhash, nearcopies, simhash
from tests.llm.edges import no_documents, odd_documents


def jaccard(a, b):
    x, y = ({tuple(t.lower().split()[i : i + 5]) for i in range(max(1, len(t.split()) - 4))} for t in (a, b))
    return len(x & y) / len(x | y)


def brute_groups(texts):
    """Index of each text to the smallest index reachable through similarities of 0.8 and more."""
    root = list(range(len(texts)))

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for i, a in enumerate(texts):
        for j in range(i):
            if jaccard(a, texts[j]) >= 0.8:
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return [find(i) for i in range(len(texts))]


def changed(rng, words, n):
    out = list(words)
    for i in rng.sample(range(len(out)), n):
        out[i] = f"new{rng.randrange(10**6)}"
    return out


@pytest.mark.parametrize("large", [1000, 3])
def test_groups_match_brute_force(spark, large):
    rng = random.Random(12)
    texts = []
    for _ in range(12):
        base = [f"v{rng.randrange(2000)}" for _ in range(rng.choice([30, 80, 200]))]
        last = base
        for _ in range(8):
            texts.append(" ".join(last))
            last = changed(rng, rng.choice([base, last]), max(1, round(rng.choice([0.01, 0.02, 0.03]) * len(base))))
    rng.shuffle(texts)
    got = {r.doc_id: r.root for r in nearcopies.near_copies(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), large).collect()}
    want = brute_groups(texts)
    assert 12 < len(set(want)) < len(texts)
    assert len(set(zip(want, (got[i] for i in range(len(texts))), strict=True))) == len(set(want)) == len(set(got.values()))


def test_stage_finds_all_at_a_similarity_of_four_fifths_and_nothing_below(spark):
    rng = random.Random(13)
    rows, want = [], []
    for i in range(150):
        words = [f"v{rng.randrange(3000)}" for _ in range(200)]
        other = changed(rng, words, 4)
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(other))]
        want += [2 * i] if jaccard(*(" ".join(x) for x in (words, other))) >= 0.8 else [2 * i, 2 * i + 1]
    words = [f"same{i}" for i in range(60)]
    rows += [(1000, " ".join(words)), (1001, " ".join(reversed(words)))]  # equal words in another order
    kept = corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
    assert sorted(r.doc_id for r in kept.collect()) == [*want, 1000, 1001]


def test_fingerprint_links_alone_join_close_copies(spark, monkeypatch):
    """Round 0 is SimHash with pigeonring chains, each link checked by whole sets; without any band it must
    join texts whose fingerprints are at most two bits apart, and only those that are similar too."""
    rng = random.Random(14)
    texts = []
    for _ in range(25):
        words = [f"v{rng.randrange(3000)}" for _ in range(400)]
        texts += [" ".join(words), " ".join(changed(rng, words, 1)), " ".join(changed(rng, words, 2))]
    texts += ["a b c d e f", "a b c d e f a b c d e f a b c d e f a b c d e f"]  # not similar by sets
    prints = [simhash.fingerprint(t.encode()) for t in texts]
    want = {(i, j) for i in range(len(texts)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 2 and jaccard(texts[i], texts[j]) >= 0.8}
    assert len(want) > 15
    monkeypatch.setattr(hyperminhash, "candidates", lambda *_: None)
    got = {r.doc_id: r.root for r in nearcopies.near_copies(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert all(got[i] == got[j] for i, j in want) and got[75] != got[76]
    assert all(got[i] != got[j] for i in range(len(texts)) for j in range(i) if i // 3 != j // 3)


def test_small_link_tables_take_few_tasks(spark):
    """Each round of components shuffles several times: tasks grow with the links, not with the session's setting."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 60)
    try:
        rows = [(i, i + 1) for i in range(50)] + [(100, 101)]
        found = components.connected_components(spark.createDataFrame(rows, "a long, b long").repartition(60, "a"))
        assert found.rdd.getNumPartitions() < 60
        assert {r.node: r.root for r in found.collect()} == {**{i: 0 for i in range(51)}, 100: 100, 101: 100}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_odd_documents(spark):
    docs = odd_documents(spark)
    assert len(nearcopies.near_copies(docs).collect()) == docs.count()
    kept = nearcopies.keep_one(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert ids.count(0) == 1 and not {1, 2, 9} & set(ids) and ids.count(8) == 1 and ids.count(3) == 2 and ids.count(None) == 1
    assert nearcopies.keep_one(no_documents(spark)).collect() == []

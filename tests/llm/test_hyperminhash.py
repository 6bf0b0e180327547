import random

import duckdb
import numpy as np
import pytest

from pulselake.llm import hyperminhash, queries
from tests.llm.edges import no_documents, odd_documents
from tests.llm.test_nearcopies import changed


def shingle_set(text, k):
    words = (text or "").translate({i: i + 32 for i in range(65, 91)}).split()
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def brute(rows, k=4):
    """(doc_id, n_shingles, component_id, kept) by comparing all pairs."""
    sets = [shingle_set(t, k) for _, t in rows]
    root = list(range(len(rows)))

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    return sorted((d, len(s), least[find(i)], d == least[find(i)]) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True)))


def found(spark, rows):
    return sorted(tuple(r) for r in hyperminhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect())


def families(seed, n=14, each=8):
    rng = random.Random(seed)
    rows = []
    for _ in range(n):
        base = last = [f"v{rng.randrange(2000)}" for _ in range(rng.choice([4, 9, 30, 80, 300, 900]))]
        for _ in range(each):
            rows.append(" ".join(last))
            last = changed(rng, rng.choice([base, last]), max(1, round(rng.choice([0.01, 0.03]) * len(base))))
    rng.shuffle(rows)
    return [*enumerate([*rows, None, "", " \n", "one", "One", "two words", "a b c", "a b c d", "a b c d e"])]


@pytest.mark.parametrize("large", [24, 2])
def test_against_all_pairs(spark, monkeypatch, large):
    monkeypatch.setattr(hyperminhash.near_groups, "__defaults__", (large,))
    rows = families(1)
    want = brute(rows)
    assert 20 < sum(r[3] for r in want) < len(want) - 20
    assert found(spark, rows) == want


def passages(rng, n, pool=16, length=40, picked=8):
    texts = [" ".join(f"p{i}w{j}" for j in range(length)) for i in range(pool)]
    return [" ".join(rng.sample(texts, picked)) for _ in range(n)]


def test_texts_of_common_passages_make_few_pairs(spark):
    """Boilerplate in all of them, few links: pairs that are compared stay few for each text."""
    rng = random.Random(5)
    compared = []
    for n in (500, 2000):
        texts = passages(rng, n)
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        groups = hyperminhash._Groups(docs, 5)
        groups.add(hyperminhash.candidates(groups.rooted(), hyperminhash.FIRST, 1)[0])
        pairs, _ = hyperminhash.candidates(groups.rooted(), hyperminhash.ALL, hyperminhash.LARGE)
        compared.append((pairs.count() / n, hyperminhash.estimated(pairs, groups.classes).count() / n))
    assert compared[1][0] < 60 and compared[1][1] < 4  # of 2000 others; of which 0.5 % are just below the bound


def test_large_keys_with_few_links(spark):
    """Every text has most of a common passage: keys are large, links few, and none is lost."""
    rng = random.Random(6)
    common = [f"c{i}" for i in range(130)]
    rows = []
    for i in range(150):
        own = [f"x{rng.randrange(10**6)}" for _ in range(rng.choice([20, 30, 45]))]
        rows.append(" ".join(common + own))
        if i % 10 == 0:
            rows.append(" ".join(common + own[:-2] + ["other", "end"]))
    rows = [*enumerate(rows)]
    assert found(spark, rows) == brute(rows)


def test_estimates():
    rng = np.random.default_rng(2)
    for n in (3, 50, 500, 5000):
        for share in (0.3, 0.8, 0.95):
            common = rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2)
            more = [rng.integers(0, 1 << 63, max(1, round(n * (1 - share) / 2 / share)), dtype=np.uint64) * np.uint64(2) for _ in range(2)]
            a, b = (np.unique(np.append(common, m)) for m in more)
            true = n / (len(a) + len(b) - n)
            ra, rb = (hyperminhash.registers(x)[None] for x in (a, b))
            by_chance = hyperminhash.chance(np.array([len(a)]), np.array([len(b)]))[0]
            assert 0 <= by_chance < 0.002
            estimate = ((ra == rb).mean() - by_chance) / (1 - by_chance)
            assert abs(estimate - true) < 5 * np.sqrt(true * (1 - true) / min(n, 512)) + 0.02
            if true >= 0.8:
                assert hyperminhash.may_link(ra, rb, np.array([len(a)]), np.array([len(b)]))[0]
    a, b = (hyperminhash.registers(np.unique(rng.integers(0, 1 << 63, 4000, dtype=np.uint64) * np.uint64(2)))[None] for _ in range(2))
    assert not hyperminhash.may_link(a, b, np.array([4000]), np.array([4000]))[0]


def test_bands_find_pairs_at_the_bound():
    rng = np.random.default_rng(3)
    missed = {hyperminhash.ALL: 0, hyperminhash.STRONG: 0}
    for i in range(600):
        n = (8, 40, 200, 900)[i % 4]
        common = rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2)
        a, b = (hyperminhash.registers(np.unique(np.append(common, rng.integers(0, 1 << 63, n // 8, dtype=np.uint64))))[None] for _ in range(2))
        for bands in missed:
            missed[bands] += not (hyperminhash.band_keys(a, bands) == hyperminhash.band_keys(b, bands)).any()
    assert missed[hyperminhash.ALL] == 0 and missed[hyperminhash.STRONG] <= 1


def test_odd_documents(spark):
    docs = odd_documents(spark)
    got = hyperminhash.near_duplicates(docs).collect()
    assert len(got) == docs.count()
    by_id = {}
    for r in got:
        by_id.setdefault(r.doc_id, []).append(tuple(r)[1:])
    assert by_id[0] == by_id[1] == by_id[2] or [by_id[i] for i in range(3)] == [[(0, i, True)] for i in range(3)]
    assert [by_id[i][0][1:] for i in (8, 9)] == [(8, True), (8, False)]
    assert sorted(by_id[None]) == [(0, None, True), (1, None, True)]
    assert hyperminhash.near_duplicates(no_documents(spark)).collect() == []


def test_sql_agrees_with_brute_force():
    rows = families(3, 8, 5)
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", rows)
    assert sorted(con.execute(queries.OP11_SQL).fetchall()) == brute(rows)

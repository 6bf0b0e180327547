import numpy as np

from pulselake.llm import mtree


def brute(rows, k, step):
    """rows: (id, ints); exact results by query row."""
    good = [(n, i, v) for n, (i, v) in enumerate(rows) if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for n, i, v in good:
        if i % step == 0:
            q = [int(np.floor(256 * x)) for x in v]
            scored = sorted((-sum(a * int(np.floor(256 * b)) for a, b in zip(q, w)), j) for m, j, w in good if m != n and len(w) == len(v))
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scored[:k])]
    return sorted(out)


def search(spark, rows, k=5, step=7, extra=False):
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<float>, score int, v int")
    found = mtree.top_k(df, f"id % {step} = 0", k=k)
    assert found.columns == ["query_id", "rank", "vec_id", "score"]
    return sorted(map(tuple, found.collect()))


def test_matches_brute_force_with_copies_and_ties(spark, monkeypatch):
    monkeypatch.setattr(mtree, "TREE_ROWS", 40)
    rng = np.random.default_rng(1)
    rows = [(i, rng.integers(-3, 4, 5).astype(float).tolist()) for i in range(300)]
    rows += [(300 + i, [1.0, 2.0, 0.0, 0.0, 1.0]) for i in range(60)]
    assert search(spark, rows) == brute(rows, 5, 7)


def test_real_vectors(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=16).astype(np.float32).astype(float).tolist()) for i in range(500)]
    assert search(spark, rows, k=3, step=11) == brute(rows, 3, 11)


def test_nulls_other_lengths_repeated_ids_and_few_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (0, [1.0, 2.0]), (7, [0.0, 0.0]), (1, None), (14, [None, 1.0]), (2, [nan, 1.0]), (21, [inf, 1.0]), (None, [1.0, 1.0]), (28, [1.0, 2.0, 3.0]), (35, [])]
    assert search(spark, rows) == brute(rows, 5, 7)
    assert search(spark, []) == []


def test_large_components_are_exact(spark):
    rows = [(i, [float(2**20 + i), float(-(2**20)), 3.0]) for i in range(20)]
    assert search(spark, rows) == brute(rows, 5, 7)


def test_pruning_avoids_pages():
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(30, 8)) * 1000
    x = (centres[rng.integers(0, 30, 3000)] + rng.normal(size=(3000, 8))).astype(np.int32)
    largest = int((x.astype(np.int64) ** 2).sum(1).max())
    fields, order = mtree.Tree.build(x, largest)
    tree, best, opened = mtree.Tree(*fields), mtree.Best(x[:5], largest, 4), []
    add = best.add
    best.add = lambda rows, scores, ids, refs: (opened.append(scores.size), add(rows, scores, ids, refs))
    mtree.search(tree, best, order, list(order))
    assert sum(opened) < 5 * 3000 / 2
    for q, got in enumerate(best.found):
        scores = x.astype(np.int64) @ x[q].astype(np.int64)
        want = sorted((-int(s), i) for i, s in enumerate(scores))[:4]
        assert [f[:2] for f in got] == want


def test_directory_leaves_few_trees_and_loses_none():
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(40, 8))
    centres = centres / np.sqrt((centres**2).sum(1))[:, None] * 5000
    groups = [(c + rng.normal(size=(100, 8))).astype(np.int32) for c in centres]
    largest = max(int((g.astype(np.int64) ** 2).sum(1).max()) for g in groups)
    fields = [mtree.Tree.build(g, largest)[0] for g in groups]
    trees = [mtree.Tree(*f) for f in fields]
    roots, radii = np.stack([t.pivots[0] for t in trees]), np.array([t.radius[0] for t in trees])
    queries = np.stack([g[0] for g in groups])
    scores = np.stack([queries.astype(np.int64) @ g.astype(np.int64).T for g in groups], 1)  # query, tree, entry
    first = mtree.Best(queries, largest, 5).root_distances(roots).argmin(1)
    kth = np.sort(scores[np.arange(40), first], 1)[:, -5]
    need = mtree.Best(queries, largest, 5, kth).needed(roots, radii)
    assert need.sum() < 40 * 40 / 4
    assert (scores.max(2)[~need] < np.broadcast_to(kth[:, None], (40, 40))[~need]).all()
    assert mtree.Best(queries, largest, 5).needed(roots, radii).all()


def test_directory_in_pages_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(mtree, "TREE_ROWS", 10)
    monkeypatch.setattr(mtree, "DIRECTORY_ROWS", 4)
    monkeypatch.setattr(mtree, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(mtree, "BLOCK_QUERIES", 6)
    rng = np.random.default_rng(6)
    rows = [(i, rng.integers(-3, 4, 3 + i % 2).astype(float).tolist()) for i in range(260)]
    assert search(spark, rows) == brute(rows, 5, 7)

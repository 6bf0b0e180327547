"""Matching of beats against walking through a whole record."""

import random

import pytest

from pulselake.operators import annotations as ann
from pulselake.operators import beats


def walked(refs, tests, window):
    """Pairs of places, by looking at every test beat for every reference beat."""
    out, start, last = {}, 0, None
    for i, r in enumerate(refs):
        left = range(start, len(tests))
        if not left:
            break
        own = min(left, key=lambda k: (abs(tests[k] - r), k))
        lost = False
        if i + 1 < len(refs):
            rival = min(left, key=lambda k: (abs(tests[k] - refs[i + 1]), k))
            lost = rival == own and abs(refs[i + 1] - tests[own]) < abs(r - tests[own])
        if lost:
            own = own - 1 if own > 0 and own - 1 != last else None
        last = None
        if own is not None:
            if abs(tests[own] - r) < window:
                out[i] = last = own
            start = own + 1
    return out


def pairs(refs, tests, window):
    return sorted((refs[i], tests[k]) for i, k in walked(refs, tests, window).items())


@pytest.mark.parametrize("spread", [15, 40, 90, 400])
def test_clusters_decide_as_whole_records_do(spark, monkeypatch, spread):
    monkeypatch.setattr(ann, "BLOCK", 500)
    rng = random.Random(spread)
    refs, tests, want = [], [], []
    for record in range(150):
        span = range(rng.randrange(5, 40) * spread)
        own = [sorted(rng.sample(span, rng.randrange(0, 30))), sorted(rng.choices(span, k=rng.randrange(0, 30)))]
        refs += [(record, s) for s in own[0]] + [(record, s) for s in own[0][:1]]  # once more
        tests += [(record, s) for s in own[1]]
        want += [(record, *p) for p in pairs(*own, 36)]
    frames = [spark.createDataFrame(x + [(None, 5), (3, None)], "record int, sample long") for x in (refs, tests)]
    assert sorted(tuple(r) for r in beats.match_beats(*frames, 36).collect()) == sorted(want)
    found = {r.record: (r.tp, r.fp, r.fn) for r in beats.beat_statistics(*frames, 36).collect()}
    n = {k: sum(w[0] == k for w in want) for k in range(150)}
    assert found == {k: (n[k], sum(t[0] == k for t in tests) - n[k], len({r for r in refs if r[0] == k}) - n[k]) for k in {x[0] for x in refs + tests}}


@pytest.mark.parametrize(
    ("refs", "tests", "want"),
    [
        ([0, 50, 90, 130], [0, 80, 130], [(0, 0), (90, 80), (130, 130)]),
        ([0, 50, 110, 150], [0, 90, 120, 150], [(0, 0), (110, 120), (150, 150)]),
        ([0, 70, 130, 170], [0, 20, 110, 140, 170], [(0, 0), (130, 140), (170, 170)]),
        ([10, 40], [5, 30], [(10, 5), (40, 30)]),
        ([10, 30], [22], [(30, 22)]),
        ([20, 20], [20, 21], [(20, 20), (20, 21)]),
        ([], [5], []),
    ],
)
def test_contests(refs, tests, want):
    got = beats.contest(refs, tests, 36)
    assert sorted((r, tests[k]) for r, k in zip(refs, got, strict=True) if k is not None) == pairs(refs, tests, 36) == want

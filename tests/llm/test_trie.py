import hashlib
import random
import zlib
from collections import defaultdict

import duckdb
import pytest

from pulselake.llm import queries, trie

SCHEMA = "conv_id long, turn long, role string, text string, depth int, part string, total string, D1 int"


def brute(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(t)] for c, t in own.items()}
    made = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (abs(c) % 5) * (1 if c >= 0 else -1)
        made[c] = tuple(own.get(base, [])[:h]) + tuple(turns[h:])
    members = defaultdict(list)
    for c, turns in made.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    children = defaultdict(list)
    for n in members:
        if n:
            children[n[:-1]].append(n)
    out = []

    def below(n):
        todo = [n]
        while todo:
            x = todo.pop()
            yield x
            todo += children[x]

    for n, m in members.items():
        ends = sorted(c for c in m if made[c] == n)
        leaves, saved = 0, 0
        for x in below(n):
            leaves += not children[x]
            saved += (len(members[x]) - 1) * len(x[-1][1].encode()) if x else 0
        out.append((min(m), len(n), min(members[n[:-1]]) if n else None, len(m), len(children[n]), leaves, saved, hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return sorted(out, key=str)


def random_rows(seed, n_convs=60, longest=14):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(-20, 150), n_convs):
        for t in range(rng.randrange(1, longest)):
            rows.append((c, t if rng.random() < 0.95 else None, rng.choice(["user", "assistant", None]), rng.choice(["hi", "hi", "", None, "ça va", "more text here"])))
    return rows + rows[:5]


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", "y", 2) for r in rows], SCHEMA)


def found(df):
    return sorted((tuple(r)[:8] for r in df.collect()), key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    rows = random_rows(seed)
    want = brute(rows)
    assert found(trie.prefix_trie(table(spark, rows).repartition(5))) == want
    assert len({r[0] for r in want}) > 20


def test_long_conversations_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(trie, "BLOCK", 7)
    monkeypatch.setattr(trie, "IDS", 3)
    rng = random.Random(3)
    line = [("user" if i % 2 else "assistant", f"t{rng.randrange(3)}") for i in range(150)]
    rows = [(c, i, *x) for c in (5, 10, 15, 200) for i, x in enumerate(line[: 150 - c // 2])]
    rows += [(1000 + c, i, "user", "same") for c in range(40) for i in range(9)]
    assert found(trie.prefix_trie(table(spark, rows).repartition(6))) == brute(rows)


def test_turnless_null_and_empty(spark):
    absent = next(c for c in range(1, 1000) if c % 5 and zlib.crc32(str(c).encode()) % 9 >= 2)
    rows = [(absent, 0, "user", "gone"), (None, 0, "user", "no id"), (None, None, None, None)]
    got = found(trie.prefix_trie(table(spark, rows)))
    assert got == brute(rows) == [(absent, 0, None, 1, 0, 1, 0, hashlib.sha256(str(absent).encode()).hexdigest())]
    assert trie.prefix_trie(spark.createDataFrame([], SCHEMA)).collect() == []


def test_sql_agrees_with_brute_force(tmp_path):
    rows = [r for r in random_rows(4, 40, 6) if r[0] is not None]
    con = duckdb.connect()
    con.execute("create table conversations (conv_id bigint, turn bigint, role varchar, text varchar)")
    con.executemany("insert into conversations values (?, ?, ?, ?)", rows)
    assert sorted(con.execute(queries.OP12_SQL).fetchall(), key=str) == brute(rows)

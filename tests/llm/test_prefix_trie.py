"""The prefix trie against a trie built in plain Python."""

import hashlib
import random
import zlib

import pytest

from basketry.llm import prefix_trie as trie

SCHEMA = "conv_id long, turn long, role string, text string"


def said(row):
    role, text = row[2] or "", row[3] or ""
    return hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()


def rebuilt(rows):
    own = {}
    for row in rows:
        if row[0] is not None:
            own.setdefault(row[0], []).append(row)
    for turns in own.values():
        turns.sort(key=lambda r: (r[1] is not None, r[1] or 0, said(r)))
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        lender = c - (c % 100 if c >= 0 else -(-c % 100))
        out[c] = [(r[2] or "", r[3] or "") for r in own.get(lender, [])[:h] + turns[h:]]
    return out


def expected(rows):
    members, ends, own = {}, {}, {}
    for c, turns in rebuilt(rows).items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
        ends.setdefault(tuple(turns), []).append(c)
    children = {k: 0 for k in members}
    for k in members:
        if k:
            children[k[:-1]] += 1
    leaves, saved = {k: 0 for k in members}, {k: 0 for k in members}
    for k in members:
        own = (len(members[k]) - 1) * len(k[-1][1]) if k else 0
        for d in range(len(k) + 1):
            leaves[k[:d]] += children[k] == 0
            saved[k[:d]] += own
    return [
        (min(m), len(k), min(members[k[:-1]]) if k else None, len(m), children[k], leaves[k], saved[k],
         hashlib.sha256(",".join(map(str, sorted(ends.get(k, [])))).encode()).hexdigest())
        for k, m in members.items()
    ]


def order(row):
    return tuple((v is not None, v) for v in row)


def check(spark, rows, **settings):
    got = sorted((tuple(r) for r in trie.trie_report(spark.createDataFrame(rows, SCHEMA), **settings).collect()), key=order)
    assert got == sorted(expected(rows), key=order)


def random_rows(seed, convs=60, longest=9, words=2):
    draw = random.Random(seed)
    rows = []
    for c in draw.sample(range(-150, 350), convs):
        for t in range(draw.randrange(longest)):
            rows.append((c, draw.choice([t, t, t, None, 1]), draw.choice(["user", "bot", None]), draw.choice(["", None, "é" * 3, "text", "x" * 10][:words + 2])))
    return rows


CASES = {
    "empty": [],
    "no ids": [(None, 1, "user", "text")],
    "one turn": [(7, 0, "user", "text")],
    "equal turns": [(100, 0, "user", "a")] * 9 + [(101, 0, "user", "a")] * 9,
    "copies": [(100 + i, t, "user", f"turn {t}") for i in range(40) for t in range(6)],
    "turnless": [(c, 0, "user", "a") for c in range(101, 160)],
    "length decides": [(100, 0, "ab", "c"), (101, 0, "a", "bc"), (200, 0, "", "abc"), (201, 0, "abc", "")],
    "very long text": [(100 + i, t, "user", "ü" * 300_000 + str(t)) for i in range(3) for t in range(3)],
}


@pytest.mark.parametrize("name", CASES)
def test_nodes(spark, name):
    check(spark, CASES[name])


@pytest.mark.parametrize("seed,block,run", [(1, 4, 16), (2, 2, 2), (3, 3, 4), (4, 1, 16)])
def test_random_conversations(spark, seed, block, run):
    check(spark, random_rows(seed), block=block, run=run)


def test_conversations_longer_than_many_runs(spark):
    # 101 and 102 part in the middle of a block far down; 103 ends at the end of a run.
    rows = [(c, t, "user", "x" if t != at else f"y{c}") for c, n, at in ((101, 300, 201), (102, 300, 201), (103, 261, 999), (500, 70, 69)) for t in range(n)]
    check(spark, rows, block=4, run=4)


def test_long_lists_of_ids(spark, monkeypatch):
    monkeypatch.setattr(trie, "PIECE", 64)
    rows = [(bytes([i % 3]), i * 7919 % 1000) for i in range(1000)] + [(bytes([9, i]), i) for i in range(100)]
    got = {bytes(r.key): r.sha for r in trie.id_lists(spark.createDataFrame(rows, "key binary, id long").repartition(5)).collect()}
    want = {}
    for key, i in sorted(rows):
        want.setdefault(key, []).append(str(i))
    assert got == {k: hashlib.sha256(",".join(v).encode()).hexdigest() for k, v in want.items()}


def test_clashing_names(spark):
    rows = random_rows(6, 20)
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as CONV_ID", "2 as digest", "3 as place", "4 as `a.b``c`")
    got = sorted((tuple(r) for r in trie.trie_report(df).collect()), key=order)
    assert got == sorted(expected(rows), key=order)

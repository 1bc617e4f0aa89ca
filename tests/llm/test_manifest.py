"""The Merkle manifest against trees built in plain Python."""

import hashlib
import random
import zlib

import pytest

from basketry.llm import merkle
from basketry.llm._order import placed

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def tree(hashes):
    """The root and of each leaf its siblings (left, right), level by level."""
    proofs, under = [[] for _ in hashes], [[i] for i in range(len(hashes))]
    while len(hashes) > 1:
        above, below = [], []
        for at in range(0, len(hashes), 8):
            run = hashes[at : at + 8]
            for k in range(len(run)):
                for i in under[at + k]:
                    proofs[i].append(("".join(run[:k]), "".join(run[k + 1 :])))
            above.append(h("".join(run)))
            below.append(sum(under[at : at + 8], []))
        hashes, under = above, below
    return hashes[0], proofs


def expected(rows):
    groups = {}
    for row in rows:
        groups.setdefault(row[2], []).append(row)
    trees = []
    for lang in sorted(groups, key=lambda x: (x is not None, (x or "").encode())):
        members = sorted(groups[lang], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees.append((members, *tree([leaf(r) for r in members])))
    if not trees:
        return []
    root, over = tree([t[1] for t in trees])
    out = []
    for (members, subroot, proofs), rest in zip(trees, over):
        for row, proof in zip(members, proofs):
            other = row
            if row[0] is not None and row[4] is not None and zlib.crc32(str(row[0]).encode()) % 3 == 0:
                other = row[:4] + ("".join(c.lower() if "A" <= c <= "Z" else c for c in row[4]),)
            folded = leaf(other)
            for a, b in proof + rest:
                folded = h(a + folded + b)
            out.append((row[0], leaf(row), subroot, root, h("".join(a + b for a, b in proof + rest)), folded, folded == root))
    return out


def order(row):
    return tuple((v is not None, v) for v in row)


def result(spark, rows):
    return sorted((tuple(r) for r in merkle.manifest_report(spark.createDataFrame(rows, SCHEMA)).collect()), key=order)


CASES = {
    "empty": [],
    "one row": [(1, "a", "en", 3, "Abc")],
    "one full run": [(i, "a", "en", 3, "Abc") for i in range(8)],
    "nulls and equal rows": [(None, None, None, None, None)] * 20 + [(3, "a", None, 3, "AB")] * 3 + [(3, "b", "", 0, "")],
    "one language over three levels": [(i, "s", "x", i, "T") for i in range(513)] + [(3, "s", "y", 1, None)],
    "many languages of few": [(i % 7, "s", chr(97 + i % 13), i, f"T{i}") for i in range(120)],
    "bytes decide": [(1, "s", x, 1, "É" * 5000 + "A") for x in ("z", "é", "Z", "𝔸", "￿")],
}


@pytest.mark.parametrize("name", CASES)
def test_trees_and_proofs(spark, name):
    assert result(spark, CASES[name]) == sorted(expected(CASES[name]), key=order)


def test_random_tables(spark):
    draw = random.Random(5)
    rows = [
        (draw.choice([None, draw.randrange(40)]), draw.choice([None, "s"]), draw.choice([None, "en", "de", f"l{i}"]), draw.choice([None, 1]),
         draw.choice([None, "", "Ab", "ÄB c"]))
        for i in range(150)
    ]
    assert result(spark, rows) == sorted(expected(rows), key=order)


def test_only_a_change_of_the_text_is_noticed(spark):
    rows = [(i, "s", "en", 1, "UP" if i % 2 else "low") for i in range(60)]
    for doc_id, *_, verified in result(spark, rows):
        assert verified == (zlib.crc32(str(doc_id).encode()) % 3 != 0 or doc_id % 2 == 0)


def test_clashing_names(spark):
    rows = [(i, "s", "en", 1, "Text") for i in range(20)]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' as `TEXT`", "1 as part__", "2 as place", "3 as `a.b``c`", "4 as leaf")
    got = sorted((tuple(r) for r in merkle.manifest_report(df).collect()), key=order)
    assert got == sorted(expected(rows), key=order)


def test_places_of_equal_rows(spark):
    df = spark.range(0, 1000, 1, 7).selectExpr("id % 3 as k", "id as row")
    got = placed(df, ["k", "row"], "places").collect()
    assert [r.row for r in sorted(got, key=lambda r: r.place)] == sorted(range(1000), key=lambda i: (i % 3, i))
    assert sorted(r.place for r in got) == list(range(1000))

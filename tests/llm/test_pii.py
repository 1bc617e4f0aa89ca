"""Personal data: base spans against plain regular expressions, found ones against a naive bootstrap."""

import hashlib
import math
import random
import re
import time
from collections import Counter, defaultdict

import pytest

from basketry.llm import pii

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain(text):
    out = []
    for k, (kind, form) in enumerate(PLAIN.items()):
        for m in re.finditer(form, text):
            digits = [int(c) for c in m.group() if c.isdigit()]
            back = digits[::-1]
            luhn = sum(back[::2]) + sum(sum(divmod(2 * d, 10)) for d in back[1::2])
            if (
                kind == "email" or kind == "ip" and all(int(p) <= 255 for p in m.group().split("."))
                or kind == "card" and 16 <= len(digits) <= 19 and luhn % 10 == 0 or kind == "phone" and 8 <= len(digits) <= 15
            ):
                out.append((k, m.start(), m.end()))
    return out


def test_base_spans_are_those_of_the_plain_forms():
    draw = random.Random(1)
    bits = ["a", "@", ".", "1", "23", "-", " ", "+", "(", ")", "é", "4111111111111111", "255", "a@b.c", "\n", "0", "+49 30 1234567"]
    for _ in range(30000):
        text = "".join(draw.choices(bits, k=draw.randrange(14)))
        assert pii.base_spans(text) == plain(text), text


def test_time_is_linear_in_the_text():
    text = "a" * 2_000_000 + "@" + "1" * 2_000_000 + "." * 1000 + "+5" + "(" * 2_000_000 + ":" * 100_000 + "1 " * 500_000 + "@" * 100_000
    start = time.perf_counter()
    pii.wide_slots(text, pii.base_spans(text))
    assert time.perf_counter() - start < 20


def naive(rows, support=3, rounds=4, accept=0.8, doubt=1.0):
    """The bootstrap with dictionaries over whole texts."""
    slots, total = [], Counter()
    for r, (_, text) in enumerate(rows):
        text = text or ""
        words = [(m.start(), m.end(), m.group().encode().lower().decode() if m.group().isascii() else "".join(c.lower() if c.isascii() else c for c in m.group())) for m in re.finditer(r"[A-Za-z0-9\u0080-\U0010ffff]+", text)]
        for n in (2, 3):
            total.update(tuple(w for *_, w in words[i : i + n]) for i in range(len(words) - n + 1))
        base = plain(text)
        for kinds, a, b, known in [([k], a, b, True) for k, a, b in base] + [(*s, False) for s in pii.wide_slots(text, base)]:
            near = [w for _, end, w in words if end <= a]
            # A word that the span starts in counts up to the span.
            near += ["".join(c.lower() if c.isascii() else c for c in text[s:a]) for s, e, _ in words if s < a < e]
            ctx = [tuple(near[-n:]) if len(near) >= n else None for n in (2, 3)]
            for kind in kinds:
                slots.append((r, kind, a, b, pii._value(kinds[0], text[a:b]), known, *ctx))
    score = {(s[1], s[4]): 1.0 for s in slots if s[5]}
    values = defaultdict(set)
    for s in slots:
        for c in s[6:]:
            values[s[1], c].add(s[4])
    counted = {c for (_, c), v in values.items() if c and len(v) >= support}
    fresh = {}
    for _ in range(rounds):
        held, has = Counter(), defaultdict(set)
        for r, kind, a, b, value, known, *ctx in slots:
            # An identifier's score as a seed and as one found count apart.
            for kept, all_scores in ((score, True), (fresh, False)):
                if (kind, value) in kept:
                    for c in ctx:
                        if c in counted:
                            held[kind, c] += kept[kind, value]
                            if kept[kind, value] >= 0.5:
                                has[kind, c].add((value, all_scores))
        sure = {k: min(h / (total[k[1]] + doubt), 0.999) for k, h in held.items() if len(has[k]) >= support}
        led = defaultdict(dict)
        for r, kind, a, b, value, known, two, three in slots:
            best = max(sure.get((kind, two), 0.0), sure.get((kind, three), 0.0))
            if not known and best > 0:
                led[kind, value][two] = max(led[kind, value].get(two, 0.0), best)
        fresh = {k: 1 - math.exp(sum(math.log1p(-x) for x in v.values())) for k, v in led.items()}
    out = []
    for r, (doc_id, text) in enumerate(rows):
        base, found = plain(text or ""), {}
        for s in slots:
            if s[0] == r and not s[5] and fresh.get((s[1], s[4]), 0) >= accept:
                found.setdefault((s[2], s[3]), []).append((-fresh[s[1], s[4]], s[1]))
        spans = sorted(base + [(min(v)[1], a, b) for (a, b), v in found.items()])
        n = Counter(k for k, *_ in base)
        text_of = lambda x: ",".join(f"{pii.KINDS[k]}:{a}:{b}" for k, a, b in x)
        out.append((doc_id, *(n[k] for k in range(4)), hashlib.sha256(text_of(base).encode()).hexdigest(), text_of(spans), len(found)))
    return out


def order(row):
    return tuple((v is not None, v) for v in row)


def report(spark, rows, **settings):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return sorted((tuple(r) for r in pii.pii_report(df, **settings).collect()), key=order)


def corpus():
    draw = random.Random(3)
    words = "the of and house river blue stone water moon green".split()
    noise = lambda n=6: " ".join(draw.choices(words, k=n))
    rows = []
    for i in range(30):
        rows.append((i, f"{noise()}. Please call me at +1 ({i:03}) 555-{7000 + i} {noise()} and write to user{i}@mail.example.com {noise()}"))
    for i in range(6):  # found by contexts of the seeds
        rows.append((100 + i, f"{noise()} please call me at 0{i}11 555 {8000 + i} {noise()}, write to user{i} [at] mail [dot] example [dot] org {noise()}"))
        # a context that only found identifiers speak for
        rows.append((200 + i, f"{noise()} my old extension: 0{i}11 555 {8000 + i} {noise()}"))
    rows.append((300, f"{noise()} my old extension: 0123 555 9999 {noise()}"))
    for i in range(8):  # numbers that no context speaks for
        rows.append((400 + i, f"{noise()} of the {1234567 + i} {noise()}"))
    return rows


def test_found_by_contexts(spark):
    got = {r[0]: r for r in report(spark, corpus())}
    assert all(got[100 + i][-1] == 2 and "phone" in got[100 + i][-2] and "email" in got[100 + i][-2] for i in range(6))
    assert all(got[200 + i][-1] == 1 for i in range(6)) and got[300][-1] == 1
    assert all(got[400 + i][-1] == 0 and got[400 + i][-2] == "" for i in range(8))
    assert all(got[i][1:5] == (1, 0, 0, 1) and got[i][-1] == 0 for i in range(30))


@pytest.mark.parametrize("settings", [{}, {"rounds": 1}, {"support": 2, "accept": 0.6}])
def test_as_the_naive_bootstrap(spark, settings):
    rows = corpus()
    rows += [rows[3], rows[35], (None, rows[36][1]), (None, None), (7, ""), (8, "Ünique größe call me at 0999 555 1111" * 3), (9, "x" * 3000 + " call me at 0999 555 1112")]
    assert report(spark, rows, **settings) == sorted(naive(rows, **settings), key=order)


def test_empty_and_clashing_names(spark):
    assert report(spark, []) == []
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as TEXT", "2 as row", "3 as n", "4 as `a.b``c`", "5 as kind")
    assert sorted((tuple(r) for r in pii.pii_report(df).collect()), key=order) == report(spark, rows)

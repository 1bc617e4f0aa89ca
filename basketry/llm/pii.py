"""Personal data in texts: plain forms by fixed patterns, further forms by contexts learned from these."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.llm._order import pick
from basketry.llm._text import WORD, hashes, mix, runs, shingles, tokens
from basketry.llm.ngram_join import id_filter
from basketry.session import materialize

KINDS = ("email", "ip", "card", "phone")
EMAIL, IP, CARD, PHONE = range(4)

# Fixed forms of the base spans. An e-mail address is looked for around its @, so that no text takes
# time that grows with the square of its length.
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_DIGITS = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
# Wider forms: what may be an identifier if its context says so.
_MARK = re.compile(r"@|[\[({] ?at ?[\])}]", re.IGNORECASE)
_WIDE_DOMAIN = re.compile(r" ?[A-Za-z0-9-]+(?: ?(?:\.|[\[({] ?dot ?[\])}]) ?[A-Za-z0-9-]+)*", re.IGNORECASE)
_COLONS = re.compile(r"[0-9A-Fa-f]{0,4}(?::[0-9A-Fa-f]{0,4}){2,7}")
_HEX = frozenset("0123456789ABCDEFabcdef")
_NUMBER = re.compile(r"[0-9](?:[ ./()-]{0,2}[0-9])+")
_QUAD = re.compile(r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}\Z")
_WORDS = re.compile(r"[A-Za-z0-9\u0080-\U0010ffff]+")

# A context is the two or three words before a span, within so many code points.
WINDOW = 256
SLOTS = "array<struct<kinds:array<int>,start:long,end:long,value:long,base:boolean,two:long,three:long>>"
SCANNED = f"doc_id long, row long, n array<long>, base string, slots {SLOTS}"

# A context counts if so many different identifiers follow it; rounds of scores; the score from which
# an identifier is taken; occurrences that are added to a context's as if without identifier.
SUPPORT, ROUNDS, ACCEPT, DOUBT = 3, 4, 0.8, 1.0


def luhn(digits: str) -> bool:
    values = [int(d) for d in reversed(digits)]
    return sum(values[::2] + [sum(divmod(2 * d, 10)) for d in values[1::2]]) % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            end = found.end()
            yield start, end
        at = text.find("@", max(at + 1, end))


def _quads(text: str) -> Iterator[tuple[int, int]]:
    for run in _DOTTED.finditer(text):
        if run.group().count(".") < 3:
            continue
        parts, at = run.group().split("."), run.start()
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            end = at + sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in four):
                yield at, end
            at = end + 1


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the fixed forms, by kind and start; linear in the text's length."""
    out = [(EMAIL, a, b) for a, b in _emails(text)]
    out += [(IP, a, b) for a, b in _quads(text)]
    for m in _DIGITS.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m.group().replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append((CARD, m.start(), m.end()))
    if "+" in text:
        out += [(PHONE, m.start(), m.end()) for m in _PHONE.finditer(text) if 8 <= sum(c.isdigit() for c in m.group()) <= 15]
    return out


def wide_slots(text: str, taken: list[tuple[int, int, int]]) -> list[tuple[list[int], int, int]]:
    """(possible kinds, start, end) of wider forms; disjoint, clear of ``taken`` and of letters and digits beside."""
    found: list[tuple[list[int], int, int]] = []
    end = 0
    for mark in _MARK.finditer(text):
        close = mark.start() - (text[mark.start() - 1 : mark.start()] == " ")
        start = close
        while start > max(end, 0) and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        domain = _WIDE_DOMAIN.match(text, mark.end()) if start < close else None
        if domain:
            end = domain.end()
            found.append(([EMAIL], start, end))
    end, at = 0, text.find(":")
    while at >= 0:
        start = at
        while start > max(end, at - 4) and text[start - 1] in _HEX:
            start -= 1
        m = _COLONS.match(text, start)
        if m and m.end() - start - m.group().count(":") >= 4:
            found.append(([IP], start, m.end()))
        end = m.end() if m else at + 1
        at = text.find(":", max(at + 1, end))
    for m in _NUMBER.finditer(text):
        if m.end() - m.start() < 7:
            continue
        count = sum(c.isdigit() for c in m.group())
        kinds = ([IP] if _QUAD.match(m.group()) else []) + ([CARD] if 12 <= count <= 19 else []) + ([PHONE] if 7 <= count <= 15 else [])
        if kinds:
            start = m.start() - (text[m.start() - 1 : m.start()] in ("+", "("))
            found.append((kinds, start, m.end()))
    out, last = [], -1
    ends = sorted((a, b) for _, a, b in taken)
    k = 0
    for kinds, a, b in sorted(found, key=lambda x: (x[1], x[0])):
        while k < len(ends) and ends[k][1] <= a:
            k += 1
        free = k == len(ends) or ends[k][0] >= b
        if a >= last and free and not text[a - 1 : a].isalnum() and not text[b : b + 1].isalnum():
            out.append((kinds, a, b))
            last = b
    return out


def _value(kind: int, text: str) -> int:
    """Number of an identifier: letters and digits count, case and separators don't."""
    plain = re.sub(r"[\[({] ?(at|dot) ?[\])}]| ", lambda m: {"at": "@", "dot": "."}.get((m.group(1) or "").lower(), ""), text, flags=re.IGNORECASE)
    if kind == EMAIL:
        plain = plain.lower()
    elif kind != IP:
        plain = re.sub(r"[^0-9]", "", plain)
    return int.from_bytes(hashlib.blake2b(plain.encode(), digest_size=8).digest(), "big", signed=True)


def before(text: str, start: int) -> list[str]:
    """The last three words before ``start``, fewer if a word may be cut by the window."""
    left = max(0, start - WINDOW)
    words = [m.group() for m in _WORDS.finditer(text, left, start) if not (left and m.start() == left)]
    return words[-3:]


def _context_hashes(words: list[list[str]], width: int) -> list[int | None]:
    """For each list of words the hash of its last ``width`` ones, as the counts of contexts have it."""
    enough = [k for k, w in enumerate(words) if len(w) >= width]
    out: list[int | None] = [None] * len(words)
    for i, _, data, at in runs(pa.array([" ".join(words[k][-width:]) for k in enough], pa.large_string())):
        found = tokens(data, at, WORD)
        made, begin = shingles(hashes(found.sums, found.start, found.end), found.first, width)
        for k, value in zip(enough[i:], made[begin[:-1]].astype(np.int64).tolist()):
            out[k] = value
    return out


def _listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{a}:{b}" for kind, a, b in spans)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Base spans and wider slots of each text, with the words before them as hashes."""
    for whole in batches:
        for at in range(0, len(whole), 1000):
            batch = whole.slice(at, 1000)
            n, base, slots, near, slot_row = [], [], [], [], []
            for r, scalar in enumerate(batch.column(2)):
                text = scalar.as_py() or ""
                spans = base_spans(text)
                n.append([sum(s[0] == k for s in spans) for k in range(4)])
                base.append(_listed(spans))
                for kinds, a, b, known in [([k], a, b, True) for k, a, b in spans] + [(*s, False) for s in wide_slots(text, spans)]:
                    slots.append({"kinds": kinds, "start": a, "end": b, "value": _value(kinds[0], text[a:b]), "base": known})
                    near.append(before(text, a))
                    slot_row.append(r)
            for width, name in ((2, "two"), (3, "three")):
                for slot, value in zip(slots, _context_hashes(near, width)):
                    slot[name] = value
            by_row: list[list[dict]] = [[] for _ in n]
            for r, slot in zip(slot_row, slots):
                by_row[r].append(slot)
            slot_type = pa.list_(pa.struct([
                ("kinds", pa.list_(pa.int32())), ("start", pa.int64()), ("end", pa.int64()), ("value", pa.int64()), ("base", pa.bool_()),
                ("two", pa.int64()), ("three", pa.int64()),
            ]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(n, pa.list_(pa.int64())), pa.array(base, pa.string()), pa.array(by_row, slot_type)],
                ["doc_id", "row", "n", "base", "slots"],
            )


def _count_contexts(wanted):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filter_ = wanted.value
        for batch in batches:
            for _, _, data, at in runs(batch.column(0)):
                found = tokens(data, at, WORD)
                words = hashes(found.sums, found.start, found.end)
                for width in (2, 3):
                    made, count = np.unique(shingles(words, found.first, width)[0], return_counts=True)
                    held = filter_.has(mix(made))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(made[held].astype(np.int64)), pa.array(count[held].astype(np.int64))], ["context", "times"]
                    )

    return run


def _scores(edges: DataFrame, totals: DataFrame, support: int, rounds: int, doubt: float) -> DataFrame:
    """(kind, value, score) of the identifiers that are not of a base form.

    ``edges`` is the graph of contexts and identifiers: (kind, value, base, two, three, times). A
    context's confidence is the share of its occurrences in the corpus that known identifiers of
    the kind follow, each counted with its score; it has none before enough different ones with a
    score of a half do. An identifier's score is the chance that not all of its contexts are wrong.
    Each round sums up edges by context and by identifier, and is written.
    """
    known = edges.select("kind", "value").where("base").distinct().withColumn("score", F.lit(1.0))
    known = materialize(known, "pii-scores")
    unsure = edges.where("not base")
    fresh = known.limit(0)
    for _ in range(rounds):
        scored = edges.join(known.unionAll(fresh), ["kind", "value"])
        every = scored.select("kind", "value", "score", "times", F.explode(F.array("two", "three")).alias("context")).where("context is not null")
        every = every.groupBy("kind", "context", "value", "score").agg(F.sum("times").alias("times"))
        sums = every.groupBy("kind", "context").agg(
            F.sum(F.col("score") * F.col("times")).alias("held"), F.count_if(F.col("score") >= 0.5).alias("support")
        )
        sure = sums.where(F.col("support") >= support).join(totals, "context").select(
            "kind", "context", F.least(F.col("held") / (F.col("total") + doubt), F.lit(0.999)).alias("sure")
        )
        sure = materialize(sure, "pii-contexts")
        at = {w: sure.select("kind", F.col("context").alias(w), F.col("sure").alias(f"sure_{w}")) for w in ("two", "three")}
        led = unsure.join(at["two"], ["kind", "two"], "left").join(at["three"], ["kind", "three"], "left").select(
            "kind", "value", "two", F.greatest(F.coalesce("sure_two", F.lit(0.0)), F.coalesce("sure_three", F.lit(0.0))).alias("sure")
        )
        led = led.where("sure > 0").groupBy("kind", "value", "two").agg(F.max("sure").alias("sure"))
        fresh = led.groupBy("kind", "value").agg((1 - F.exp(F.sum(F.log1p(-F.col("sure"))))).alias("score"))
        fresh = materialize(fresh, "pii-scores")
        if fresh.isEmpty():
            break
    return fresh


def find(docs: DataFrame, support: int = SUPPORT, rounds: int = ROUNDS, accept: float = ACCEPT, doubt: float = DOUBT) -> DataFrame:
    """(doc_id, n, base, added) of every row of ``docs``: counts and list of the base spans, and the spans found by context.

    Base forms are seeds. The two or three words before a span are its context; those that enough
    different candidates follow are counted in the whole corpus by a second pass, which moves only
    contexts that a Bloom filter of at most 8 MB lets through. Contexts and identifiers are then
    scored in turn as a graph (``_scores``): contexts that nearly always lead to known identifiers make
    the wider forms behind them identifiers, which in turn speak for further contexts. Wherever an
    identifier so found occurs, its span is added; added spans never touch others.

    Uses doc_id and text by exact name, others are ignored. A null text is empty; rows may share an id
    or have none. An empty table gives no rows.
    """
    spark = docs.sparkSession
    source = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), F.col("text").cast("string").alias("text"))
    scanned = materialize(source.mapInArrow(_scan, SCANNED), "pii-scanned")
    slots = scanned.select("row", F.explode("slots").alias("s")).select("row", "s.*").withColumn("kind", F.explode("kinds")).drop("kinds")
    edges = slots.groupBy("kind", "value", "base", "two", "three").agg(F.count("*").alias("times"))
    edges = materialize(edges, "pii-edges")
    contexts = edges.select("kind", "value", F.explode(F.array("two", "three")).alias("context")).where("context is not null").distinct()
    contexts = contexts.groupBy("kind", "context").agg(F.count("*").alias("values")).where(F.col("values") >= support)
    contexts = materialize(contexts.select("context").distinct(), "pii-contexts")
    wanted = spark.sparkContext.broadcast(id_filter(contexts, max_bits=1 << 26))
    counted = source.select("text").mapInArrow(_count_contexts(wanted), "context long, times long")
    totals = counted.groupBy("context").agg(F.sum("times").alias("total")).join(contexts, "context", "left_semi")
    totals = materialize(totals, "pii-totals")
    scores = _scores(edges, totals, support, rounds, doubt).where(F.col("score") >= accept)
    # A candidate of several kinds is of the likeliest, the first of those equally likely.
    best = F.max_by("kind", F.struct("score", -F.col("kind")))
    named = slots.where("not base").join(scores, ["kind", "value"]).groupBy("row", "start", "end").agg(best.alias("kind"))
    added = named.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("kind", "start", "end"))).alias("added"))
    return scanned.select("doc_id", "row", "n", "base").join(added, "row", "left").select("doc_id", "n", "base", "added")


def pii_report(docs: DataFrame, **settings) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added) of every row; see ``find``.

    The counts and the digest are of the base spans, ``spans`` lists all, those found by context, too.
    """
    found = find(docs, **settings)
    names = F.array(*map(F.lit, KINDS))
    # Base spans are in order, so their list is parsed only where spans are added.
    parts = F.transform(F.filter(F.split("base", ","), lambda s: s != ""), lambda s: F.split(s, ":"))
    spans = F.transform(parts, lambda p: F.struct((F.array_position(names, p[0]) - 1).cast("int").alias("kind"), p[1].cast("long").alias("start"), p[2].cast("long").alias("end")))
    merged = F.array_sort(F.concat(spans, "added"))
    text = F.array_join(F.transform(merged, lambda s: F.concat_ws(":", names[s.kind], s.start.cast("string"), s.end.cast("string"))), ",")
    counts = [F.col("n")[k].alias(f"n_{kind}") for k, kind in enumerate(KINDS)]
    return found.select(
        "doc_id", *counts, F.sha2("base", 256).alias("base_sha256"), F.when(F.col("added").isNull(), F.col("base")).otherwise(text).alias("spans"),
        F.coalesce(F.size("added"), F.lit(0)).cast("long").alias("n_added"),
    )
